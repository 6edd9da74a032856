"""Scoring (D), parsers (E), gates and corrections (F), strategies (G) and recorded calls (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, prompts
from ..functions import text as T
from ..operators import gating, parsers, scoring, timeline
from ..plans import backends, strategies
from ..sources import views
from . import query
from .corpus import SWITCHES, pct
from .sql import PCT, rate, words_distance

#: Words that stand in for the Hindi markers on the test texts.
MARKERS, STRONG = ["thing", "other", "hati", "withre", "isnd", "erand"], ["ththth", "ingingth"]

NOISY = "list_transform(h.words, lambda w, i: CASE WHEN i % 5 = 0 THEN w || 'x' ELSE w END)"
TURN_PAIRS = f"""tp AS (SELECT t.sample_id, t.turn_idx, t.words AS r, {NOISY} AS h FROM turns t JOIN hyps h USING (sample_id, turn_idx) WHERE strategy = 'adaptive')"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis words turn by turn; every fifth hypothesis word is misspelled."""
    h = views.hypotheses(spark, sf_dir).where("strategy = 'adaptive'")
    noisy = F.transform("words", lambda w, i: F.when((i + 1) % 5 == 0, F.concat(w, F.lit("x"))).otherwise(w))
    h = h.select("sample_id", "turn_idx", noisy.alias("h"))
    return views.turns(spark, sf_dir).select("sample_id", "turn_idx", F.col("words").alias("r")).join(h, ["sample_id", "turn_idx"])


CODED = f""", {TURN_PAIRS}, tv AS (SELECT *, list_distinct(r || h) AS v FROM tp),
    tc AS (SELECT *, list_transform(r, lambda w: list_position(v, w)) AS rc, list_transform(h, lambda w: list_position(v, w)) AS hc FROM tv),
    td AS (SELECT sample_id, turn_idx, len(r) AS n, len(h) AS m, CASE WHEN len(r) = 0 OR len(h) = 0 THEN greatest(len(r), len(h)) ELSE {words_distance('rc', 'hc')} END AS d FROM tc)"""


@query(f"{CODED} SELECT sample_id, turn_idx, CAST(d AS INTEGER) AS distance FROM td")
def d01_word_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("sample_id", "turn_idx", distance.word_distance(F.col("r"), F.col("h")).alias("distance"))


@query(f"{CODED} SELECT sample_id, turn_idx, {rate('d', 'n', 'm')} AS wer FROM td")
def d02_turn_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("sample_id", "turn_idx", distance.wer(F.col("r"), F.col("h")).alias("wer"))


FOLD = "regexp_replace(array_to_string({}, ' '), '[^\\x00-\\x7F]', '?', 'g')"


@query(f", {TURN_PAIRS}, f AS (SELECT sample_id, turn_idx, {FOLD.format('r')} AS a, {FOLD.format('h')} AS b FROM tp) SELECT sample_id, turn_idx, {rate('levenshtein(a, b)', 'length(a)', 'length(b)')} AS cer FROM f")
def d03_turn_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (distance.fold_ascii(F.array_join(c, " ")) for c in ("r", "h"))
    return turn_pairs(spark, sf_dir).select("sample_id", "turn_idx", distance.cer(a, b).alias("cer"))


@query("""SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY turn_idx, i) - 1 AS INTEGER) AS pos, speaker, word
    FROM (SELECT sample_id, turn_idx, speaker, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM turns)""")
def d04_flat_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flat_words(views.turns(spark, sf_dir), ["sample_id"])


ALIGNED = "c AS (SELECT sample_id, strategy, ref_speaker, hyp_speaker, CAST(v AS BIGINT) AS n FROM aligned_cells)"


def same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hypotheses(spark, sf_dir).where("strategy in ('flips', 'labels')")


def cells(spark: SparkSession, sf_dir: str, hyp: DataFrame | None = None) -> DataFrame:
    return scoring.confusion(views.turns(spark, sf_dir), views.hypotheses(spark, sf_dir) if hyp is None else hyp, ["sample_id"], ["sample_id", "strategy"])


@query(f", {ALIGNED} SELECT sample_id, strategy, CAST(sum(n) AS BIGINT) AS aligned FROM c WHERE strategy IN ('flips', 'labels') GROUP BY ALL")
def d05_aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir, same_words(spark, sf_dir))
    return c.groupBy("sample_id", "strategy").agg(F.sum("n").alias("aligned"))


@query(f", {ALIGNED} SELECT sample_id, strategy, CAST(sum(n) AS BIGINT) AS aligned FROM c WHERE strategy IN ('baseline', 'adaptive') GROUP BY ALL")
def d05_aligned_words_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir, views.hypotheses(spark, sf_dir).where("strategy in ('baseline', 'adaptive')"))
    return c.groupBy("sample_id", "strategy").agg(F.sum("n").alias("aligned"))


@query(f", {ALIGNED} SELECT * FROM c")
def d06_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


@query("SELECT sample_id, strategy, CAST(best AS DOUBLE) AS matched FROM saa_best")
def d07_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring._matrix(cells(spark, sf_dir), ["sample_id", "strategy"], "ref_speaker", "hyp_speaker", "n")
    return scoring.assigned(m, ["sample_id", "strategy"], True).select("sample_id", "strategy", F.col("total").alias("matched"))


@query("SELECT sample_id, strategy, CAST(best AS DOUBLE) / total AS saa FROM saa_best")
def d08_speaker_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.speaker_accuracy(cells(spark, sf_dir), ["sample_id", "strategy"]).select("sample_id", "strategy", "saa")


@query("SELECT sample_id, speaker, string_agg(array_to_string(words, ' '), ' ' ORDER BY turn_idx) AS doc FROM turns WHERE len(words) > 0 GROUP BY ALL")
def d09_speaker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.speaker_documents(views.turns(spark, sf_dir), ["sample_id"]).where(F.size("doc") > 0)
    return d.select("sample_id", "speaker", F.array_join("doc", " ").alias("doc"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hypotheses(spark, sf_dir).where("strategy <> 'labels'")


COST_CELLS = """, rl AS (SELECT sample_id, list_sort(list(DISTINCT speaker)) AS rs FROM turns GROUP BY ALL), hl AS (SELECT sample_id, strategy, list_sort(list(DISTINCT speaker)) AS hs FROM hyps WHERE strategy <> 'labels' GROUP BY ALL),
    kk AS (SELECT *, unnest(range(greatest(len(rs), len(hs)))) AS i, greatest(len(rs), len(hs)) AS k FROM hl JOIN rl USING (sample_id)), ij AS (SELECT *, unnest(range(k)) AS j FROM kk)
    SELECT ij.sample_id, ij.strategy, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(coalesce(c.cost, len(r.doc), len(h.doc), 0) AS INTEGER) AS cost FROM ij
    LEFT JOIN ref_docs r ON r.sample_id = ij.sample_id AND r.speaker = rs[i + 1] LEFT JOIN hyp_docs h ON h.sample_id = ij.sample_id AND h.strategy = ij.strategy AND h.speaker = hs[j + 1]
    LEFT JOIN costs c ON c.sample_id = ij.sample_id AND c.strategy = ij.strategy AND c.ref_speaker = rs[i + 1] AND c.hyp_speaker = hs[j + 1]"""


@query(COST_CELLS)
def d10_cost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cost_cells(views.turns(spark, sf_dir), edited(spark, sf_dir), ["sample_id"], ["sample_id", "strategy"])


@query("SELECT sample_id, strategy, CAST(n + m - best AS BIGINT) AS cost FROM k1 JOIN cost_best USING (sample_id, strategy) WHERE strategy <> 'labels'")
def d11_least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cpwer(views.turns(spark, sf_dir), edited(spark, sf_dir), ["sample_id"], ["sample_id", "strategy"]).select("sample_id", "strategy", "cost")


@query("SELECT sample_id, cpwer, CAST(cpwer * n_words AS BIGINT) AS cost FROM scores JOIN (SELECT sample_id, n_words FROM samples) USING (sample_id) WHERE n_words > 0 AND strategy = 'labels'")
def d12_cpwer_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.hypotheses(spark, sf_dir).where("strategy = 'labels'")
    return scoring.cpwer(views.turns(spark, sf_dir), h, ["sample_id"], ["sample_id", "strategy"]).select("sample_id", "cpwer", "cost")


@query("SELECT sample_id, strategy, cpwer FROM scores JOIN k1 USING (sample_id, strategy) WHERE n > 0 AND m > 0")
def d12_cpwer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cpwer(views.turns(spark, sf_dir), views.hypotheses(spark, sf_dir), ["sample_id"], ["sample_id", "strategy"]).select("sample_id", "strategy", "cpwer")


@query("SELECT sample_id, strategy, greatest(0.0, cpwer - wer) AS gap FROM scores")
def d13_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scores(spark, sf_dir).select("sample_id", "strategy", scoring.degradation_gap(F.col("cpwer"), F.col("wer")).alias("gap"))


def texts(hyp: DataFrame) -> DataFrame:
    return hyp.select("sample_id", "strategy", "turn_idx", "speaker", F.array_join("words", " ").alias("text"))


@query("SELECT sample_id, strategy, wer, cer, saa, true AS format_valid FROM scores WHERE strategy IN ('flips', 'labels')")
def d14_evaluate_same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = texts(same_words(spark, sf_dir))
    e = scoring.evaluate(h.select("sample_id", "strategy").distinct(), views.raw_turns(spark, sf_dir), h)
    return e.select("sample_id", "strategy", "wer", "cer", "saa", "format_valid")


@query("SELECT sample_id, strategy, wer, cer, saa, cpwer, gap, true AS format_valid FROM scores")
def d14_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = texts(views.hypotheses(spark, sf_dir))
    return scoring.evaluate(h.select("sample_id", "strategy").distinct(), views.raw_turns(spark, sf_dir), h).drop("mapping")


# Replies of the adaptive strategy in each grammar; turns without words are not said.
SAID = """said AS (SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY turn_idx) - 1 AS INTEGER) AS turn_idx, speaker, array_to_string(words, ' ') AS text FROM hyps WHERE strategy = 'adaptive' AND len(words) > 0)"""


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.hypotheses(spark, sf_dir).where((F.col("strategy") == "adaptive") & (F.size("words") > 0))
    at = F.row_number().over(Window.partitionBy("sample_id").orderBy("turn_idx")) - 1
    return h.select("sample_id", at.alias("turn_idx"), "speaker", F.array_join("words", " ").alias("text"))


SHAPES = {
    "labelled": lambda: F.format_string("%s: %s", "speaker", "text"),
    "numbered": lambda: F.format_string("Turn %d: %s", F.col("turn_idx") + 1, "text"),
    "text_first": lambda: F.format_string("[Utterance] %s | [Speaker] %s", "text", "speaker"),
    "tri_field": lambda: F.format_string("[Utterance] %s | [Transition] SHIFT | [Speaker] %s", "text", "speaker"),
    "tagged": lambda: F.format_string("[Utterance] %s | [Transition] %s | [Speaker] %s", "text", F.when(F.col("turn_idx") % 2 == 0, "RESUME").otherwise("overlaps"), "speaker"),
}


def replies(spark: SparkSession, sf_dir: str, grammar: str, lead: str = "") -> DataFrame:
    """(sample_id, raw_response): the said turns written in a grammar."""
    t = said(spark, sf_dir)
    if grammar == "json":
        item = F.struct(F.col("text").alias("utterance"), F.lit("SPEAKER_FLOOR_SHIFT").alias("transition_type"), "speaker")
        rows = t.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", item.alias("i")))).alias("l"))
        return rows.select("sample_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("l.i").alias("dialogue"))), F.lit("\n```")).alias("raw_response"))
    rows = t.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", SHAPES[grammar]().alias("line")))).alias("l"))
    return rows.select("sample_id", F.concat(F.lit(lead), F.array_join("l.line", "\n")).alias("raw_response"))


ALL_SAID = f", {SAID} SELECT * FROM said"
PROFILE = "[Speaker Profiles]\n- Speaker 0: low voice\n- Speaker 1: high voice\n"


@query(ALL_SAID)
def e01_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "labelled"), "labelled").drop("tag")


@query(f", {SAID} SELECT sample_id, turn_idx, text FROM said")
def e02_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "numbered"), "numbered").drop("tag", "speaker")


@query(ALL_SAID)
def e03_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = replies(spark, sf_dir, "labelled").withColumn("raw_response", F.regexp_replace("raw_response", r"(?m)^(Speaker \d): ", "**$1**: "))
    return parsers.parse(marked, "labelled").drop("tag")


@query(ALL_SAID)
def e04_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "text_first"), "text_first").drop("tag")


@query(ALL_SAID)
def e05_tri_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "tri_field", PROFILE), "tri_field").drop("tag")


@query(f", {SAID} SELECT *, CASE WHEN turn_idx % 2 = 0 THEN 'RESUMES_AFTER_INTERRUPTION' ELSE 'SIMULTANEOUS_OVERLAP' END AS tag FROM said")
def e06_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "tagged", "```\n" + PROFILE), "tagged")


@query(ALL_SAID)
def e07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(replies(spark, sf_dir, "json"), "json").drop("tag")


@query(ALL_SAID)
def e08_broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = replies(spark, sf_dir, "json").withColumn("raw_response", F.regexp_replace("raw_response", r"\]\}\n```$", ""))
    return parsers.parse(cut, "json").drop("tag")


def mixed(spark: SparkSession, sf_dir: str, lines: list, first) -> DataFrame:
    """(sample_id, raw_response): said turns, each in the shape of ``lines`` that its place chooses, under an opening line."""
    t = said(spark, sf_dir)
    line = F.element_at(F.array(*lines), F.col("turn_idx") % len(lines) + 1)
    rows = t.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("line")))).alias("l"))
    return rows.select("sample_id", F.concat_ws("\n", first, F.array_join("l.line", "\n")).alias("raw_response"))


@query(f""", {SAID}, m AS (SELECT *, CAST(turn_idx // 4 * 3 + turn_idx % 4 AS INTEGER) AS g FROM said WHERE turn_idx % 4 < 3),
    j AS (SELECT m.sample_id, g, m.speaker, m.text || coalesce(' ' || n.text, '') AS text FROM m LEFT JOIN said n ON n.sample_id = m.sample_id AND n.turn_idx = m.turn_idx + 1 AND n.turn_idx % 4 = 3),
    o AS (SELECT DISTINCT sample_id, -1 AS g, CASE sample_id % 3 WHEN 0 THEN 'Dr Rao' ELSE 'Speaker 0' END AS speaker, CASE sample_id % 3 WHEN 0 THEN 'hello' ELSE 'no label stands here: yes' END AS text FROM said WHERE sample_id % 3 < 2)
    SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY g) - 1 AS INTEGER) AS turn_idx, speaker, text FROM (SELECT * FROM j UNION ALL BY NAME SELECT * FROM o)""")
def e01_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in three dresses, lines without one, and openings that name a speaker in two words or no one."""
    lines = [F.format_string("**%s:** %s", "speaker", "text"), F.format_string("- [%s]: %s", "speaker", "text"), F.format_string("# %s \u2013 %s", "speaker", "text"), F.col("text")]
    first = F.when(F.col("sample_id") % 3 == 0, "Dr Rao: hello").when(F.col("sample_id") % 3 == 1, "no label stands here: yes")
    return parsers.parse(mixed(spark, sf_dir, lines, first), "labelled").drop("tag")


@query(f""", {SAID}, m AS (SELECT *, CASE WHEN turn_idx % 5 IN (1, 4) THEN trim(regexp_replace(text, '^\\d+', '')) ELSE text END AS words FROM said),
    j AS (SELECT a.sample_id, a.turn_idx, a.speaker, a.words || coalesce(' ' || b.words, '') AS text FROM m a LEFT JOIN m b ON b.sample_id = a.sample_id AND b.turn_idx = a.turn_idx + 1 AND b.turn_idx % 5 = 4 WHERE a.turn_idx % 5 < 4)
    SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY turn_idx) - 1 AS INTEGER) AS turn_idx, speaker, CASE WHEN turn_idx = 0 THEN 'first words ' ELSE '' END || text AS text FROM j""")
def e04_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked lines, bare numbers, labels in front, an utterance cut from its label, loose lines; words before the first label."""
    number = F.regexp_extract("speaker", r"\d+", 0)
    lines = [
        F.format_string("[Utterance] %s | [Speaker] %s", "text", "speaker"), F.format_string("- %s | %s", "text", number), F.format_string("%s: %s", "speaker", "text"),
        F.format_string("**[Utterance]** %s\n | [Speaker]: %s", "text", number), F.col("text"),
    ]
    return parsers.parse(mixed(spark, sf_dir, lines, F.lit("first words")), "text_first").drop("tag")


@query(f""", {SAID} SELECT sample_id, turn_idx, CASE WHEN turn_idx % 3 = 2 THEN 'Speaker 0' ELSE speaker END AS speaker, text,
    CASE WHEN turn_idx % 3 = 0 THEN 'RESUMES_AFTER_INTERRUPTION' WHEN turn_idx % 3 = 2 THEN 'ODD_ONE' WHEN lag(CASE WHEN turn_idx % 3 = 2 THEN 'Speaker 0' ELSE speaker END) OVER (PARTITION BY sample_id ORDER BY turn_idx) = speaker THEN 'CONTINUES_SAME_SPEAKER' ELSE 'SPEAKER_FLOOR_SHIFT' END AS tag FROM said""")
def e06_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences, a preamble with a bar in it, short and unknown tags, bare numbers, and lines without a tag."""
    lines = [
        F.format_string("[Utterance] %s | [Transition] resumption | [Speaker] %s", "text", "speaker"), F.format_string("[Utterance] %s | %s", "text", F.regexp_extract("speaker", r"\d+", 0)),
        F.format_string("* [Utterance]: %s | odd_one | spk_0", "text"),
    ]
    first = F.lit("```text\n[Speaker Profiles]\n- Speaker 0: low | hoarse\nno words yet")
    return parsers.parse(mixed(spark, sf_dir, lines, first), "tagged")


FIXES = """fixes AS (SELECT a.sample_id, CAST(row_number() OVER (PARTITION BY a.sample_id ORDER BY a.turn_idx) - 1 AS INTEGER) AS pos, CAST(a.turn_idx + 1 AS VARCHAR) AS turn_id, t.label AS speaker
    FROM (SELECT * FROM hyps WHERE strategy = 'adaptive') a JOIN (SELECT *, CASE speaker WHEN 'user' THEN 'Speaker 0' WHEN 'assistant' THEN 'Speaker 1' ELSE 'Speaker 2' END AS label FROM turns) t USING (sample_id, turn_idx) WHERE t.label <> a.speaker)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, raw_json): the corrections that undo the adaptive strategy's misplaced turns."""
    a = views.hypotheses(spark, sf_dir).where("strategy = 'adaptive'").select("sample_id", "turn_idx", "speaker")
    t = views.turns(spark, sf_dir).select("sample_id", "turn_idx", views._mapped("speaker", views.LABEL).alias("right"))
    rows = a.join(t, ["sample_id", "turn_idx"])
    wrong = F.when(F.col("right") != F.col("speaker"), F.struct((F.col("turn_idx") + 1).alias("turn_id"), F.col("right").alias("speaker")))
    listed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(wrong)).alias("corrections"))
    return listed.select("sample_id", F.concat(F.lit("Here they are: "), F.to_json(F.struct("corrections")), F.lit(" done")).alias("raw_json"))


@query(f", {FIXES} SELECT * FROM fixes")
def e09_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.corrections(fixes(spark, sf_dir))


@query("SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN CAST(sample_id % 100 AS BIGINT) ELSE 70 END AS diarization FROM samples")
def e10_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def score(s):
        return s.map(lambda x: parsers.critique(x)["diarization_score"])

    good = F.format_string('```json\n{"diarization_score": %d, "transcription_score": 1, "format_score": 2}\n```', F.col("sample_id") % 100)
    return views.samples(spark, sf_dir).select("sample_id", score(F.when(F.col("sample_id") % 2 == 0, good).otherwise("no json")).alias("diarization"))


@query("SELECT sample_id, 'Speaker 0' || (sample_id % 10) AS speaker FROM samples")
def e11_canonical_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", T.canonical_speaker(F.format_string("spk_0%d (host)", F.col("sample_id") % 10)).alias("speaker"))


@query(f", {SAID} SELECT DISTINCT sample_id, trim('{PROFILE}', chr(10)) AS profiles FROM said")
def e12_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = replies(spark, sf_dir, "tagged", PROFILE)
    return r.select("sample_id", F.rtrim(parsers.profile_block(F.col("raw_response"))).alias("p")).select("sample_id", F.regexp_replace("p", r"\n$", "").alias("profiles"))


LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
DEBATE = f"""dt AS (SELECT sample_id, string_agg(text, ' ' ORDER BY turn_idx) AS x FROM said GROUP BY sample_id),
    db AS (SELECT sample_id, list_filter({LIST(MARKERS)}, lambda m: contains(x, m)) AS found, len(list_filter({LIST(STRONG)}, lambda m: contains(x, m))) > 0 AS strong FROM dt)"""


@query(f", {SAID}, {DEBATE} SELECT sample_id, strong OR len(found) >= 2 AS debate, array_to_string(found, ',') AS found FROM db")
def f01_debate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = said(spark, sf_dir).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("t")).select("sample_id", F.array_join("t.text", " ").alias("x"))
    is_debate, found = gating.debate(F.col("x"), MARKERS, STRONG)
    return t.select("sample_id", is_debate.alias("debate"), F.array_join(found, ",").alias("found"))


GATE = f"""{SAID}, {DEBATE}, gw AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY sample_id ORDER BY turn_idx) <> speaker THEN 1 ELSE 0 END AS sw FROM said),
    gf AS (SELECT sample_id, count(*) AS n, count(DISTINCT speaker) AS k, CAST(sum(sw) AS DOUBLE) / nullif(count(*) - 1, 0) AS a FROM gw GROUP BY sample_id),
    gate AS (SELECT s.sample_id, CASE WHEN coalesce(n, 0) <= 1 THEN 'too_few_turns' WHEN k < 2 AND n >= 4 THEN 'collapse' WHEN duration_ms >= 70000 THEN 'long' WHEN a >= 0.85 AND n >= 16 THEN 'ping_pong' WHEN strong OR len(found) >= 2 THEN 'debate' ELSE 'bypass' END AS reason
      FROM samples s LEFT JOIN gf USING (sample_id) LEFT JOIN db USING (sample_id))"""


def gate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", (F.col("duration_ms") / 1000).alias("duration_seconds"), "num_speakers")


@query(f", {GATE} SELECT sample_id, reason NOT IN ('too_few_turns', 'bypass') AS triggered, reason FROM gate")
def f02_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.gate(gate_samples(spark, sf_dir), said(spark, sf_dir), markers=MARKERS, strong=STRONG)


PROMPT = "'Dialogue:' || chr(10) || string_agg('[Turn ' || (turn_idx + 1) || '] ' || speaker || ' | [Transition] SPEAKER_FLOOR_SHIFT: ' || text, chr(10) ORDER BY turn_idx) || chr(10) || chr(10) || 'Corrections as JSON:'"


@query(f", {SAID} SELECT sample_id, {PROMPT} AS prompt FROM said GROUP BY sample_id")
def f03_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.stage2_prompt(said(spark, sf_dir).withColumn("tag", F.lit(None).cast("string")))


@query(f""", {SAID} SELECT sample_id, {PROMPT.replace("speaker ||", "'Speaker 0' ||")} || CASE WHEN count(*) >= 4 THEN chr(10) || chr(10) || 'Notice: every turn has the same speaker. Share the turns among ' ||
    CASE any_value(num_speakers) WHEN 1 THEN 'Speaker 0' WHEN 2 THEN 'Speaker 0, Speaker 1' ELSE 'Speaker 0, Speaker 1, Speaker 2' END || '.' ELSE '' END AS prompt FROM said JOIN samples USING (sample_id) GROUP BY sample_id""")
def f04_collapse_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = said(spark, sf_dir).withColumn("speaker", F.lit("Speaker 0")).withColumn("tag", F.lit(None).cast("string"))
    return gating.stage2_prompt(one, speakers=views.samples(spark, sf_dir).select("sample_id", "num_speakers"))


def adaptive_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hypotheses(spark, sf_dir).where("strategy = 'adaptive'").select("sample_id", "turn_idx", "speaker")


@query("SELECT sample_id, turn_idx, CASE speaker WHEN 'user' THEN 'Speaker 0' WHEN 'assistant' THEN 'Speaker 1' ELSE 'Speaker 2' END AS speaker FROM turns")
def f05_apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.apply_corrections(adaptive_turns(spark, sf_dir), parsers.corrections(fixes(spark, sf_dir)))


@query("SELECT sample_id, turn_idx, CASE WHEN turn_idx = 0 THEN 'Speaker 9' ELSE speaker END AS speaker FROM hyps WHERE strategy = 'adaptive'")
def f06_static_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).select("sample_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("0").alias("turn_id"), F.lit("Speaker 9").alias("speaker")), F.struct(F.lit(1).alias("pos"), F.lit("two").alias("turn_id"), F.lit("Speaker 8").alias("speaker")))).alias("c")).select("sample_id", "c.*")
    return gating.apply_corrections(adaptive_turns(spark, sf_dir), rows, static=True)


@query("SELECT sample_id, CAST(CASE WHEN sample_id % 5 = 0 THEN 4 WHEN sample_id % 3 = 0 THEN 3 WHEN sample_id % 2 = 0 THEN num_speakers ELSE 2 END AS INTEGER) AS n FROM samples")
def f07_speaker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample_id")
    return views.samples(spark, sf_dir).select("sample_id", gating.speaker_count(F.when(k % 5 == 0, 4), F.when(k % 3 == 0, 3).otherwise(0), F.when(k % 2 == 0, F.col("num_speakers"))).alias("n"))


#: The gate without words that mark a debate, as the strategies' own list has none of these texts.
GATED = GATE.replace("strong OR len(found) >= 2", "false")


@query(f""", {GATED} SELECT sample_id, CAST(CASE WHEN reason IN ('too_few_turns', 'bypass') OR sample_id % 3 = 0 THEN 1000 ELSE 1250 END AS BIGINT) AS latency_ms,
    reason NOT IN ('too_few_turns', 'bypass') AS triggered, CASE WHEN reason NOT IN ('too_few_turns', 'bypass') AND sample_id % 3 = 0 THEN 'no recorded reply' END AS error FROM gate WHERE sample_id IN (SELECT sample_id FROM said)""")
def f08_fallback_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive strategy where a third of the second calls have no reply: the first call's turns and time stay."""
    s = strategies.STRATEGIES["adaptive"]
    lost = recorded(spark, sf_dir, s).recorded.where("not (stage = 'stage2' and sample_id % 3 = 0)")
    _, info = strategies.run(s, gate_samples(spark, sf_dir).join(said(spark, sf_dir), "sample_id", "left_semi"), backends.Replay(lost))
    return info.select("sample_id", "latency_ms", "triggered", "error")


@query(f""", {SWITCHES} SELECT sample_id, CASE WHEN duration_ms > 210000 AND {PCT} >= 20 OR duration_ms > 300000 AND {PCT} >= 16 THEN 3 WHEN duration_ms < 70000 AND switches < 4 THEN 1 ELSE 2 END AS tier
    FROM samples JOIN sw USING (sample_id)""")
def f09_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).join(timeline.switches(views.turns(spark, sf_dir)).select("sample_id", "switches"), "sample_id")
    return s.select("sample_id", gating.route(F.col("duration_ms") / 1000, pct(), F.col("switches") >= 4).alias("tier"))


@query("""SELECT num_speakers, avg(gap) FILTER (strategy = 'adaptive') > 0.18 AS gap_violation, count(*) FILTER (strategy = 'adaptive' AND saa < 0.8) AS low_samples,
    avg(saa) FILTER (strategy = 'baseline') - avg(saa) FILTER (strategy = 'adaptive') > 0.04 AS deficit_violation FROM scores GROUP BY num_speakers""")
def f10_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.cutoff_violations(views.scores(spark, sf_dir), "num_speakers", "adaptive", "baseline")


WINDOWS = """wd AS (SELECT sample_id, CAST(unnest(range(0, CAST(greatest(0, ceil((duration_ms - 120000) / 105000.0)) AS BIGINT) + 1)) AS INTEGER) AS "window", duration_ms FROM samples)"""


@query(f', {WINDOWS} SELECT sample_id, "window", "window" * CAST(105000 AS BIGINT) AS from_ms, least("window" * CAST(105000 AS BIGINT) + 120000, duration_ms) AS to_ms FROM wd')
def f11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.windows(views.samples(spark, sf_dir))


@query(f""", {WINDOWS}, wt AS (SELECT w.sample_id, w."window", t.turn_idx, CASE WHEN w."window" % 2 = 0 THEN t.speaker ELSE 'x' || t.speaker END AS speaker
      FROM wd w JOIN turns t ON t.sample_id = w.sample_id AND t.start_ms < w."window" * 105000 + 120000 AND t.end_ms > w."window" * 105000)
    SELECT b.sample_id, b."window", a.speaker AS before, b.speaker AS after, count(*) AS n FROM wt a JOIN wt b ON a.sample_id = b.sample_id AND a.turn_idx = b.turn_idx AND b."window" = a."window" + 1 GROUP BY ALL""")
def f11_stitch_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.stitch(window_turns(spark, sf_dir))


def window_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every window they reach into; odd windows call the speakers by other names."""
    w = gating.windows(views.samples(spark, sf_dir)).select(F.col("sample_id").alias("s"), "window", "from_ms")
    t = views.turns(spark, sf_dir)
    inside = (F.col("s") == t.sample_id) & (t.start_ms < F.col("from_ms") + 120_000) & (t.end_ms > F.col("from_ms"))
    return t.join(w, inside).select("sample_id", "window", "turn_idx", F.when(F.col("window") % 2 == 0, F.col("speaker")).otherwise(F.concat(F.lit("x"), "speaker")).alias("speaker"))


#: Short windows, so that samples have many; the labels A, B and C change hands in every window.
CLASHING = """wd AS (SELECT sample_id, unnest(range(0, CAST(greatest(0, ceil((duration_ms - 40000) / 30000.0)) AS BIGINT) + 1)) AS k FROM samples),
    wt AS (SELECT w.sample_id, k, turn_idx, speaker, chr(CAST(65 + (CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END + k) % 3 AS INTEGER)) AS label
      FROM wd w JOIN turns t ON t.sample_id = w.sample_id AND t.start_ms < k * 30000 + 40000 AND t.end_ms > k * 30000)"""


def clashing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every window they reach into, under labels that stand for another speaker in each window."""
    w = gating.windows(views.samples(spark, sf_dir), 40_000, 10_000).select(F.col("sample_id").alias("s"), "window", "from_ms")
    t = views.turns(spark, sf_dir)
    inside = (F.col("s") == t.sample_id) & (t.start_ms < F.col("from_ms") + 40_000) & (t.end_ms > F.col("from_ms"))
    place = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2)
    return t.join(w, inside).select("sample_id", "window", "turn_idx", F.get(F.array(*map(F.lit, "ABC")), (place + F.col("window")) % 3).alias("speaker"))


@query(f""", {CLASHING},
    linked AS (SELECT DISTINCT b.sample_id, b.k, b.speaker, true AS goes_on FROM wt a JOIN wt b ON a.sample_id = b.sample_id AND a.turn_idx = b.turn_idx AND b.k = a.k + 1),
    named AS (SELECT sample_id, k, speaker, label, max(CASE WHEN goes_on IS NULL THEN k END) OVER (PARTITION BY sample_id, speaker ORDER BY k) AS since
              FROM (SELECT DISTINCT sample_id, k, speaker, label FROM wt) LEFT JOIN linked USING (sample_id, k, speaker)),
    called AS (SELECT n.sample_id, n.k, n.speaker, f.label || CASE WHEN n.since = 0 THEN '' ELSE '@' || n.since END AS name FROM named n JOIN named f ON f.sample_id = n.sample_id AND f.speaker = n.speaker AND f.k = n.since)
    SELECT sample_id, CAST(k AS INTEGER) AS "window", turn_idx, name AS speaker FROM wt JOIN called USING (sample_id, k, speaker)""")
def f11_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.renamed(clashing_turns(spark, sf_dir))


@query("SELECT h.sample_id, h.strategy, sum(len(h.words)) > 2.5 * sum(t.n_words) AS runaway FROM hyps h JOIN turns t USING (sample_id, turn_idx) GROUP BY ALL")
def f12_runaway(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.hypotheses(spark, sf_dir).join(views.turns(spark, sf_dir).select("sample_id", "turn_idx", "n_words"), ["sample_id", "turn_idx"])
    s = h.groupBy("sample_id", "strategy").agg(F.sum(F.size("words")).alias("m"), F.sum("n_words").alias("n"))
    return s.select("sample_id", "strategy", gating.runaway(F.col("m"), F.col("n"), 2.5).alias("runaway"))


def recorded(spark: SparkSession, sf_dir: str, strategy: strategies.Strategy) -> backends.Replay:
    """Replies of both stages, as a recording would hold them."""
    one = replies(spark, sf_dir, strategy.first).select("sample_id", F.lit("stage1").alias("stage"), "raw_response", F.lit(1000).cast("long").alias("latency_ms"))
    if strategy.second == "text":
        two = replies(spark, sf_dir, strategy.first)
    else:
        two = fixes(spark, sf_dir).withColumnRenamed("raw_json", "raw_response")
    return backends.Replay(one.unionByName(two.select("sample_id", F.lit("stage2").alias("stage"), "raw_response", F.lit(250).cast("long").alias("latency_ms"))))


def played(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    s = strategies.STRATEGIES[name]
    turns, _ = strategies.run(s, gate_samples(spark, sf_dir), recorded(spark, sf_dir, s))
    return turns.select("sample_id", "turn_idx", "speaker", "text")


LISTING = "CASE n WHEN 1 THEN 'Speaker 0' WHEN 2 THEN 'Speaker 0, Speaker 1' WHEN 3 THEN 'Speaker 0, Speaker 1, Speaker 2' ELSE 'Speaker 0, Speaker 1, Speaker 2, Speaker 3' END"


def _grammar(s: strategies.Strategy) -> str:
    return "tri_field" if s.first == "tagged" else s.first


#: Every strategy's own advice and format, written out for SQL.
TEXTS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in (s.name, prompts.FORMATS[_grammar(s)], prompts.ADVICE[s.name])) + "')" for s in strategies.STRATEGIES.values())


@query(f""" SELECT sample_id, strategy, 'Transcribe the conversation word by word. ' ||
      CASE WHEN n = 2 THEN 'Two people talk: Speaker 0 speaks first, Speaker 1 answers.' ELSE n || ' people talk: ' || {LISTING} || '.' END || ' ' || format || ' ' || advice AS prompt,
      CASE WHEN strategy = 'structured_json' THEN n END AS labels
    FROM (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN CASE WHEN sample_id % 2 = 0 THEN 4 ELSE 2 END ELSE num_speakers END AS n FROM samples) CROSS JOIN (VALUES {TEXTS}) t(strategy, format, advice)""")
def g00_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of every strategy. A third of the samples state no count; half of these have a reference to count."""
    k = F.col("sample_id")
    s = gate_samples(spark, sf_dir).withColumn("num_speakers", F.when(k % 3 == 0, 0).otherwise(F.col("num_speakers"))).withColumn("ref_speakers", F.when(k % 2 == 0, 4).otherwise(0))
    labels = lambda c: F.size(F.from_json(F.get_json_object(c, "$.properties.dialogue.items.properties.speaker.enum"), "array<string>"))
    out = None
    for x in strategies.STRATEGIES.values():
        asked = strategies.requests(x, s)
        one = asked.select("sample_id", F.lit(x.name).alias("strategy"), "prompt", (labels("response_schema") if x.schema else F.lit(None).cast("int")).alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out


@query(ALL_SAID)
def g01_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "single_step")


@query(ALL_SAID)
def g02_anchor_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "anchor_prompt")


@query(ALL_SAID)
def g03_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "two_step")


@query(ALL_SAID)
def g04_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "text_first")


@query(ALL_SAID)
def g05_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "two_pass")


@query(ALL_SAID)
def g06_advanced_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "advanced_text_first")


@query(ALL_SAID)
def g07_structured_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "structured_json")


@query(ALL_SAID)
def g08_tri_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "tri_field")


CORRECTED = f"""{SAID}, {FIXES}, many AS (SELECT sample_id, count(*) AS n FROM said GROUP BY sample_id)"""


@query(f""", {CORRECTED} SELECT s.sample_id, s.turn_idx, CASE WHEN n > 1 THEN coalesce(f.speaker, s.speaker) ELSE s.speaker END AS speaker, text FROM said s JOIN many USING (sample_id)
    LEFT JOIN fixes f ON f.sample_id = s.sample_id AND f.turn_id = CAST(s.turn_idx + 1 AS VARCHAR)""")
def g09_multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "multi_stage")


@query(f""", {GATE.replace("strong OR len(found) >= 2", "false")}, {FIXES} SELECT s.sample_id, s.turn_idx, CASE WHEN reason NOT IN ('too_few_turns', 'bypass') THEN coalesce(f.speaker, s.speaker) ELSE s.speaker END AS speaker, text FROM said s JOIN gate USING (sample_id)
    LEFT JOIN fixes f ON f.sample_id = s.sample_id AND f.turn_id = CAST(s.turn_idx + 1 AS VARCHAR)""")
def g10_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(spark, sf_dir, "adaptive")


@query(f""", {GATED} SELECT sample_id, CAST(CASE WHEN sample_id NOT IN (SELECT sample_id FROM said) THEN 0 WHEN reason IN ('too_few_turns', 'bypass') THEN 1000 ELSE 1250 END AS BIGINT) AS latency_ms, reason NOT IN ('too_few_turns', 'bypass') AS triggered, reason FROM gate""")
def g10_adaptive_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies.STRATEGIES["adaptive"]
    return strategies.run(s, gate_samples(spark, sf_dir), recorded(spark, sf_dir, s))[1].drop("error")


@query(f", {SAID} SELECT sample_id, count(*) > 0 AS found FROM said GROUP BY sample_id")
def k01_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies.STRATEGIES["single_step"]
    requests = said(spark, sf_dir).select("sample_id").distinct().withColumn("prompt", prompts.instructions(F.lit(2), "labelled"))
    return recorded(spark, sf_dir, s)(requests, "stage1").select("sample_id", F.col("error").isNull().alias("found"))


class Refused(Exception):
    """An error with a code, as a client library raises it."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def unreliable(prompt: str, n: int) -> tuple[str, float]:
    """A model that refuses some calls at the first try and some always, by the prompt's length."""
    if len(prompt) % 5 == 0:
        raise Refused(400, "bad request")
    if len(prompt) % 5 == 1 and n % 2:
        raise Refused(503, "busy")
    if len(prompt) % 5 == 2 and n % 2:
        raise TimeoutError("slow")
    return f"said {len(prompt)}", 0.25


CALLED = """SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE 'said ' || length(text) END AS raw_response,
    CAST(CASE WHEN length(text) % 5 = 0 OR text IS NULL THEN NULL ELSE 250 END AS BIGINT) AS latency_ms, CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 5 = 0 THEN 'Refused: bad request' END AS error
    FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text FROM conversations)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a prompt; every fourth turn has none."""
    c = views.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("text")).alias("prompt"), F.length("text").alias("seconds"))


@query(CALLED)
def k02_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backends.Calls(unreliable, at_once=6)(asked(spark, sf_dir), "stage1").select("conv_id", "turn", "raw_response", "latency_ms", "error")


@query(CALLED)
def m01_calls_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls from partitions of equal cost, the longest first."""
    calls = backends.Calls(unreliable, at_once=6, cost="seconds", by=("conv_id", "turn"), parts=8)
    return calls(asked(spark, sf_dir), "stage1").select("conv_id", "turn", "raw_response", "latency_ms", "error")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'click' THEN event_id % 1000 IN (429, 500, 502, 503, 504) OR event_id % 7 = 0 ELSE false END AS retry FROM events""")
def k03_retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "client").otherwise("other")
    message = F.when(F.col("event_id") % 7 == 0, "Model OVERLOADED, wait").otherwise("bad request")
    return e.select("event_id", backends.is_retryable(kind, F.col("event_id") % 1000, message).alias("retry"))


@query("SELECT event_id, CAST(event_id % 9 + 1 AS INTEGER) AS attempt, CAST(least(2.0 * 2 ** (event_id % 9), 60.0) AS DOUBLE) AS most FROM events")
def k04_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9 + 1).cast("int").alias("attempt"))
    return e.select("event_id", "attempt", backends.longest_wait(F.col("attempt")).alias("most"))
