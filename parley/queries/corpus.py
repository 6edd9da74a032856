"""Scans, sinks and result sets (A), timelines and slices (B), normalization (C)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import results, rollups, scoring, timeline
from ..schemas import SAMPLE
from ..sources import files, views
from ..sources.scratch import scratch
from . import query
from .sql import BUCKET, PCT, TIER, norm, sweep

LISTED = [34, 3, 21, 3, 55, 1_000_000, 8]
PATTERN = r"(?i)\b(thing|other|with)\b"


def pct():
    return timeline.overlap_ratio(F.col("overlap_ms"), F.col("duration_ms"))


def pct_expr(df: DataFrame) -> DataFrame:
    return df.withColumn("overlap_pct", pct())


@query("SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars FROM conversations")
def a01_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_corpus(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@query(f"SELECT sample_id, duration_ms FROM samples WHERE sample_id IN ({', '.join(map(str, LISTED))})")
def a02_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).where(F.col("sample_id").isin(LISTED)).select("sample_id", "duration_ms")


@query("SELECT sample_id, num_turns FROM samples WHERE num_speakers = 2")
def a03_equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).where("num_speakers = 2").select("sample_id", "num_turns")


@query("SELECT sample_id, num_turns FROM samples WHERE num_speakers >= 3")
def a04_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).where("num_speakers >= 3").select("sample_id", "num_turns")


@query(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{PATTERN}') ORDER BY conv_id, turn LIMIT 15")
def a05_regex_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "conversations").where(F.coalesce(F.col("text").rlike(PATTERN), F.lit(False)))
    return rows.orderBy("conv_id", "turn").limit(15).select("conv_id", "turn")


@query("SELECT range AS sample_id FROM range(0, (SELECT max(conv_id) + 25 FROM conversations)) WHERE range NOT IN (SELECT conv_id FROM conversations)")
def a06_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.samples(spark, sf_dir)
    expected = found.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("sample_id") + 24)).alias("sample_id"))
    return results.missing(expected, found)


@query(f"SELECT sample_id, duration_ms, CAST(list_position([{', '.join(map(str, dict.fromkeys(LISTED)))}], sample_id) - 1 AS INTEGER) AS pos FROM samples WHERE sample_id IN ({', '.join(map(str, LISTED))})")
def a07_ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.listed(views.samples(spark, sf_dir), LISTED).select("sample_id", "duration_ms", "pos").orderBy("pos")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a metadata file has them; some overlaps and paths are missing."""
    s = pct_expr(views.samples(spark, sf_dir))
    nested = timeline.nested_turns(views.turns(spark, sf_dir)).withColumnRenamed("turns", "ground_truth_turns")
    made = s.join(nested, "sample_id").select(
        F.col("sample_id").cast("string").alias("sample_id"), (F.col("duration_ms") / 1000).alias("duration_seconds"), "num_speakers",
        F.when(F.col("sample_id") % 4 != 0, F.col("overlap_pct")).alias("overlap_ratio"), F.when(F.col("sample_id") % 3 == 0, F.format_string("clips/%d.wav", "sample_id")).alias("audio_file"),
        "ground_truth_turns",
    )
    return made.select(*[F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SAMPLE.fields])


@query(f"""SELECT CAST(sample_id AS VARCHAR) AS sample_id, duration_ms / 1000 AS duration_seconds, num_speakers,
    CASE WHEN sample_id % 4 <> 0 THEN {PCT} ELSE 0.0 END AS overlap_ratio,
    CASE WHEN sample_id % 3 = 0 THEN 'clips/' || sample_id || '.wav' ELSE 'audio/' || sample_id || '.wav' END AS audio_path, num_turns FROM samples""")
def a08_load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metadata")
    files.write_records(metadata(spark, sf_dir), path)
    got = files.read_samples(spark, path, multi_line=False)
    return got.select("sample_id", "duration_seconds", "num_speakers", "overlap_ratio", "audio_path", F.size("ground_truth_turns").alias("num_turns"))


@query("""SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'given/' || sample_id || '.wav' WHEN sample_id % 3 = 1 THEN 'file' || sample_id || '.wav'
    ELSE 'audio/' || sample_id || '.wav' END AS path FROM samples""")
def a09_audio_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample_id") % 3
    given = F.when(k == 0, F.format_string("given/%d.wav", "sample_id")).otherwise("")
    file = F.when(k == 1, F.format_string("file%d.wav", "sample_id"))
    return views.samples(spark, sf_dir).select("sample_id", results.audio_path(given, file, F.col("sample_id")).alias("path"))


@query("SELECT sample_id, duration_ms, num_turns FROM samples WHERE sample_id = 7")
def a10_get_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).select("sample_id", "duration_ms", "num_turns")
    return spark.createDataFrame([results.get(s, 7)], s.schema)


@query("SELECT sample_id, turn_idx, 1 AS channels, 16000 AS rate, 16 AS bits, CAST(n_words * 10 AS BIGINT) AS frames, true AS ok FROM turns")
def a11_wav_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    def clips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(audio=[files.wav_bytes(struct.pack("<h", 0) * int(n) * 10) for n in pdf.n_words])

    rows = views.turns(spark, sf_dir).select("sample_id", "turn_idx", "n_words").mapInPandas(clips, "sample_id long, turn_idx int, n_words int, audio binary")
    return rows.withColumn("h", files.check_wav("audio")).select("sample_id", "turn_idx", "h.*")


@query("SELECT sample_id, strategy, wer, latency_ms FROM scores")
def a12_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    own = views.scores(spark, sf_dir).select("sample_id", "strategy", "wer", "latency_ms")
    files.write_records(own, path)
    return spark.read.schema(own.schema).json(path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive predictions; every tenth sample has none."""
    h = views.hypotheses(spark, sf_dir).where("strategy = 'adaptive'")
    turn = F.struct("turn_idx", "speaker", F.array_join("words", " ").alias("text"))
    rows = h.groupBy("sample_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.withColumn("predicted_turns", F.when(F.col("sample_id") % 10 == 0, F.slice("t", 1, 0)).otherwise(F.col("t"))).drop("t")


@query("SELECT sample_id, num_turns FROM samples WHERE sample_id % 10 <> 0")
def a13_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.valid(records(spark, sf_dir)).select("sample_id", F.size("predicted_turns").alias("num_turns"))


@query("""SELECT coalesce(n.sample_id, o.sample_id) AS sample_id, coalesce(n.saa, o.saa) AS saa, CAST(o.sample_id IS NULL AS INTEGER) AS is_new, coalesce(o.sample_id, n.sample_id) AS pos
    FROM (SELECT * FROM scores WHERE strategy = 'adaptive' AND sample_id % 3 <> 0) o
    FULL JOIN (SELECT * FROM scores WHERE strategy = 'flips' AND sample_id % 4 = 0) n USING (sample_id)""")
def a14_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).withColumn("pos", F.col("sample_id"))
    side = lambda name, rule: s.where(F.col("strategy") == name).where(rule).select("sample_id", "saa", "pos")
    return results.upsert(side("adaptive", "sample_id % 3 <> 0"), side("flips", "sample_id % 4 = 0"))


MERGED = """m AS (SELECT sample_id, saa, CASE strategy WHEN 'adaptive' THEN 0 WHEN 'flips' THEN 1 ELSE 2 END AS p,
      CASE strategy WHEN 'adaptive' THEN 'hard' WHEN 'flips' THEN 'saved' ELSE 'base' END AS source FROM scores
      WHERE strategy = 'adaptive' AND sample_id % 5 = 0 OR strategy = 'flips' AND sample_id % 3 = 0 OR strategy = 'baseline' AND sample_id % 7 = 0 AND num_speakers = 2)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    part = lambda name, rule: s.where((F.col("strategy") == name) & F.expr(rule)).select("sample_id", "saa")
    return results.coalesce_sets([("hard", part("adaptive", "sample_id % 5 = 0")), ("saved", part("flips", "sample_id % 3 = 0")), ("base", part("baseline", "sample_id % 7 = 0 and num_speakers = 2"))])


@query(f", {MERGED} SELECT sample_id, saa, source FROM m QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY p) = 1")
def a15_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("sample_id", "saa", "source")


@query(f", {MERGED} SELECT sample_id FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM m)")
def a15_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.to_do(views.samples(spark, sf_dir), merged(spark, sf_dir)).select("sample_id")


@query("SELECT sample_id, num_turns, n_words FROM samples WHERE sample_id % 4 <> 1")
def a16_tolerant_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth record is broken, in one of three ways; a path that isn't there adds nothing."""
    own = views.samples(spark, sf_dir).select("sample_id", "num_turns", "n_words")
    whole = F.to_json(F.struct(*own.columns))
    broken = F.element_at(F.array(F.expr("substring(j, 1, length(j) - 1)"), F.lit("not JSON at all"), F.concat(F.lit("]"), F.col("j"))), (F.expr("sample_id div 4") % 3 + 1).cast("int"))
    path = scratch(spark, "broken")
    own.withColumn("j", whole).select(F.when(F.col("sample_id") % 4 == 1, broken).otherwise(F.col("j")).alias("value")).write.text(path)
    found = results.tolerant(spark, path, own.schema, multi_line=False)
    return found.unionByName(results.tolerant(spark, f"{path}-not-there", own.schema))


@query("SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'out/run_' || sample_id || '_partial.json' ELSE 'out/run_' || sample_id || '.json' END AS path FROM samples")
def a17_partial_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("out/run_%d.json", "sample_id")
    return views.samples(spark, sf_dir).select("sample_id", results.partial_name(path, F.col("sample_id") % 2 == 0).alias("path"))


@query("""SELECT strategy, metric, round(value, 6) AS value FROM (
    SELECT strategy, CAST(count(*) AS DOUBLE) AS n, avg(wer) AS mean_wer, avg(saa) AS mean_saa FROM scores GROUP BY strategy)
    UNPIVOT (value FOR metric IN (n, mean_wer, mean_saa))""")
def a18_long_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rollups.macro_summary(views.scores(spark, sf_dir)).select("strategy", "n", "mean_wer", "mean_saa")
    return rollups.long_form(m, ["strategy"]).withColumn("value", F.round("value", 6))


@query("SELECT strategy, '| ' || strategy || ' | ' || count(*) || ' | ' || printf('%.4f', avg(saa)) || ' |' AS line FROM scores GROUP BY strategy")
def a19_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rollups.macro_summary(views.scores(spark, sf_dir))
    return m.select("strategy", F.format_string("| %s | %d | %.4f |", "strategy", "n", "mean_saa").alias("line"))


@query("SELECT DISTINCT strategy, 'm_1.5_' || strategy AS slug FROM scores")
def a20_model_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.hypotheses(spark, sf_dir).select("strategy").distinct()
    return s.select("strategy", T.model_slug(F.concat(F.lit("vendor/m-1.5-"), "strategy")).alias("slug"))


@query(f", {sweep('segs')} SELECT sample_id, overlap FROM ov")
def b01_segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlap_duration(views.segments(spark, sf_dir))


@query(f", {sweep('turns')} SELECT sample_id, overlap FROM ov")
def b01_turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlap_duration(views.turns(spark, sf_dir))


@query(f", {sweep('turns')} SELECT sample_id, CASE WHEN duration_ms > 0 THEN 100.0 * overlap / duration_ms ELSE 0.0 END AS raw_ratio, CASE WHEN duration_ms // 1000 > 0 THEN 100.0 * overlap / (duration_ms // 1000 * 1000) ELSE 0.0 END AS whole_ratio FROM ov JOIN samples USING (sample_id)")
def b02_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = timeline.overlap_duration(views.turns(spark, sf_dir)).join(views.samples(spark, sf_dir), "sample_id")
    whole = F.expr("duration_ms div 1000") * 1000
    return o.select("sample_id", timeline.overlap_ratio(F.col("overlap"), F.col("duration_ms")).alias("raw_ratio"), timeline.overlap_ratio(F.col("overlap"), whole).alias("whole_ratio"))


SWITCHES = """w AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY sample_id ORDER BY turn_idx) <> speaker THEN 1 ELSE 0 END AS sw FROM turns),
    sw AS (SELECT sample_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(DISTINCT speaker) AS INTEGER) AS n_speakers, CAST(sum(sw) AS INTEGER) AS switches FROM w GROUP BY sample_id)"""


@query(f", {SWITCHES} SELECT sample_id, switches FROM sw")
def b03_turn_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.switches(views.turns(spark, sf_dir)).select("sample_id", "switches")


@query("SELECT sample_id, pos, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY start_ms, pos) - 1 AS INTEGER) AS rank FROM segs")
def b04_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.chronological(views.segments(spark, sf_dir)).select("sample_id", "pos", "rank")


@query(f", {SWITCHES} SELECT sample_id, CASE WHEN n_turns > 1 THEN CAST(switches AS DOUBLE) / (n_turns - 1) ELSE 0.0 END AS alternation FROM sw")
def b05_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.switches(views.turns(spark, sf_dir)).select("sample_id", "alternation")


@query("SELECT user_id AS sample_id, count(DISTINCT event_type) < 2 AND count(*) >= 4 AS collapsed FROM events GROUP BY user_id")
def b06_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.segments(spark, sf_dir)
    return timeline.switches(s, order="start_ms").select("sample_id", "collapsed")


@query("SELECT sample_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_idx) AS dialogue FROM turns WHERE text <> '' GROUP BY sample_id")
def b07_dialogue_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.dialogue(views.raw_turns(spark, sf_dir))


@query("SELECT sample_id, string_agg(speaker || ': ' || array_to_string(words, ' '), chr(10) ORDER BY turn_idx) AS dialogue FROM turns WHERE len(words) > 0 GROUP BY sample_id")
def b07_dialogue_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.dialogue(T.normalize_turns(views.raw_turns(spark, sf_dir)))


@query("SELECT sample_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS labels FROM turns GROUP BY sample_id")
def b08_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.labels(views.turns(spark, sf_dir)).select("sample_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT sample_id, CAST(count(*) AS INTEGER) AS n, min(start_ms) / 1000 AS first_start, max(end_ms) / 1000 AS last_end, string_agg(speaker, '>' ORDER BY turn_idx) AS who FROM turns GROUP BY sample_id")
def b09_nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = timeline.nested_turns(views.turns(spark, sf_dir))
    return n.select("sample_id", F.size("turns").alias("n"), F.array_min("turns.start_time").alias("first_start"), F.array_max("turns.end_time").alias("last_end"), F.array_join("turns.speaker", ">").alias("who"))


@query(f"""SELECT count(*) AS n, round(sum(duration_ms) / 1000, 6) AS total_duration, round(avg(duration_ms) / 1000, 6) AS mean_duration, round(avg({PCT}), 6) AS mean_overlap,
    (SELECT string_agg(k || '=' || c, ',' ORDER BY k) FROM (SELECT CAST(num_speakers AS VARCHAR) AS k, count(*) AS c FROM samples GROUP BY 1)) AS by_speakers,
    (SELECT string_agg(k || '=' || c, ',' ORDER BY k) FROM (SELECT CASE WHEN num_turns > 5 THEN 'long' ELSE 'short' END AS k, count(*) AS c FROM samples WHERE num_turns <> 2 GROUP BY 1)) AS by_condition FROM samples""")
def b10_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("overlap_ratio", pct()).withColumn("duration", F.col("duration_ms"))
    s = s.withColumn("condition", F.when(F.col("num_turns") == 2, "").when(F.col("num_turns") > 5, "long").otherwise("short"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    one = timeline.summary_stats(s)
    return one.select("n", F.round(F.col("total_duration") / 1000, 6).alias("total_duration"), F.round(F.col("mean_duration") / 1000, 6).alias("mean_duration"), F.round("mean_overlap", 6).alias("mean_overlap"), text("num_speakers").alias("by_speakers"), text("condition").alias("by_condition"))


@query(f"SELECT sample_id, {BUCKET} AS bucket FROM samples")
def b11_duration_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", timeline.duration_bucket(F.col("duration_ms") / 1000).alias("bucket"))


@query(f"SELECT sample_id, {TIER} AS tier FROM samples")
def b12_conflict_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", timeline.conflict_tier(pct()).alias("tier"))


@query(f"SELECT sample_id, CASE WHEN {PCT} < 5 THEN 'low' WHEN {PCT} <= 12 THEN 'moderate' ELSE 'high' END AS slice FROM samples")
def b13_overlap_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", timeline.overlap_slice(pct()).alias("slice"))


@query(f"SELECT {BUCKET} AS bucket, {TIER} AS tier, count(*) AS n, round(avg(saa), 6) AS saa FROM scores WHERE strategy = 'adaptive' GROUP BY CUBE (1, 2)")
def b14_bucket_tier_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).where("strategy = 'adaptive'")
    s = s.withColumn("bucket", timeline.duration_bucket(F.col("duration_ms") / 1000)).withColumn("tier", timeline.conflict_tier(pct()))
    return s.cube("bucket", "tier").agg(F.count("*").alias("n"), F.round(F.avg("saa"), 6).alias("saa"))


@query(f""", {SWITCHES} SELECT round(1 - avg(a), 6) AS consecutive_share, round(avg(CASE WHEN a = 1 THEN 1.0 ELSE 0.0 END), 6) AS strict_share, count(*) AS n
    FROM (SELECT CASE WHEN n_turns > 1 THEN CAST(switches AS DOUBLE) / (n_turns - 1) ELSE 0.0 END AS a FROM sw)""")
def b15_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = timeline.switches(views.turns(spark, sf_dir))
    return a.agg(F.round(1 - F.avg("alternation"), 6).alias("consecutive_share"), F.round(F.avg(F.when(F.col("alternation") == 1, 1.0).otherwise(0.0)), 6).alias("strict_share"), F.count("*").alias("n"))


#: In every third pair of turns the second one is taken into the first, as a model does that misses a change of speakers.
JOINED = "turn_idx - CASE WHEN turn_idx % 2 = 1 AND (sample_id + turn_idx // 2) % 3 = 0 THEN 1 ELSE 0 END"


@query(f""", tb AS (SELECT sample_id, strategy, flatten(list(list_transform(words, lambda x: {JOINED}) ORDER BY turn_idx)) AS t FROM hyps GROUP BY ALL),
    wt AS (SELECT sample_id, strategy, unnest(t) AS turn_idx, generate_subscripts(t, 1) AS h FROM tb),
    al AS (SELECT sample_id, strategy, CASE WHEN more THEN rb[j] ELSE rb[i] END AS ref_speaker, CASE WHEN more THEN i ELSE j END AS h FROM (SELECT sample_id, strategy, more, rb, unnest(pl) AS i, generate_subscripts(pl, 1) AS j FROM embedded)),
    tc AS (SELECT sample_id, strategy, turn_idx, count(DISTINCT ref_speaker) AS k, count(ref_speaker) AS n FROM wt LEFT JOIN al USING (sample_id, strategy, h) GROUP BY ALL)
    SELECT strategy, count(*) AS turns, CAST(sum(n) AS BIGINT) AS words, round(avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END), 6) AS merged_share FROM tc GROUP BY strategy""")
def b15_merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("turn_idx") % 2 == 1) & ((F.col("sample_id") + F.expr("turn_idx div 2")) % 3 == 0)
    h = views.hypotheses(spark, sf_dir).withColumn("into", F.col("turn_idx") - odd.cast("int"))
    rows = h.groupBy("sample_id", "strategy", "into").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "speaker", "words"))).alias("t"))
    joined = rows.select("sample_id", "strategy", F.col("into").alias("turn_idx"), F.col("t")[0].speaker.alias("speaker"), F.flatten("t.words").alias("words"))
    got = scoring.turn_coverage(views.turns(spark, sf_dir), joined, ["sample_id"], ["sample_id", "strategy"])
    return got.groupBy("strategy").agg(F.count("*").alias("turns"), F.sum("n").alias("words"), F.round(F.avg(F.when(F.col("speakers") >= 2, 1.0).otherwise(0.0)), 6).alias("merged_share"))


@query(f"""SELECT slice, strategy, count(*) AS n, round(avg(wer), 6) AS mean_wer FROM (
    SELECT unnest(list_filter([CASE WHEN sample_id IN ({', '.join(map(str, LISTED))}) THEN 'listed' END, CASE WHEN sample_id NOT IN ({', '.join(map(str, LISTED))}) THEN 'rest' END, CASE WHEN sample_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS slice, strategy, wer FROM scores) GROUP BY ALL""")
def b16_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.col("sample_id").isin(LISTED)
    got = rollups.sliced(views.scores(spark, sf_dir), {"listed": listed, "rest": ~listed, "even": F.col("sample_id") % 2 == 0})
    return got.select("slice", "strategy", "n", F.round("mean_wer", 6).alias("mean_wer"))


@query("""SELECT k AS num_speakers, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(saa, 0.0) AS saa FROM (SELECT unnest([2, 3, 4]) AS k)
    LEFT JOIN (SELECT num_speakers, count(*) AS n, round(avg(saa), 6) AS saa FROM scores WHERE strategy = 'adaptive' GROUP BY 1) ON k = num_speakers""")
def b17_speaker_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = views.scores(spark, sf_dir).where("strategy = 'adaptive'").groupBy("num_speakers").agg(F.count("*").alias("n"), F.round(F.avg("saa"), 6).alias("saa"))
    return timeline.with_empty_slices(got, spark.createDataFrame([(2,), (3,), (4,)], "num_speakers int"), ["num_speakers"])


@query("SELECT doc_id, nfc_normalize(text) = text AS composed, CAST(length(nfc_normalize(text)) AS INTEGER) AS n, sha256(nfc_normalize(text)) AS digest FROM documents")
def c01_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), "text")
    return T.compose(d, "text").select("doc_id", (F.col("text") == F.col("before")).alias("composed"), F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, sha256(regexp_replace(html, '(?s)\\[.*?\\]|<.*?>', ' ', 'g')) AS digest FROM pages")
def c02_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("digest"))


@query("SELECT page_id, sha256(regexp_replace(html, '(?s)\\(.*?\\)', ' ', 'g')) AS digest FROM pages")
def c03_strip_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_glosses(F.col("html")), 256).alias("digest"))


@query("SELECT sample_id, turn_idx, replace(array_to_string(words, ' '), ' ', '') AS joined FROM turns")
def c04_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir)
    return t.select("sample_id", "turn_idx", T.drop_zero_width(F.array_join("words", T.ZERO_WIDTH[0])).alias("joined"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(lower(html), '[^\\p{L}\\p{M}\\p{N}\\p{Z}]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) AS digest FROM pages")
def c06_keep_word_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.sha2(T.collapse_space(T.keep_word_characters(F.lower("html"))), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({norm('text')}) AS digest, sha256({norm('text', False)}) AS with_glosses FROM documents")
def c07_normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("digest"), F.sha2(T.normalize(F.col("text"), False), 256).alias("with_glosses"))


@query(f"SELECT page_id, sha256({norm('html')}) AS digest FROM pages")
def c07_normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.sha2(T.normalize(F.col("html")), 256).alias("digest"))


@query("SELECT sample_id, turn_idx, speaker, array_to_string(words, ' ') AS text FROM turns WHERE len(words) > 0")
def c08_normalize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalize_turns(views.raw_turns(spark, sf_dir))
