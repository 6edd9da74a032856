"""Rollups (H), comparisons (I), prompts (J), the synthetic corpus (L) and incremental work (M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import compare, results, rollups, synth, timeline
from ..plans import backends, search
from ..sources import clips, files, store, views
from ..sources.scratch import scratch
from ..streaming import ingest
from . import query
from .corpus import LISTED, pct
from .sql import BUCKET, PCT, TIER

MACRO = """count(*) AS n, avg(wer) AS mean_wer, avg(cer) AS mean_cer, avg(saa) AS mean_saa, avg(cpwer) AS mean_cpwer, avg(gap) AS mean_gap,
    coalesce(avg(wer) FILTER (wer <= 2), avg(wer)) AS trimmed_wer, coalesce(avg(cer) FILTER (cer <= 2), avg(cer)) AS trimmed_cer, coalesce(avg(cpwer) FILTER (cpwer <= 2), avg(cpwer)) AS trimmed_cpwer,
    avg(latency_ms) / 1000 AS mean_latency, count(*) FILTER (wer > 2) AS outliers"""
NUMBERS = ["mean_wer", "mean_cer", "mean_saa", "mean_cpwer", "mean_gap", "trimmed_wer", "trimmed_cer", "trimmed_cpwer", "mean_latency"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so what reads it more than once computes it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    return s.withColumn("bucket", timeline.duration_bucket(F.col("duration_ms") / 1000)).withColumn("tier", timeline.conflict_tier(pct()))


def _speedup(keys: str, on: str) -> str:
    return f"""m AS (SELECT {keys}, {MACRO} FROM (SELECT *, {BUCKET} AS bucket, {TIER} AS tier FROM scores) GROUP BY ALL)
    SELECT {", ".join("m." + k.strip() for k in keys.split(","))}, m.n, {", ".join(f"round(m.{c}, 6) AS {c}" for c in NUMBERS)}, m.outliers, round(b.mean_latency / m.mean_latency, 6) AS speedup FROM m LEFT JOIN (SELECT * FROM m WHERE strategy = 'baseline') b ON {on}"""


@query(f", {_speedup('bucket, strategy', 'b.bucket = m.bucket')}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to turns, hypotheses, word error rates, and the trimmed summary of each duration bucket."""
    return rounded(rollups.macro_summary(scored(spark, sf_dir), ["bucket", "strategy"], "baseline"))


GROUPED = f"""g AS (SELECT CASE GROUPING(bucket) * 2 + GROUPING(tier) WHEN 3 THEN 'overall' WHEN 1 THEN 'bucket' WHEN 2 THEN 'tier' ELSE 'bucket_tier' END AS level, bucket, tier, strategy, {MACRO}, sum(duration_ms) / 1000 AS seconds
      FROM (SELECT *, {BUCKET} AS bucket, {TIER} AS tier FROM scores) GROUP BY GROUPING SETS ((strategy), (strategy, bucket), (strategy, tier), (strategy, bucket, tier)))
    SELECT g.level, g.bucket, g.tier, g.strategy, g.n, {", ".join(f"round(g.{c}, 6) AS {c}" for c in NUMBERS)}, g.outliers, round(g.seconds, 6) AS seconds, round(b.mean_latency / g.mean_latency, 6) AS speedup,
      {", ".join(f"round(g.mean_{c} - b.mean_{c}, 6) AS delta_{c}" for c in rollups.DELTAS)}
    FROM g LEFT JOIN (SELECT * FROM g WHERE strategy = 'baseline') b ON b.level = g.level AND b.bucket IS NOT DISTINCT FROM g.bucket AND b.tier IS NOT DISTINCT FROM g.tier"""


@query(f", {GROUPED}")
def h13_all_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, bucket, tier and crossed rollups with trimmed means, speedups and deltas from one pass."""
    return rollups.all_slices(scored(spark, sf_dir), "baseline")


@query(f", {GROUPED}")
def a18_summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers written as one nested document, read back and taken apart again."""
    path = scratch(spark, "summary")
    made = rollups.document(stored(rollups.all_slices(scored(spark, sf_dir), "baseline"), "slices"))
    files.write_document(made, path)
    doc = files.read_document(spark, path, made.schema)
    none = F.lit(None).cast("string")
    overall = doc.select(F.explode("overall").alias("strategy", "v")).select(F.lit("overall").alias("level"), none.alias("bucket"), none.alias("tier"), "strategy", "v.*")
    one = lambda c, level: doc.select(F.explode(c).alias("slice", "m")).select("slice", F.explode("m").alias("strategy", "v")).select(F.lit(level).alias("level"), *[(F.col("slice") if level == k else none).alias(k) for k in ("bucket", "tier")], "strategy", "v.*")
    two = doc.select(F.explode("by_bucket_and_tier").alias("bucket", "t")).select("bucket", F.explode("t").alias("tier", "m")).select("bucket", "tier", F.explode("m").alias("strategy", "v")).select(F.lit("bucket_tier").alias("level"), "bucket", "tier", "strategy", "v.*")
    return overall.unionByName(one("by_bucket", "bucket")).unionByName(one("by_tier", "tier")).unionByName(two)


@query("""SELECT 1 AS version, 'baseline' AS strategy, count(*) AS n, round(avg(wer), 6) AS wer, round(avg(saa), 6) AS saa FROM scores WHERE strategy = 'baseline'
    UNION ALL SELECT 2, CASE WHEN sample_id % 3 = 0 THEN 'adaptive' ELSE 'baseline' END AS s, count(*), round(avg(wer), 6), round(avg(saa), 6) FROM scores WHERE strategy = CASE WHEN sample_id % 3 = 0 THEN 'adaptive' ELSE 'baseline' END GROUP BY s""")
def m05_compiled_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results merged bucket by bucket before anything is summed up, and a summary compiled from each named version."""
    own = views.scores(spark, sf_dir).select("sample_id", "strategy", "wer", "saa", F.col("sample_id").alias("pos"))
    own = stored(own, "own-scores")
    kept = store.BucketStore(spark, scratch(spark, "results"), buckets=16)
    kept.put(own.where("strategy = 'baseline'"), 1)
    again = own.where("strategy = 'adaptive' and sample_id % 3 = 0")
    kept.put(again, 2)
    kept.put(again, 2)  # a batch that comes twice
    summary = lambda df: rounded(df.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"), F.avg("saa").alias("saa")))
    made = [kept.compile(v, summary, "by-strategy").select(F.lit(v).alias("version"), "*") for v in kept.versions()]
    return made[0].unionByName(made[1])


@query(f", {_speedup('strategy', 'true')}")
def h01_macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.macro_summary(scored(spark, sf_dir), ["strategy"], "baseline"))


@query(f", m AS (SELECT strategy, {MACRO} FROM scores GROUP BY strategy) SELECT strategy, n, {ROUNDED}, outliers FROM m")
def h02_macro_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.macro_summary(views.scores(spark, sf_dir)))


@query(f""", m AS (SELECT num_speakers AS k, {MACRO} FROM scores WHERE strategy = 'adaptive' GROUP BY 1)
    SELECT CAST(d AS INTEGER) AS num_speakers, CAST(coalesce(n, 0) AS BIGINT) AS n, {", ".join(f"coalesce(round({c}, 6), 0.0) AS {c}" for c in NUMBERS)}, CAST(coalesce(outliers, 0) AS BIGINT) AS outliers FROM (SELECT unnest([2, 3, 4]) AS d) LEFT JOIN m ON d = k""")
def h03_slices_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rounded(rollups.macro_summary(views.scores(spark, sf_dir).where("strategy = 'adaptive'"), ["num_speakers"]))
    return timeline.with_empty_slices(got, spark.createDataFrame([(2,), (3,), (4,)], "num_speakers int"), ["num_speakers"])


SLICE = f"""SELECT slice, strategy, count(*) AS n, round(avg(wer), 6) AS mean_wer, round(avg(saa), 6) AS mean_saa, round(avg(latency_ms) / 1000, 6) AS mean_latency FROM (
    SELECT *, unnest(list_filter([CASE WHEN {PCT} < 5 THEN 'low' END, CASE WHEN {PCT} >= 5 AND {PCT} <= 12 THEN 'moderate' END, CASE WHEN {PCT} > 12 THEN 'high' END, CASE WHEN num_speakers = 2 THEN 'pairs' END], lambda x: x IS NOT NULL)) AS slice FROM scores) GROUP BY ALL"""


@query(SLICE)
def h04_predicate_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).withColumn("pct", pct())
    p = F.col("pct")
    got = rollups.sliced(s, {"low": p < 5, "moderate": (p >= 5) & (p <= 12), "high": p > 12, "pairs": F.col("num_speakers") == 2})
    return rounded(got.select("slice", "strategy", "n", "mean_wer", "mean_saa", "mean_latency"))


@query("SELECT strategy, round(avg(wer), 6) AS wer, round(avg(saa), 6) AS saa, round(avg(latency_ms), 6) AS latency FROM scores GROUP BY strategy")
def h05_plain_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.scores(spark, sf_dir).groupBy("strategy").agg(F.avg("wer").alias("wer"), F.avg("saa").alias("saa"), F.avg("latency_ms").alias("latency")))


@query("SELECT strategy, round(0.7 * avg(saa) + 0.2 * greatest(0, 1 - avg(wer)) + 0.1 * greatest(0, 1 - avg(gap)), 6) AS fitness FROM scores GROUP BY strategy")
def h06_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.fitness(views.scores(spark, sf_dir), ["strategy"]))


@query(f""", m AS (SELECT {BUCKET} AS bucket, strategy, {MACRO} FROM scores GROUP BY ALL)
    SELECT a.bucket, {", ".join(f"round(a.{c} - b.{c}, 6) AS delta_{c}" for c in NUMBERS[:5])} FROM m a JOIN m b USING (bucket) WHERE a.strategy = 'adaptive' AND b.strategy = 'baseline'""")
def h07_bucket_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rollups.macro_summary(scored(spark, sf_dir), ["bucket", "strategy"])
    return rounded(rollups.deltas(m, "adaptive", "baseline", ["bucket"], NUMBERS[:5]))


@query(f", {_speedup('tier, strategy', 'b.tier = m.tier')}")
def h08_tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.macro_summary(scored(spark, sf_dir), ["tier", "strategy"], "baseline"))


@query("""SELECT strategy, round((SELECT avg(latency_ms) FROM scores WHERE strategy = 'baseline') / avg(latency_ms), 6) AS speedup FROM scores GROUP BY strategy""")
def h09_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.macro_summary(views.scores(spark, sf_dir), baseline="baseline").select("strategy", "speedup"))


@query(f"SELECT strategy, count(*) AS n, round(avg(wer), 6) AS wer FROM scores WHERE NOT (strategy = 'baseline' AND sample_id IN ({', '.join(map(str, LISTED))})) GROUP BY strategy")
def h10_without_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rollups.without(views.scores(spark, sf_dir), LISTED, "baseline")
    return rounded(kept.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("wer").alias("wer")))


EVIDENCE = f"""w AS (SELECT sample_id, duration_ms, overlap_ms, max(saa) FILTER (strategy = 'baseline') AS a, max(saa) FILTER (strategy = 'flips') AS b, max(saa) FILTER (strategy = 'adaptive') AS c, max(saa) FILTER (strategy = 'labels') AS d FROM scores GROUP BY ALL),
    ev AS (SELECT sample_id, a AS light, b AS strong, greatest(c, d) AS best, greatest(c, d) >= a AS recovered FROM w WHERE a < b OR (a < 0.8 AND {PCT} > 4) OR (a < 0.99 AND greatest(c, d) > a))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("overlap_ratio", pct())
    table = compare.side_by_side(s, views.scores(spark, sf_dir), ["baseline", "flips", "adaptive", "labels"])
    return compare.failures(table, "baseline", "flips", ["adaptive", "labels"])


@query(f", {EVIDENCE} SELECT count(*) AS total, count(*) FILTER (recovered) AS recovered, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (recovered) / count(*), 1) ELSE 100.0 END AS rate FROM ev")
def h11_recovery_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recovery_rate(evidence(spark, sf_dir))


@query(f"SELECT CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(avg(duration_ms), 6) AS mean_ms, round(avg({PCT}), 6) AS mean_overlap FROM samples")
def h12_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.samples(spark, sf_dir).agg(F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"), F.avg(pct()).alias("mean_overlap")))


@query("SELECT sample_id, strategy, num_turns, saa FROM scores JOIN (SELECT sample_id FROM samples WHERE num_turns > 3) USING (sample_id)")
def i01_prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).where("num_turns > 3").select("sample_id")
    return views.scores(spark, sf_dir).join(s, "sample_id").select("sample_id", "strategy", "num_turns", "saa")


DELTAS = ", ".join(f"CASE WHEN round(n.{c} - o.{c}, 4) = 0 THEN 0.0 ELSE round(n.{c} - o.{c}, 4) END AS delta_{c}" for c in compare.METRICS)
PAIR = f"""pr AS (SELECT n.sample_id, {DELTAS}, o.latency_ms / greatest(n.latency_ms, 1) AS speedup FROM scores n JOIN scores o USING (sample_id) WHERE n.strategy = 'adaptive' AND o.strategy = 'baseline'),
    pw AS (SELECT *, delta_saa < -0.02 OR delta_wer > 0.03 OR delta_cpwer > 0.03 AS regressed FROM pr)"""


@query(f", {PAIR} SELECT * FROM pw")
def i02_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pairwise(views.scores(spark, sf_dir), "adaptive", "baseline")


@query(f", {PAIR} SELECT regressed, count(*) AS n FROM pw GROUP BY regressed")
def i03_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pairwise(views.scores(spark, sf_dir), "adaptive", "baseline").groupBy("regressed").agg(F.count("*").alias("n"))


@query(f"""SELECT {", ".join(f"round(n.{c} - o.{c}, 4) AS delta_{c}" for c in compare.METRICS)}, round(o.l / n.l, 3) AS speedup FROM
    (SELECT {", ".join(f"round(avg({c}), 4) AS {c}" for c in compare.METRICS)}, avg(latency_ms) AS l FROM scores WHERE strategy = 'adaptive') n,
    (SELECT {", ".join(f"round(avg({c}), 4) AS {c}" for c in compare.METRICS)}, avg(latency_ms) AS l FROM scores WHERE strategy = 'baseline') o""")
def i04_overall_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overall(views.scores(spark, sf_dir), "adaptive", "baseline")


@query("""SELECT sample_id, coalesce(max(saa) FILTER (strategy = 'adaptive' AND sample_id % 3 <> 0), 0.0) AS adaptive_saa, coalesce(max(wer) FILTER (strategy = 'adaptive' AND sample_id % 3 <> 0), 0.0) AS adaptive_wer,
    max(saa) FILTER (strategy = 'flips') AS flips_saa, max(wer) FILTER (strategy = 'flips') AS flips_wer FROM scores GROUP BY sample_id""")
def i05_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).where("not (strategy = 'adaptive' and sample_id % 3 = 0)")
    return compare.side_by_side(views.samples(spark, sf_dir).select("sample_id"), s, ["adaptive", "flips"], zero_missing=True)


@query(f", {EVIDENCE} SELECT * FROM ev")
def i06_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query("""SELECT sample_id, greatest(coalesce(x, 0), coalesce(y, 0)) AS best, greatest(coalesce(x, 0), coalesce(y, 0)) - a AS gain, greatest(coalesce(x, 0), coalesce(y, 0)) >= b - 0.05 OR greatest(coalesce(x, 0), coalesce(y, 0)) - a > 0.15 AS recovered FROM (
    SELECT sample_id, max(saa) FILTER (strategy = 'labels' AND sample_id % 2 = 0) AS x, max(saa) FILTER (strategy = 'adaptive' AND sample_id % 3 = 0) AS y, max(saa) FILTER (strategy = 'baseline') AS a, max(saa) FILTER (strategy = 'flips') AS b FROM scores GROUP BY sample_id)
    WHERE coalesce(x, y) IS NOT NULL AND a < b""")
def i07_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    own = lambda name, rule="true": s.where((F.col("strategy") == name) & F.expr(rule))
    return compare.recoveries([own("labels", "sample_id % 2 = 0"), own("adaptive", "sample_id % 3 = 0")], own("baseline"), own("flips"))


@query(f"SELECT sample_id, strategy, saa FROM scores WHERE {BUCKET} = '70s-180s'")
def i08_bucket_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = scored(spark, sf_dir).where("bucket = '70s-180s'").select("sample_id").distinct()
    return views.scores(spark, sf_dir).join(ids, "sample_id", "left_semi").select("sample_id", "strategy", "saa")


@query("SELECT strategy, baseline, round(avg(saa) - c, 6) AS delta_mean_saa FROM scores, (SELECT unnest(['light', 'strong']) AS baseline, unnest([0.6904, 0.7942]) AS c) GROUP BY strategy, baseline, c")
def i09_against_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    constants = spark.createDataFrame([("light", 0.6904), ("strong", 0.7942)], "name string, mean_saa double")
    return rounded(compare.against_constants(rollups.macro_summary(views.scores(spark, sf_dir)), constants, ["mean_saa"]))


@query("SELECT sample_id, saa, gap FROM scores WHERE strategy = 'adaptive' ORDER BY saa - gap, sample_id LIMIT 3")
def i10_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.worst(views.scores(spark, sf_dir).where("strategy = 'adaptive'")).select("sample_id", "saa", "gap")


def judge(prompt: str, n: int) -> tuple[str, float]:
    """A stand-in for the model that judges and rewrites: its rewritten prompts count themselves."""
    if prompt.startswith("Reference:"):
        return f'{{"diarization_score": {len(prompt) % 100}, "finding": "turns of {len(prompt.splitlines())} lines"}}', 0.1
    return "```\nListen once more, name the speaker of each turn, and let no word of a turn go to anyone but the speaker who said it: version " + str(prompt.count("version") + 1) + "\n```", 0.1


@query("""SELECT CAST(g AS INTEGER) AS generation, round(fitness, 4) AS fitness, coalesce(round(fitness, 4) >= max(round(fitness, 4)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
    FROM (SELECT list_position(['baseline', 'flips'], strategy) - 1 AS g, 0.7 * avg(saa) + 0.2 * greatest(0, 1 - avg(wer)) + 0.1 * greatest(0, 1 - avg(gap)) AS fitness FROM scores WHERE strategy IN ('baseline', 'flips') GROUP BY strategy)""")
def i11_prompt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation after the seed: the worst samples are judged, the prompt is rewritten by a backend and evaluated."""
    s = stored(views.scores(spark, sf_dir).select("sample_id", "strategy", "wer", "saa", "gap"), "scores")
    nested = timeline.nested_turns(views.turns(spark, sf_dir))
    evaluate = lambda p: s.where(F.col("strategy") == ("flips" if "version 1" in p else "baseline"))
    shown = lambda p, ids: nested.join(F.broadcast(ids), "sample_id").select("sample_id", F.col("turns").alias("ref"), F.col("turns").alias("hyp"))
    _, history = search.search(spark, "seed", evaluate, shown, backends.Calls(judge), scratch(spark, "search"), rounds=1)
    return history.select("generation", "fitness", "accepted")


@query(f"SELECT sample_id, strategy, wer FROM scores WHERE sample_id IN ({', '.join(map(str, LISTED))})")
def i12_listed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scores(spark, sf_dir).where(F.col("sample_id").isin(LISTED)).select("sample_id", "strategy", "wer")


@query("SELECT sample_id, strategy, m.metric, NOT (m.metric = 'wer' AND sample_id % 5 = 0 OR m.metric = 'saa' AND strategy = 'flips') AS ok FROM scores, (SELECT unnest(['wer', 'saa']) AS metric) m")
def i13_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported values are rounded, and some have drifted by twice the tolerance."""
    s = stored(views.scores(spark, sf_dir).select("sample_id", "strategy", "wer", "saa"), "scores")
    reported = s.withColumn("wer", F.round("wer", 4) + F.when(F.col("sample_id") % 5 == 0, 0.002).otherwise(0.0))
    reported = reported.withColumn("saa", F.round("saa", 4) - F.when(F.col("strategy") == "flips", 0.002).otherwise(0.0))
    return compare.consistent(reported, s, ["sample_id", "strategy"], ["wer", "saa"]).select("sample_id", "strategy", "metric", "ok")


@query("SELECT sample_id FROM samples ORDER BY sample_id LIMIT 3")
def i14_subset_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.subset_or_first(views.samples(spark, sf_dir), [-1, -2]).select("sample_id")


@query("""SELECT sample_id, 'Transcribe the conversation word by word. ' || CASE num_speakers WHEN 2 THEN 'Two people talk: Speaker 0 speaks first, Speaker 1 answers.' WHEN 1 THEN '1 people talk: Speaker 0.' ELSE num_speakers || ' people talk: Speaker 0, Speaker 1, Speaker 2.' END
    || ' Write each turn as ''Speaker N: words''.' AS prompt FROM samples""")
def j01_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("sample_id", prompts.instructions(F.col("num_speakers"), "labelled").alias("prompt"))


@query("SELECT sample_id, CASE WHEN sample_id % 4 = 0 THEN 0 ELSE num_speakers END AS n_labels, 'Speaker ' || (num_speakers - 1) AS last_label, 'utterance,transition_type,speaker' AS fields FROM samples WHERE sample_id % 4 <> 0 UNION ALL SELECT sample_id, 0, NULL, 'utterance,transition_type,speaker' FROM samples WHERE sample_id % 4 = 0")
def j02_response_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of every sample's request, taken apart again; a quarter of the samples state no count."""
    n = F.when(F.col("sample_id") % 4 == 0, 0).otherwise(F.col("num_speakers"))
    item = F.get_json_object(prompts.schema_json(n), "$.properties.dialogue.items")
    labels = F.from_json(F.get_json_object(item, "$.properties.speaker.enum"), "array<string>")
    got = views.samples(spark, sf_dir).select("sample_id", labels.alias("l"), F.from_json(F.get_json_object(item, "$.required"), "array<string>").alias("f"))
    return got.select("sample_id", F.coalesce(F.size("l"), F.lit(0)).alias("n_labels"), F.try_element_at("l", F.lit(-1)).alias("last_label"), F.array_join("f", ",").alias("fields"))


@query("""SELECT r.sample_id, 'Reference:' || chr(10) || r.t || chr(10) || chr(10) || 'Candidate:' || chr(10) || r.t || chr(10) || chr(10) || 'Score the candidate as JSON.' AS prompt
    FROM (SELECT sample_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_idx) FILTER (turn_idx < 15) AS t FROM turns GROUP BY sample_id) r""")
def j03_critique_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = timeline.nested_turns(views.turns(spark, sf_dir))
    return n.select("sample_id", prompts.critique(F.col("turns"), F.col("turns")).alias("prompt"))


@query("""SELECT conv_id, turn, 'This prompt is in use:' || chr(10) || role || chr(10) || chr(10) || 'Its replies fall short here:' || chr(10) || text || chr(10) || chr(10) || 'Write an improved prompt, whole, and nothing else.' AS prompt FROM conversations""")
def j03_mutation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.mutation(F.col("role"), F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 100 THEN trim(text) ELSE 'before' END AS prompt FROM conversations")
def j04_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.read(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("```text\n"), F.trim("text"), F.lit("\n```"))
    return c.select("conv_id", "turn", prompts.accepted(F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text")), F.lit("before")).alias("prompt"))


TEMPLATES = [(1, "Call {name} about {days} days"), (2, "{name} owes since {days} days")]


@query("SELECT k AS template_id, CASE k WHEN 1 THEN 'Call ' || n_name || ' about ' || n_nationkey || ' days' ELSE n_name || ' owes since ' || n_nationkey || ' days' END AS text FROM nation, (SELECT unnest([1, 2]) AS k)")
def l01_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = views.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("days"))
    return synth.expand_templates(spark.createDataFrame(TEMPLATES, "template_id int, template string"), slots).select("template_id", "text")


@query("SELECT sample_id, turn_idx, substr(sha256(speaker || '|1.0|' || text), 1, 24) AS key FROM turns")
def l02_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_turns(spark, sf_dir).select("sample_id", "turn_idx", synth.cache_key(F.col("speaker"), F.lit("1.0"), F.col("text")).alias("key"))


@query("""SELECT key, CAST(max(n) * 160 AS BIGINT) AS frames, true AS ok, CAST(0 AS BIGINT) AS again FROM (
    SELECT substr(sha256(speaker || '|1.0|' || text), 1, 24) AS key, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM turns WHERE text IS NOT NULL) GROUP BY key""")
def l03_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's clip rendered, trimmed, kept under its hash and read back with its header; a second run renders nothing."""
    kept = clips.ClipStore(spark, scratch(spark, "clips"))
    wanted = views.raw_turns(spark, sf_dir)
    kept.add(wanted.where("turn_idx % 2 = 0"))
    kept.add(wanted)
    again = kept.add(wanted)
    read = kept.read(F.substring("audio", 1, files.HEAD).alias("head"), F.octet_length("audio").alias("n_bytes"), "frames").withColumn("h", files.check_wav("head"))
    whole = F.col("h.ok") & (F.col("h.frames") == F.col("frames")) & (F.col("n_bytes") == files.HEAD + 2 * F.col("frames"))
    return read.select("key", F.col("h.frames").alias("frames"), whole.alias("ok"), F.lit(again).cast("long").alias("again"))


@query("""SELECT printf('call_%03d', row_number() OVER (ORDER BY k, i)) AS spec, bucket, CAST(round((a + (b - a) * i / (n - 1)) * 1000) AS BIGINT) AS duration_ms, CAST(round(13.5 + (row_number() OVER (ORDER BY k, i) * 3.7) % 12.0, 6) AS DOUBLE) AS overlap_pct
    FROM (SELECT *, unnest(range(0, n)) AS i FROM (VALUES (0, 'short_30_70s', 13, 34.0, 66.0), (1, 'medium_70_180s', 13, 76.0, 172.0), (2, 'long_180_300s', 12, 186.0, 294.0), (3, 'very_long_300_600s', 12, 312.0, 585.0)) g(k, bucket, n, a, b))""")
def l12_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synth.specifications(spark))


# What the two sides of a synthetic call say, with slots.
SAID = [
    (0, 0, "Good morning, this is the service desk for {name}."),
    (0, 1, "May I have your reference number, please?"),
    (0, 2, "I see here that the last instalment of your plan is {days} days late, is that right?"),
    (0, 3, "Thank you for telling me."),
    (0, 4, "We could split the amount into three parts, the first of which would be due at the end of this month."),
    (0, 5, "Would {days} days be enough for you to arrange it?"),
    (0, 6, "I understand, and I will note that in your file so that nobody else from {name} has to ask you again."),
    (0, 7, "Let me repeat what we have agreed on before we end the call."),
    (1, 0, "Hello, yes, speaking."),
    (1, 1, "I wrote to {name} about this two weeks ago and nobody has answered me since."),
    (1, 2, "Just a moment, I have to look for it."),
    (1, 3, "That is true, my salary came {days} days late this time and so did everything else."),
    (1, 4, "No, that will not work."),
    (1, 5, "If I pay the first part on Friday, can the rest wait until after the holidays?"),
    (1, 6, "All right, {days} days is fine with me."),
    (1, 7, "Please send me that in writing, because the last person I talked to at {name} promised it and then did not do it."),
]


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either side may say: fixed templates with every nation as a slot, numbered by side."""
    slots = views.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("days"))
    said = synth.expand_templates(spark.createDataFrame(SAID, "side int, k int, template string"), slots)
    at = F.row_number().over(Window.partitionBy("side").orderBy("days", "k")) - 1
    return said.select("side", at.alias("pos"), "text", (F.size(F.split("text", " ")) * views.WORD_MS).cast("long").alias("dur_ms"))


@query()
def l05_chosen_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.choose_turns(synth.specifications(spark), pool(spark, sf_dir))


@query()
def l06_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.transitions(l05_chosen_turns(spark, sf_dir)).drop("text")


@query()
def l08_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.timelines(synth.specifications(spark), l05_chosen_turns(spark, sf_dir))


@query()
def l11_second_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synth.render(l08_timelines(spark, sf_dir), synth.specifications(spark))
    return synth.second_levels(made).groupBy("spec").agg(F.count("*").alias("seconds"), F.min("rms").alias("quietest"))


@query("SELECT CAST(50 AS BIGINT) AS calls, true AS enough_overlap")
def l13_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = l08_timelines(spark, sf_dir)
    o = timeline.overlap_duration(t, "spec").join(synth.specifications(spark), "spec")
    return o.agg(F.count("*").alias("calls"), (F.avg(100 * F.col("overlap") / F.col("duration_ms")) >= 15).alias("enough_overlap"))


@query("SELECT sample_id, strategy FROM scores WHERE NOT (strategy = 'adaptive' AND sample_id % 2 = 0)")
def m02_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.scores(spark, sf_dir).select("sample_id", "strategy")
    done = every.where("strategy = 'adaptive' and sample_id % 2 = 0")
    return every.join(done, ["sample_id", "strategy"], "left_anti")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS centis FROM events GROUP BY ALL")
def n01_windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_activity(views.read(spark, sf_dir, "events"))


@query("SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'again' ELSE 'first' END AS run FROM samples")
def n02_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).select("sample_id", F.col("sample_id").alias("pos"))
    first, again = s.withColumn("run", F.lit("first")), s.where("sample_id % 3 = 0").withColumn("run", F.lit("again"))
    return results.upsert(first, again).select("sample_id", "run")
