"""The driver's tables as samples, reference turns, hypotheses and scores, in whole milliseconds and counts.

A word takes 400 ms; where the speaker changes, a turn starts early by two fifths of the shorter of the two
turns. Hypotheses are deterministic edits of the reference: ``baseline`` drops every seventh word and gives
some turns to the wrong speaker (and repeats some samples four times), ``adaptive`` drops fewer words and
misplaces fewer turns, ``flips`` only misplaces turns, ``labels`` only renames speakers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, words
from ..plans.balance import spread

WORD_MS, OVERLAP_WORD_MS = 400, 160
NEXT_ROLE = {"user": "assistant", "assistant": "system", "system": "user"}
LABEL = {"user": "Speaker 0", "assistant": "Speaker 1", "system": "Speaker 2"}
REPEATED = 17


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, turn_idx, speaker, text)"""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").cast("int").alias("turn_idx"), F.col("role").alias("speaker"), "text")


def turns(spark: SparkSession, sf_dir: str, keep_parts: bool = False) -> DataFrame:
    """Timed reference turns: (sample_id, turn_idx, speaker, text, words, n_words, start_ms, end_ms).

    ``keep_parts`` asks that the shuffle by sample which the windows need keeps all its partitions.
    """
    t = raw_turns(spark, sf_dir).withColumn("words", words(normalize(F.col("text")))).withColumn("n_words", F.size("words"))
    t = spread(t, "sample_id") if keep_parts else t
    w = Window.partitionBy("sample_id").orderBy("turn_idx")
    t = t.withColumn("__prev", F.lag("speaker").over(w)).withColumn("__n", F.lag("n_words").over(w))
    early = F.when(F.col("__prev") != F.col("speaker"), F.least("n_words", "__n") * OVERLAP_WORD_MS).otherwise(0)
    t = t.withColumn("__early", early)
    before = F.coalesce(F.sum("n_words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * WORD_MS
    start = (before - F.sum("__early").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    t = t.withColumn("start_ms", start).withColumn("end_ms", start + F.col("n_words") * WORD_MS)
    return t.drop("__prev", "__n", "__early")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, duration_ms, num_speakers, num_turns, n_words, overlap_ms): totals of a sample's turns."""
    t = turns(spark, sf_dir)
    w = Window.partitionBy("sample_id").orderBy("turn_idx")
    t = t.withColumn("__o", F.greatest(F.lag("end_ms").over(w) - F.col("start_ms"), F.lit(0)))
    return t.groupBy("sample_id").agg(F.max("end_ms").alias("duration_ms"), F.countDistinct("speaker").cast("int").alias("num_speakers"), F.count("*").cast("int").alias("num_turns"), F.sum("n_words").alias("n_words"), F.coalesce(F.sum("__o"), F.lit(0)).alias("overlap_ms"))


def _mapped(column: str, table: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)]


def _plans(sample, turn, speaker, words_) -> list[tuple]:
    """(strategy, words, role) of what each strategy makes of a turn."""
    role = F.create_map(*[F.lit(x) for pair in NEXT_ROLE.items() for x in pair])[speaker]
    keep = lambda salt, n: F.filter(words_, lambda w, i: F.pmod(i + salt, F.lit(n)) != n - 1)
    many = F.flatten(F.array_repeat(words_, 4))
    where = lambda cond: F.when(cond, role).otherwise(speaker)
    return [
        ("baseline", F.when(sample % REPEATED == 0, many).otherwise(keep(turn, 7)), where((3 * sample + turn) % 5 == 0)),
        ("adaptive", keep(sample, 13), where((sample + turn) % 9 == 0)),
        ("flips", words_, where((sample + 2 * turn) % 4 == 0)),
        ("labels", words_, role),
    ]


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, strategy, turn_idx, role, speaker, words) of every strategy."""
    t = turns(spark, sf_dir).select("sample_id", "turn_idx", "speaker", "words")
    plans = _plans(F.col("sample_id"), F.col("turn_idx"), F.col("speaker"), F.col("words"))
    made = F.array(*[F.struct(F.lit(n).alias("strategy"), r.alias("role"), w.alias("words")) for n, w, r in plans])
    out = t.select("sample_id", "turn_idx", F.explode(made).alias("h")).select("sample_id", "h.strategy", "turn_idx", "h.role", "h.words")
    return out.withColumn("speaker", _mapped("role", LABEL))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (sample, strategy): wer, cer, saa, cpwer, gap, latency_ms and the sample's totals.

    The metrics are those of ``scoring.score_nested``. Turns are read, timed and gathered once; a sample's hypotheses
    and totals are made from its gathered turns, in the same row.
    """
    from ..operators.scoring import score_nested

    t = turns(spark, sf_dir, keep_parts=True).select("sample_id", F.struct("turn_idx", "speaker", "words", "n_words", "start_ms", "end_ms").alias("t"))
    rows = t.groupBy("sample_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.greatest(a.end_ms - b.start_ms, F.lit(0)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.select(
        "sample_id", "t", F.array_max("t.end_ms").alias("duration_ms"), F.size(F.array_distinct("t.speaker")).alias("num_speakers"), F.size("t").alias("num_turns"),
        F.when(F.size("t") > 1, total(pairs)).otherwise(F.lit(0).cast("long")).alias("overlap_ms"),
    )
    label = F.create_map(*[F.lit(x) for pair in LABEL.items() for x in pair])

    def said(k: int):
        def turn(t):
            _, w, r = _plans(F.col("sample_id"), t.turn_idx, t.speaker, t.words)[k]
            return F.struct(label[r].alias("speaker"), w.alias("words"))

        return F.transform("t", turn)

    names = [n for n, *_ in _plans(*[F.lit(0)] * 4)]
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), said(k).alias("hyp")) for k, n in enumerate(names)])).alias("h")
    ref = F.transform("t", lambda t: F.struct(t.speaker.alias("speaker"), t.words.alias("words"))).alias("ref")
    both = rows.select("sample_id", "duration_ms", "num_speakers", "num_turns", "overlap_ms", ref, made)
    both = both.select("sample_id", "h.strategy", "duration_ms", "num_speakers", "num_turns", "overlap_ms", "ref", "h.hyp")
    slow = F.when(F.col("strategy") == "baseline", 2000 + F.expr("duration_ms div 20")).when(F.col("strategy") == "adaptive", 1500 + F.expr("duration_ms div 25")).otherwise(1000 + F.expr("duration_ms div 40"))
    got = score_nested(both, "ref", "hyp")
    return got.select("sample_id", "strategy", "duration_ms", "num_speakers", "num_turns", "overlap_ms", "wer", "cer", "saa", "cpwer", "gap", slow.cast("long").alias("latency_ms"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech segments: (sample_id, speaker, pos, start_ms, end_ms); values are seconds of speech."""
    e = read(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("speaker"), F.col("event_id").alias("pos"), start.alias("start_ms"), (start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"))
