"""The second-stage gate, sparse corrections, and the routing rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_speaker
from . import timeline

# Words that mark an argument (matched as substrings), and those that decide alone.
DEBATE_MARKERS = ["बहस", "सहमत", "असहमत", "विरोध", "नुकसान", "फायदा", "फायदे", "खिलाफ", "पक्ष", "मुद्दा", "मुद्दे", "तर्क", "आपत्ति", "समस्या", "राय"]
STRONG_MARKERS = ["बहस", "असहमत", "विरोध", "खिलाफ", "आपत्ति"]
LONG_SECONDS, ALTERNATION, MANY_TURNS = 70.0, 0.85, 16


def debate(text: Column, markers: list[str] | None = None, strong: list[str] | None = None) -> tuple[Column, Column]:
    """(is a debate, markers found): one strong marker or any two."""
    markers, strong = markers or DEBATE_MARKERS, strong or STRONG_MARKERS
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))
    alone = F.exists(F.array(*map(F.lit, strong)), lambda m: F.contains(text, m))
    return alone | (F.size(found) >= 2), found


def gate(samples: DataFrame, turns: DataFrame, key: str = "sample_id", seconds: str = "duration_seconds", markers: list[str] | None = None, strong: list[str] | None = None) -> DataFrame:
    """(key, triggered, reason) of every sample, from its stage-1 turns.

    Rules in order: one turn or none, no; single-speaker collapse; long; ping-pong alternation; debate; else no.
    Samples without turns don't trigger.
    """
    facts = timeline.switches(turns, key)
    text = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("t")).select(key, F.array_join("t.text", " ").alias("__text"))
    all_ = samples.select(key, seconds).join(facts, key, "left").join(text, key, "left")
    is_debate, _ = debate(F.coalesce("__text", F.lit("")), markers, strong)
    n = F.coalesce("n_turns", F.lit(0))
    reason = (
        F.when(n <= 1, "too_few_turns").when(F.col("collapsed"), "collapse").when(F.col(seconds) >= LONG_SECONDS, "long")
        .when((F.col("alternation") >= ALTERNATION) & (n >= MANY_TURNS), "ping_pong").when(is_debate, "debate").otherwise("bypass")
    )
    return all_.select(key, (~reason.isin("too_few_turns", "bypass")).alias("triggered"), reason.alias("reason"))


def stage2_prompt(turns: DataFrame, key: str = "sample_id", context: DataFrame | None = None, speakers: DataFrame | None = None) -> DataFrame:
    """(key, prompt): numbered lines with tags, an optional context above, and a notice where all turns have one speaker.

    ``context`` is (key, profiles); ``speakers`` is (key, num_speakers) and switches the notice on.
    """
    tag = F.coalesce("tag", F.lit("SPEAKER_FLOOR_SHIFT"))
    line = F.format_string("[Turn %d] %s | [Transition] %s: %s", F.col("turn_idx") + 1, "speaker", tag, "text")
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("line")))).alias("l"), F.countDistinct("speaker").alias("k"), F.count("*").alias("n"))
    above = F.lit(None).cast("string")
    if context is not None:
        rows = rows.join(context, key, "left")
        above = F.when(F.trim("profiles") != "", F.concat(F.lit("Speakers:\n"), F.trim("profiles"), F.lit("\n")))
    notice = F.lit(None).cast("string")
    if speakers is not None:
        rows = rows.join(speakers, key, "left")
        names = F.array_join(F.transform(F.sequence(F.lit(0), F.coalesce("num_speakers", F.lit(2)) - 1), lambda i: F.concat(F.lit("Speaker "), i.cast("string"))), ", ")
        notice = F.when((F.col("k") < 2) & (F.col("n") >= 4), F.concat(F.lit("\nNotice: every turn has the same speaker. Share the turns among "), names, F.lit(".")))
    return rows.select(key, F.concat_ws("\n", above, F.lit("Dialogue:"), F.array_join("l.line", "\n"), F.lit("\nCorrections as JSON:"), notice).alias("prompt"))


def apply_corrections(turns: DataFrame, corrections: DataFrame, key: str = "sample_id", static: bool = False) -> DataFrame:
    """Turns with corrected speakers; texts never change.

    ``turn_id`` counts from 1 and is read as an integer (``true`` is 1, as in the replies that use it); other
    ids, ids out of range and null speakers are skipped; the last correction of a turn wins. In the ``static``
    mode only plain integers count, and 0 corrects the first turn.
    """
    c = corrections.where(F.col("speaker").isNotNull())
    if static:
        at = F.when(F.col("turn_id").rlike(r"^-?\d+$"), F.expr("try_cast(turn_id as int)"))
        at = F.when(at == 0, 0).otherwise(at - 1)
    else:
        raw = F.trim("turn_id")
        whole = F.when(raw.rlike(r"^[+-]?\d+$"), F.expr("try_cast(trim(turn_id) as int)")).when(raw.rlike(r"^-?\d+\.\d+$"), F.expr("try_cast(try_cast(trim(turn_id) as double) as int)"))
        at = F.when(raw == "true", 1).when(raw == "false", 0).otherwise(whole) - 1
    last = Window.partitionBy(key, "__at").orderBy(F.col("pos").desc())
    c = c.withColumn("__at", at).where(F.col("__at") >= 0).withColumn("__r", F.row_number().over(last)).where("__r = 1")
    c = c.select(F.col(key).alias("__k"), "__at", canonical_speaker(F.col("speaker")).alias("__s"))
    joined = turns.join(c, (F.col(key) == F.col("__k")) & (F.col("turn_idx") == F.col("__at")), "left")
    return joined.withColumn("speaker", F.coalesce("__s", "speaker")).drop("__k", "__at", "__s")


def speaker_count(override: Column, stated: Column, distinct_ref: Column) -> Column:
    """The override, else a stated count above 0, else the reference's speakers, else 2."""
    return F.coalesce(override, F.when(stated > 0, stated), F.when(distinct_ref > 0, distinct_ref), F.lit(2)).cast("int")


def route(seconds: Column, overlap_pct: Column, triggered: Column) -> Column:
    """Tier 3 for long calls with much overlap, tier 1 for short ones that don't trigger, else tier 2.

    The order settles the cases that the stated rules leave open or claim twice.
    """
    hard = ((seconds > 210) & (overlap_pct >= 20)) | ((seconds > 300) & (overlap_pct >= 16))
    return F.when(hard, 3).when((seconds < LONG_SECONDS) & ~triggered, 1).otherwise(2).cast("int")


def cutoff_violations(scores: DataFrame, bucket: str, challenger: str, baseline: str) -> DataFrame:
    """(bucket, gap_violation, low_samples, deficit_violation) of the challenger.

    A mean gap above 0.18, any sample's accuracy under 0.8, or a mean accuracy more than 4 points below the
    baseline's.
    """
    on = lambda name, e: F.avg(F.when(F.col("strategy") == name, e))
    own = F.col("strategy") == challenger
    got = scores.groupBy(bucket).agg(on(challenger, F.col("gap")).alias("g"), F.count_if(own & (F.col("saa") < 0.8)).alias("low_samples"), on(challenger, F.col("saa")).alias("a"), on(baseline, F.col("saa")).alias("b"))
    return got.select(bucket, (F.col("g") > 0.18).alias("gap_violation"), "low_samples", (F.col("b") - F.col("a") > 0.04).alias("deficit_violation"))


def windows(samples: DataFrame, length_ms: int = 120_000, overlap_ms: int = 15_000, key: str = "sample_id") -> DataFrame:
    """(key, window, from_ms, to_ms): windows of a length, each starting an overlap before the last one ends."""
    step = length_ms - overlap_ms
    last = F.greatest(F.lit(0), F.ceil((F.col("duration_ms") - length_ms) / F.lit(step))).cast("int")
    w = samples.select(key, "duration_ms", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    start = F.col("window").cast("long") * step
    return w.select(key, "window", start.alias("from_ms"), F.least(start + length_ms, F.col("duration_ms")).alias("to_ms"))


def stitch(parts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Votes for renaming each window's speakers to those of the window before: (key, window, before, after, n).

    ``parts`` is (key, window, turn_idx, speaker). Turns in two windows vote; the assignment of the votes names
    the speakers.
    """
    a = parts.select(key, (F.col("window") + 1).alias("window"), "turn_idx", F.col("speaker").alias("before"))
    b = parts.select(key, "window", "turn_idx", F.col("speaker").alias("after"))
    return a.join(b, [key, "window", "turn_idx"]).groupBy(key, "window", "before", "after").agg(F.count("*").alias("n"))


def _followed(maps: DataFrame, key: str, spark) -> DataFrame:
    """``maps`` (key, window, own, to_window, to), each label's place one step back, followed to its end.

    Maps of windows compose associatively, so each round joins the table with itself and doubles every step: as many
    rounds as the longest chain has binary digits. Each round is written, which keeps plans short and outlives executors.
    """
    from ..sources.scratch import scratch

    root, k = scratch(spark, "stitch"), 0
    while True:
        maps.write.parquet(f"{root}/{k}")
        maps = spark.read.schema(maps.schema).parquet(f"{root}/{k}")
        if not maps.where("moved").limit(1).count():
            return maps.drop("moved")
        on = maps.select(F.col(key).alias("__k"), F.col("window").alias("__w"), F.col("own").alias("__o"), F.col("to_window").alias("__tw"), F.col("to").alias("__t"))
        met = maps.join(on, (F.col(key) == F.col("__k")) & (F.col("to_window") == F.col("__w")) & (F.col("to") == F.col("__o")))
        maps = met.select(key, "window", "own", F.col("__tw").alias("to_window"), F.col("__t").alias("to"), (F.col("__tw") < F.col("to_window")).alias("moved"))
        k += 1


def renamed(parts: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, window, turn_idx, speaker): windows' turns under names that hold throughout a sample.

    The assignment of ``stitch``'s votes maps each window's labels to those of the window before, one to one, pairs
    without a vote left out. A label keeps the name of the first label its chain of maps leads back to. A chain that
    begins after the first window is a newcomer's: its name is the label and ``@`` and the window, and a label of the first
    window that already looks like that gets ``@0``. So no two labels of a window ever share a name.
    """
    from .scoring import _matrix, assigned

    votes = stitch(parts, key)
    best = assigned(_matrix(votes, [key, "window"], "after", "before", "n"), [key, "window"], True)
    pairs = best.select(key, "window", F.explode(F.arrays_zip(F.col("rows").alias("after"), F.col("cols").alias("before"))).alias("p")).select(key, "window", "p.after", "p.before")
    pairs = pairs.join(votes.select(key, "window", "after", "before"), [key, "window", "after", "before"], "left_semi")
    labels = parts.select(key, "window", F.col("speaker").alias("own")).where("own is not null").distinct()
    back = pairs.select(key, "window", F.col("after").alias("own"), "before")
    maps = labels.join(back, [key, "window", "own"], "left")
    known = F.col("before").isNotNull()
    maps = maps.select(key, "window", "own", F.when(known, F.col("window") - 1).otherwise(F.col("window")).alias("to_window"), F.coalesce("before", "own").alias("to"), known.alias("moved"))
    ends = _followed(maps, key, parts.sparkSession)
    late = (F.col("to_window") > 0) | F.col("to").rlike(r"@\d+$")
    name = F.when(late, F.concat("to", F.lit("@"), F.col("to_window").cast("string"))).otherwise(F.col("to"))
    names = ends.select(F.col(key).alias("__k"), F.col("window").alias("__w"), F.col("own").alias("__a"), name.alias("__b"))
    same = (F.col(key) == F.col("__k")) & (F.col("window") == F.col("__w")) & (F.col("speaker") == F.col("__a"))
    return parts.join(names, same, "left").select(key, "window", "turn_idx", F.col("__b").alias("speaker"))


def runaway(output_words: Column, expected_words: Column, factor: float = 4.0) -> Column:
    """Output far longer than expected: a repetition loop."""
    return output_words > expected_words * factor
