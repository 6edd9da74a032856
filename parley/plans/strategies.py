"""Strategies: request, reply, parse, and for some a gated second stage. Each is a DataFrame to DataFrame step.

A backend takes requests (sample_id, prompt) and a stage and adds (raw_response, latency_ms, error).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import schema_json, second_prompt, strategy_prompt
from ..operators import gating, parsers

Backend = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Strategy:
    """``first`` is the grammar of the first reply. ``second`` is None, ``"text"`` (the first reply is text for a
    second call whose reply is parsed) or ``"corrections"`` (the second call corrects speakers, where ``gated``
    only if the gate opens, else wherever there is more than one turn). ``schema`` sends the response schema along."""

    name: str
    first: str
    second: str | None = None
    gated: bool = False
    static: bool = False
    schema: bool = False


STRATEGIES = {
    s.name: s
    for s in (
        Strategy("single_step", "labelled"), Strategy("anchor_prompt", "labelled"), Strategy("two_step", "labelled", "text"), Strategy("text_first", "text_first"),
        Strategy("two_pass", "labelled", "text"), Strategy("advanced_text_first", "text_first"), Strategy("structured_json", "json", schema=True),
        Strategy("tri_field", "tri_field"), Strategy("multi_stage", "tri_field", "corrections", static=True), Strategy("adaptive", "tagged", "corrections", gated=True),
    )
}


def requests(strategy: Strategy, samples: DataFrame, speakers: int | None = None) -> DataFrame:
    """(sample_id, duration_seconds, num_speakers, prompt[, response_schema]): the first requests.

    ``num_speakers`` is what the prompt says: ``speakers`` if given, else the sample's own count, else the speakers of
    its reference (``ref_speakers``, where there is such a column), else two.
    """
    known = F.col("ref_speakers") if "ref_speakers" in samples.columns else F.lit(None).cast("int")
    count = gating.speaker_count(F.lit(speakers).cast("int"), F.col("num_speakers"), known)
    asked = samples.select("sample_id", "duration_seconds", count.alias("num_speakers"))
    grammar = "tri_field" if strategy.first == "tagged" else strategy.first
    asked = asked.withColumn("prompt", strategy_prompt(F.col("num_speakers"), strategy.name, grammar))
    return asked.withColumn("response_schema", schema_json(F.col("num_speakers"))) if strategy.schema else asked


def run(strategy: Strategy, samples: DataFrame, backend: Backend, speakers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, info) of a strategy over samples (sample_id, duration_seconds, num_speakers[, ref_speakers]).

    ``turns`` is (sample_id, turn_idx, speaker, text, tag). ``info`` is (sample_id, latency_ms, triggered, reason,
    error), one row per sample: the gate's own decision, taken from stage-1 turns, and the first error met.
    A sample whose first call fails has no turns; one whose second call fails keeps its stage-1 turns and the
    first call's latency alone.
    """
    samples = requests(strategy, samples, speakers)
    one = backend(samples, "stage1")
    info = one.select("sample_id", F.col("latency_ms").alias("l1"), F.col("error").alias("e1"))
    none = F.lit(None).cast("string")
    if strategy.second is None:
        turns = parsers.parse(one, strategy.first)
        return turns, info.select("sample_id", F.coalesce("l1", F.lit(0)).cast("long").alias("latency_ms"), F.lit(False).alias("triggered"), none.alias("reason"), F.col("e1").alias("error"))
    if strategy.second == "text":
        asked = one.where("error is null").select("sample_id", second_prompt(F.col("num_speakers"), strategy.name, F.col("raw_response")).alias("prompt"))
        two = backend(asked, "stage2")
        turns = parsers.parse(two, strategy.first)
        both = info.join(two.select("sample_id", F.col("latency_ms").alias("l2"), F.col("error").alias("e2")), "sample_id", "left")
        return turns, both.select("sample_id", (F.coalesce("l1", F.lit(0)) + F.coalesce("l2", F.lit(0))).cast("long").alias("latency_ms"), F.lit(True).alias("triggered"), none.alias("reason"), F.coalesce("e1", "e2").alias("error"))
    first = parsers.parse(one, strategy.first)
    decided = gating.gate(samples, first)
    if not strategy.gated:
        decided = decided.select("sample_id", (F.col("reason") != "too_few_turns").alias("triggered"), F.when(F.col("reason") != "too_few_turns", F.lit("always")).otherwise(F.col("reason")).alias("reason"))
    chosen = first.join(decided.where("triggered").select("sample_id"), "sample_id", "left_semi")  # no call for the others
    context = one.select("sample_id", parsers.profile_block(F.coalesce("raw_response", F.lit(""))).alias("profiles"))
    prompts = gating.stage2_prompt(chosen, context=context, speakers=samples.select("sample_id", "num_speakers"))
    two = backend(prompts, "stage2")
    fixes = parsers.corrections(two.where("error is null"), "raw_response")
    turns = gating.apply_corrections(first, fixes, static=strategy.static)
    both = info.join(decided, "sample_id", "left").join(two.select("sample_id", F.col("latency_ms").alias("l2"), F.col("error").alias("e2")), "sample_id", "left")
    return turns, both.select("sample_id", (F.coalesce("l1", F.lit(0)) + F.when(F.col("e2").isNull(), F.coalesce("l2", F.lit(0))).otherwise(0)).cast("long").alias("latency_ms"), F.coalesce("triggered", F.lit(False)).alias("triggered"), "reason", F.coalesce("e1", "e2").alias("error"))


def combined_response(first, reason, second):
    """Both replies as one raw text."""
    return F.concat_ws("\n\n", F.concat(F.lit("--- stage 1 ---\n"), first), F.when(second.isNotNull(), F.concat(F.lit("--- stage 2, "), reason, F.lit(" ---\n"), second)))
