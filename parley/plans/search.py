"""Hill-climbing over prompts: evaluate, look at the worst samples, propose, keep what is no worse.

``climb`` takes any proposal; ``search`` has critiques and rewritten prompts made by a backend and keeps its generations
in a table, from which a broken run goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import compare, rollups
from ..operators.results import is_missing

#: From (requests, stage) to requests with raw_response and error.
Backend = Callable[[DataFrame, str], DataFrame]
HISTORY = "generation int, prompt string, fitness double, mean_saa double, mean_wer double, mean_gap double, accepted boolean, delta double"


def _fitness(means) -> float:
    return round(rollups.WEIGHTS["saa"] * means["saa"] + rollups.WEIGHTS["wer"] * max(0, 1 - means["wer"]) + rollups.WEIGHTS["gap"] * max(0, 1 - means["gap"]), 4)


def climb(spark: SparkSession, seed: str, evaluate: Callable[[str], DataFrame], propose: Callable[[str, list], str], rounds: int = 2, k: int = 3) -> tuple[str, DataFrame]:
    """(best prompt, history). ``evaluate`` scores a prompt: (sample_id, saa, wer, gap); ``propose`` gets the best
    prompt and its k worst samples. Only k rows and one row of means reach the driver in a round."""
    best, top, history, worst = seed, None, [], []
    for generation in range(rounds + 1):
        prompt = seed if generation == 0 else propose(best, worst)
        scored = evaluate(prompt)
        means = scored.selectExpr("avg(saa) saa", "avg(wer) wer", "avg(gap) gap").head()
        if means["saa"] is None:
            raise ValueError("no sample was scored")
        fit = _fitness(means)
        accepted = top is None or fit >= top
        history.append((generation, prompt, fit, means["saa"], means["wer"], means["gap"], accepted, 0.0 if top is None else fit - top))
        if accepted:
            best, top = prompt, fit
            worst = compare.worst(scored, k).collect()
    return best, spark.createDataFrame(history, HISTORY)


GENERATION = HISTORY + ", worst array<string>, error string"


def _rewritten(spark: SparkSession, best: str, worst: list, shown: Callable[[str, DataFrame], DataFrame], backend: Backend, key: str) -> tuple[str, str | None]:
    """(candidate, error): the worst samples are judged, and what is found goes into one request for a better prompt."""
    sides = shown(best, worst)
    asked = sides.select(key, prompts.critique(F.col("ref"), F.col("hyp")).alias("prompt"))
    judged = backend(asked, "critique")
    found = judged.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", F.col(key).cast("string"), "raw_response"))), "\n").alias("finding"), F.min("error").alias("e"))
    request = found.select(F.lit(0).cast("long").alias(key), prompts.mutation(F.lit(best), F.col("finding")).alias("prompt"), "e")
    reply = backend(request, "mutation").select(prompts.accepted(F.coalesce("raw_response", F.lit("")), F.lit(best)).alias("p"), F.coalesce("error", "e").alias("e")).head()
    return reply["p"], reply["e"]


def search(spark: SparkSession, seed: str, evaluate: Callable[[str], DataFrame], shown: Callable[[str, DataFrame], DataFrame], backend: Backend, path: str, rounds: int = 2, k: int = 3, key: str = "sample_id") -> tuple[str, DataFrame]:
    """(best prompt, history) of a search whose judges are calls of ``backend``.

    ``evaluate`` scores a prompt: (key, saa, wer, gap). ``shown`` gives the turns of listed samples under a prompt:
    (key, ref, hyp). In each generation the ``k`` worst samples of the best prompt are judged (stage ``critique``), and a
    new prompt is asked for with what was found (stage ``mutation``); a reply that is too short leaves the prompt as it is, so
    a failed call costs a generation, not the search. Each generation is written under ``path`` when it is done: a run that
    broke off goes on behind the last one written, and one that had finished gives its history again without a call.
    Only k ids, one row of means and one prompt reach the driver in a generation.
    """
    try:
        done = spark.read.schema(GENERATION).parquet(f"{path}/*").orderBy("generation").collect()
    except AnalysisException as e:
        if not is_missing(e):
            raise
        done = []
    best, top, worst = seed, None, []
    for r in done:
        if r["accepted"]:
            best, top, worst = r["prompt"], r["fitness"], r["worst"]
    for generation in range(len(done), rounds + 1):
        prompt, error = seed, None
        if generation:
            scored = evaluate(best)
            ids = scored.where(F.col(key).cast("string").isin(worst)).select(key)
            prompt, error = _rewritten(spark, best, ids, shown, backend, key)
        scored = evaluate(prompt)
        means = scored.selectExpr("avg(saa) saa", "avg(wer) wer", "avg(gap) gap").head()
        if means["saa"] is None:
            raise ValueError("no sample was scored")
        fit = _fitness(means)
        accepted = top is None or fit >= top
        least = [str(x[key]) for x in compare.worst(scored, k).collect()]
        row = (generation, prompt, fit, means["saa"], means["wer"], means["gap"], accepted, 0.0 if top is None else fit - top, least, error)
        spark.createDataFrame([row], GENERATION).coalesce(1).write.mode("overwrite").parquet(f"{path}/{generation:05d}")
        if accepted:
            best, top, worst = prompt, fit, least
    return best, spark.read.schema(GENERATION).parquet(f"{path}/*").where(F.col("generation") <= rounds).orderBy("generation")
