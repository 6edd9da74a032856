"""Scoring of hypothesis turns against reference turns, one row per sample (and strategy)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from ..functions.assignment import align, best_pairs, matched_speakers
from ..functions.distance import character_distance, edit_distance, error_rate, long_character_distance
from ..functions.text import normalize, words
from ..plans.balance import spread


def flat_words(turns: DataFrame, key: list[str], order: str = "turn_idx", words_col: str = "words") -> DataFrame:
    """(key.., pos, speaker, word): a sample's words in order with their speaker."""
    rows = turns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "speaker", F.col(words_col).alias("w")))).alias("t"))
    tagged = F.flatten(F.transform("t", lambda t: F.transform(t.w, lambda w: F.struct(t.speaker.alias("speaker"), w.alias("word")))))
    return rows.select(*key, F.posexplode(tagged).alias("pos", "x")).select(*key, "pos", "x.speaker", "x.word")


def tagged_arrays(turns: DataFrame, key: list[str], out: str, order: str = "turn_idx", words_col: str = "words") -> DataFrame:
    """(key.., out): arrays of (speaker, word) in order, the nested form of ``flat_words``."""
    rows = turns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "speaker", F.col(words_col).alias("w")))).alias("t"))
    return rows.select(*key, F.flatten(F.transform("t", lambda t: F.transform(t.w, lambda w: F.struct(t.speaker.alias("speaker"), w.alias("word"))))).alias(out))


def both_sides(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., h, r): both sides' turns of the samples that have both, dealt over all shuffle partitions.

    Gathered turns are many times as large as Spark takes them to be, so the join is a merge join: no side goes whole
    through the driver.
    """
    return _met(nested(hyp, key, "h"), nested(ref, ref_key, "r"), ref_key, key)


def _met(hyp: DataFrame, ref: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    return spread(hyp.hint("merge").join(ref, ref_key), *key)


def confusion(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., ref_speaker, hyp_speaker, n): words aligned as equal or substituted, by both speakers.

    Words go to the alignment with a speaker and a length for each turn, in Arrow batches.
    """
    both = both_sides(ref, hyp, ref_key, key)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *k, hs, hn, hw, rs, rn, rw in pdf.itertuples(index=False):
                out += [(*k, a, b, n) for (a, b), n in matched_speakers(list(rw), list(hw), np.repeat(rs, rn).tolist(), np.repeat(hs, hn).tolist()).items()]
            yield pd.DataFrame(out, columns=[*key, "ref_speaker", "hyp_speaker", "n"])

    kinds = ", ".join(f"{k} {t}" for k, t in both.select(*key).dtypes)
    side = lambda s: (F.col(f"{s}.speaker").alias(f"{s}s"), F.transform(F.col(f"{s}.words"), F.size).alias(f"{s}n"), F.flatten(f"{s}.words").alias(f"{s}w"))
    return both.where("size(h) > 0 and size(r) > 0").select(*key, *side("h"), *side("r")).mapInPandas(aligned, f"{kinds}, ref_speaker string, hyp_speaker string, n long")


def aligned_blocks(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., ref_from, hyp_from, n): runs of aligned words that go on by one on both sides, by word positions from 0."""
    both = tagged_arrays(hyp, key, "h").join(tagged_arrays(ref, ref_key, "r"), ref_key)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *k, h, r in pdf.itertuples(index=False):
                pairs = [(i, i) for i in range(len(r))] if len(r) == len(h) and (r == h).all() else align(list(r), list(h))
                starts = [x for x, (i, j) in enumerate(pairs) if not x or pairs[x - 1] != (i - 1, j - 1)]
                out += [(*k, *pairs[a], b - a) for a, b in zip(starts, [*starts[1:], len(pairs)], strict=True)]
            yield pd.DataFrame(out, columns=[*key, "ref_from", "hyp_from", "n"])

    kinds = ", ".join(f"{k} {t}" for k, t in both.select(*key).dtypes)
    return both.select(*key, "h.word", F.col("r.word").alias("ref_word")).mapInPandas(blocks, f"{kinds}, ref_from long, hyp_from long, n long")


def word_spans(turns: DataFrame, key: list[str], order: str = "turn_idx", words_col: str = "words") -> DataFrame:
    """(key.., order, speaker, from, to): the word positions of each turn that has words, ``to`` not included."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select(*key, order, "speaker", F.size(words_col).alias("__n")).where("__n > 0").withColumn("to", F.sum("__n").over(w))
    return rows.select(*key, order, "speaker", (F.col("to") - F.col("__n")).alias("from"), "to")


def turn_coverage(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str], order: str = "turn_idx") -> DataFrame:
    """(key.., order, speakers, n): for each hypothesis turn with words how many reference speakers its aligned words have, and how many those words are.

    Two range joins within a sample: hypothesis turns against aligned runs, and the reference side of these
    against reference turns. A turn without aligned words has 0 speakers; with two or more it is a merged turn.
    """
    h = word_spans(hyp, key, order)
    r = word_spans(ref, ref_key, order).select(*ref_key, F.col("speaker").alias("__s"), F.col("from").alias("__rf"), F.col("to").alias("__rt"))
    met = h.join(aligned_blocks(ref, hyp, ref_key, key), key).where("hyp_from < `to` and hyp_from + n > `from`")
    low, high = F.greatest("hyp_from", "from"), F.least(F.col("hyp_from") + F.col("n"), F.col("to"))
    met = met.withColumn("__f", low - F.col("hyp_from") + F.col("ref_from")).withColumn("__t", high - F.col("hyp_from") + F.col("ref_from"))
    said = met.join(r, ref_key).where("__rf < __t and __rt > __f").withColumn("__n", F.least("__t", "__rt") - F.greatest("__f", "__rf"))
    counts = said.groupBy(*key, order).agg(F.countDistinct("__s").alias("speakers"), F.sum("__n").alias("n"))
    return h.select(*key, order).join(counts, [*key, order], "left").na.fill(0, ["speakers", "n"])


def _matrix(cells: DataFrame, key: list[str], row: str, col: str, value: str) -> DataFrame:
    """(key.., rows, cols, m): sorted labels and the matrix of values, missing cells 0."""
    g = cells.groupBy(*key).agg(F.array_sort(F.collect_set(row)).alias("rows"), F.array_sort(F.collect_set(col)).alias("cols"), F.map_from_entries(F.collect_list(F.struct(F.struct(F.col(row).alias("r"), F.col(col).alias("c")), F.col(value).cast("double")))).alias("v"))
    m = F.expr("transform(rows, r -> transform(cols, c -> coalesce(try_element_at(v, named_struct('r', r, 'c', c)), 0D)))")
    return g.select(*key, "rows", "cols", m.alias("m"))


def assigned(matrices: DataFrame, key: list[str], maximize: bool) -> DataFrame:
    """(key.., total, weight, rows, cols): the best assignment's total, the sum of all cells, and the paired labels."""
    kinds = dict(matrices.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *k, rows, cols, m in pdf.itertuples(index=False):
                a = np.array([list(r) for r in m], float).reshape(len(rows), len(cols))
                total, pairs = best_pairs(a, maximize) if a.size else (0.0, [])
                out.append((*k, total, float(a.sum()), [rows[i] for i, _ in pairs], [cols[j] for _, j in pairs]))
            yield pd.DataFrame(out, columns=[*key, "total", "weight", "rows", "cols"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + f", total double, weight double, rows {kinds['rows']}, cols {kinds['cols']}"
    return matrices.select(*key, "rows", "cols", "m").mapInPandas(run, schema)


def speaker_accuracy(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key.., saa, mapping) from a confusion table: matched over aligned words under the best one-to-one mapping."""
    a = assigned(_matrix(cells, key, "ref_speaker", "hyp_speaker", "n"), key, True)
    return a.select(*key, F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).otherwise(0.0).alias("saa"), F.map_from_arrays("cols", "rows").alias("mapping"))


def speaker_documents(turns: DataFrame, key: list[str], order: str = "turn_idx", words_col: str = "words") -> DataFrame:
    """(key.., speaker, doc): each speaker's words in turn order."""
    rows = turns.groupBy(*key, "speaker").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(words_col).alias("w")))).alias("t"))
    return rows.select(*key, "speaker", F.flatten("t.w").alias("doc"))


def _both_documents(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., h, r): arrays of each side's (speaker, doc) in label order."""
    docs = lambda t, k, name: speaker_documents(t, k).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("speaker", "doc"))).alias(name))
    return _met(docs(hyp, key, "h"), docs(ref, ref_key, "r"), ref_key, key)


def cost_cells(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., i, j, cost): word distance between the i-th reference and j-th hypothesis speaker, padded square.

    Speakers are in label order; the shorter side is filled with empty documents. Both sides are a sample's few
    speakers, so the pairs of a sample are as few.
    """
    both = _both_documents(ref, hyp, ref_key, key)
    rows = both.select(*key, F.posexplode(_costs(F.col("r.doc"), F.col("h.doc"))).alias("i", "row"))
    return rows.select(*key, "i", F.posexplode("row").alias("j", "cost"))


def cpwer(ref: DataFrame, hyp: DataFrame, ref_key: list[str], key: list[str]) -> DataFrame:
    """(key.., cpwer, cost): least total speaker-wise word distance over the reference words.

    Samples present on one side only have no row here; ``evaluate`` gives them their fixed values.
    """
    both = _both_documents(ref, hyp, ref_key, key)
    n = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda s, x: s + F.size(x.doc))
    total = _least_cost(F.col("r.doc"), F.col("h.doc"))
    got = both.select(*key, total.alias("total"), n("r").alias("n_ref"), n("h").alias("n_hyp"))
    return got.select(*key, error_rate(F.col("total"), F.col("n_ref"), F.col("n_hyp")).alias("cpwer"), F.col("total").cast("long").alias("cost"))


def degradation_gap(cp: Column, w: Column) -> Column:
    return F.greatest(F.lit(0.0), cp - w)


_MATCH = StructType([StructField("matched", DoubleType()), StructField("aligned", LongType()), StructField("mapping", MapType(StringType(), StringType()))])


@F.pandas_udf(_MATCH)
def _speaker_match(ref: pd.Series, hyp: pd.Series, ref_by: pd.Series, ref_n: pd.Series, hyp_by: pd.Series, hyp_n: pd.Series) -> pd.DataFrame:
    """The best one-to-one mapping of speakers over aligned words; texts are joined words, speakers and counts go by turn."""
    out = []
    for r, h, rb, rn, hb, hn in zip(ref, hyp, ref_by, ref_n, hyp_by, hyp_n, strict=True):
        if not r or not h:
            out.append((None, None, None))
            continue
        n = matched_speakers(r.split(" "), h.split(" "), np.repeat(rb, rn).tolist(), np.repeat(hb, hn).tolist())
        rows, cols = sorted({a for a, _ in n}), sorted({b for _, b in n})
        total, pairs = best_pairs(np.array([[n.get((a, b), 0) for b in cols] for a in rows], float), True)
        out.append((total, sum(n.values()), {cols[j]: rows[i] for i, j in pairs}))
    return pd.DataFrame(out, columns=["matched", "aligned", "mapping"])


@F.pandas_udf(IntegerType())
def _joined_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word distance of texts of joined words, by bit vectors."""
    return pd.Series([None if a is None or b is None else character_distance(a.split(" "), b.split(" ")) for a, b in zip(ref, hyp, strict=True)], dtype="Int32")


def _cost_matrix(ref: list, hyp: list) -> list[list[int]]:
    """Word distances of all pairs of two sides' documents, the shorter side filled with empty ones."""
    k = max(len(ref), len(hyp))
    rs, hs = ([list(d) for d in side] + [[]] * (k - len(side)) for side in (ref, hyp))
    return [[character_distance(a, b) for b in hs] for a in rs]


def _least(ref: list, hyp: list) -> float:
    cells = _cost_matrix(ref, hyp)
    return best_pairs(np.array(cells, float), False)[0] if cells else 0.0


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _costs(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """``_cost_matrix`` of arrays of documents, each an array of words."""
    return pd.Series([_cost_matrix(r, h) for r, h in zip(ref, hyp, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def _least_cost(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The least total word distance of one-to-one pairs of documents, each an array of words."""
    return pd.Series([_least(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _least_total(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The same of documents that are texts of joined words."""
    split = lambda side: [d.split(" ") for d in side]
    return pd.Series([None if r is None or h is None else _least(split(r), split(h)) for r, h in zip(ref, hyp, strict=True)], dtype="float64")


def nested(turns: DataFrame, key: list[str], name: str, order: str = "turn_idx", words_col: str = "words") -> DataFrame:
    """(key.., name): a row's turns with words, as an array of (speaker, words) in order."""
    said = F.when(F.size(words_col) > 0, F.struct(F.col(order).alias("o"), "speaker", F.col(words_col).alias("words")))
    rows = turns.groupBy(*key).agg(F.array_sort(F.collect_list(said)).alias(name))
    return rows.select(*key, F.transform(name, lambda t: F.struct(t.speaker.alias("speaker"), t.words.alias("words"))).alias(name))


def score_nested(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds wer, cer, saa, cpwer, gap and mapping to rows that hold both sides' turns as arrays of (speaker, words).

    Null and empty arrays are sides without words. Everything is a column of the row: the only Python steps are one
    Arrow batch for characters, alignment and assignments, and metrics that nobody asks for are never computed.
    """
    none = F.array().cast("array<struct<speaker:string,words:array<string>>>")
    side = lambda c: F.filter(F.coalesce(F.col(c), none), lambda t: F.size(t.words) > 0)

    def said_by(turns: Column):
        return lambda name: F.array_join(F.flatten(F.filter(turns, lambda t: t.speaker == name).words), " ")

    got = rows.withColumn("__r", side(ref)).withColumn("__h", side(hyp))
    for s in ("r", "h"):
        turns = F.col(f"__{s}")
        names = F.array_sort(F.array_distinct(turns.speaker))
        got = got.withColumn(f"__{s}w", F.flatten(turns.words)).withColumn(f"__{s}d", F.transform(names, said_by(turns)))
        got = got.withColumn(f"__{s}t", F.array_join(f"__{s}w", " ")).withColumn(f"__{s}n", F.transform(turns.words, F.size))
    n, m = F.size("__rw"), F.size("__hw")
    empty, one = (n == 0) & (m == 0), (n == 0) | (m == 0)
    differ = ~one & (F.col("__rt") != F.col("__ht"))
    chars = F.coalesce(long_character_distance(F.when(differ, F.col("__rt")), F.when(differ, F.col("__ht"))), F.lit(0))
    match = _speaker_match("__rt", "__ht", F.col("__r.speaker"), "__rn", F.col("__h.speaker"), "__hn")
    least = _least_total(F.when(~one, F.col("__rd")), F.when(~one, F.col("__hd")))
    got = got.withColumn("wer", error_rate(F.coalesce(_joined_distance(F.when(differ, F.col("__rt")), F.when(differ, F.col("__ht"))), F.lit(0)), n, m))
    got = got.withColumn("cer", error_rate(chars, F.length("__rt"), F.length("__ht")))
    got = got.withColumn("__m", match).withColumn("mapping", F.col("__m.mapping"))
    saa = F.when(F.col("__m.aligned") > 0, F.col("__m.matched") / F.col("__m.aligned")).otherwise(0.0)
    got = got.withColumn("saa", F.when(empty, 1.0).when(one, 0.0).otherwise(saa))
    got = got.withColumn("cpwer", F.when(empty, 0.0).when(one, 1.0).otherwise(least / n))
    got = got.withColumn("gap", degradation_gap(F.col("cpwer"), F.col("wer")))
    return got.drop("__m", *[f"__{s}{x}" for s in "rh" for x in ("", "w", "d", "t", "n")])


def evaluate(samples: DataFrame, ref: DataFrame, hyp: DataFrame, key: str = "sample_id", strategy: str = "strategy") -> DataFrame:
    """One row per sample and strategy: wer, cer, saa, cpwer, gap, mapping and format_valid.

    ``ref`` is (key, turn_idx, speaker, text), ``hyp`` the same with a strategy; ``samples`` lists the (key,
    strategy) pairs to score, so samples without turns on either side are scored too. Texts are normalized
    once. ``format_valid`` tells whether the hypothesis had a turn before normalization.
    """
    both = [key, strategy]
    r, h = (t.withColumn("words", words(normalize(F.col("text")))) for t in (ref, hyp))
    rows = samples.select(*both).hint("merge").join(nested(r, [key], "__ref"), key, "left").hint("merge").join(nested(h, both, "__hyp"), both, "left")
    scored = score_nested(spread(rows, *both), "__ref", "__hyp").withColumn("format_valid", F.col("__hyp").isNotNull())
    return scored.select(*both, "wer", "cer", "saa", "cpwer", "gap", "mapping", "format_valid")


def evaluate_pair(ref: list[tuple[str, str]], hyp: list[tuple[str, str]]) -> dict[str, float]:
    """The same for one pair of (speaker, text) lists already normalized: the plain form tests compare with."""
    rw = [(s, w) for s, t in ref for w in t.split()]
    hw = [(s, w) for s, t in hyp for w in t.split()]
    rate = lambda d, n, m: 0.0 if not n and not m else 1.0 if not n or not m else d / n
    rs, hs = sorted({s for s, _ in rw}), sorted({s for s, _ in hw})
    out = {"wer": rate(edit_distance([w for _, w in rw], [w for _, w in hw]), len(rw), len(hw))}
    if not rw or not hw:
        return out | {"saa": float(not rw and not hw), "cpwer": rate(0, len(rw), len(hw)), "gap": 0.0}
    conf = np.zeros((len(rs), len(hs)))
    for i, j in align([w for _, w in rw], [w for _, w in hw]):
        conf[rs.index(rw[i][0]), hs.index(hw[j][0])] += 1
    k = max(len(rs), len(hs))
    doc = lambda side, names, i: [w for s, w in side if i < len(names) and s == names[i]]
    cost = np.array([[edit_distance(doc(rw, rs, i), doc(hw, hs, j)) for j in range(k)] for i in range(k)], float)
    out["saa"] = best_pairs(conf, True)[0] / conf.sum() if conf.sum() else 0.0
    out["cpwer"] = best_pairs(cost, False)[0] / len(rw)
    return out | {"gap": max(0.0, out["cpwer"] - out["wer"])}
