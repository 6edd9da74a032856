"""Toxicity by weak supervision.

Lexicon and pattern voters look at a text's words. A generative label model, fitted to the moments of
all documents' votes and to no label, estimates each voter's firing rates on toxic and on clean texts:
voters that are independent given the label have covariances of rank one. Pairs that stray from it are
correlated; the strongest form a forest, and for each of its pairs the model has the rate at which both
fire on either kind of text, from third moments with voters independent of the two. A linear classifier
with features of its own, hashed words beside the votes, is trained on the posteriors of unlabelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_bucket, small_batches, unit_hash

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_WORDS = re.compile(r"[^\W\d_]+")

#: Insults that need no label to be known, by language.
SEED_LEXICONS = {
    "en": "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb",
    "de": "idiot trottel depp dummkopf arschloch abschaum versager widerlich",
    "fr": "idiote imbécile connard crétin abruti ordure salaud minable",
    "es": "imbécil estúpido escoria basura asqueroso inútil payaso idiota",
}
SHARDS = 12
PREFIXES = (4, 5, 6)
WORD_FEATURES = 512


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def _features(found: set[str]) -> set[str]:
    """Words, and word beginnings as ``beginning*``."""
    return found | {w[:n] + "*" for n in PREFIXES for w in found if len(w) > n}


@dataclass
class Voters:
    """Learned terms dealt to voters. ``terms`` maps a word or ``beginning*`` to its voter."""

    terms: dict[str, int]
    n_terms: int
    names: list[str] = field(default_factory=list)

    def __post_init__(self):
        seeds = list(SEED_LEXICONS)
        self.names = [f"lexicon{i}" for i in range(SHARDS)] + [f"beginning{i}" for i in range(SHARDS)] + [f"seed_{s}" for s in seeds] + ["any_term", "two_terms", "four_terms", "dense"]
        self.whole = {t for t in self.terms if t[-1] != "*"}
        self.starts = {n: {t[:-1] for t in self.terms if t[-1] == "*" and len(t) == n + 1} for n in PREFIXES}
        self.seeds = [set(SEED_LEXICONS[s].split()) for s in seeds]

    def vote(self, text: str | None) -> np.ndarray:
        """One value a voter: 1 it fires, 0 it doesn't; then the counts that only the classifier sees."""
        found = words(text)
        out = np.zeros(len(self.names) + 2)
        hit = found & self.whole
        n = len(hit)
        for w in hit:
            out[self.terms[w]] = 1
        for size, known in self.starts.items():
            if known:
                begun = {w[:size] for w in found if len(w) > size} & known
                n += sum(1 for w in found if w[:size] in begun and len(w) > size) if begun else 0
                for b in begun:
                    out[SHARDS + self.terms[b + "*"]] = 1
        at = 2 * SHARDS
        for i, lexicon in enumerate(self.seeds):
            k = len(found & lexicon)
            out[at + i] = k > 0
            n = max(n, k)
        at += len(self.seeds)
        out[at : at + 4] = n >= 1, n >= 2, n >= 4, n >= 2 and n >= 0.01 * len(found)
        out[-2:] = np.log1p(n), min(1.0, 20 * n / (len(found) + 5))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """What the classifier sees: ``vote``, and the text's distinct words hashed to WORD_FEATURES places, of length 1."""
        found = words(text)
        at = np.fromiter((crc32(w.encode()) % WORD_FEATURES for w in found), np.int64, len(found))
        hashed = np.bincount(at, minlength=WORD_FEATURES).astype(np.float64)
        return np.concatenate([self.vote(text), hashed / max(1.0, float(np.sqrt(hashed @ hashed)))])


def sample(docs: DataFrame, labels: DataFrame, *, per_class: int, folds: int, held_out: int, work: Workspace) -> DataFrame:
    """(toxic, text) of about ``per_class`` unlike labelled texts of each class outside the held-out fold.

    Texts are drawn by a hash of themselves below a cut that the class's number of unlike texts sets and that is never
    below its least hash: copies don't count, no class is lost, and no task ranks one. The drawn hashes are at most
    a small multiple of ``per_class``, which bounds the broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (crc_bucket("doc_id", folds) != held_out)).distinct()
    text = F.col("text").cast("string")
    hashed = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), unit_hash(text).alias("u"))
    pairs = work.put(hashed.join(own, "doc_id").select("toxic", "u"), "pairs")
    found = pairs.groupBy("toxic").agg(F.approx_count_distinct("u", 0.02).alias("unlike"), F.min("u").alias("least")).collect()
    cut = F.create_map(*[F.lit(x) for r in found for x in (r["toxic"], max(r["least"], per_class / max(r["unlike"], 1)))]) if found else F.create_map(F.lit(0), F.lit(0.0))
    few = pairs.where(F.col("u") <= cut[F.col("toxic")]).distinct()
    return docs.select(text.alias("text"), unit_hash(text).alias("u")).join(F.broadcast(few), "u").dropDuplicates(["toxic", "u"]).select("toxic", "text")


def mine_terms(labelled: DataFrame, *, min_precision: float = 0.98) -> dict[str, int]:
    """Words and beginnings that mark toxic texts in the sample, dealt to voters in turn.

    A term needs at least four toxic texts and one in 100 of them, near copies counted once. A beginning that does as
    well stands for the words and longer beginnings under it.
    """

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py()) for t in batch.column(1)]
            # near copies of a text share their least word hash, and so count once
            least = [min(map(crc32, map(str.encode, f)), default=-1) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.int64())], ["toxic", "family"])

    def terms_of(known: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column(0):
                    found = words(text.as_py())
                    terms = list(_features(found) if known is None else _features(found) & known)
                    if terms:
                        family = min(crc32(w.encode()) for w in found)
                        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([family] * len(terms), pa.int64())], ["term", "family"])

        return run

    def counts(toxic: int, known: set[str] | None) -> DataFrame:
        rows = labelled.where(F.col("toxic") == toxic).select("text").mapInArrow(terms_of(known), "term string, family long")
        return rows.distinct().groupBy("term").agg(F.count("*").alias("n"))

    total = dict(labelled.select("toxic", "text").mapInArrow(families, "toxic int, family long").distinct().groupBy("toxic").count().collect())
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    support = max(4, n_pos // 100)
    pos = dict(counts(1, None).where(F.col("n") >= support).collect())
    neg = dict(counts(0, set(pos)).collect())

    def precise(term: str) -> float:
        # rates, not counts: the sample's classes are not in proportion
        a, b = (pos[term] + 0.05) / max(n_pos, 1), (neg.get(term, 0) + 0.05) / max(n_neg, 1)
        return a / (a + 5 * b)

    best = sorted((t for t in pos if precise(t) >= min_precision), key=lambda t: (-pos[t], len(t), t))
    kept: dict[str, int] = {}
    for term in best:
        stem = term.rstrip("*")
        under = [t for t in kept if t[-1] == "*" and stem.startswith(t[:-1])]
        if not under:
            kept[term] = pos[term]
    # a word whose own beginning came later and covers little more stays a word
    kept = {t: p for t, p in kept.items() if not (t[-1] == "*" and any(w[-1] != "*" and w.startswith(t[:-1]) and p <= 1.02 * q for w, q in kept.items()))}
    turn = [0, 0]
    out = {}
    for t in kept:
        kind = t[-1] == "*"
        out[t] = turn[kind] % SHARDS
        turn[kind] += 1
    return out


@dataclass
class LabelModel:
    """``parents[i]`` is the voter that i depends on, or -1; ``both_*`` are the rates at which the two fire together."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    used: np.ndarray
    correlated: np.ndarray
    parents: np.ndarray
    both_toxic: np.ndarray
    both_clean: np.ndarray

    def log_odds(self, votes: np.ndarray, none: int) -> np.ndarray:
        """Posterior log-odds of toxic. A voter that doesn't fire abstains; where none fires, the silence of
        the voter ``none``, which fires whenever another does, is the vote for clean."""
        a, b, p = self.on_toxic, self.on_clean, self.parents
        child = p >= 0
        with_a, with_b = self.both_toxic / a[p], self.both_clean / b[p]
        less_a, less_b = (a - self.both_toxic) / (1 - a[p]), (b - self.both_clean) / (1 - b[p])
        ratio = lambda x, y: np.log(np.maximum(x, 1e-4) / np.maximum(y, 1e-5))
        after = votes[:, p] * child
        fire = np.where(child, np.where(after > 0, ratio(with_a, with_b), ratio(less_a, less_b)), ratio(a, b))
        quiet = np.log((1 - a[none]) / (1 - b[none]))
        return np.log(self.prior / (1 - self.prior)) + (votes * fire * self.used).sum(1) + (votes.sum(1) == 0) * quiet


def fit_label_model(n: float, three: np.ndarray, prior: float, *, rounds: int = 4, stray: float = 0.1) -> LabelModel:
    """Accuracies and correlations from how often voters, pairs and triples of them fire over all documents.

    For voters i, j independent given the label, cov(i, j) = u_i u_j with u_i = sqrt(p (1 - p)) (a_i - b_i),
    a and b the firing rates on toxic and clean texts. u_i is the median of sqrt(c_ij c_ik / c_jk) over
    the pairs (j, k) not marked as correlated; pairs whose correlation differs from that by more than
    ``stray`` are marked, and the estimate is repeated without them. A marked pair's joint rates solve
    P(ij) = p a_ij + (1 - p) b_ij and P(ijk) = p a_ij a_k + (1 - p) b_ij b_k, the median over unmarked k.
    """
    v = len(three)
    every = np.arange(v)
    both = three[every, every, :] / max(n, 1.0)  # votes are 0 or 1, so E[i i k] = E[i k]
    m = np.diag(both).copy()
    cov = both - np.outer(m, m)
    sd = np.sqrt(np.maximum(m * (1 - m), 1e-12))
    used = m * n >= 3
    prior = min(max(prior, 1e-3), 0.5)
    unit = np.sqrt(prior * (1 - prior))
    marked = np.eye(v, dtype=bool)
    u = np.zeros(v)
    for _ in range(rounds):
        for i in np.flatnonzero(used):
            free = np.flatnonzero(used & ~marked[i] & (cov[i] > 0))
            est = [np.sqrt(cov[i, j] * cov[i, k] / cov[j, k]) for x, j in enumerate(free) for k in free[x + 1 :] if not marked[j, k] and cov[j, k] > 1e-12]
            u[i] = np.median(est) if est else (np.sqrt(max(cov[i][used & (every != i)].max(initial=0.0), 0.0)))
        u = np.clip(u, 0, sd)
        gap = np.abs(cov - np.outer(u, u)) / np.outer(sd, sd)
        then = (gap > stray) | np.eye(v, dtype=bool)
        then[~used] = then[:, ~used] = False
        # a voter keeps at least three partners, those that stray least
        for i in np.flatnonzero(used):
            closest = [j for j in np.argsort(gap[i]) if used[j] and j != i][:3]
            then[i, closest] = False
        if (then == marked).all():
            break
        marked = then
    a = np.clip(m + (1 - prior) * u / unit, 1e-4, 1 - 1e-4)
    b = np.clip(m - prior * u / unit, 1e-5, 1 - 1e-4)
    a = np.maximum(a, b)
    marked &= marked.T
    np.fill_diagonal(marked, False)
    parents, both_a, both_b = np.full(v, -1), np.zeros(v), np.zeros(v)
    gap = np.where(marked, np.abs(cov - np.outer(u, u)) / np.outer(sd, sd), 0)
    tree = every.copy()
    links: list[list[int]] = [[] for _ in range(v)]
    for i, j in sorted(zip(*np.nonzero(np.triu(gap)), strict=True), key=lambda x: -gap[x]):  # a maximum spanning forest
        if tree[i] != tree[j]:
            tree[tree == tree[j]] = tree[i]
            links[i].append(j)
            links[j].append(i)
    for root in every[tree == every]:
        queue, seen = [root], {int(root)}
        for x in queue:
            for c in links[x]:
                if int(c) not in seen:
                    seen.add(int(c))
                    parents[c] = x
                    queue.append(c)
    for i in np.flatnonzero(parents >= 0):
        j = parents[i]
        free = np.flatnonzero(used & ~marked[i] & ~marked[j] & (every != i) & (every != j) & (a - b > 0.02))
        est = (three[i, j, free] / max(n, 1.0) - b[free] * both[i, j]) / (prior * (a[free] - b[free])) if len(free) else [both[i, j] / prior]
        both_a[i] = np.clip(np.median(est), max(0.0, a[i] + a[j] - 1), min(a[i], a[j]))
        both_b[i] = np.clip((both[i, j] - prior * both_a[i]) / (1 - prior), max(0.0, b[i] + b[j] - 1), min(b[i], b[j]))
    return LabelModel(prior, a, b, used.astype(float), marked, parents, both_a, both_b)


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    coef: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Each text's score; features live for one text at a time."""
        z = np.fromiter((self.voters.features(t.as_py()) @ self.coef for t in texts), np.float64, len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, steps: int = 20) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * max(w.sum(), 1.0) / max(len(x), 1))
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (p - y)) + keep * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def triples(votes: np.ndarray) -> np.ndarray:
    """How often each triple of voters fires in these rows."""
    x = votes[votes.any(1)]
    return np.einsum("ni,nj,nk->ijk", x, x, x, optimize=True)


def moments(docs: DataFrame, voters: Voters, text_col: str = "text") -> tuple[float, np.ndarray]:
    """Over all documents: their count, and how often triples of voters fire. Each task sends one table."""
    v = len(voters.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((v, v, v))
        for batch in batches:
            x = np.array([voters.vote(t.as_py())[:v] for t in batch.column(0)]).reshape(-1, v)
            n, sums = n + len(x), sums + triples(x)
        at = np.flatnonzero(sums)
        at = at[(at // v**2 <= at // v % v) & (at // v % v <= at % v)]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*sums.ravel()[at].tolist(), float(n)], pa.float64())], ["at", "n"])

    got = dict(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect())
    n = got.pop(-1, 0.0)
    three = np.zeros((v, v, v))
    for at, k in got.items():
        for i, j, l in permutations((at // v**2, at // v % v, at % v)):
            three[i, j, l] = k
    return n, three


def unlabelled(docs: DataFrame, voters: Voters, n: float, fired: float, *, each: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of about ``each`` texts on which a voter fires and as many on which none does.

    Drawn by a hash of the text, whatever its labels; weights restore the two kinds' shares. Equal texts count once.
    """
    text = F.col(text_col).cast("string")
    some, none = (min(1.0, each / max(k, 1.0)) for k in (fired, n - fired))
    any_vote = voters.names.index("any_term")

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        us, kinds, xs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(us, pa.float64()), pa.array(kinds, pa.bool_()), pa.array(list(xs), pa.list_(pa.float64()))], ["u", "fires", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[float] = set()
        for batch in batches:
            rows = []
            for t, u in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if u not in seen:
                    seen.add(u)
                    x = voters.features(t.as_py())
                    fires = bool(x[any_vote] > 0)
                    if u <= (some if fires else none):
                        rows.append((u, fires, x))
                if len(rows) >= 256:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    drawn = docs.select(text.alias("text"), F.coalesce(unit_hash(text), F.lit(0.0)).alias("u")).where(F.col("u") <= max(some, none))
    got = drawn.mapInArrow(run, "u double, fires boolean, x array<double>").dropDuplicates(["u"]).collect()
    kinds = np.array([r["fires"] for r in got], bool)
    share = {True: fired / max(n, 1.0), False: 1 - fired / max(n, 1.0)}
    weight = np.array([share[bool(k)] / max((kinds == k).sum(), 1) for k in kinds])
    return np.array([r["x"] for r in got]).reshape(len(got), len(voters.names) + 2 + WORD_FEATURES), weight


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = 4000, each: int = 3000) -> Model:
    """Mine terms, fit the label model to all documents' votes, train the classifier on its posteriors.

    Labels serve the choice of terms, from about ``per_class`` unlike texts of each class, and the class prior, the
    share of toxic rows; both outside the held-out fold only. The label model and the classifier, which learns from
    about 2 x ``each`` texts, see no label. Without labels nothing is mined and the fixed lexicons vote alone.
    """
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_bucket("doc_id", folds) != held_out))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).head()[0]
    picked = work.put(sample(docs, labels, per_class=per_class, folds=folds, held_out=held_out, work=work), "picked")
    voters = Voters(terms := mine_terms(picked), len(terms))
    work.drop("pairs", "picked")
    n, three = moments(docs, voters)
    model = fit_label_model(n, three, 0.05 if prior is None else prior)
    v, none = len(voters.names), voters.names.index("any_term")
    x, weight = unlabelled(docs, voters, n, float(three[none, none, none]), each=each)
    if not len(x):
        x, weight = voters.features(None)[None], np.ones(1)
    posterior = 1 / (1 + np.exp(-np.clip(model.log_odds(x[:, :v], none), -30, 30)))
    coef, bias = _logistic(x, posterior, weight / weight.sum() * 4000)
    return Model(voters, model, coef, bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text alone.

    Null and empty texts have no votes and get the score of that. A null id counts as held out. Repeated
    rows each give a row, an empty table none; other columns are ignored. A very long text is one set of words,
    read whole. Ids must be numbers.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(True))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``. No shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
