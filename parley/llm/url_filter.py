"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

Rules are domain and path prefixes; the longest that fits decides. What no rule fits is scored by a model that is
trained here from a small labelled table of URLs. Hosts, paths and rules are column expressions; only the n-grams
are hashed in Arrow batches. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import unit_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: So many rules are carried in the plan; more ask for a list that has been cut down first.
MOST_RULES = 10_000
BUCKETS, ORDERS = 1 << 18, (3, 4, 5)
MOST_LABELLED, MOST_LABELLED_BYTES = 20_000, 2_000

#: A small labelled table: hosts and paths of sites that a corpus leaves out ...
BLOCKED = """
casino-royal.example/slots  online-casino.test/en/bonus  www.casino-bonus.example/play  m.lucky-casino.test/fr/spin  vegas-win.example/jackpot  big-win-slots.test/en/12
blog.win-money.example/spin  free-bets-online.test/en/odds  www.free-bets.example/sport  bets365-win.test/de/77  m.sport-bets.example/live  poker-free.test/es/3
www.texas-poker.example/room  jackpot-slots.test/free  cheap-pills-online.example/buy  www.cheap-viagra.test/en/order  m.cheap-meds.example/fr/9  pills-discount.test/rx
www.buy-pills.example/en/1  no-prescription-pills.test/cart  diet-pills-cheap.example/order  generic-cialis.test/cheap  pharmacy-cheap.example/en/55  blog.weight-loss-pills.test/fast
adult-videos.example/xxx  www.adult-chat.test/en/live  m.adult-x-tube.example/hot  xxx-adult.test/cams  sex-cams.example/live  www.porn-x.test/free
hot-adult-dating.example/join  escort-adult.test/en/4  x-rated.example/clips  ads-server.example/click  www.ads-track-net.test/pixel  m.ad-tracker.example/en/2
track-ads.test/redirect  click-track.example/r  adserver-track.test/imp  banner-ads.example/show  www.popup-ads.test/fr/8  blog.ads-network.example/en/66
spam-links.example/farm  www.link-farm.test/en/5  spamfarm.example/a  m.seo-spam.test/links  content-farm.example/en/90  backlink-farm.test/buy
www.spam-mail.example/list  farm-spam.test/de/31  free-money-now.example/win  work-home-rich.test/cash  payday-loans-cheap.example/apply  www.fast-loans.test/en/cash
crypto-win.example/double  www.double-bitcoin.test/free  replica-watches.example/cheap  cheap-bags-outlet.test/sale  warez-crack.example/keygen  www.free-cracks.test/serial
"""
#: ... and of sites that it keeps.
ALLOWED = """
www.city-library.example/en/hours  blog.garden-notes.test/2021/roses  m.daily-news.example/fr/politics  www.river-school.test/en/12  history-museum.example/de/rooms  science-journal.test/articles/77
en.open-wiki.example/water  www.weather-report.test/es/today  blog.mountain-walks.example/en/9  university-physics.test/courses  www.train-times.example/en/timetable  m.recipes-home.test/bread
cooking-with-anna.example/fr/soup  docs.python-guide.test/tutorial  www.linux-forum.example/threads/88  maths-for-all.test/en/algebra  blog.sailing-log.example/day/4  www.town-hall.test/council
health-service.example/en/advice  m.local-theatre.test/es/season  bird-watching.example/en/333  www.chess-club.test/openings  astronomy-letters.example/de/stars  blog.ceramics-studio.test/kiln
www.film-archive.example/en/directors  language-lessons.test/fr/verbs  m.river-fishing.example/maps  the-evening-post.test/en/world  www.bicycle-repair.example/chains  architecture-review.test/es/houses
www.geology-society.example/en/rocks  blog.the-other-thing.test/en/14  northern-herald.example/en/805  the-thought.test/fr/612.html  m.another-thread.example/de/40  www.thirteen-there.test/en/148
blog.nation-reader.example/es/22  www.station-notes.test/en/97  motion-and-rest.example/org/3  tension-lab.test/en/608  m.weather-there.example/en/77  www.thinking-then.test/fr/3
blog.other-hands.example/en/552  this-then-that.test/en/5  www.hand-and-eye.example/es/71  render-engine.test/docs  www.erosion-study.example/en/204  blog.inherent.test/fr/19
research-station.example/data  www.public-records.test/en/1889  open-maps.example/tiles  m.poetry-archive.test/en/sonnets  www.music-theory.example/scales  blog.old-books.test/de/binding
law-review.example/en/cases  www.plant-database.test/species  software-news.example/en/releases  m.family-tree.test/records  blog.winter-sports.example/fr/ski  www.water-board.test/en/reports
farmers-market.example/en/stalls  www.dairy-farm.test/visits  express-parcels.example/en/find  blog.adulthood.test/en/essays  trackside-railways.example/photos  www.free-software.test/en/licence
"""


def default_labels() -> list[tuple[str, int]]:
    return [(f"https://{u}", label) for text, label in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased and the path of a URL; both empty without ``://`` or URL."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(text, verdict) of the longest rule that fits, ties to the longer host; null if none does.

    The host's suffixes are looked up in a map of rules by host, so the work is that of a host's few labels,
    whatever the number of rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} travel in a plan")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(len(h)).alias("host_n"), F.lit(p).alias("path"), F.lit(h + p).alias("text"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    table = F.create_map(*chain.from_iterable((F.lit(h), F.array(*r)) for h, r in by_host.items()))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()))
    best = F.array_max(F.filter(named, lambda r: F.startswith(path, r.path)))
    return F.when(best.isNotNull(), F.struct(best.text.alias("text"), best.verdict.alias("verdict")))


def grams(texts: list[bytes], salt: int, *, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of bytes of each text between marks of its begin and end, in one pass over all."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(b"\x02" + t + b"\x03" for t in texts), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    rows, found = [], []
    for n in orders:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, salt * 1_000_003 + n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * np.uint64(0x100000001B3)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = row[:m] == row[n - 1 :]
        rows.append(row[:m][inside])
        found.append((h[inside] >> np.uint64(32)).astype(np.int64) % buckets)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    """Logistic regression over hashed n-grams; a URL's n-grams share a weight of one."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS

    def score(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The probability of ``block`` for each host and path."""
        row, bucket, share = _shares(hosts, paths, self.orders, len(self.weights))
        z = self.bias + np.bincount(row, self.weights[bucket] * share, minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shares(hosts: list[bytes], paths: list[bytes], orders: Sequence[int], buckets: int):
    r1, b1 = grams(hosts, 1, orders=orders, buckets=buckets)
    r2, b2 = grams(paths, 2, orders=orders, buckets=buckets)
    row, bucket = np.concatenate([r1, r2]), np.concatenate([b1, b2])
    n1, n2 = np.bincount(r1, minlength=len(hosts)), np.bincount(r2, minlength=len(hosts))
    # host and path each weigh the same, however long; three quarters go to the host
    share = np.concatenate([1.5 / np.sqrt(np.maximum(n1, 1))[r1], 0.5 / np.sqrt(np.maximum(n2, 1))[r2]])
    return row, bucket, share


def fit(hosts: list[bytes], paths: list[bytes], labels: np.ndarray, *, ridge: float = 0.0003, rounds: int = 400, rate: float = 4.0, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Model:
    """Gradient steps with momentum on the mean logistic loss; both classes weigh alike."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the one known label, or keep
        return Model(np.zeros(buckets), 30.0 if len(y) and y[0] else -30.0, orders)
    row, bucket, share = _shares(hosts, paths, orders, buckets)
    own = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, pace, pace0 = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    used = np.unique(bucket)
    for _ in range(rounds):
        z = bias + np.bincount(row, w[bucket] * share, minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * own
        slope = np.bincount(bucket, off[row] * share, minlength=buckets)[used] + ridge * w[used]
        pace[used] = 0.9 * pace[used] - rate * slope
        pace0 = 0.9 * pace0 - 0.1 * rate * off.sum()
        w[used] += pace[used]
        bias += pace0
    return Model(w, bias, orders)


def learn(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", most: int = MOST_LABELLED, **settings) -> Model:
    """A model from a labelled table (label 1: block); of more than ``most`` rows, about that many are drawn by a hash.

    Rows without URL or label are left out, and so are URLs of more than ``MOST_LABELLED_BYTES`` bytes, so what is
    gathered is bounded whatever the table. A table of one label gives that label to all; an empty one blocks nothing.
    """
    rows = labelled.select(F.col(url_col).cast("string").alias("__url"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where((F.octet_length("__url") <= MOST_LABELLED_BYTES) & F.col("label").isin(0, 1))
    n = rows.count()
    if n > most:
        rows = rows.where(unit_hash("__url", "label") < most / n).limit(2 * most)
    host, path = host_and_path(F.col("__url"))
    got = rows.select(host.alias("host"), path.alias("path"), "label").collect()
    return fit([r.host.encode() for r in got], [r.path.encode() for r in got], np.array([r.label for r in got]), **settings)


def judge(pages: DataFrame, model: Model, *, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of every row, whether its id or URL repeats or not.

    ``score`` is the model's probability of ``block``; it decides where no rule fits. A null URL, or one without
    ``://``, has an empty host and path, fits no rule and is scored as such. Very long URLs are scored whole, null ids
    stay null, other columns are ignored, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    parts = rows.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    flat = ruled.select("page_id", "host", "path", F.col("__rule.text").alias("rule"), F.col("__rule.verdict").alias("verdict"))
    schema = StructType([*flat.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score([t.encode() for t in batch.column(1).to_pylist()], [t.encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(score)], schema.names)

    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return flat.mapInArrow(run, schema).select("page_id", "host", "path", "rule", "score", F.coalesce("verdict", own).alias("verdict"))


def keep_allowed(pages: DataFrame, model: Model, *, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns."""
    names = pages.columns
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{url_col}`").alias("url"))
    judged = judge(row, model, rules=rules, id_col="row", url_col="url", threshold=threshold)
    return judged.where(F.col("verdict") == "allow").select(*[F.col("page_id")[c].alias(c) for c in names])
