"""Gradient-boosted trees on lexical features of URLs.

Features: length, path depth, digit ratio, entropy, numbers of parameters, host labels, hyphens and so on, and statistics of the suffix and of the
host's character pairs: smoothed log-odds of unwanted URLs with the same last host label, and the mean log-odds of the host's pairs, counted on the
training part. Labels: a table ``url, label``, the argument of :func:`fit`, or, as the test tables have none, a list of known unwanted sites. Trees are grown by
histograms on at most ``SAMPLE`` labelled URLs of either kind (those that hash lowest, so the same for any partitioning) with logistic loss, where rare unwanted
ones are repeated until they are at least ``SHARE`` of the fit; the cutoff is the lowest of at least 0 there at which at most ``FALSE`` of the held-out wanted URLs
are rejected. Scores are corrected for the share that unwanted URLs have in the table.

Features and trees are computed for a batch of URLs at once from their joined bytes. Nothing is shuffled but the training sample.

Defined cases. A null or blank URL has a null score and is rejected. One that has no scheme or host is scored on what it has; one of any length is read to its end. Repeated rows are judged alike, and extra
columns ignored; an empty table gives no rows. A URL with several labels counts as unwanted if any says so. Of splits equally good the first feature's lowest is taken. Without labels of both kinds every other URL is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import mapped

SAMPLE, TREES, DEPTH, RATE, FALSE, SHARE = 20_000, 40, 3, 0.3, 0.002, 0.1
#: Sites that stand for the unwanted in the pages' labels, by the first label of their registered domain.
KNOWN = ("spam-farm", "cheap-pills", "adult-x", "casino-win", "free-bets", "ads-track")
_SPLIT = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
NAMES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "query_length",
    "fragment", "https", "www", "extension", "upper_ratio", "vowel_ratio", "suffix_odds", "pair_odds",
)


def _entropy(rows: list[bytes]) -> np.ndarray:
    """Shannon entropy of the bytes of each row."""
    n = np.array([len(r) for r in rows])
    flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(rows)), n) * 256 + flat, minlength=256 * len(rows)).reshape(-1, 256)
    p = count / np.maximum(n, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def split(url: str) -> tuple[str, str, str, str, str]:
    scheme, host, path, query, fragment = (x or "" for x in _SPLIT.match(url.strip()).groups())
    return scheme.lower(), host.lower().rpartition("@")[2].split(":")[0], path, query, fragment


class Lexicon:
    """Log-odds of suffixes and of pairs of host characters."""

    def __init__(self, urls: list[str], y: np.ndarray) -> None:
        hosts = [split(u)[1] for u in urls]
        self.base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        self.suffix = self._odds([[h.rpartition(".")[2]] for h in hosts], y)
        self.pair = self._odds([self.pairs(h) for h in hosts], y)

    @staticmethod
    def pairs(host: str) -> list[str]:
        name = host.removeprefix("www.").rpartition(".")[0] or host
        return sorted({name[i : i + 2] for i in range(len(name) - 1)})

    def _odds(self, rows: list[list[str]], y: np.ndarray) -> dict[str, float]:
        count: dict[str, list[int]] = {}
        for row, k in zip(rows, y.tolist()):
            for x in row:
                count.setdefault(x, [0, 0])[int(k)] += 1
        return {x: float(np.log((b + 1) / (a + 1))) - self.base for x, (a, b) in count.items() if a + b >= 3}


def features(urls: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of ``NAMES`` for each URL."""
    out = np.zeros((len(urls), len(NAMES)), np.float32)
    if not urls:
        return out
    cut = [split(u) for u in urls]
    hosts, text = [c[1].encode("utf-8", "replace") for c in cut], [u.encode("utf-8", "replace") for u in urls]
    n = np.array([len(t) for t in text])
    flat, owner = np.frombuffer(b"".join(text), np.uint8), np.repeat(np.arange(len(text)), n)
    kinds = np.zeros((3, 256), bool)
    kinds[0, 48:58] = kinds[1, 65:91] = True
    kinds[2, list(b"aeiou")] = True
    digits, upper, vowels = (np.bincount(owner, k[flat], len(text)) for k in kinds)
    size = np.maximum(n, 1)
    for k, (scheme, host, path, query, fragment) in enumerate(cut):
        pairs = lexicon.pairs(host)
        last = path.rpartition("/")[2]
        out[k] = (
            n[k], len(host), len(path), path.count("/"), host.count(".") + 1, 0, sum(c.isdigit() for c in host), host.count("-"), 0, 0,
            len([p for p in re.split("[&;]", query) if p]), len(query), bool(fragment), scheme == "https", host.startswith("www."), "." in last, 0, 0,
            lexicon.suffix.get(host.rpartition(".")[2], 0.0), sum(lexicon.pair.get(p, 0.0) for p in pairs) / max(1, len(pairs)),
        )
    out[:, 5], out[:, 16], out[:, 17] = digits / size, upper / size, vowels / size
    out[:, 8], out[:, 9] = _entropy(text), _entropy(hosts)
    return out


class Boosted:
    """Logistic gradient boosting with histogram trees of a fixed depth, kept as arrays so that all rows descend at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 64) -> None:
        self.depth = depth
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # code <= k iff x <= edges[k]
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((trees, 2**depth - 1), np.int32)
        self.cut = np.full((trees, 2**depth - 1), np.inf, np.float32)
        self.leaf = np.zeros((trees, 2**depth), np.float64)
        f = np.full(len(y), self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first = 2**level - 1
                for k in range(2**level):
                    at = np.flatnonzero(node == first + k)
                    best = (1e-6, 0, np.inf)
                    total_g, total_h = g[at].sum(), h[at].sum()
                    for j, e in enumerate(edges):
                        if not len(e) or len(at) < 20:
                            continue
                        gs = np.cumsum(np.bincount(code[at, j], g[at], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(code[at, j], h[at], len(e) + 1))[:-1]
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        if gain.max() > best[0] + 1e-9:
                            best = (float(gain.max()), j, float(e[int(gain.argmax())]))
                    self.feature[t, first + k], self.cut[t, first + k] = best[1], best[2]
                where = node
                node = 2 * where + 1 + (x[np.arange(len(x)), self.feature[t, where]] > self.cut[t, where])
            leaf = node - (2**depth - 1)
            self.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            f += self.leaf[t, leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


class Model:
    """``shares``: the parts of the wanted and of the unwanted URLs that were drawn for ``urls``."""

    def __init__(self, urls: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0)) -> None:
        y = np.array(labels, np.float64)
        self.trees: Boosted | None = None
        self.cutoff, self.prior = np.inf, 0.0
        if not len(y) or y.min() == y.max():
            return
        fold = np.random.default_rng(9).random(len(y)) < 0.7
        for side in (0, 1):  # few of a kind are all fitted on
            if not fold[y == side].any():
                fold[y == side] = True
        train = [u for u, f in zip(urls, fold) if f]
        self.lexicon = Lexicon(train, y[fold])
        bad = int(y[fold].sum())
        times = max(1, int(SHARE / (1 - SHARE) * (len(train) - bad) / bad))
        self.prior = float(np.log(shares[0] / shares[1] / times))
        repeat = np.where(y[fold] == 1, times, 1)
        self.trees = Boosted(np.repeat(features(train, self.lexicon), repeat, 0), np.repeat(y[fold], repeat))
        held = self.trees.margin(features([u for u, f in zip(urls, fold) if not f], self.lexicon))
        good = np.sort(held[y[~fold] == 0])
        self.cutoff = max(0.0, float(good[min(len(good) - 1, int(np.ceil(len(good) * (1 - FALSE))))]) + 1e-9) if len(good) else 0.0

    def scores(self, urls: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.trees.margin(features(urls, self.lexicon)) - self.prior)) if self.trees else np.zeros(len(urls))

    @property
    def threshold(self) -> float:
        return float(1 / (1 + np.exp(-self.cutoff - self.prior)))


def known_label(url: Column, sites: tuple[str, ...] = KNOWN) -> Column:
    """1 for a URL of one of ``sites``, by the label before the last two of its host."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)", 1))
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, sites))).cast("int")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From ``url, label``; only the sample, ``sample`` URLs of either kind, goes to the driver."""
    whole = 1 << 30
    h = F.pmod(F.xxhash64("url", F.lit(31)), F.lit(whole))
    marked = labelled.where("url is not null and label in (0, 1)")
    unwanted = marked.where("label = 1")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    rows, shares = [], [1.0, 1.0]
    for k in (0, 1):
        # URLs that pass a hash filter, so only about four samples are shuffled; again with more where URLs repeat so often that too few are left
        limit = min(whole, 4 * whole * sample // max(1, counts.get(k, 0)) + 1) if counts.get(k) else 0
        while limit:
            # a URL of both labels is unwanted
            some = marked.where(h < limit).groupBy("url").agg(F.max("label").alias("label")).where(F.col("label") == k) if k == 0 else unwanted.where(h < limit).select("url", "label").distinct()
            got = some.withColumn("h", h).orderBy("h", "url").limit(sample).collect()
            if len(got) == sample or limit == whole:
                rows += got
                shares[k] = (got[-1]["h"] + 1) / whole if len(got) == sample else 1.0  # the part of the hash's range that the sample fills
                break
            limit = min(whole, limit * 64)
    return Model([r["url"] for r in rows], [r["label"] for r in rows], tuple(shares))


def judged(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, url, score, keep`` of each row."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            urls = b.column(1).to_pylist()
            some = [k for k, u in enumerate(urls) if u and u.strip()]
            value = m.scores([urls[k] for k in some])
            score: list = [None] * len(urls)
            kept = [False] * len(urls)
            for k, s in zip(some, value.tolist()):
                score[k], kept[k] = round(s, 9), s < m.threshold  # where unwanted URLs are rare, scores are small
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), keep], names=[key, "url", "score", "keep"])

    return mapped(pages.select(F.col(key).cast("long").alias(key), F.col(url).alias("url")), run, f"`{key}` bigint, url string, score double, keep boolean", 4096)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, fit(pages.select("url", known_label(F.col("url")).alias("label"))))
