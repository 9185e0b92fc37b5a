"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel sums, over all subsequences of ``LENGTH`` characters, ``DECAY`` to the power of the spans they take in both strings, and is
normalised, so ``idiot``, ``id-iot`` and ``i d i o t`` are near each other. Sentences are seen through their *units*: words without
outer punctuation, in lower case; runs of three or more single characters, as spelt-out words are, also as one unit; two to ``PIECES`` neighbouring short words of at most ``SHORT``
characters, of which at least one isn't common in clean labelled documents, also as one, as of words broken by spaces; and units longer than ``SPAN`` through all their windows of that length, half a window apart.
A sentence scores as its highest unit, a document as its highest sentence. Words that clean labelled documents hold about as often as toxic ones (``KNOWN`` of them at least) are known to be clean, whatever they resemble.

Training is multiple-instance. Labels mark documents; every sentence of a document bears its label. Landmarks are the units most associated
with toxic sentences (by document log-odds) with the common units of clean ones that are nearest to them. A linear SVM with squared hinge loss, fitted on Nyström
features, sees the units of clean sentences as negatives and, for each toxic document, its highest unit as the positive, which is chosen again
after each fit, and spoilt forms of the chosen units as positives too; toxic documents whose units all score as clean are dropped as noise, and of copies
one is used. The threshold maximises F1 on a held-out part. At most ``LABELS`` labelled documents of either kind are fitted on; scoring reads every text from end to end.

Defined cases. Null and empty texts score null and are never toxic; an empty table gives no rows, and one without labels of both kinds a model that finds nothing. Repeated rows are judged alike, and extra columns ignored. Units that tie for
a document's score count alike, of sentences that tie the first is shown. Very long texts are read to their end. A labelled document with several labels is toxic if any says so.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, mapped, per_process

LENGTH, DECAY, SPAN, LANDMARKS, LABELS, ROUNDS = 3, 0.85, 16, 64, 2500, 6
SHORT, PIECES, KNOWN, HARD = 4, 3, 4, 16
#: Weights by subsequence are kept for at most this many different characters of the landmarks; with more, kernels are computed.
LETTERS = 120
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELT = re.compile(r"(?<!\S)(?:\S[^\S\n]+){2,}\S(?!\S)")


_BROKEN = re.compile(rf"(?<!\S)\S{{1,{SHORT}}}(?:[^\S\n]+\S{{1,{SHORT}}})+(?!\S)")


def units(token: str) -> list[str]:
    """The units of one part of a lower-case text."""
    word = _EDGE.sub("", token)
    if len(word) <= SPAN:
        return [word] if len(word) >= LENGTH else []
    return [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


_MARKS = ".,;:!?()[]\"'-*|"


def parts(text: str, common: frozenset[str] = frozenset()) -> list[str]:
    """Words, spelt-out runs and neighbouring short words of a text, repeated as they are. Of neighbours at least one isn't a ``common`` word."""
    low = text.lower()
    out = low.split() + _SPELT.findall(low)
    for run in _BROKEN.findall(low):
        words = run.split()
        for i, w in enumerate(words):
            if w in common or w.strip(_MARKS) in common:
                continue
            for a in range(max(0, i - PIECES + 1), i + 1):
                for z in range(max(i + 1, a + 2), min(len(words), a + PIECES) + 1):
                    joined = " ".join(words[a:z])
                    if LENGTH + 2 <= len(joined) <= SPAN:
                        out.append(joined)
    return out


#: Code of a character that isn't a letter or digit: it matches nothing, not even itself, and only takes its place in a span. 0 is after the end.
GAP = 1


def _codes(strings: list[str]) -> np.ndarray:
    flat = "".join(s.ljust(SPAN, "\0") for s in strings)
    out = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).copy()
    odd = [i for i, c in enumerate(flat) if not c.isalnum() and c != "\0"] if not flat.replace("\0", "").isalnum() else []
    out[odd] = GAP
    return out.reshape(len(strings), SPAN)


def kernel(a: np.ndarray, b: np.ndarray, decay: float = DECAY, length: int = LENGTH) -> np.ndarray:
    """Subsequence kernel of each string of ``a`` with each of ``b``, for all pairs at once.

    By the usual recursion over prefixes: reading one more character of ``a``, K'_i with the first j characters of ``b`` is ``decay`` times what it was plus K''_i,
    which runs along ``b`` and gains ``decay ** 2 * K'_(i-1)`` wherever the characters match.
    """
    n, m = len(a), len(b)
    wide, high = (int((x > 0).sum(1).max(initial=0)) for x in (b, a))
    lam = np.float32(decay)
    inner = [np.zeros((wide + 1, n, m), np.float32) for _ in range(length)]
    inner[0] += 1
    total, run, gain = (np.zeros((n, m), np.float32) for _ in range(3))
    to = np.where(b > GAP, b, 0xFFFFFFFF)
    for x in range(high):
        same = [np.multiply(a[:, x, None] == to[None, :, j], lam * lam, dtype=np.float32) for j in range(wide)]
        for j in range(length - 1, wide):
            np.multiply(same[j], inner[length - 1][j], out=gain)
            total += gain
        for i in range(length - 1, 0, -1):
            run[:] = 0
            for j in range(i - 1, wide):
                run *= lam
                np.multiply(same[j], inner[i - 1][j], out=gain)
                run += gain
                inner[i][j + 1] *= lam
                inner[i][j + 1] += run
    return total


def own(a: np.ndarray, decay: float = DECAY, length: int = LENGTH) -> np.ndarray:
    """The kernel of each string with itself."""
    n, wide, lam = len(a), int((a > 0).sum(1).max(initial=0)), np.float32(decay)
    inner = [np.zeros((wide + 1, n), np.float32) for _ in range(length)]
    inner[0] += 1
    total = np.zeros(n, np.float32)
    for x in range(wide):
        same = ((a[:, x, None] == a[:, :wide]) & (a[:, x, None] > GAP)).T.astype(np.float32) * (lam * lam)
        for j in range(length - 1, wide):
            total += same[j] * inner[length - 1][j]
        for i in range(length - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(wide):
                run = run * lam + same[j] * inner[i - 1][j]
                inner[i][j + 1] = inner[i][j + 1] * lam + run
    return total


def normalised(strings: list[str], marks: np.ndarray, marks_own: np.ndarray) -> np.ndarray:
    """Normalised kernel of strings with landmarks, in slices of strings of like length."""
    out = np.zeros((len(strings), len(marks)), np.float32)
    order = np.argsort([len(s) for s in strings], kind="stable")
    for i in range(0, len(order), 512):
        part = order[i : i + 512]
        codes = _codes([strings[k] for k in part])
        out[part] = kernel(codes, marks) / np.sqrt(np.maximum(own(codes), 1e-12)[:, None] * marks_own)
    return out


def _distinct(bags: list[list[str]]) -> list[bool]:
    """Which bags aren't near copies of an earlier one: three minimum hashes of longer units in common. Else a family of copies would vote many times."""
    odd = np.random.default_rng(1).integers(1, 1 << 31, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    out = []
    for bag in bags:
        h = np.array([crc32(u.encode()) for u in bag if len(u) >= 6] or [crc32(" ".join(bag).encode())], np.uint64)
        low = ((h[:, None] * odd) & np.uint64(0xFFFFFFFF)).min(0).reshape(4, 3).tolist()
        bands = {(k, *band) for k, band in enumerate(low)}
        out.append(not bands & seen)
        seen |= bands
    return out


def spoilt(unit: str, pick: np.random.Generator) -> list[str]:
    """A unit with gaps and with an inserted character, as positives of their own."""
    k = int(pick.integers(1, len(unit)))
    return [unit[:k] + "bcdfgjkmpqvwxyz"[pick.integers(15)] + unit[k:], unit[:k] + unit[k - 1] + unit[k:], unit[:k] + "*" + unit[k:], " ".join(unit)[:SPAN]]


class Model:
    """Landmarks and a weight for each; the threshold."""

    def __init__(self, texts: list[str], toxic: list[int]) -> None:
        self.threshold, self.bias = np.inf, 0.0
        self.name, self.clean = uuid.uuid4().hex, frozenset()
        self.marks, self.own, self.weights = np.zeros((0, SPAN), np.uint32), np.zeros(0, np.float32), np.zeros(0, np.float32)
        short = Counter(w for t, s in zip(texts, toxic) if not s for w in {x.strip(_MARKS) for x in t.lower().split() if len(x) <= SHORT + 2} if 0 < len(w) <= SHORT)
        self.common = frozenset(w for w, k in short.items() if k >= KNOWN)
        bags = [sorted({u for p in set(self.parts(t)) for u in units(p)}) for t in texts]
        fine = _distinct(bags)
        bags, y = [b for b, f in zip(bags, fine) if f], np.array([bool(t) for t, f in zip(toxic, fine) if f], bool)
        if not y.any() or y.all():
            return
        pick = np.random.default_rng(5)
        fold = pick.random(len(y)) < 0.75
        seen = [Counter(u for bag, f, s in zip(bags, fold, y) if f and s == side for u in bag) for side in (False, True)]
        n = [max(1, int((fold & (y == side)).sum())) for side in (False, True)]

        def worth(u: str) -> float:
            return seen[1][u] * float(np.log((seen[1][u] + 0.5) / (n[1] + 1) * (n[0] + 1) / (seen[0][u] + 0.5)))

        likely = sorted((u for u in seen[1] if seen[1][u] >= 3), key=lambda u: (-worth(u), u))[: LANDMARKS * 3 // 4]
        likely = [u for u in likely if worth(u) > 8 and seen[1][u] / n[1] > 8 * seen[0][u] / n[0]]
        if not likely:
            return
        clean = sorted(seen[0])
        marks = _codes(likely)
        close = normalised(clean, marks, own(marks)).max(1)
        often = np.log1p([seen[0][u] for u in clean])
        hard = [clean[k] for k in np.argsort(-close * often, kind="stable") if clean[k] not in likely][:HARD]
        self.marks = _codes(likely + hard)
        self.own = own(self.marks)
        w, v = np.linalg.eigh((kernel(self.marks, self.marks) / np.sqrt(self.own[:, None] * self.own)).astype(np.float64))
        root = v[:, w > 1e-5] / np.sqrt(w[w > 1e-5])
        # all clean units near a likely landmark, and every so many of the others; frequent and near ones weigh more
        order = np.argsort(-close, kind="stable")
        picked = np.concatenate((order[:4000], order[4000 :: max(1, len(order) // 8000)]))
        heavy = np.sqrt(np.array([seen[0][clean[k]] for k in picked], float)) * (0.02 + close[picked] ** 2)
        phi = normalised([clean[k] for k in picked], self.marks, self.own) @ root
        may = lambda u: seen[1][u] / n[1] > 4 * seen[0][u] / n[0]  # noqa: E731 - what clean documents hold about as often is no witness
        sacks = [sack for bag, f, s in zip(bags, fold, y) if f and s and (sack := [u for u in bag if may(u)])]
        value = dict(zip(flat := sorted({u for bag in sacks for u in bag}), normalised(flat, self.marks, self.own) @ root))
        chosen = [max((u for u in bag if u in likely), key=worth) for bag in sacks if set(bag) & set(likely)]
        for _ in range(ROUNDS):
            varied = [x for u in sorted(set(chosen)) for _ in range(6) for x in spoilt(u, pick)]
            pos = np.vstack([np.array([value[u] for u in chosen]), normalised(varied, self.marks, self.own) @ root])
            weight = np.concatenate((np.full(len(chosen), 0.5 / len(chosen)), np.full(len(varied), 0.5 / len(varied)), heavy / heavy.sum()))
            beta, bias = _svm(np.vstack((pos, phi)), np.concatenate((np.ones(len(pos)), -np.ones(len(phi)))), weight)
            heavy = np.where(phi @ beta + bias > -0.3, 3 * heavy, heavy)  # clean units that come near count more in the next fit
            best = [max(bag, key=lambda u: (value[u] @ beta, u)) for bag in sacks]
            chosen = [u for u in best if value[u] @ beta + bias > 0]
            if not chosen:
                return
        self.weights, self.bias = (root @ beta).astype(np.float32), float(bias)
        self.clean = frozenset(u for u, k in seen[0].items() if k >= KNOWN and seen[1][u] / n[1] <= 2 * k / n[0])
        self.compile()
        held = [(max(self.scores(bag), default=-9.0), s) for bag, f, s in zip(bags, fold, y) if not f]
        s, t = np.array([a for a, _ in held], float), np.array([b for _, b in held], bool)
        f1 = {round(cut, 3): round(2 * ((s >= cut) & t).sum() / max(1, (s >= cut).sum() + t.sum()), 3) for cut in np.linspace(-0.9, 0.9, 37)}
        # of cutoffs that are as good but for chance, one that leaves clean documents alone and spoilt forms, fitted beyond 1, above it
        top = [cut for cut, f in f1.items() if f >= max(f1.values()) - 0.004]
        self.threshold = max([cut for cut in top if cut <= 0.5], default=min(top)) if max(f1.values()) > 0 else np.inf

    def parts(self, text: str) -> list[str]:
        return parts(text, self.common)

    def compile(self) -> None:
        """The score is linear in the kernel's features, so landmarks and weights are one weight for each subsequence of ``LENGTH`` = 3 characters.

        ``table[a, b, c]`` is that weight by classes of characters, of which 0 is any that no landmark holds.
        """
        letters = np.unique(self.marks[self.marks > GAP])
        self.table = None
        if len(letters) > LETTERS:
            return  # the table would be large; kernels are computed instead
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        n = len(letters) + 1
        table = np.zeros((n, n, n))
        for mark, weight in zip(self.classes[self.marks], self.weights / np.sqrt(self.own)):
            for i, j, k in combinations(np.flatnonzero(mark), 3):
                table[mark[i], mark[j], mark[k]] += weight * DECAY ** (k - i + 1)
        self.table = table.reshape(-1).astype(np.float32)
        self.width = n

    def scores(self, strings: list[str]) -> np.ndarray:
        """Scores of units: normalised kernels with the landmarks times the weights; -9 of words known to be clean."""
        out = self.linear(strings)
        out[[i for i, s in enumerate(strings) if s in self.clean]] = -9
        return out

    def linear(self, strings: list[str]) -> np.ndarray:
        """Equal to normalised kernels with the landmarks times the weights."""
        if not len(self.weights):
            return np.full(len(strings), -9.0, np.float32)
        if self.table is None:
            return normalised(strings, self.marks, self.own) @ self.weights + np.float32(self.bias)
        out = np.zeros(len(strings), np.float32)
        order = np.argsort([len(s) for s in strings], kind="stable")
        for at in range(0, len(order), 8192):
            part = order[at : at + 8192]
            codes = _codes([strings[i] for i in part])
            wide = int((codes > 0).sum(1).max(initial=0))
            c = self.classes[codes[:, :wide]].T.astype(np.int32)
            total = np.zeros(len(part), np.float32)
            for j in range(1, wide - 1):
                for i in range(j):
                    two = (c[i] * self.width + c[j]) * self.width
                    for k in range(j + 1, wide):
                        total += self.table[two + c[k]] * np.float32(DECAY ** (k - i + 1))
            out[part] = total / np.sqrt(np.maximum(own(codes), 1e-12))
        return out + np.float32(self.bias)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps over the examples inside the margin."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    weight = weight / weight.sum()
    beta = np.zeros(x1.shape[1])
    reg = ridge * np.eye(len(beta))
    reg[-1, -1] = 1e-9
    for _ in range(30):
        inside = y * (x1 @ beta) < 1
        a = x1[inside] * weight[inside, None]
        new = np.linalg.solve(x1[inside].T @ a + reg, a.T @ y[inside])
        if np.allclose(new, beta, atol=1e-8):
            break
        beta = new
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> Model:
    """Fit on the ``bound`` labelled documents of either kind whose ids hash lowest."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    h = F.xxhash64("doc_id", F.lit(23))
    picked = marks.where("toxic = 0").orderBy(h, "doc_id").limit(bound).union(marks.where("toxic = 1").orderBy(h, "doc_id").limit(bound))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Model([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(docs: DataFrame, model: Model, only_toxic: bool = False) -> DataFrame:
    """``doc_id, score, n_toxic, sentence, toxic``: the highest score, how many sentences reach the threshold, and the worst of them."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = model.name  # of this fit: workers outlive it, and an address may come back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known, unit_of = per_process(("toxicity", key), lambda: (Memo(lambda p: -9.0, 200_000), Memo(lambda u: None, 200_000)))
        of = known.__getitem__

        def learn(missing: list[str]) -> None:
            cut = [units(p) for p in missing]
            flat = sorted({u for us in cut for u in us if u not in unit_of})
            if len(unit_of) + len(flat) > unit_of.limit:
                unit_of.clear()
                flat = sorted({u for us in cut for u in us})
            unit_of.update(zip(flat, m.scores(flat).tolist()))
            known.update((p, max((unit_of[u] for u in us), default=-9.0)) for p, us in zip(missing, cut))

        for b in batches:
            split = [None if not t else m.parts(t) for t in b.column(1).to_pylist()]
            fresh = set().union(*(w for w in split if w))
            known.limit = max(known.limit, len(fresh))
            if len(known) + len(fresh) > known.limit:
                known.clear()
            learn([p for p in fresh if p not in known])
            score = [None if not w else max(map(of, w)) for w in split]
            texts = b.column(1).to_pylist()
            bad, worst = [], []
            for t, s in zip(texts, score):
                if s is None or s < m.threshold:
                    bad.append(0)
                    worst.append(None)
                    continue
                sentences = [x for x in _END.split(t) if x.strip()]
                each = [max(map(of, p), default=-9.0) if (p := [q for q in m.parts(x) if q in known]) else -9.0 for x in sentences]
                bad.append(max(1, sum(e >= m.threshold for e in each)))
                worst.append(sentences[int(np.argmax(each))])
            flag = pa.array([s is not None and s >= m.threshold for s in score])
            out = [b.column(0), pa.array([None if s is None else round(s, 5) for s in score], pa.float64()), pa.array(bad, pa.int64()), pa.array(worst, pa.string()), flag]
            made = pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "n_toxic", "sentence", "toxic"])
            yield made.filter(flag) if only_toxic else made

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, score double, n_toxic bigint, sentence string, toxic boolean", 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), True)
