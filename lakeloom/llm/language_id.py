"""Language identification with a blended-spectrum string kernel.

``k(x, y)`` counts the distinct character n-grams, n = 1 to 3, that two texts share, divided by the square root of
``k(x, x) k(y, y)``. Landmarks give a Nyström feature map, one-versus-rest kernel ridge regression is fitted on
labelled texts, and a batch of documents is scored by two matrix products: presence times landmarks, times weights.
Word gaps and Latin letters up to U+00FC are classes of their own, so n-grams of them are a row of a table with 64 + 64^2 + 64^3 columns and aren't
sorted. N-grams that hold any other letter or mark keep it in lower case, whatever its script: they are whole numbers of three code points, and are
looked up among those of the landmarks, the only ones that count besides the text's number of n-grams.

The fit sees at most ``SAMPLE`` labelled documents a language, whole, and one sentence of each; scoring
sees every text from end to end. A document is rejected if it holds no letter, or if its scores contradict the declared language by
at least the declared language's margin, which about ``RISK`` of its correctly labelled documents reach. Margins are set from out-of-fold scores
(a text and its sentence share a fold) by median and median deviation of the lead of the declared language, so mislabelled rows, as long as they are
a minority of their language's sample, move them little, and one badly labelled language doesn't move the others'.

Defined cases. Null, empty and letterless texts get a null language and are rejected; an empty table gives none. Ties go to the language that
sorts first. Every declared language that has a text is fitted. A null declared language can't be contradicted. Without two labelled languages every text with letters
is accepted. Repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import NormalDist
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fresh, mapped

#: Labelled documents a language for the fit; landmarks, and of each language at least; ridge; share of clean documents that a margin may reject.
SAMPLE, LANDMARKS, FEWEST, RIDGE, RISK = 300, 96, 4, 1e-3, 0.01
#: Folds that are held out for the margins, and the least margin.
FOLDS, LEAST = 5, 0.3
WIDTH = 64 + 64**2 + 64**3
ROWS = 24


#: Class, from which letters aren't in the table, and code point that stands for a gap beside such letters.
OTHER, GAP = 57, 1


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point."""
    table, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.int64)
    for cp in range(0x32400):  # no letters are assigned beyond
        c = chr(cp)
        if c.isalpha() or cp >= 0x370 and category(c)[0] == "M":
            low = ord(c.lower()[0])
            lower[cp] = low
            table[cp] = 1 + low - 97 if 97 <= low <= 122 else 27 + low - 223 if 223 <= low <= 252 else OTHER
    lower[table == 0] = GAP
    return table, lower


CLASSES, LOWER = _classes()


def presence(texts: list[str], out: np.ndarray | None = None, others: list[np.ndarray] | None = None) -> np.ndarray:
    """A row for each text: which of the table's n-grams it holds. Runs of other characters count as one gap; text is set between gaps.
    ``others`` gets for each text its distinct n-grams that aren't in the table, in order.
    """
    out = np.zeros((len(texts), WIDTH), bool) if out is None else out[: len(texts)]
    out[:] = False
    for row, text in zip(out, texts):
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        code = np.concatenate(([0], CLASSES[points], [0])).astype(np.int32)
        kept = np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))
        code = code[kept]
        more = np.zeros(0, np.int64)
        if len(code) >= 3:
            two = code[:-1] * 64 + code[1:]
            three = two[:-1] * 64 + code[2:]
            one = code
            if (far := code >= OTHER).any():
                p = np.concatenate(([GAP], LOWER[points], [GAP]))[kept]
                in_two = far[:-1] | far[1:]
                in_three = in_two[:-1] | far[2:]
                pair = p[:-1] | p[1:] << 21
                more = np.unique(np.concatenate((p[far], pair[in_two], (pair[:-1] | p[2:] << 42)[in_three])))
                one, two, three = code[~far], two[~in_two], three[~in_three]
            row[one] = True
            row[0] = False
            row[64 + two] = True
            row[64 + 4096 + three] = True
        if others is not None:
            others.append(more)
    return out


class Model:
    """Fitted weights; small, whatever the corpus. ``groups``: texts of one group, by number, are held out together."""

    def __init__(self, texts: list[str], langs: list[str], groups: list[int] | None = None) -> None:
        self.langs = sorted(set(langs))
        order = np.random.default_rng(7).permutation(len(texts))
        texts, y = [texts[i] for i in order], np.array([self.langs.index(langs[i]) for i in order], int)
        # landmarks: as many texts of each language, the first of the sample's random order; rows are never held for the whole sample
        per = max(FEWEST, LANDMARKS // max(1, len(self.langs)))
        marks = [i for k in range(len(self.langs)) for i in np.flatnonzero(y == k)[:per].tolist()]
        others: list[np.ndarray] = []
        held = presence([texts[i] for i in marks], None, others)
        size = held.sum(1, dtype=np.float32) + np.array([len(o) for o in others], np.float32)
        others = [o for o, n in zip(others, size) if n]
        held, size = held[size > 0], size[size > 0]
        # n-grams outside the table, sorted, with the landmark that each is of
        keys, owner = np.concatenate([np.zeros(0, np.int64), *others]), np.repeat(np.arange(len(others)), [len(o) for o in others])
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.root_size = keys[by_key], owner[by_key].astype(np.int32), np.sqrt(size)
        self.cols = np.flatnonzero(held.any(0))
        self.marks = (held[:, self.cols] / np.sqrt(size)[:, None]).astype(np.float32)
        square = self.kernel(held, size, others)
        del held
        w, v = np.linalg.eigh(square.astype(np.float64)) if len(square) else (np.zeros(0), np.zeros((0, 0)))
        root = v[:, w > 1e-6] / np.sqrt(w[w > 1e-6])
        kernel = self.kernels(texts)[0] if texts else np.zeros((0, len(square)))
        phi = kernel @ root
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        beta = np.linalg.solve(phi.T @ phi + RIDGE * max(1, len(y)) * np.eye(phi.shape[1]), phi.T @ target) if phi.shape[1] else np.zeros((0, len(self.langs)))
        self.weights = (root @ beta).astype(np.float32)
        self.margins = np.full(len(self.langs), LEAST)
        if len(self.langs) > 1 and phi.shape[1]:
            fold = np.array([i if groups is None else groups[i] for i in order]) % FOLDS
            lead = np.zeros(len(y))
            for k in range(FOLDS):
                rest, out = fold != k, fold == k
                if rest.any() and out.any():
                    s = phi[out] @ np.linalg.solve(phi[rest].T @ phi[rest] + RIDGE * rest.sum() * np.eye(phi.shape[1]), phi[rest].T @ target[rest])
                    mine = s[np.arange(len(s)), y[out]].copy()
                    s[np.arange(len(s)), y[out]] = -np.inf
                    lead[out] = mine - s.max(1)
            for k in range(len(self.langs)):
                of = lead[y == k]
                middle = np.median(of)
                self.margins[k] = max(LEAST, NormalDist().inv_cdf(1 - RISK) * 1.4826 * np.median(np.abs(of - middle)) - middle)

    def kernel(self, rows: np.ndarray, size: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Of a batch of presence rows, and the n-grams that aren't in them, with the landmarks."""
        shared = rows[:, self.cols].astype(np.float32) @ self.marks.T
        for k, own in enumerate(others):
            if len(own) and len(self.keys):
                first = np.searchsorted(self.keys, own, "left")
                n = np.searchsorted(self.keys, own, "right") - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared[k] += np.bincount(self.owner[at], minlength=len(self.root_size)) / self.root_size
        return shared / np.sqrt(np.maximum(size, 1))[:, None]

    def kernels(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts with the landmarks, in batches, and each text's number of distinct n-grams."""
        buffer = np.empty((ROWS, WIDTH), bool)
        got, sizes = [], []
        for i in range(0, len(texts), ROWS):
            others: list[np.ndarray] = []
            rows = presence([t or "" for t in texts[i : i + ROWS]], buffer, others)
            sizes.append(np.array([np.count_nonzero(r) + len(o) for r, o in zip(rows, others)], np.float32))
            got.append(self.kernel(rows, sizes[-1], others))
        return np.concatenate(got), np.concatenate(sizes)

    def classify(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores for each text and language, and the number of distinct n-grams."""
        kernel, size = self.kernels(texts)
        return kernel @ self.weights, size


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s) >= 12]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` documents of each language whose ids hash lowest; a bounded gather, the same for any partitioning."""
    counts = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}  # of one narrow column
    h, whole = F.xxhash64("doc_id", F.lit(11)), 1 << 30
    share = {k: min(whole, 4 * whole * sample // n + 1) for k, n in counts.items()}
    got: dict[str, list[str]] = {}
    spark = docs.sparkSession
    while share:
        # one pass over the texts for all languages: of each about four times its sample pass a hash filter, the sample is the first of these
        limits = F.broadcast(spark.createDataFrame(sorted(share.items()), "__lang string, __share bigint"))
        some = docs.select("doc_id", "text", "lang").where("text is not null").join(limits, F.col("lang") == F.col("__lang")).where(F.pmod(h, F.lit(whole)) < F.col("__share"))
        first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(h, F.lit(whole)), "doc_id", "text"))
        found: dict[str, list[tuple[int, str]]] = {}
        for r in some.withColumn("__n", first).where(F.col("__n") <= sample).select("lang", "__n", "text").collect():
            found.setdefault(r["lang"], []).append((r["__n"], r["text"]))
        got |= {k: [t for _, t in sorted(v)] for k, v in found.items()}
        # again only where texts are null so often that the filter left too few
        share = {k: min(whole, 64 * s) for k, s in share.items() if s < whole and len(found.get(k, [])) < sample}
    texts, langs = [t for k in sorted(got) for t in got[k]], [k for k in sorted(got) for _ in got[k]]
    pick = np.random.default_rng(3)
    more = [(s[pick.integers(len(s))], k, i) for i, (t, k) in enumerate(zip(texts, langs)) if (s := _sentences(t))]
    return Model(texts + [s for s, _, _ in more], langs + [k for _, k, _ in more], [*range(len(texts)), *(i for _, _, i in more)])


SCHEMA = "pred_lang string, margin double, accepted boolean"


def identify(docs: DataFrame, model: Model, keep_all: bool = True) -> DataFrame:
    """``docs`` with ``SCHEMA``'s columns (named anew where they clash), or only the accepted rows with their own columns."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = {c.lower(): i for i, c in enumerate(names)}
    text, lang = at["text"], at["lang"]
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores, size = m.classify(b.column(text).to_pylist())
            if len(m.langs):
                best = scores.argmax(1)
                declared = b.column(lang).to_pylist()
                own = np.array([m.langs.index(k) if k in m.langs else -1 for k in declared])
                against = np.where(own >= 0, scores.max(1) - scores[np.arange(len(own)), np.maximum(own, 0)], 0.0)
                second = np.sort(scores, 1)[:, -2] if len(m.langs) > 1 else np.zeros(len(own))
                margin = (scores.max(1) - second).astype(float)
            else:
                best, against, margin = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
            seen = size > 0
            ok = seen & ((own < 0) | (against < m.margins[np.maximum(own, 0)]) if len(m.langs) > 1 else True)
            if keep_all:
                pred = pa.array([m.langs[k] if s and m.langs else None for k, s in zip(best, seen)], pa.string())
                extra = [pred, pa.array([round(x, 6) if s else None for x, s in zip(margin.tolist(), seen)], pa.float64()), pa.array(ok)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "a", "b", "c"])
            else:
                yield b.filter(pa.array(ok))

    if not keep_all:
        return mapped(docs, run, schema, 512)
    out = schema
    for c, kind in (x.split() for x in SCHEMA.split(", ")):
        out = type(out)(list(out.fields)).add(c if c not in at else fresh(docs, c), kind)
    return mapped(docs, run, out, 512)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).drop("text")
