"""Word-piece token counts by a linear longest-match automaton.

Words are what white space separates; a word is cut greedily into the longest piece that starts it, then the longest
continuation piece, and so on; a word that can't be cut to its end is one unknown token. The automaton is a trie of
first and continuation pieces. A node's failure link leads to where matching resumes once the node's longest pieces
are popped, and the node holds how many pieces that pops, so a word's count is a sum of small numbers: each character
costs amortised constant time and no piece is ever built. Words repeat, so a worker keeps the counts of recent ones.

Defined cases. A null text has null counts, an empty or blank one zeros. Repeated rows are counted alike, extra
columns are ignored, and text of any length is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, mapped, per_process
from .pieces import NORMAL, TOKENIZER, USER, PieceModel

UNKNOWN_ONE = 1 << 40  # a word's count is tokens + UNKNOWN_ONE * unknown words, so one sum gives both


class LongestMatch:
    """The automaton. Node 0 starts words, node 1 starts continuations."""

    def __init__(self, first: Iterable[str], rest: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        parents: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, words in ((0, first), (1, rest)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                        parents.append((node, c))
                    node = self.next[node][c]
                if word:
                    ends[node] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        layer = [*self.next[0].values(), *self.next[1].values()]
        while layer:  # breadth first: a node's failure link is to a node of lesser depth
            for v in layer:
                if ends[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                u, c = parents[v]
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped
            layer = [w for v in layer for w in self.next[v].values()]

    def count(self, word: str) -> int:
        """Pieces of a word without white space; ``1 + UNKNOWN_ONE`` if it has no cut."""
        nxt, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for c in word:
            while (to := nxt[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1 + UNKNOWN_ONE
            node = to
        while node > 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1 + UNKNOWN_ONE
        return total


def automaton(path: str = TOKENIZER) -> LongestMatch:
    """From a piece vocabulary: pieces with the space mark start words, others continue them."""
    m = PieceModel.load(path)
    words = [p for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER)]
    return LongestMatch([p[1:] for p in words if p[0] == "▁" and "▁" not in p[1:]], [p for p in words if "▁" not in p])


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of each row; narrow, reads two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Memo:
            return Memo(automaton(path).count)

        of = per_process(("token_counts", path), made).__getitem__
        for b in batches:
            words = [None if t is None else t.split() for t in b.column(1).to_pylist()]
            sums = [None if w is None else sum(map(of, w)) for w in words]
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([None if w is None else len(w) for w in words], long),
                    pa.array([None if s is None else s % UNKNOWN_ONE for s in sums], long),
                    pa.array([None if s is None else s // UNKNOWN_ONE for s in sums], long),
                ],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
