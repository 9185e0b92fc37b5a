"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines of :mod:`.transducers` are compiled from the model file. The *normaliser* is two of them composed: the model's character map, if it has one, and the spaces' machine, which sets the
space mark before a text and for each space, and squeezes spaces if the model does. The *lexicon* maps characters to pieces: a prefix tree whose arcs into final states emit an id, with arcs that emit
``<0xNN>`` ids for the bytes of a character that no piece is, or the unknown id. The *grammar* reads pieces and remembers the last one:
its weight, in the tropical semiring, is 0 where two neighbours may stand side by side and infinite elsewhere. For a
merge (BPE) vocabulary two pieces are neighbours iff encoding their joined characters by merges gives just these two;
a sequence of pieces is the merge encoding iff all its neighbours are, so the one path of finite weight is that
encoding. For a unigram vocabulary there is no grammar, and an arc costs minus the piece's score. A text is composed with the machines lazily, state by state,
and the shortest path is read back.

No piece crosses from another character into a space mark, and with a vocabulary whose pieces don't mix letters with other characters none crosses between those,
so paths through a text factor into paths of its words, and a worker keeps the paths of recent words. With a merge vocabulary a word's path is found by :meth:`Transducer.only_path`, the same search without
layers of states, as there is one state at most for each place; tests hold it against :func:`.transducers.shortest` over the composed machines. A model without a character map and squeezing is normalised by replacing.

Defined cases. A null text has null ids; an empty one has none, and an empty table no rows. The space mark itself decodes to a space, as in the
original library, so a text that holds it isn't returned exactly (``exact`` is false), nor is one that normalisation changes. Control and byte pieces written
out in a text are ordinary characters; symbols that the model's user defined are never split. Decoding drops ids that don't exist, gives `` ⁇ `` for the unknown id and replaces bytes that aren't UTF-8. Repeated rows
and extra columns don't matter; texts of any length are read to their end. Of unigram paths of equal weight the one that is found first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, mapped, per_process
from .pieces import BYTE, CONTROL, NORMAL, TOKENIZER, UNKNOWN, USER, PieceModel
from .transducers import CharacterMap, Composed, Machine, Spaces, Tropical, shortest

MARK = "▁"


def segments(pieces: list[str]) -> re.Pattern:
    """Where texts may be cut: between characters that stand side by side in no piece.

    Characters are letters and digits, without those that share pieces with others, or others; if that leaves out an ASCII letter, only space marks cut.
    """
    word, out = re.compile("[^\\W_]").match, set()
    bare = [p.lstrip(MARK) for p in pieces]
    while more := {c for p in bare if any(not word(c) or c in out for c in p) for c in p if word(c) and c not in out}:
        out |= more
    if any(c.isascii() for c in out):
        return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    odd = "".join(sorted(out))
    lone = "" if any("\n" in p for p in pieces) else "\n|"
    return re.compile(f"{MARK}*[^\\W_{odd}]+|{lone}{MARK}*(?:[^\\w{MARK}\n]|[_{odd}])+|{MARK}+|\n")


class Transducer:
    """Normaliser, lexicon and grammar of one model file."""

    def __init__(self, path: str = TOKENIZER) -> None:
        self.model = m = PieceModel.load(path)
        if not m.escape:
            raise ValueError("only models that mark spaces are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER)}
        user = sorted((p for p, k in zip(m.pieces, m.kinds) if k == USER), key=lambda p: (-len(p), p))
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after other characters")
        self.segments = segments(list(self.ids))
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE} if m.byte_fallback else {}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        self.lexicon = self._lexicon()
        self.spaces = Spaces(MARK, m.dummy_prefix, m.squeeze)
        self.map = CharacterMap(m.charsmap) if m.charsmap else None
        self.normaliser = Composed(self.map, self.spaces) if self.map else self.spaces
        self.neighbours = Memo(self._neighbours, 250_000)  # by first id * 2^20 + second
        self.machine = Composed(self.lexicon, Neighbours(self)) if m.bpe else self.lexicon
        out = [b""] * len(m.pieces)
        for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
            out[i] = bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
        self.out = out

    def _lexicon(self) -> Machine:
        """Characters to ids. Each arc into a node of the prefix tree has a twin that ends the piece there and goes back to the root."""
        m = self.model
        least = min((m.scores[i] for i in self.ids.values()), default=0.0)
        cost = Tropical.one if m.bpe else 10.0 - least  # below any piece, as in the original library
        lexicon = Machine(lambda state, c: [(self.lone(c), cost, 0)] if state == 0 and c not in self.ids else [])
        self.tree: dict = {}
        at: dict[int, int] = {id(self.tree): 0}
        for p, i in self.ids.items():
            if m.bpe and m.kinds[i] == NORMAL and len(p) > 1 and [i] != self._merged(p):
                continue  # merges never end in this piece
            node = self.tree
            for k, c in enumerate(p):
                new = c not in node
                before, node = node, node.setdefault(c, {})
                if new:
                    at[id(node)] = lexicon.state()
                    lexicon.arc(at[id(before)], c, (), Tropical.one, at[id(node)])
                    if not at[id(before)] and c not in self.ids:  # such a character may also stand alone
                        lexicon.arc(0, c, self.lone(c), cost, 0)
                if k == len(p) - 1:
                    lexicon.arc(at[id(before)], c, (i,), Tropical.one if m.bpe else -m.scores[i], 0)
            node[""] = i
        lexicon.finals[0] = (), Tropical.one
        return lexicon

    def lone(self, c: str) -> tuple[int, ...]:
        """What stands for a character that no piece is."""
        return tuple(self.bytes[b] for b in c.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def _neighbours(self, pair: int) -> bool:
        a, b = pair >> 20, pair & 0xFFFFF
        return self._merged(self.model.pieces[a] + self.model.pieces[b]) == [a, b]

    def _merged(self, text: str) -> list[int]:
        """Ids by merging the neighbours whose union scores highest, leftmost first; -1 for a character that isn't a piece."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heappush(heap, (-self.model.scores[i], a, b, parts[a] + parts[b]))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids.get(p, -1) for p in parts if p is not None]

    def normalised(self, text: str) -> str:
        if not self.map and not self.model.squeeze:  # what the spaces' machine does
            text = text.replace(" ", MARK)
            return MARK + text if text and self.model.dummy_prefix else text
        parts = [(text, False)]
        if self.user and self.map:  # their symbols aren't mapped
            ends = [0, *(x for m in self.user.finditer(text) for x in m.span()), len(text)]
            parts = [(text[a:z], bool(k % 2)) for k, (a, z) in enumerate(zip(ends, ends[1:]))]
        mapped_ = "".join(t if kept or not self.map else "".join(shortest(self.map, t)[0]) for t, kept in parts)
        found = "".join(shortest(self.spaces, mapped_)[0])
        return found.rstrip(MARK) if self.model.squeeze else found

    def path(self, word: str) -> list[int]:
        """The shortest path of ``word`` through lexicon and grammar."""
        if self.model.bpe:
            return self.only_path(word)
        found = shortest(self.machine, word)
        return list(found[0]) if found else [i for c in word for i in self.lone(c)]

    def only_path(self, word: str) -> list[int]:
        """With a merge vocabulary every position has at most one state of finite weight: the last piece of its prefix's encoding."""
        tree, neighbours, known = self.tree, self.neighbours, self.ids
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        before = [0] * (n + 1)
        last[0] = -1  # also after bytes, which have any neighbours
        for i in range(n):
            state = last[i]
            if state is None:
                continue
            if word[i] not in known:
                last[i + 1], before[i + 1] = -1, i
            node, j = tree, i
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if (piece := node.get("")) is not None and (state < 0 or neighbours[state << 20 | piece]):
                    last[j], before[j] = piece, i
        at, found = n, []
        while at:
            i = before[at]
            if last[at] >= 0:
                found.append(last[at])
            else:
                found += self.lone(word[i])[::-1]
            at = i
        return found[::-1]

    def words(self, text: str) -> list[str]:
        """Parts of a normalised text whose paths are independent."""
        if not self.user:
            return self.segments.findall(text)
        out, at = [], 0
        for m in self.user.finditer(text):
            out += [*self.segments.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return [*out, *self.segments.findall(text[at:])]

    def word_path(self, word: str) -> list[int]:
        return [self.ids[word]] if self.user and self.user.fullmatch(word) else self.path(word)

    def joined(self, ids: list[int]) -> list[int]:
        """Neighbouring unknown ids are one, as in the original library."""
        return ids if self.bytes else [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]

    def encode(self, text: str) -> list[int]:
        return self.joined([i for word in self.words(self.normalised(text)) for i in self.word_path(word)])

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids if 0 <= i < len(out)]).decode("utf-8", "replace")
        return text[1:] if (self.model.dummy_prefix or self.model.squeeze) and text[:1] == " " else text


class Neighbours:
    """The grammar: a piece after another, if merges would leave the two side by side; bytes and unknown characters after anything. States are the last id, or -1."""

    start = -1

    def __init__(self, of: Transducer) -> None:
        self.of, self.alone = of, {*of.bytes.values()} or {of.unknown}

    def step(self, last: int, piece: int) -> list:
        if piece in self.alone:
            return [((piece,), Tropical.one, -1)]
        return [((piece,), Tropical.one, piece)] if last < 0 or self.of.neighbours[last << 20 | piece] else []

    def final(self, state: int) -> tuple[tuple, float]:
        return (), Tropical.one


def _machine(path: str) -> tuple[Transducer, Memo]:
    t = Transducer(path)
    return t, Memo(lambda word: np.array(t.word_path(word), np.int32).tobytes())


def encoded(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, n_ids, exact`` of each row; ``exact``: decoding the ids gives the text back. Narrow, reads two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = per_process(("sentence_pieces", path), lambda: _machine(path))
        of, out = words.__getitem__, machine.out.__getitem__
        for b in batches:
            flat, sizes, exact = [], [0], []
            for text in b.column(1).to_pylist():
                data = b"".join(map(of, machine.words(machine.normalised(text)))) if text else b""
                if data and not machine.bytes:
                    data = np.array(machine.joined(np.frombuffer(data, np.int32).tolist()), np.int32).tobytes()
                flat.append(data)
                sizes.append(sizes[-1] + len(data) // 4)
                if text is None:
                    exact.append(None)
                else:
                    back = b"".join(map(out, np.frombuffer(data, np.int32).tolist()))
                    exact.append(back[bool(data) and machine.model.dummy_prefix :] == text.encode("utf-8", "replace"))
            null = pa.array([e is None for e in exact])
            values = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(flat))])
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=null)
            count = pa.array([None if e is None else n for e, n in zip(exact, np.diff(sizes).tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, count, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "n_ids", "exact"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, ids array<int>, n_ids bigint, exact boolean", 512)


def decoded(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = per_process(("sentence_pieces", path), lambda: _machine(path))
        for b in batches:
            texts = [None if i is None else machine.decode([k for k in i if k is not None]) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(rows.select("doc_id", "ids"), run, "doc_id bigint, text string", 512)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
