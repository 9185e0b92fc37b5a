"""N-gram Jaccard self-join that skips by set relations; exact.

A text's set holds the 64-bit hashes of its runs of ``N`` words (all its words, if fewer). All pairs of documents with
Jaccard similarity of at least ``T`` are found, every document being a query. Nothing is sampled, capped or estimated.

The query gives one row for each document (:func:`linked`): its class, which is what links connect, and its number of links, so its result grows with the documents. All pairs
(:func:`similar_pairs`), whose number is quadratic in the copies, are there for small tables.

1. *Classes*. One pass over the texts gives each set's size and two order-free digests. Documents with equal digests are one set from here on.
2. *Rarity*. Each set's hashes go to buckets of about ``BUCKET`` tokens, packed in six bytes each. A bucket finds which tokens several sets hold and tells
   those sets, in like packed form, about how many hold each; tokens of one set are told by their absence.
3. *Index lists*. So a set knows the order of its tokens from the rarest on, and by the prefix filter (``size - ceil(T * size) + 1`` first tokens, ties included) it is
   listed under the tokens in that prefix, with its size and its position there. What many documents share, as passages and boilerplate, is at the end of the
   order, so lists hold little but true partners. A list is cut into blocks by position and sorted by size in each: the overlap that remains after a
   position bounds the similarity, so whole blocks of positions, and sizes out of range, are skipped, and a set without a possible partner leaves the list.
4. *Tiles*. Lists with the same smallest id are joined into one group, since near copies share most of their lists. A group of more than ``TILE`` sets or ``TOKENS`` tokens
   is cut into square tiles, each a task's work, so that a group of any size is spread out. Only for sets that are in a group n-grams are computed again and shuffled.
5. *Answers*. In a tile, a set's overlaps with all others come from inverted lists. The next set's overlaps are derived from those of an already
   answered, highly similar set: minus the lists of n-grams that only that set has, plus those that only this one has. Overlaps are exact.
6. *Links*. Two sets may meet in several groups. Each set brings the earlier ones of its groups along, and a pair counts in the first that it shares, so links are added up where they are found, as
   many for each set as documents hold the other, and no pair leaves a tile; what does are sums, and links that connect the tile's sets.

Words are runs of ``[a-z0-9_]`` and non-ASCII characters of the lower-cased text.

Defined cases. Null, empty and wordless texts and null ids have no pairs; an empty table has none. Rows that repeat an id are one document if their texts have the
same n-grams; otherwise each of its texts counts, and a pair is given once for each pair of texts. Very long texts are read to their end. Ties don't arise: pairs are sets. Extra columns are ignored.
In :func:`linked` each id has one row: documents without pairs are classes of their own without links, rows with a null id are left out, and of an id with several texts, which are one class, links are counted once for
each pair of its texts and those of other ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dropped, mapped, stored

N, T = 3, 0.5
#: Sets and tokens of a tile; tokens of a bucket of inverted lists, and of the texts that a task packs together.
TILE, TOKENS, BUCKET, PACK = 2048, 1_500_000, 2_000_000, 1_000_000
#: Ids up to this many (8 bytes each) are broadcast to pick the documents whose n-grams are needed; beyond it they are joined.
BROADCAST_IDS = 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if n > 1 << 22:  # of a very long text; not kept
        return [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _POWERS


def shingles(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams."""
    data = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    i = 0
    while i < len(data):  # about a megabyte at a time
        j, size = i, 0
        while j < len(data) and (j == i or size + len(data[j]) < 1 << 20):
            size += len(data[j]) + 1
            j += 1
        out += _shingles(data[i:j], n)
        i = j
    return out


def _shingles(data: list[bytes], n: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    up, down = _powers(len(raw))
    word = _WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    h = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    last = np.cumsum([len(d) + 1 for d in data])
    bounds = np.concatenate(([0], np.searchsorted(starts, last)))
    g = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        g = _mix(g * np.uint64(31) + h[k : k + len(g)])
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= n:
            out.append(np.unique(g[a : z - n + 1]))
        elif z > a:
            few = np.zeros(1, np.uint64)
            for k in range(a, z):
                few = _mix(few * np.uint64(31) + h[k : k + 1])
            out.append(_mix(few + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(size: np.ndarray, t: float) -> np.ndarray:
    """How many first tokens a set is listed under: sets at least ``t`` alike share one of them in any common order of tokens."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


#: What documents of the same set of n-grams share.
KEY = ("size", "sum", "xor")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """``KEY`` of each set."""
    sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    xors = np.array([np.bitwise_xor.reduce(_mix(s)) for s in sets], np.uint64).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int32()), pa.array(sums), pa.array(xors)]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, size, sum, xor``; one row for each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingles(b.column(1).to_pylist(), n)
            keep = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *_digests([sets[k] for k in keep])], names=["doc_id", *KEY])

    return mapped(_texts(docs), run, "doc_id bigint, size int, sum bigint, xor bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def packed(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """``bucket, pack, data``: the texts of a task in packs of about ``PACK`` tokens. A pack's row of bucket -1 has its documents' ids and sizes; the
    row of another bucket has the lower halves of the hashes that fall there and the number of the document that each is of. The bucket stands for the upper halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, task = [], [], 0, TaskContext.get()
        pack = (task.partitionId() if task else 0) << 20

        def batch() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held])
            flat = np.concatenate(held)
            own = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            to = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(to, kind="stable")
            low, own = flat[order].astype(np.uint32), own[order]
            there, first = np.unique(to[order], return_index=True)
            data = [np.array(ids, np.int64).tobytes() + sizes.astype(np.int32).tobytes()]
            data += [low[a:z].tobytes() + own[a:z].tobytes() for a, z in zip(first.tolist(), [*first[1:].tolist(), len(flat)])]
            at = [pa.array([-1, *there.tolist()], pa.int64()), pa.array([pack] * len(data), pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(at, names=["bucket", "pack", "data"])

        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), shingles(b.column(1).to_pylist(), n)):
                if len(s):
                    held.append(s)
                    ids.append(i)
                    size += len(s)
                if size >= PACK or len(held) == 1 << 16:
                    yield batch()
                    held, ids, size, pack = [], [], 0, pack + 1
        if held:
            yield batch()

    return mapped(_texts(docs), run, "bucket bigint, pack bigint, data binary", 256)


def _grouped(rows: DataFrame, answer, schema: str) -> DataFrame:
    """Apply ``answer(key, columns)``, which yields record batches, to the rows of each value of the first column."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            keys = np.asarray(b.column(0))
            cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(cut[:-1], cut[1:]):
                if a == z:
                    continue
                if held and keys[a] != last:
                    yield from answer(last, pa.Table.from_batches(held))
                    held = []
                last = int(keys[a])
                held.append(b.slice(a, z - a))
        if held:
            yield from answer(last, pa.Table.from_batches(held))

    return mapped(rows.repartition(key).sortWithinPartitions(key), run, schema, 4096)


def told(packs: DataFrame) -> DataFrame:
    """``pack, bucket, data`` for each pack and bucket: the tokens of the pack that several sets hold, each with the document's number and the logarithm of how many hold it. Rows of bucket -1 pass."""

    def answer(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pack, data = np.asarray(rows.column("pack").combine_chunks()), rows.column("data").to_pylist()
        n = np.array([len(d) // 6 for d in data])
        token = np.concatenate([np.frombuffer(d, np.uint32, k) for d, k in zip(data, n.tolist())])
        number = np.concatenate([np.frombuffer(d, np.uint16, k, 4 * k) for d, k in zip(data, n.tolist())])
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        more = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if not more.any():
            return
        token, order = token[more], order[more]
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        holders = np.diff(np.append(head, len(token)))
        often = np.repeat(np.floor(np.log2(holders)).astype(np.uint8), holders)
        of = np.repeat(np.arange(len(pack)), n)[order]
        by_pack = np.argsort(of, kind="stable")
        token, often, number, of = token[by_pack], often[by_pack], number[order][by_pack], of[by_pack]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist()
        for i in range(0, len(cut), 512):
            some = list(zip(cut[i : i + 512], [*cut[i + 1 : i + 513], *[len(of)] * (i + 512 >= len(cut))]))
            out = [token[a:z].tobytes() + number[a:z].tobytes() + often[a:z].tobytes() for a, z in some]
            yield pa.RecordBatch.from_arrays([pa.array(pack[of[[a for a, _ in some]]]), pa.array([bucket] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["pack", "bucket", "data"])

    return packs.where("bucket < 0").select("pack", "bucket", "data").unionByName(_grouped(packs.where("bucket >= 0"), answer, "pack bigint, bucket bigint, data binary"))


def listed(replies: DataFrame, t: float) -> DataFrame:
    """``bucket, data``: for each bucket the tokens there that are in a prefix, each with the set's id, its size and its position."""

    def answer(pack: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = sizes = None
        found: list[tuple] = []
        for bucket, d in zip(rows.column("bucket").to_pylist(), rows.column("data").to_pylist()):
            if bucket < 0:
                n = len(d) // 12
                ids, sizes = np.frombuffer(d, np.int64, n), np.frombuffer(d, np.int32, n, 8 * n)
                continue
            n = len(d) // 7
            found.append((np.frombuffer(d, np.uint32, n), np.frombuffer(d, np.uint16, n, 4 * n), np.frombuffer(d, np.uint8, n, 6 * n), np.full(n, bucket)))
        if not found:
            return
        token, number, often, bucket = (np.concatenate(c) for c in zip(*found))
        key = often.astype(np.uint64) << np.uint64(32) | token
        order = np.lexsort((key, number))
        key, number, token, bucket = key[order], number[order].astype(np.int64), token[order], bucket[order]
        shared = np.bincount(number, minlength=len(ids))
        start = np.cumsum(shared) - shared
        alone = sizes - shared  # tokens of this set only come first
        at = alone[number] + np.arange(len(number)) - start[number]
        room = prefix(sizes, t) - alone
        some = room > 0
        last = np.zeros(len(ids), np.uint64)
        last[some] = key[np.minimum(start + room, start + shared)[some] - 1]
        inside = some[number] & (key <= last[number])
        token, number, at, bucket = token[inside], number[inside], at[inside].astype(np.int32), bucket[inside]
        order = np.lexsort((number, bucket))
        token, number, at, bucket = token[order], number[order], at[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)].tolist()
        out = []
        for a, z in zip(cut, [*cut[1:], len(bucket)]):
            who, local = np.unique(number[a:z], return_inverse=True)
            out.append(np.array([len(who), z - a], np.int32).tobytes() + ids[who].tobytes() + sizes[who].tobytes() + token[a:z].tobytes() + at[a:z].tobytes() + local.astype(np.uint16).tobytes())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(out, pa.binary())], names=["bucket", "data"])

    return _grouped(replies, answer, "bucket bigint, data binary")


def partners(size: np.ndarray, at: np.ndarray, t: float) -> np.ndarray:
    """Which entries of one index list have a possible partner in it.

    Entries are grouped in blocks by position. If two sets are listed here for the first token that they share, it is no earlier than positions p and q, so they
    share at most ``min(size - p, size' - q)``; a block whose position leaves too little for its largest set is skipped as a whole.
    """
    order = np.lexsort((size, at))
    size, at = size[order].astype(np.float64), at[order]
    heads = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))
    found = np.zeros(len(at), bool)
    for a in range(len(heads) - 1):
        for b in range(a, len(heads) - 1):
            x, y = slice(heads[a], heads[a + 1]), slice(heads[b], heads[b + 1])
            if size[x][-1] < t * size[y][0] or size[y][-1] < t * size[x][0]:
                continue  # sizes out of range
            # for the best case sizes are equal: the overlap must reach 2 t s / (1 + t) and leaves s - position
            most = min(size[x][-1] - at[x][0], size[y][-1] - at[y][0])
            if most < t / (1 + t) * (size[x][0] + size[y][0]) - 1e-9:
                continue
            lo, hi = np.searchsorted(size[y], t * size[x] - 1e-9), np.searchsorted(size[y], size[x] / t + 1e-9, "right")
            some = hi - lo > (1 if a == b else 0)
            found[x] |= some
            lo, hi = np.searchsorted(size[x], t * size[y] - 1e-9), np.searchsorted(size[x], size[y] / t + 1e-9, "right")
            found[y] |= hi - lo > (1 if a == b else 0)
    out = np.zeros(len(at), bool)
    out[order] = found
    return out


def members(lists: DataFrame, t: float) -> DataFrame:
    """``block, rep, size`` of the sets that have a possible partner in a list; ``block`` is the smallest id of those."""

    def answer(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = []
        for d in rows.column("data").to_pylist():
            m, n = np.frombuffer(d, np.int32, 2).tolist()
            local = np.frombuffer(d, np.uint16, n, 8 + 12 * m + 8 * n)
            parts.append((np.frombuffer(d, np.uint32, n, 8 + 12 * m), np.frombuffer(d, np.int64, m, 8)[local], np.frombuffer(d, np.int32, m, 8 + 8 * m)[local], np.frombuffer(d, np.int32, n, 8 + 12 * m + 4 * n)))
        token, rep, size, at = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((size, token))
        token, rep, size, at = token[order], rep[order], size[order], at[order]
        # in a list, sorted by size, a set has no partner if its neighbours' sizes are out of range, and has one if enough remains for it and a neighbour after their positions
        near = (token[1:] == token[:-1]) & (size[:-1] >= t * size[1:] - 1e-9)
        enough = near & (np.minimum(size[:-1] - at[:-1], size[1:] - at[1:]) >= t / (1 + t) * (size[:-1] + size[1:]) - 1e-9)
        may, keep = (np.concatenate((x, [False])) | np.concatenate(([False], x)) for x in (near, enough))
        head = np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token))
        n = np.diff(head)
        open_ = np.add.reduceat(may & ~keep, head[:-1])
        for k in np.flatnonzero((open_ > 0) & (n > 2)).tolist():  # blocks of positions decide
            a, z = head[k], head[k + 1]
            keep[a:z] = partners(size[a:z], at[a:z], t)
        token, rep, size = token[keep], rep[keep], size[keep]
        if not len(token):
            return
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        block = np.repeat(np.minimum.reduceat(rep, head), np.diff(np.append(head, len(token))))
        order = np.lexsort((rep, block))
        block, rep, size = block[order], rep[order], size[order]
        new = np.concatenate(([True], (block[1:] != block[:-1]) | (rep[1:] != rep[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(rep[new]), pa.array(size[new])], names=["block", "rep", "size"])

    return _grouped(lists, answer, "block bigint, rep bigint, size int").groupBy("block", "rep").agg(F.max("size").alias("size"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of ``left`` its overlaps with every set of ``right``, derived from the answers of a similar set where one was just answered."""
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    tokens, heads = np.unique(flat, return_index=True)
    heads = np.append(heads, len(flat))

    def counted(s: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        k = k[tokens[k] == s]
        if not len(k):
            return np.zeros(len(right), np.int64)
        n = heads[k + 1] - heads[k]
        ids = owner[np.repeat(heads[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        return np.bincount(ids, minlength=len(right))

    known: tuple[np.ndarray, np.ndarray] | None = None
    for s in left:
        if known is not None:
            gone, new = np.setdiff1d(known[0], s, True), np.setdiff1d(s, known[0], True)
            if len(gone) + len(new) < len(s):
                known = s, known[1] - counted(gone) + counted(new)
                yield known[1]
                continue
        known = s, counted(s)
        yield known[1]


def tile_pairs(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], t: float, before: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a tile, some at a time: within it where ``side`` is all 0, else between sides 1 and 2. ``before``: for each set its earlier groups; sets that share one of them are no pair here."""
    if len(ids) == 2 and (side == 0).all():
        if before is not None and len(np.intersect1d(*before, True)):
            return
        both = len(np.intersect1d(sets[0], sets[1], True))
        j = both / (len(sets[0]) + len(sets[1]) - both)
        if j >= t:
            yield ids[:1], ids[1:], np.array([j])
        return
    # neighbours in this order are alike, which serves the derivation
    order = sorted(range(len(ids)), key=lambda k: tuple(sets[k][:4].tolist()))
    ids, side, sets = ids[order], side[order], [sets[k] for k in order]
    within = bool((side == 0).all())
    rows = range(len(ids)) if within else np.flatnonzero(side == 1)
    cols = np.arange(len(ids)) if within else np.flatnonzero(side == 2)
    if not len(rows) or not len(cols):
        return
    size = np.array([len(sets[k]) for k in cols])
    met: Iterator[np.ndarray | None] = repeat(None)
    if before is not None:
        left, right = ([before[order[k]] for k in part] for part in (rows, cols))
        if any(map(len, left)) and any(map(len, right)):
            met = overlaps(left, right)
    out: list[list[np.ndarray]] = [[], [], []]
    n = 0
    for k, both, earlier in zip(rows, overlaps([sets[k] for k in rows], [sets[k] for k in cols]), met):
        j = both / (len(sets[k]) + size - both)
        hit = j >= t
        if earlier is not None:
            hit &= earlier == 0
        if within:
            hit[: k + 1] = False
        some = int(hit.sum())
        if some:
            for c, x in zip(out, (np.full(some, ids[k]), ids[cols[hit]], j[hit])):
                c.append(x)
            n += some
        if n > 50_000:
            yield tuple(np.concatenate(c) for c in out)
            out, n = [[], [], []], 0
    if n:
        yield tuple(np.concatenate(c) for c in out)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, root) that connect what the pairs connect; fewer than there are members."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    links = [(x, top(x)) for x in parent if top(x) != x]
    return np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)


def tile_links(side: np.ndarray, sets: list[np.ndarray], before: list[np.ndarray], copies: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a tile how many documents hold those that are pairs with it, and the number of the first set that pairs connect it with."""
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for x, y, _ in tile_pairs(np.arange(len(sets)), side, sets, t, before):
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        new = root[x] != root[y]
        if new.any():  # few: near copies are soon connected
            to = np.arange(len(sets))
            member, first = _forest(root[x[new]], root[y[new]])
            to[member] = first
            root = to[root]
    return links, root


def placed(member: DataFrame) -> DataFrame:
    """``rep, tile, side`` and what else ``member`` has, from ``block, rep, size``. A list of few sets is one tile; of more, sets are dealt to parts and each two parts are a tile."""
    tiles = member.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TOKENS)).cast("int").alias("tiles"))
    dealt = member.join(tiles, "block").withColumn("c", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    more = [c for c in member.columns if c not in ("block", "rep", "size")]
    dealt = dealt.select("block", "rep", "c", *more, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("d"))
    side = F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2)
    return dealt.select("rep", F.xxhash64("block", F.least("c", "d"), F.greatest("c", "d")).alias("tile"), side.alias("side"), *more)


class _Joined:
    """What both uses of the join start from: tables in the shared folder, deleted by :meth:`end`."""

    def __init__(self, docs: DataFrame, n: int, t: float, counted: bool = False) -> None:
        """``counted``: links are to be counted, so ``copies`` must be the number of ids."""
        self.docs, self.n, self.t, self.counted = docs, n, t, counted
        self.sig = stored(signatures(docs, n), "signatures")
        held = F.min("doc_id").alias("rep"), F.count("*").alias("copies")
        self.classes = stored((self.sig.distinct() if counted else self.sig).groupBy(*KEY).agg(*held), "classes")
        firsts = self.classes.where("copies > 1").select(*KEY, "rep")
        # row by row: a set may have very many copies
        self.copies = stored(self.sig.select("doc_id", *KEY).join(firsts, list(KEY)).where("rep <> doc_id").select("doc_id").distinct(), "copies")
        self.tables = [self.sig, self.classes, self.copies]

    def near(self) -> DataFrame:
        """``block, rep, size``: lists of sets that may be near each other."""
        total = self.sig.agg(F.sum("size")).first()[0] or 0
        needless = self.copies.join(self.classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
        few = self.copies.count() <= BROADCAST_IDS
        once = self.docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(needless) if few else needless, "doc_id", "left_anti")
        if not few:  # a task that is run again must pack the same rows again
            once = once.sortWithinPartitions("doc_id", F.xxhash64("text"))
        packs = packed(once, self.n, max(1, -(-total // BUCKET)))
        member = stored(members(listed(told(packs), self.t), self.t), "members")
        self.tables.append(member)
        return member

    def odd(self) -> DataFrame:
        """``rep`` of ids that stand for several texts of different sets: their sets are told apart by digest. There are few or none."""
        return self.sig.select("doc_id", *KEY).distinct().groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("rep"))

    def sets(self) -> DataFrame:
        """``tile, rep, k, side, set``, where ``k`` is 0 or, of an id that stands for several sets, tells them apart; if links are counted also ``copies`` and ``before``, the set's earlier blocks."""
        n, member = self.n, self.near()
        needed = member.select("rep").distinct()
        source = _texts(self.docs).withColumnRenamed("doc_id", "rep")
        if needed.count() <= BROADCAST_IDS:
            needed = F.broadcast(needed)

        def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = shingles(b.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([b.column(0), *_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", *KEY, "set"])

        sets = mapped(source.join(needed, "rep", "left_semi"), shipped, "rep bigint, size int, sum bigint, xor bigint, set binary", 256).where("size > 0")
        odd, more = self.odd(), []
        if self.counted:
            blocks = member.groupBy("rep").agg(F.collect_list("block").alias("blocks"))
            member = member.join(blocks, "rep").select("block", "rep", "size", F.filter("blocks", lambda x: x < F.col("block")).alias("before"))
            more = ["before", "copies"]
        if odd.isEmpty():
            sets = sets.select("rep", F.lit(0).cast("long").alias("k"), "set")
            if self.counted:
                member = member.join(self.classes.select("rep", "copies"), "rep")
        else:  # of a set that several ids have, one row stands for it
            sets = sets.join(self.classes.select("rep", *KEY, *more[1:]), ["rep", *KEY], "inner" if self.counted else "left_semi").dropDuplicates(["rep", *KEY])
            sets = sets.join(odd.withColumn("odd", F.lit(True)), "rep", "left").select("rep", F.when(F.col("odd"), F.xxhash64(*KEY)).otherwise(0).alias("k"), "set", *more[1:])
        return sets.join(placed(member), "rep").select("tile", "rep", "k", "side", "set", *more)

    def found(self, forest: bool) -> DataFrame:
        """``a, ka, b, kb, jaccard`` of sets; for ``forest`` only links that connect them."""
        t = self.t

        def answer(tile: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            ids, k, side = (np.asarray(held.column(c).combine_chunks()) for c in ("rep", "k", "side"))
            some = tile_pairs(np.arange(len(ids)), side, [np.frombuffer(h, np.uint64) for h in held.column("set").to_pylist()], t)
            if forest:
                parts = list(some)
                links = _forest(*(np.concatenate([p[c] for p in parts]) for c in (0, 1))) if parts else None
                some = [(*links, np.ones(len(links[0])))] if links else []
            for x, y, j in some:
                x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[i]) for i in (x, y) for c in (ids, k)), pa.array(j)], names=["a", "ka", "b", "kb", "jaccard"])

        pairs = _grouped(self.sets(), answer, "a bigint, ka bigint, b bigint, kb bigint, jaccard double").where("a <> b")
        return pairs.distinct() if forest else pairs.groupBy("a", "ka", "b", "kb").agg(F.max("jaccard").alias("jaccard"))

    def sums(self) -> DataFrame:
        """``rep, k, to, links`` of sets: for each tile that has pairs of one, how many documents hold those that it is a pair with, and the id of a set that they connect it with."""
        t = self.t

        def answer(tile: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
            # rows that repeat an id and its text are one set
            once = np.unique([np.asarray(held.column(c).combine_chunks()) for c in ("rep", "k")], axis=1, return_index=True)[1]
            if len(once) < 2:
                return
            held = held.take(once) if len(once) < len(held) else held
            ids, k, side, copies = (np.asarray(held.column(c).combine_chunks()) for c in ("rep", "k", "side", "copies"))
            before = [np.array(x, np.int64) for x in held.column("before").to_pylist()]
            links, root = tile_links(side, [np.frombuffer(h, np.uint64) for h in held.column("set").to_pylist()], before, copies, t)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], k[some], ids[root[some]], links[some])], names=["rep", "k", "to", "links"])

        return _grouped(self.sets(), answer, "rep bigint, k bigint, to bigint, links bigint")

    def own(self, odd: DataFrame) -> DataFrame:
        """``doc_id, links`` that sets of one id, of those that have several, have among themselves."""
        n, t = self.n, self.t

        def answer(doc: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sets = [*{s.tobytes(): s for s in shingles(rows.column("text").to_pylist(), n) if len(s)}.values()]
            pairs = sum(len(x) for x, _, _ in tile_pairs(np.arange(len(sets)), np.zeros(len(sets)), sets, t)) if len(sets) > 1 else 0
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([2 * pairs], pa.int64())], names=["doc_id", "links"])

        return _grouped(_texts(self.docs).join(odd.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), answer, "doc_id bigint, links bigint")

    def end(self) -> None:
        dropped(*self.tables)


def similar_pairs(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """``doc_a, doc_b, jaccard`` with doc_a < doc_b for all pairs of documents at least ``t`` alike."""
    joined = _Joined(docs, n, t)
    # all pairs of copies are asked for, so their ids may be gathered
    many = joined.sig.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.array_sort(F.collect_set("doc_id")).alias("members")).where(F.size("members") > 1)
    same = many.select(F.posexplode("members").alias("i", "doc_a"), "members")
    same = same.select("doc_a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("doc_b"), F.lit(1.0).alias("jaccard"))
    near, odd = joined.found(False), joined.odd()
    if odd.isEmpty():
        many = many.withColumn("k", F.lit(0).cast("long"))
    else:
        many = many.join(odd.withColumn("odd", F.lit(True)), "rep", "left").withColumn("k", F.when(F.col("odd"), F.xxhash64(*KEY)).otherwise(0))
    for x in ("a", "b"):
        near = near.join(many.select(F.col("rep").alias(x), F.col("k").alias(f"k{x}"), F.col("members").alias(f"m{x}")), [x, f"k{x}"], "left")
    near = near.select("jaccard", "mb", "b", F.explode(F.coalesce("ma", F.array("a"))).alias("x")).select("jaccard", "x", F.explode(F.coalesce("mb", F.array("b"))).alias("y"))
    near = near.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return same.unionByName(near)


def linked(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """``doc_id, class_id, links``, a row for each document: the smallest id that links lead to, its own at most, and to how many documents it is at least ``t`` alike; a table in the shared folder."""
    joined = _Joined(docs, n, t, True)
    sums, odd = stored(joined.sums(), "sums"), stored(joined.odd(), "odd")
    links, k = sums.select(F.col("rep").alias("a"), F.col("to").alias("b")), F.lit(0).cast("long")
    held = joined.sig.distinct()
    several = not odd.isEmpty()
    if several:  # an id's texts are one document
        links = links.union(held.join(odd.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").join(joined.classes, list(KEY)).select("doc_id", "rep"))
        k = F.when(F.col("odd"), F.xxhash64(*KEY)).otherwise(0)
    roots = components(links)
    classes = joined.classes.join(odd.withColumn("odd", F.lit(True)), "rep", "left").withColumn("k", k)
    classes = classes.join(sums.groupBy("rep", "k").agg(F.sum("links").alias("links")), ["rep", "k"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*KEY, F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    rows = held.join(classes, list(KEY)).select("doc_id", "class_id", "links")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    rows = rows.union(ids.select("doc_id", "doc_id", F.lit(0)))  # those without words too
    if several:
        rows = rows.union(joined.own(odd).select("doc_id", "doc_id", -F.col("links")))
    out = stored(rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")), "linked")
    joined.end()
    dropped(sums, odd, roots)
    return out


def components(links: DataFrame) -> DataFrame:
    """``node, root`` from links ``a, b``: each node with the smallest of its connected component.

    Rounds of two steps, each node's larger neighbours to its smallest and its smaller neighbours to its smallest, end when no link changes;
    their number grows with the logarithm of the longest path. Each round is a table of its own in the shared folder.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*").where("a <> b").distinct()
        links, old = stored(step, "links"), links
        dropped(old)
        before, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.stored_at = links.stored_at
    return out


def surplus(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """``doc_id`` of every document that isn't the first (the smallest id) of its group of near duplicates; a table in the shared folder."""
    joined = _Joined(docs, n, t)
    roots = components(joined.found(True).select("a", "b"))
    # a copy of a set goes, its first document stays or goes with the set
    out = stored(joined.copies.union(roots.select(F.col("node").alias("doc_id"))).distinct(), "surplus")
    joined.end()
    dropped(roots)
    return out


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without near duplicates; of rows that repeat an id in a group each stays or goes alike. Ids to drop are broadcast up to ``BROADCAST_IDS``."""
    gone = surplus(docs, **params)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') as w from documents where doc_id is not null),
grams as (select distinct doc_id, case when len(w) < {N} then w else w[i:i + {N - 1}] end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {N - 2}, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as k from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
js as (select doc_a, doc_b, cast(k as double) / (x.n + y.n - k) as jaccard from shared join sizes x on x.doc_id = doc_a join sizes y on y.doc_id = doc_b),
links as materialized (select unnest([doc_a, doc_b]) as a, unnest([doc_b, doc_a]) as b from js where jaccard >= {T}),
reach as (select distinct a, a as root from links union select l.b, r.root from reach r join links l on l.a = r.a where r.root < l.b)
select doc_id, coalesce((select min(root) from reach where a = doc_id), doc_id) as class_id, (select count(*) from links where a = doc_id) as links
from (select distinct doc_id from documents where doc_id is not null)"""
