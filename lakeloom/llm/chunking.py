"""Content-defined chunking of media payloads, deduplicated and verified.

A gear hash rolls over the bytes: ``h = (h << 1) + GEAR[byte]`` modulo 2^32, so it depends on the last 32 bytes and is
the same wherever they stand. It is computed for all positions of a batch by five doublings. A chunk ends where the
upper ``BITS`` bits are zero, at least ``LEAST`` and at most ``MOST`` bytes from its start, or at the payload's end.

Chunks are told apart by a 128-bit digest. Each payload keeps its *list*, the ordered digests. Joins by digest find which chunks occur more than once, and of each the first place.
The *store* keeps every chunk's bytes once, compressed, in the pack of the payload that holds its first place, so bytes are written where they are read and aren't shuffled; a payload whose chunks lie partly in other
packs gets those by a join, and only such payloads' packs move. For verification every payload is rebuilt from the written store alone, each chunk is hashed again, and the payload's
length and SHA-256 are compared with those of the original bytes, taken before they were cut.

Payloads are numbered by their place in the scan. Where a second scan would number them otherwise payloads come out as not verified.

Defined cases. A null payload has a null list and isn't verified; an empty one has an empty list and is; an empty table gives no rows. Rows of the same
id, also if they repeat, are payloads of their own. Ties between equal chunks don't matter: they're the same bytes. Very long payloads are held whole in one task, and hashed in slices. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dropped, mapped, stored

BITS, LEAST, MOST = 11, 512, 16_384
#: Bytes whose hashes are held at once; places of shared chunks up to this many are broadcast to where packs are written, beyond it they are joined.
SLICE, BROADCAST_PLACES = 4 << 20, 2_000_000
GEAR = np.frombuffer(hashlib.shake_256(b"lakeloom gear").digest(1024), np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte."""
    h = GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where chunks end."""
    n, start, ends = len(data), 0, []
    found = [np.zeros(0, int)]
    for a in range(0, n, SLICE):  # with the 31 bytes before, on which the first hashes depend
        b = max(0, a - 31)
        found.append(np.flatnonzero(rolling(np.frombuffer(data, np.uint8, min(n, a + SLICE) - b, b))[a - b :] < np.uint32(1 << (32 - bits))) + a + 1)
    where = np.concatenate(found)
    while n - start > least:
        k = np.searchsorted(where, start + least)
        end = int(where[k]) if k < len(where) else n
        start = min(end, start + most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _numbered(media: DataFrame, key: str, payload: str) -> DataFrame:
    return media.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(payload).cast("binary").alias("payload"))


def _pieces(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:z] for a, z in zip([0, *ends[:-1]], ends)]


def listed(media: DataFrame, key: str, payload: str) -> DataFrame:
    """``row, digests``: the list of each payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [None if data is None else [digest(p) for p in _pieces(data)] for data in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.binary()))], names=["row", "digests"])

    return mapped(_numbered(media, key, payload), run, "row bigint, digests array<binary>", 256)


def places(lists: DataFrame) -> DataFrame:
    """``row, n_shared, skip, lend, need`` of the payloads that hold chunks of several places: how many of their places are such; the places whose chunk is kept elsewhere;
    those kept here that other payloads need; and the digests that this one needs. A chunk of very many places is one row of the aggregate, and its places are split like any skewed join's."""
    every = lists.select("row", F.posexplode("digests").alias("at", "digest"))
    shared = every.groupBy("digest").agg(F.count("*").alias("refs"), F.min(F.struct("row", "at")).alias("kept"), F.max("row").alias("last")).where("refs > 1")
    x = every.join(shared.drop("refs"), "digest")
    here = (F.col("kept.row") == F.col("row")) & (F.col("kept.at") == F.col("at"))
    return x.groupBy("row").agg(
        F.count("*").alias("n_shared"), F.collect_list(F.when(~here, F.col("at"))).alias("skip"), F.collect_list(F.when(here & (F.col("last") != F.col("row")), F.col("at"))).alias("lend"),
        F.collect_set(F.when(F.col("kept.row") != F.col("row"), F.col("digest"))).alias("need"),
    )


STORE = "row bigint, id bigint, size bigint, whole string, digests array<binary>, n_shared bigint, need array<binary>, chunks array<struct<digest:binary,data:binary,lent:boolean>>"


def packs(media: DataFrame, key: str, payload: str, held: DataFrame) -> DataFrame:
    """The store: of each payload its list, size and SHA-256, and the chunks whose first place is there, compressed. ``held``: the table of :func:`places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        of = pa.struct([("digest", pa.binary()), ("data", pa.binary()), ("lent", pa.bool_())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.binary()), pa.list_(of)]
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for row, i, data, shared, skip, lend, need in zip(*(c.to_pylist() for c in b.columns)):
                if data is None:
                    made = (row, i, None, None, None, None, None, None)
                else:
                    proof, parts = hashlib.sha256(data).hexdigest(), _pieces(data)
                    names, gone, lent = [digest(p) for p in parts], set(skip or ()), set(lend or ())
                    chunks = [{"digest": d, "data": pack(p), "lent": at in lent} for at, (d, p) in enumerate(zip(names, parts)) if at not in gone]
                    made = (row, i, len(data), proof, names, shared or 0, need or [], chunks)
                for c, v in zip(cols, made):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in STORE.split(", ")])

    few = (held.agg(F.sum("n_shared")).first()[0] or 0) <= BROADCAST_PLACES
    return mapped(_numbered(media, key, payload).join(F.broadcast(held) if few else held, "row", "left"), run, STORE, 256)


def rebuilt(kept: DataFrame) -> DataFrame:
    """``row, id, payload`` from the store alone; the payload is null for a null list or where a chunk is missing or isn't what its digest says."""
    whole = kept.select("row", "id", "digests", "chunks", F.lit(None).cast("array<struct<digest:binary,data:binary>>").alias("more")).where("need is null or size(need) = 0")
    partly = kept.where("size(need) > 0")
    lent = kept.select(F.explode(F.filter("chunks", lambda c: c["lent"])).alias("c")).select("c.digest", "c.data")
    more = partly.select("row", F.explode("need").alias("digest")).join(lent, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "data")).alias("more"))
    partly = partly.join(more, "row", "left").select("row", "id", "digests", "chunks", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            got: list[bytes | None] = []
            for names, own, others in zip(*(c.to_pylist() for c in b.columns[2:])):
                if names is None:
                    got.append(None)
                    continue
                by = {c["digest"]: unpack(c["data"]) for c in (*own, *(others or ()))}
                parts = [by.get(d) for d in names]
                got.append(b"".join(parts) if all(p is not None for p in parts) and all(digest(p) == d for d, p in by.items()) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["row", "id", "payload"])

    return mapped(whole.unionByName(partly), run, "row bigint, id bigint, payload binary", 64)


def verified(media: DataFrame, key: str, payload: str) -> DataFrame:
    """``id, size, digests, n_chunks, n_shared, verified`` for each payload, rebuilt from the store that is written for it."""
    lists = stored(listed(media, key, payload), "lists")
    held = stored(places(lists), "places")
    kept = stored(packs(media, key, payload, held), "store")
    dropped(lists, held)
    there = F.col("digests").isNotNull()

    back = rebuilt(kept).select("row", F.length("payload").alias("length"), F.sha2("payload", 256).alias("proof"))
    same = F.coalesce((F.col("length") == F.col("size")) & (F.col("proof") == F.col("whole")), F.lit(False))
    out = kept.select("row", "id", "size", "whole", "digests", "n_shared").join(back, "row", "left")
    return out.select(
        "id", "size", F.transform("digests", lambda d: F.lower(F.hex(d))).alias("digests"), F.when(there, F.size("digests").cast("long")).alias("n_chunks"),
        F.when(there, F.col("n_shared")).alias("n_shared"), F.when(there, same).alias("verified"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pages as payloads."""
    return verified(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html").withColumnRenamed("id", "page_id")
