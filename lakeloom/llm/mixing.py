"""Mixing overlapping sources to target weights by min-cost flow.

A document may count for several *mixture parts*: its ``source`` and its ``lang``, or whatever an array of part names says, as of a document that several sources hold. Documents are aggregated by membership
pattern, the set of a document's parts, so the flow network has a node for each pattern, whatever the corpus. Tokens flow from the patterns to the parts' quotas. A pattern's supply is split in copies: the first costs nothing, each further one
costs more (convex, so copies are used in order), up to ``COPIES``. Every part has a quota of ``weight * budget`` tokens; what can't be filled flows from a dummy supply at a cost above any
repetition, so the flow is as full as it can be and, of the fullest, repeats least; what a part misses is logged. Capacities are whole tokens and flows exact: successive shortest paths with potentials.

The flow gives each pattern a number of tokens: whole passes over the pattern and a remainder, for which documents are drawn in the order of a seeded hash of their id until the remainder
is used. The cut in that order is found from sums over hash ranges, and then only the documents of one range are sorted, so nothing sorts a whole pattern.

Tokens are words: runs of characters other than white space (space, tab, newline, return, form feed, vertical tab). Defined cases. A null or blank text has no tokens and isn't drawn. Null ``source`` and ``lang`` are values of their own, ``""``; parts without a
weight get none; a document without parts isn't drawn. An empty table stays empty, and texts of any length are counted to their end. Repeated rows are drawn alike; with equal hashes the id decides, and rows of one id are drawn together. A null id hashes as such. Extra columns pass through.
"""

from __future__ import annotations

import heapq
import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import dropped, fresh, stored

#: The production mixture: shares of the budget by language part, and evenly by source; the tokens to draw as a share of those there are; copies of a document at most.
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}
LANG_SHARE, BUDGET, COPIES, SEED = 0.5, 0.9, 3, 17
#: Cost of a token's k-th copy: k * (k - 1) / 2 times this; a token that is missing costs MISSING.
REPEAT, MISSING = 10, 1000
RANGES = 4096
_LOG = logging.getLogger(__name__)


def tokens(text: Column) -> Column:
    """Words of a text as white space parts them; 0 for null and blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S++")).cast("long"), F.lit(0).cast("long"))


class Flow:
    """Min-cost flow by successive shortest paths with potentials; whole numbers throughout."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Total flow and cost. Costs must not be negative."""
        n = len(self.arcs)
        lift, flow, cost = [0] * n, 0, 0
        while True:
            far, via = [None] * n, [-1] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for e in self.arcs[v]:
                    w = self.to[e]
                    if self.room[e] > 0:
                        x = d + self.cost[e] + lift[v] - lift[w]
                        if far[w] is None or x < far[w]:
                            far[w], via[w] = x, e
                            heapq.heappush(heap, (x, w))
            if far[sink] is None:
                return flow, cost
            reach = max(d for d in far if d is not None)
            lift = [a + (reach if d is None else d) for a, d in zip(lift, far)]
            step, v = None, sink
            while v != source:
                step = self.room[via[v]] if step is None else min(step, self.room[via[v]])
                v = self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.room[via[v]] -= step
                self.room[via[v] ^ 1] += step
                cost += step * self.cost[via[v]]
                v = self.to[via[v] ^ 1]
            flow += step


def routed(supply: dict[tuple[str, ...], int], quotas: dict[str, int], copies: int = COPIES, unfilled: dict[str, int] | None = None) -> dict[tuple[str, ...], int]:
    """Tokens to take from each pattern (a tuple of the parts it belongs to) to fill the quotas; ``unfilled`` gets what each part misses."""
    patterns, parts = sorted(supply), sorted(quotas)
    net = Flow(len(patterns) + len(parts) + 2)
    source, sink = len(patterns) + len(parts), len(patterns) + len(parts) + 1
    part_at = {p: len(patterns) + k for k, p in enumerate(parts)}
    taken: dict[tuple[str, ...], list[int]] = {}
    for k, p in enumerate(patterns):
        taken[p] = [net.add(source, k, supply[p], REPEAT * c * (c + 1) // 2) for c in range(copies)]
        for part in p:
            if part in part_at:
                net.add(k, part_at[part], copies * supply[p], 0)
    lack = {}
    for part in parts:
        net.add(part_at[part], sink, quotas[part], 0)
        lack[part] = net.add(source, part_at[part], quotas[part], MISSING)
    net.run(source, sink)
    if unfilled is not None:
        unfilled.update((part, n) for part, e in lack.items() if (n := net.room[e ^ 1]))
    return {p: sum(net.room[e ^ 1] for e in arcs) for p, arcs in taken.items()}


def quotas(total: int, sources: list[str], langs: dict[str, float] = LANG_WEIGHTS, share: float = LANG_SHARE, budget: float = BUDGET) -> dict[str, int]:
    """Token quotas: ``share`` of the budget by language weight, the rest evenly over the sources."""
    out = {f"lang:{k}": int(total * budget * share * w) for k, w in langs.items()}
    for s in sources:
        out[f"source:{s}"] = int(total * budget * (1 - share) / len(sources))
    return out


def plan(stats: DataFrame, copies: int = COPIES, shares: dict[str, float] | None = None, **weights) -> list[tuple[list[str], int, int, int]]:
    """``pattern, passes, remainder, supply`` from ``pattern, tokens`` sums. ``shares``: of the tokens there are, how many to draw for each part; else by :func:`quotas`."""
    supply = {tuple(r["pattern"]): int(r["tokens"]) for r in stats.collect() if r["tokens"]}
    total = sum(supply.values())
    sources = sorted({x[7:] for p in supply for x in p if x.startswith("source:")})
    want = {k: int(total * v) for k, v in shares.items()} if shares is not None else quotas(total, sources, **weights)
    unfilled: dict[str, int] = {}
    takes = routed(supply, want, copies, unfilled)
    for part, n in unfilled.items():
        _LOG.warning("%s misses %d of its %d tokens: a document is drawn at most %d times", part, n, want[part], copies)
    return [(list(p), take // supply[p], take % supply[p], supply[p]) for p, take in sorted(takes.items())]


def by_source_and_language() -> Column:
    """A document's parts by its two columns."""
    return F.array(*[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("source", "lang")])


def drawn(docs: DataFrame, seed: int = SEED, parts: Column | None = None, **params) -> tuple[DataFrame, str]:
    """``docs`` with the number of copies of each row, and that column's name. ``parts``: an array of the names of a document's parts."""
    spark = docs.sparkSession
    names = {k: fresh(docs, k) for k in ("tokens", "u", "range", "p", "copies")}
    pattern = by_source_and_language() if parts is None else F.coalesce(F.array_sort(F.array_distinct(F.array_compact(parts))), F.array().cast("array<string>"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40))
    slim = docs.select(F.col("doc_id"), pattern.alias("pattern"), tokens(F.col("text")).alias("tokens"), u.alias("u")).where("tokens > 0")
    # sums over hash ranges serve both the patterns' supply and the cuts
    ranges = stored(slim.groupBy("pattern", F.expr(f"u div {(1 << 40) // RANGES}").alias("range")).agg(F.sum("tokens").alias("tokens")), "ranges")
    planned = plan(ranges.groupBy("pattern").agg(F.sum("tokens").alias("tokens")), **params)
    rest = spark.createDataFrame([(p, n) for p, _, n, _ in planned], "pattern array<string>, rest bigint")
    before = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("range")) - F.col("tokens")
    edge = ranges.join(F.broadcast(rest), "pattern").withColumn("before", before).where("before <= rest and before + tokens > rest").select("pattern", "range", "before", "rest")
    edges = edge.collect()
    dropped(ranges)
    # within the one range of each pattern, documents in order until the remainder is used
    marks = spark.createDataFrame([tuple(r) for r in edges], "pattern array<string>, range bigint, before bigint, rest bigint")
    inside = slim.withColumn("range", F.expr(f"u div {(1 << 40) // RANGES}")).join(F.broadcast(marks), ["pattern", "range"])
    by_doc = inside.groupBy("pattern", "before", "rest", "u", "doc_id").agg(F.sum("tokens").alias("tokens"))
    used = F.col("before") + F.sum("tokens").over(Window.partitionBy("pattern").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cuts = by_doc.withColumn("used", used).where("used <= rest").groupBy("pattern").agg(F.max(F.struct("u", "doc_id")).alias("last"))
    last = {tuple(r["pattern"]): (r["last"]["u"], r["last"]["doc_id"]) for r in cuts.collect()}
    start = {tuple(r["pattern"]): r["range"] * ((1 << 40) // RANGES) for r in edges}
    table = []
    for p, passes, _, _ in planned:
        at, doc = last.get(tuple(p), (start.get(tuple(p), 1 << 40) - 1, None))
        table.append((p, passes, at, doc))
    table = spark.createDataFrame(table, "p array<string>, passes int, cut bigint, doc bigint")
    held = F.broadcast(table.select(F.col("p").alias(names["p"]), "passes", "cut", F.col("doc").alias("cut_doc")))
    held = held.select(names["p"], F.struct("passes", "cut", "cut_doc").alias(names["range"]))
    out = docs.withColumns({names["p"]: pattern, names["u"]: u, names["tokens"]: tokens(F.col("text"))}).join(held, names["p"], "left")
    c, x = F.col(names["range"]), F.col(names["u"])
    more = (x < c["cut"]) | ((x == c["cut"]) & (c["cut_doc"].isNull() | F.coalesce(F.col("doc_id") <= c["cut_doc"], F.lit(True))))
    count = F.when((F.col(names["tokens"]) > 0) & c.isNotNull(), c["passes"] + more.cast("int")).otherwise(0)
    return out.select(*[F.col(f"`{n}`") for n in docs.columns], count.alias(names["copies"]), F.col(names["tokens"])), names["copies"]


def mixed(docs: DataFrame, seed: int = SEED, **params) -> DataFrame:
    """The drawn rows of ``docs``, each as often as it is drawn, with their columns."""
    out, copies = drawn(docs, seed, **params)
    keep = [F.col(f"`{n}`") for n in docs.columns]
    return out.where(F.col(copies) > 0).select(*keep, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawn document with its tokens and how often it is drawn."""
    out, copies = drawn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.where(F.col(copies) > 0).select("doc_id", "source", "lang", F.col("__tokens").alias("tokens"), F.col(copies).alias("copies"))
