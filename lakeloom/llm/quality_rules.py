"""Quality rules with risk-controlled cutoffs.

Every rule compares one integer feature of a text (per mille) with a cutoff. Cutoffs are chosen per stratum (``lang``) from labelled documents, which are dealt by a hash
of their id to two halves. On the *choosing* half, rule by rule, the cutoff is taken that maximises ``caught / bad - price * lost / good``, counting only documents that no rule before
rejects; a rule without a cutoff of positive worth rejects nothing in that stratum. That gives a path of rule sets from mild to strict: in its step j every rule is at
its j-th cutoff, or at the chosen one if that is milder. On the *held-out* half the path is tested from its mild end: a step is certified if the exact
(Clopper-Pearson) upper bound, at confidence ``1 - delta / strata``, of the share of good documents that *any* of the rules rejects is at most ``alpha``; testing stops at the first step that fails
(fixed-sequence testing), and the last certified one is used. Strata share ``delta`` by Bonferroni. So with probability ``1 - delta`` the rules together falsely reject at most ``alpha`` in *every* stratum.

Defined cases. A null or blank text is rejected. A null ``lang`` is its own stratum, ``""``. Documents without a
label, labels without a document and null labels don't calibrate; a document with several labels counts as good if
any says so. Of cutoffs equally good the mildest is taken. Repeated rows are each kept or rejected alike; texts are read to their end. Extra columns pass through unread. Without labels
nothing but blank texts is rejected; an empty table stays empty.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh

#: rule -> (sign, cutoffs from the mildest to the strictest). With sign 1 a feature >= cutoff is rejected, with -1 one <= cutoff.
RULES: dict[str, tuple[int, tuple[int, ...]]] = {
    "symbols": (1, (500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)),
    "capitals": (1, (900, 700, 600, 500, 400, 350, 300, 250, 200, 150, 100, 70)),
    "repeats": (1, (950, 900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100, 50)),
    "other": (1, (900, 800, 700, 600, 500, 450, 400, 350, 300, 280, 260)),
    "distinct": (-1, (5, 10, 25, 50, 75, 100, 150, 200, 250, 300, 350, 400, 450, 500, 540, 580)),
}
ALPHA, DELTA, PRICE = 0.05, 0.05, 20.0
#: Labelled ids up to this many are broadcast (16 bytes each); beyond it only narrow features are shuffled.
BROADCAST_LABELS = 4_000_000


def features(text: Column) -> dict[str, Column]:
    """Integer features of a text that isn't blank, all of the whole text; null for a null text."""
    length = F.greatest(F.length(text), F.lit(1)).cast("long")
    words = F.split(text, r"\s+")

    def share(pattern: str) -> Column:
        return F.expr("1000L") * F.length(F.regexp_replace(text, pattern, "")).cast("long")

    return {
        "symbols": F.floor(share(r"[^*$%&#!|]+") / length),
        "capitals": F.floor(share(r"[^\p{Lu}]+") / length),
        "other": F.floor(share(r"\p{L}+") / length),
        "repeats": F.floor(F.expr("1000L") * F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda x: x)).cast("long") / F.size(words)),
        "distinct": F.floor(F.expr("1000L") * F.size(F.array_distinct(words)).cast("long") / F.size(words)),
    }


def bound_holds(lost: int, good: int, alpha: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound, at 1 - delta, of a rate of ``lost`` in ``good`` is at most ``alpha``.

    The bound is the p at which P(Binomial(good, p) <= lost) = delta, so it is at most alpha iff that probability at alpha is at most delta.
    """
    if not good or lost > good * alpha:
        return False
    log = [
        math.lgamma(good + 1) - math.lgamma(j + 1) - math.lgamma(good - j + 1) + j * math.log(alpha) + (good - j) * math.log1p(-alpha)
        for j in range(lost + 1)
    ]
    return math.fsum(math.exp(x) for x in log) <= delta


#: Of which half a labelled document is: 1 for held out. Whole numbers that any engine computes alike.
HELD_OUT = "((({id} % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647) {div} 65536 % 2"


def calibrate(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> dict[str, dict[str, int]]:
    """stratum -> rule -> cutoff. One pass over the labelled documents; the driver gets counts of cells, whose number the cutoffs bound."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if labels.count() <= BROADCAST_LABELS:
        seen = docs.select("doc_id", "text", "lang").join(F.broadcast(marks), "doc_id")
        seen = seen.select("doc_id", "good", F.coalesce("lang", F.lit("")).alias("stratum"), *[v.alias(k) for k, v in features(F.col("text")).items()])
    else:
        f = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *[v.alias(k) for k, v in features(F.col("text")).items()])
        seen = f.join(marks, "doc_id")
    # a document's step in a rule: how many cutoffs, the mildest first, don't hit it; documents of the same steps are one cell
    seen = seen.where(F.col("symbols").isNotNull() & F.col("good").isin(0, 1))
    steps = [sum((F.col(r) < c if sign > 0 else F.col(r) > c).cast("int") for c in cuts).alias(f"at_{r}") for r, (sign, cuts) in RULES.items()]
    half = F.expr(HELD_OUT.format(id="doc_id", div="div")).alias("held")
    cells = seen.select("stratum", "good", half, *steps).groupBy("stratum", "good", "held", *[f"at_{r}" for r in RULES]).count().collect()
    strata = sorted({c["stratum"] for c in cells})
    chosen: dict[str, dict[str, int]] = {}
    for stratum in strata:
        own = [(c["held"], c["good"], [c[f"at_{r}"] for r in RULES], c["count"]) for c in cells if c["stratum"] == stratum]
        left = [(g, at, n) for h, g, at, n in own if not h]
        good, bad = (sum(n for g, _, n in left if g == k) for k in (1, 0))
        used: dict[int, int] = {}
        for k, (_, cuts) in enumerate(RULES.values()):
            best = 0.0
            for i in range(len(cuts)):
                worth = sum(n if not g else 0 for g, at, n in left if at[k] <= i) / max(bad, 1) - price * sum(n for g, at, n in left if g and at[k] <= i) / max(good, 1)
                if worth > best:
                    best, used[k] = worth, i
            left = [c for c in left if c[1][k] > used.get(k, -1)]
        # the first step of the path that rejects a held-out good document
        falls = [(min((at[k] for k, i in used.items() if at[k] <= i), default=None), n) for h, g, at, n in own if h and g]
        sure, last = sum(n for _, n in falls), -1
        while last < max(used.values(), default=-1) and bound_holds(sum(n for j, n in falls if j is not None and j <= last + 1), sure, alpha, delta / len(strata)):
            last += 1
        if last >= 0:
            chosen[stratum] = {rule: cuts[min(used[k], last)] for k, (rule, (_, cuts)) in enumerate(RULES.items()) if k in used}
    return chosen


def verdict(text: Column, lang: Column, cutoffs: dict[str, dict[str, int]], by_rule: dict[str, Column]) -> Column:
    """The names of the rules that reject a text, joined by commas; '' if it stays."""
    said = [F.when(F.coalesce(~text.rlike(r"\S"), F.lit(True)), F.lit("blank"))]
    for rule, (sign, _) in RULES.items():
        cut = F.lit(None).cast("long")
        for stratum, rules in sorted(cutoffs.items()):
            if rule in rules:
                cut = F.when(F.coalesce(lang, F.lit("")) == stratum, F.lit(rules[rule])).otherwise(cut)
        said.append(F.when(by_rule[rule] >= cut if sign > 0 else by_rule[rule] <= cut, F.lit(rule)))
    return F.concat_ws(",", *said)


def judged(docs: DataFrame, cutoffs: dict[str, dict[str, int]]) -> tuple[DataFrame, str, dict[str, str]]:
    """``docs`` with the features and the verdict in new columns, and those columns' names."""
    names = {rule: fresh(docs, rule) for rule in RULES}
    out = docs.withColumns({names[k]: v for k, v in features(F.col("text")).items()})
    why = fresh(out, "rejected_by")
    return out.withColumn(why, verdict(F.col("text"), F.col("lang"), cutoffs, {k: F.col(v) for k, v in names.items()})), why, names


def quality_filter(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that no certified rule rejects, with all their columns. Narrow: no shuffle but for the labels."""
    out, why, _ = judged(docs, calibrate(docs, labels, **params))
    return out.where(F.col(why) == "").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their features."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, why, names = judged(docs.select("doc_id", "text", "lang"), calibrate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.where(F.col(why) == "").select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *[F.col(v).alias(k) for k, v in names.items()], F.lit(True).alias("keep"))


def oracle(source: str = "documents", columns: str | None = None) -> str:
    """DuckDB SQL for :func:`query`, or for the kept rows' ``columns`` of ``source``."""
    names, most = list(RULES), max(len(c) for _, c in RULES.values()) - 1
    steps = ", ".join("(" + " + ".join(f"(v.\"{r}\" {'<' if s > 0 else '>'} {c})::int" for c in cuts) + f") as at{k}" for k, (r, (s, cuts)) in enumerate(RULES.items()))
    parts = []
    for k, (_, cuts) in enumerate(RULES.values()):
        parts.append(f"""
w{k} as (select stratum, i, count(*) filter (good = 0 and at{k} <= i) / greatest(n0, 1) - {PRICE} * count(*) filter (good = 1 and at{k} <= i) / greatest(n1, 1) as worth
  from l{k} join sizes using (stratum), range({len(cuts)}) t(i) group by stratum, i, n0, n1),
u{k} as (select stratum, i as used from (select *, row_number() over (partition by stratum order by worth desc, i) as r from w{k} where worth > 0) where r = 1),
l{k + 1} as (select l.* from l{k} l left join u{k} u using (stratum) where used is null or at{k} > used)""")
    used = " ".join(f"left join u{k} on u{k}.stratum = s.stratum" for k in range(len(names)))
    falls = "least(" + ", ".join(f"case when at{k} <= (select used from u{k} u where u.stratum = c.stratum) then at{k} end" for k in range(len(names))) + ")"
    rejects = " or ".join(
        f"coalesce(v.\"{r}\" {'>=' if s > 0 else '<='} (select {list(cuts)}[least(used{k}, last) + 1] from cut c where c.stratum = v.stratum and last >= 0 and used{k} is not null), false)" for k, (r, (s, cuts)) in enumerate(RULES.items())
    )
    shown = columns or "doc_id, stratum, " + ", ".join(f'"{r}"' for r in RULES) + ", true as keep"
    return f"""
with feats as (
  select *, coalesce(lang, '') as stratum, string_split_regex(text, '\\s+') as w_, greatest(length(text), 1) as n_ from {source}),
vals as (
  select * exclude (w_, n_),
    (1000 * length(regexp_replace(text, '[^*$%&#!|]+', '', 'g'))) // n_ as symbols,
    (1000 * length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))) // n_ as capitals,
    (1000 * coalesce(list_sum(list_transform(range(1, len(w_)), lambda i: (w_[i] = w_[i + 1])::bigint)), 0)::bigint) // len(w_) as repeats,
    (1000 * length(regexp_replace(text, '\\p{{L}}+', '', 'g'))) // n_ as other,
    (1000 * len(list_distinct(w_))) // len(w_) as "distinct"
  from feats),
marks as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
cells as (select stratum, good, {HELD_OUT.format(id="doc_id::bigint", div="//")} as held, {steps} from vals v join marks using (doc_id) where symbols is not null and good in (0, 1)),
l0 as (select * from cells where held = 0),
strata as (select distinct stratum from cells),
sizes as (select stratum, count(l0.good) filter (good = 1) as n1, count(l0.good) filter (good = 0) as n0 from strata left join l0 using (stratum) group by stratum),{",".join(parts)},
falls as (select stratum, {falls} as j from cells c where held = 1 and good = 1),
tries as (select stratum, i, count(*) as n, count(*) filter (j <= i) as lost from falls, range({most + 1}) t(i) group by all),
held as (select stratum, i, n > 0 and lost <= n * {ALPHA} and
    (select sum(exp(lgamma(n + 1) - (case when j = 0 then 0 else lgamma(j + 1) end) - (case when n = j then 0 else lgamma(n - j + 1) end) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))
     from (select unnest(range(0, least(lost, cast(floor(n * {ALPHA}) as bigint)) + 1)) as j)) <= {DELTA} / (select count(*) from strata) as holds from tries),
fine as (select stratum, count(*) filter (ok) - 1 as last from (select *, bool_and(holds) over (partition by stratum order by i) as ok from held) group by stratum),
cut as (select s.stratum, coalesce(last, -1) as last, {", ".join(f"u{k}.used as used{k}" for k in range(len(names)))} from strata s left join fine f on f.stratum = s.stratum {used}),
kept as (select * from vals v where coalesce(regexp_matches(text, '\\S'), false) and not ({rejects}))
select {shown} from kept"""
