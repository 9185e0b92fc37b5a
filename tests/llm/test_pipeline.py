from __future__ import annotations

import corpus_pipeline as P
from lakeloom.llm import language_id, mixing, near_duplicates, quality_rules, sentence_pieces

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other_and_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "source_mixing", "sentence_pieces"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    step = P.stored(P.quality(spark, docs, SF), "t")
    cut = quality_rules.calibrate(docs, labels)
    judged, why, _ = quality_rules.judged(docs, cut)
    assert {r.doc_id for r in step.collect()} == {r.doc_id for r in judged.where(F_eq(why)).collect()} and step.columns == columns
    two = P.stored(P.language(spark, step, SF), "t")
    m = language_id.fit(step)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in language_id.identify(step, m).where("accepted").collect()} and two.columns == columns
    three = P.stored(P.near_duplicates(spark, two, SF), "t")
    rows = two.select("doc_id", "text").collect()
    sets = {r.doc_id: set(s.tolist()) for r, s in zip(rows, near_duplicates.shingles([r.text for r in rows]))}
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= near_duplicates.T:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert {r.doc_id for r in three.collect()} == {x for x in top if find(x) == x} and three.columns == columns
    four = P.stored(P.mixture(spark, three, SF), "t")
    out, copies = mixing.drawn(three)
    assert sorted(r.doc_id for r in four.collect()) == sorted(r.doc_id for r in out.collect() for _ in range(r[copies])) and four.columns == columns
    last = P.tokens(spark, four, SF)
    t = sentence_pieces.Transducer()
    by = {r.doc_id: r.text for r in docs.collect()}
    got = last.collect()
    assert all(r.ids == t.encode(by[r.doc_id]) and r.exact for r in got) and len(got) == four.count()
    whole = P.run(spark, SF)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, clashing names, and empty tables: defined and without a crash."""
    long = "a very long text that goes on and on " * 20_000
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "a row without an id", "en", "a", 1), (3, long, "en", "b", 9), (4, long, "en", "b", 9), (5, "\n", "de", None, 2), (6, "twice the very same row", "en", "a", 3), (6, "twice the very same row", "en", "a", 3), (7, "日本語 🙂 x", "xx", "c", 4)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    docs.withColumns({c: F.lit("mine") for c in ("rep", "tile", "score", "keep", "__copies", "size")}).write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    got = {r.doc_id: r.exact for r in P.run(spark, f"{tmp_path}/odd").collect()}
    assert got.keys() <= {3, 6, 7, None} and all(got.values())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def F_eq(name):
    from pyspark.sql import functions as F

    return F.col(name) == ""
