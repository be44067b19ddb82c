"""The stages of the pipeline on documents with planted cases, and the registered queries."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import registry
from tests.llm.cases import frame, vocabulary


def test_stages(spark, tmp_path):
    r = random.Random(3)
    v = vocabulary(r, 2000)
    text = lambda n=80: "\n".join(" ".join(r.choices(v, k=20)) for _ in range(n // 20))
    docs = {i: text() for i in range(20)}
    item = " ".join(r.choices(v, k=40))
    docs[30] = "### $$$ " * 60  # junk
    docs[31] = text(40) + "\n" + docs[1]  # holds an earlier document
    docs[32] = docs[2]  # an exact copy
    w = docs[3].split()
    w[10] = "changed"
    docs[33] = "\n".join(" ".join(w[k : k + 17]) for k in range(0, len(w), 17))  # a near copy on other lines
    docs[34] = text(60) + "\n" + item
    spark.createDataFrame([(1, item), (2, text(60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, docs.items()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {x.doc_id: x for x in at.collect()}
    clean = set(range(20))
    assert set(seen["quality rules"]) == clean | {31, 32, 33, 34}
    assert set(seen["line dedup"]) == clean | {31, 33, 34} and len(seen["line dedup"][31].text.split()) == 40
    assert set(seen["near duplicates"]) == clean | {31, 34}
    assert set(seen["decontamination"]) == set(seen["near duplicates"]) - {34}
    assert {x.doc_id for x in at.collect()} == set(seen["decontamination"])
    # where documents are cut depends on their order; what is packed doesn't
    tokens = lambda df: sorted((x.doc_id, x.n) for x in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert tokens(corpus_pipeline.run(spark, str(tmp_path))) == tokens(at)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_defined_cases(spark, tmp_path):
    """Null and empty texts, a null and a repeated id, repeated rows, ties, a very long text, and empty tables."""
    r = random.Random(5)
    v = vocabulary(r, 3000)
    text = lambda n=80: "\n".join(" ".join(r.choices(v, k=20)) for _ in range(n // 20))
    first, long, tie = text(), text(30_000), text()
    rows = [(1, first), (1, first), (2, None), (3, ""), (None, text()), (None, None), (4, long), (5, tie), (6, tie), (7, text())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in rows], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for folder, items in (("a", [(1, None), (None, "some other words that stand nowhere at all")]), ("b", [])):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x.doc_id for x in got} == {1, None, 4, 5, 7}
    assert all(x.n > 40_000 for x in got if x.doc_id == 4)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
