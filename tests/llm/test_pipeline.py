"""The pipeline's stages, one after another, against brute force on a small table."""

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_files import brute_tokens
from test_text_operators import ITEMS, brute_leaks, leaky

from folioflow.llm import mixing, quality_rules


def _run(spark, docs, folder):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [r for r in leaky() if r[0] is not None and r[0] != 2]
    stages = _run(spark, cases.frame(spark, rows), tmp_path)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    text, words = F.col("text"), quality_rules.words(F.col("text"))
    bad = {r["doc_id"] for r in cases.frame(spark, rows).where(quality_rules.first_rejection(quality_rules.RULES, text, words).isNotNull()).collect()}
    kept = [r for r in rows if r[0] not in bad]
    assert ids(stages[0]) == sorted(r[0] for r in kept)
    kept = [r for r, k in zip(kept, cases.components(kept, 80, 100), strict=True) if r[0] == k]
    assert ids(stages[1]) == sorted(r[0] for r in kept)
    leaks = {d for d, _, _ in brute_leaks(kept, ITEMS, 0.8)}
    kept = [r for r in kept if r[0] not in leaks]
    assert leaks and ids(stages[2]) == sorted(r[0] for r in kept)
    light, bounds = mixing.mix(cases.frame(spark, kept))
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.with_copies(light, bounds).collect()}
    mixed = [r for r in kept for _ in range(copies[r[0]])]
    assert ids(stages[3]) == sorted(r[0] for r in mixed)
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:4])
    assert [tuple(r) for r in stages[4].orderBy("start").collect()] == brute_tokens(mixed)


def test_run_equals_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert cases.ordered(map(tuple, docs.collect())) == cases.ordered(map(tuple, corpus_pipeline.run(spark, sf).collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None)], cases.hard_documents()], ids=["empty", "nulls", "hard"])
def test_hard_tables_pass(spark, tmp_path, rows):
    docs = cases.frame(spark, rows).withColumn("nid", F.lit(1)).withColumn("size", F.lit("s")).withColumn("hi", F.lit(None).cast("string"))
    stages = _run(spark, docs, tmp_path)
    assert stages[3].columns == docs.columns and stages[4].count() == stages[3].count()
