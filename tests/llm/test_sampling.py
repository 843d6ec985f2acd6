"""Samples that stay bounded and never round to nothing; scores beside a column of their name."""

from pyspark.sql import functions as F

from tests.llm import edge
from thresher.llm.quality import fit_quality, score_quality
from thresher.llm.sampling import drawn
from thresher.llm.toxicity import fit_toxicity, score_toxicity


def test_small_shares_still_draw(spark):
    ids = spark.range(20_000_000)
    n = ids.where(drawn(5e-7, F.lit("a"), "id")).count()
    assert 1 <= n <= 40
    assert ids.where(drawn(16_000 / 1e11, F.lit("a"), "id")).count() < 10
    assert spark.range(1000).where(drawn(1.0, "id")).count() == 1000
    assert 150 < spark.range(1000).where(drawn(0.2, "id")).count() < 250


def test_a_column_named_score_gives_way(spark):
    docs = edge.frame(spark, edge.documents())
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "cast(doc_id % 3 = 0 as int) AS toxic")
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        found = score(docs, fit(docs, labels))
        assert found.columns.count("score") == 1 and "key" in found.columns
        rows = found.select("doc_id", "score").collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_does_not_depend_on_partitions(spark):
    docs = edge.frame(spark, edge.documents())
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic").where("doc_id is not null")
    found = []
    for parts in (1, 6):
        dealt = docs.repartition(parts)
        rows = score_toxicity(dealt.select("doc_id", "text"), fit_toxicity(dealt, labels)).collect()
        found.append(sorted((r["doc_id"] is None, r["doc_id"], r["score"]) for r in rows))
    assert found[0] == found[1]
