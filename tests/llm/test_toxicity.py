"""Accuracy of the toxicity score on rows that it never learned from."""

from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(toxicity.labelled(docs, labels))
    marks = labels.dropna().where(toxicity.held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.score(docs, model).join(marks, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    print(n, model.map)
    assert model.map[1] > 0  # the length-normalised difference counts
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
