"""Boosted trees: staged scores and rows with missing features."""

import pytest
from pyspark.sql import functions as F

from candlespark.operators import models as ML


def test_staged_scores_and_missing_features(spark):
    rows = spark.range(400).select(
        F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 17) * 0.5 + (F.col("id") % 5) * (F.col("id") % 3)).cast("double").alias("target"),
    )
    rows = rows.withColumn("a", F.when(F.col("k") == 3, F.lit(float("nan"))).when(F.col("k") != 4, F.col("a")))
    ready = ML.assemble(rows, ["a", "b"])
    model = ML.fit(ready, "target", {"maxDepth": 3, "maxIter": 4})
    got = {(r.k, r.trees): r.y_pred for r in ML.staged_scores(model, ready, [1, 4]).collect()}
    assert len(got) == 800 and got[3, 4] is None and got[4, 1] is None
    for r in model.transform(ready.where("complete")).collect():
        assert got[r.k, 4] == pytest.approx(r.prediction)
    first = {r.k: r.prediction for r in model.trees[0].setFeaturesCol("features").transform(ready.where("complete")).collect()}
    assert all(got[k, 1] == pytest.approx(v) for k, v in first.items())
    priced = {r.k: (r.usable, r.predicted_return) for r in ML.infer(rows.withColumn("current_price", F.lit(10.0)), model, ["a", "b"]).collect()}
    assert len(priced) == 400 and priced[3] == (False, None) and priced[4] == (False, None) and priced[5][0]
