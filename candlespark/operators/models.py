"""Training, out-of-fold scoring and live inference with MLlib trees.

Every fit is a distributed job over its fold; the loop over (configuration,
fold) only submits jobs.  Predictions come back as one table keyed by
(config, fold, keys, time), which the metrics grade in a single job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.functions.names import price_from_log_return, valid_prediction
from candlespark.session import cut_lineage, shared_dir


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``features`` as a vector, and ``complete``: whether every one of them is a number.

    Rows with a missing value stay; their gaps hold 0 and nothing is learned
    from or predicted for them.
    """
    filled = {f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features}
    known = F.lit(True)
    for c in features:
        known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = rows.withColumns({**filled, "complete": known})
    return VectorAssembler(inputCols=list(filled), outputCol="features").transform(rows).drop(*filled)


def fit(rows: DataFrame, target: str, params: Mapping[str, object], seed: int = 7) -> GBTRegressionModel:
    """Gradient-boosted trees on the complete ones of assembled rows."""
    trees = GBTRegressor(featuresCol="features", labelCol=target, seed=seed, **params)
    return trees.fit(rows.where("complete"))


def leaf_values(model: GBTRegressionModel) -> list[list[float]]:
    """What each leaf of each tree adds to a prediction, leaves from left to right."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        leaves, stack = [], [tree._java_obj.rootNode()]
        while stack:
            node = stack.pop()
            if node.subtreeDepth() == 0:
                leaves.append(float(node.prediction()) * float(weight))
            else:
                stack += [node.rightChild(), node.leftChild()]
        out.append(leaves)
    return out


def staged_scores(model: GBTRegressionModel, rows: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """Predictions after the first n trees for each checkpoint, from one fit.

    A boosted prediction is the sum of the leaves a row falls into, so a
    checkpoint is a prefix of that sum.  The model names all leaves of a row in
    one pass; the plan is the same however many trees there are.
    """
    model = model.copy()
    model.setLeafCol("_leaves")
    model.setPredictionCol("_full")
    values = F.array(*[F.array(*[F.lit(v) for v in leaves]) for leaves in leaf_values(model)])
    keep = rows.columns
    scored = model.transform(rows).select(*keep, vector_to_array("_leaves").alias("_l"), values.alias("_v"))
    parts = F.transform(F.sequence(F.lit(0), F.size("_v") - 1), lambda i: F.get(F.get("_v", i), F.get("_l", i).cast("int")))
    scored = scored.select(*keep, parts.alias("_p"))
    sums = [F.struct(F.lit(n).alias("trees"), F.aggregate(F.slice("_p", 1, n), F.lit(0.0), lambda a, x: a + x).alias("y")) for n in checkpoints]
    known = F.when(F.col("complete"), F.col("_m.y")).alias("y_pred")
    return scored.select(*keep, F.explode(F.array(*sums)).alias("_m")).select(*keep, F.col("_m.trees").alias("trees"), known)


def cross_validate(
    split: DataFrame, features: Sequence[str], target: str, configs: Sequence[Mapping[str, object]],
    checkpoints: Sequence[int], keys: Sequence[str], time: str = "open_time", parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold predictions of every (config, checkpoint); NULL where a feature is missing.

    ``split`` has (fold, role) rows.  It is assembled once and written to the
    shared folder by fold and role, so a fit reads its own part only; each
    configuration is fitted once per fold with the largest number of trees.
    Every fit writes its scores, so the result is one scan however many there are.
    """
    spark = split.sparkSession
    data = assemble(split.dropna(subset=[target]), features).select(*keys, time, target, "fold", "role", "features", "complete")
    data = cut_lineage(data, "folds", ["fold", "role"])
    folds = sorted(r["fold"] for r in data.select("fold").distinct().collect())
    out = shared_dir(spark, "scores")

    def one(job):
        number, params, fold = job
        rows = data.where(F.col("fold") == fold)
        model = fit(rows.where("role = 'train'"), target, {**params, "maxIter": max(checkpoints)})
        scored = staged_scores(model, rows.where("role = 'test'"), checkpoints)
        scored.select(
            F.concat(F.lit(f"c{number}-t"), F.col("trees").cast("string")).alias("config"), F.col("fold").cast("int").alias("fold"), *keys, time,
            F.col(target).alias("y_true"), "y_pred",
        ).write.mode("overwrite").parquet(f"{out}/job={number}-{fold}")

    jobs = [(i, dict(c), f) for i, c in enumerate(configs) for f in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(one, jobs))
    return spark.read.option("basePath", out).parquet(f"{out}/job=*").drop("job")


def ablation(
    split: DataFrame, features: Sequence[str], target: str, params: Mapping[str, object], keys: Sequence[str],
    time: str = "open_time",
) -> DataFrame:
    """Out-of-fold predictions with one feature left out at a time (and none)."""
    parts = []
    for left_out in [None, *features]:
        used = [f for f in features if f != left_out]
        preds = cross_validate(split, used, target, [{k: v for k, v in params.items() if k != "maxIter"}], [params["maxIter"]], keys, time)
        parts.append(preds.withColumn("dropped", F.lit(left_out or "none")))
    return reduce(DataFrame.unionByName, parts)


def infer(rows: DataFrame, model: GBTRegressionModel, features: Sequence[str], price: Column | str = "current_price") -> DataFrame:
    """Newest features -> log return -> price, with unusable values set apart.

    Rows whose prediction or price is no finite positive number come out with
    ``usable = false``.
    """
    scored = model.transform(assemble(rows, features))
    scored = scored.withColumn("predicted_return", F.when(F.col("complete"), F.col("prediction"))).drop("prediction", "complete")
    out = scored.withColumn("predicted_price", price_from_log_return(price, "predicted_return"))
    usable = F.coalesce(valid_prediction("predicted_return") & valid_prediction("predicted_price", allow_zero=False), F.lit(False))
    return out.withColumn("usable", usable).drop("features")
