"""Training and scoring with MLlib.

Boosted trees have no SQL form, so the twins hold which rows are predicted, in
which fold, with which outcome, and whether the prediction is a number.  One
fit, a single split of a two-valued feature, is compared by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.operators import features as X
from candlespark.operators import metrics as M
from candlespark.operators import models as ML
from candlespark.operators.search import leaderboard
from candlespark.operators.splits import time_series_split
from candlespark.plans.feature_queries import _as_of
from candlespark.plans.registry import query, r
from candlespark.plans.tables import BARS, MONTH, bars_1h
from candlespark.session import cut_lineage

FEATURES = ["log_return_1h", "log_return_6h", "sma_5", "sma_10", "volatility_5h", "hl_spread_recent"]
N = 13


def _model_features(rows):
    rows = X.with_columns(rows.where("window IS NOT NULL"), {k: c for k, c in X.log_returns(N).items() if k in FEATURES})
    return X.with_technical(rows, N)


def _training(spark, sf):
    """Feature rows, written once: every fold reads them."""
    rows = _model_features(X.training_table(bars_1h(spark, sf), "1h", N, 1, cell_s=MONTH))
    return cut_lineage(rows.select("symbol", "open_time", "close", "volume", "target", *FEATURES), "training")


CONFIGS = [{"maxDepth": 3, "stepSize": 0.1}, {"maxDepth": 2, "stepSize": 0.2}]


def _predictions(spark, sf):
    rows = _training(spark, sf).where("target IS NOT NULL")
    split = time_series_split(rows, 2, gap=N + 1, cell_s=MONTH)
    return ML.cross_validate(split, FEATURES, "target", CONFIGS, [2, 5], ["symbol"])


ROWS = BARS + """, seen AS (SELECT symbol, open_time, close, volume, row_number() OVER w AS k, ln(lead(close) OVER w) - ln(close) AS target
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
usable AS (SELECT symbol, open_time, close, volume, target AS y_true FROM seen WHERE k >= 13 AND close <> 0 AND volume <> 0 AND target IS NOT NULL)"""
FOLDS = ROWS + """, ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM usable),
fd AS (SELECT *, unnest(range({k})) AS fold, n // ({k} + 1) AS sz FROM ix), tests AS (SELECT symbol, open_time, y_true, fold::INTEGER AS fold FROM fd
  WHERE i >= n - ({k} - fold) * sz AND i < n - ({k} - fold) * sz + sz)"""


@query("model_out_of_fold", f"""
WITH {FOLDS.replace('{k}', '2')} SELECT c.config, fold, symbol, open_time, {r('y_true')}, true AS predicted
FROM tests, (SELECT unnest(['c0-t2', 'c0-t5', 'c1-t2', 'c1-t5']) AS config) AS c""")
def _(spark, sf):
    """Boosted trees per configuration and fold, scored at two tree counts."""
    known = F.coalesce(~F.isnan("y_pred") & (F.abs("y_pred") < 1e9), F.lit(False))
    return _predictions(spark, sf).select("config", "fold", "symbol", "open_time", "y_true", known.alias("predicted"))


@query("model_single_split", f"""
WITH {ROWS}, side AS (SELECT *, volume > (SELECT avg(volume) FROM usable) AS high FROM usable),
m AS (SELECT high, avg(y_true) AS y_pred FROM side GROUP BY 1)
SELECT symbol, open_time, {r('y_true', 'y_pred')} FROM side JOIN m ON side.high = m.high""")
def _(spark, sf):
    """One tree with one split of a two-valued feature predicts the mean of each side."""
    rows = _training(spark, sf).where("target IS NOT NULL")
    level = rows.agg(F.avg("volume")).first()[0]
    rows = rows.withColumn("high", (F.col("volume") > level).cast("double")).withColumns({"fold": F.lit(0), "role": F.lit("train")})
    both = rows.unionByName(rows.withColumn("role", F.lit("test")))
    scored = ML.cross_validate(both, ["high"], "target", [{"maxDepth": 1}], [1], ["symbol"])
    return scored.select("symbol", "open_time", "y_true", "y_pred")


@query("model_leaderboard")
def _(spark, sf):
    """Configurations graded on their out-of-fold predictions."""
    preds = cut_lineage(_predictions(spark, sf), "predictions")
    reports = M.evaluate(preds, ["config", "symbol"], cell_s=MONTH)
    return leaderboard(reports.select("config", "symbol", "num_passed", "score", "directional_accuracy", "mae", "grade"), "config")


def _ablation(spark, sf):
    rows = _training(spark, sf).where("target IS NOT NULL")
    split = time_series_split(rows, 1, gap=N + 1, cell_s=MONTH)
    preds = ML.ablation(split, FEATURES, "target", {"maxDepth": 2, "maxIter": 3}, ["symbol"])
    return preds.groupBy("dropped", "symbol").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), F.count("y_pred").alias("n"))


@query("model_feature_ablation", f"""
WITH {FOLDS.replace('{k}', '1')} SELECT f.dropped, symbol, count(*) AS n, true AS scored
FROM tests, (SELECT unnest({['none', *FEATURES]!r}) AS dropped) AS f GROUP BY ALL""")
def _(spark, sf):
    """Errors with each feature left out in turn."""
    return _ablation(spark, sf).select("dropped", "symbol", "n", (F.col("mae") < 10).alias("scored"))


@query("model_ablation_errors")
def _(spark, sf):
    """The mean absolute error without each feature, and how far it lies above the error with all of them."""
    errors = cut_lineage(_ablation(spark, sf), "ablation")
    whole = errors.where("dropped = 'none'").select("symbol", F.col("mae").alias("mae_with_all"))
    return errors.join(whole, "symbol").withColumn("rise", F.col("mae") - F.col("mae_with_all"))


@query("model_live_prices", f"""
WITH {BARS}, seen AS (SELECT symbol, open_time, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k,
  count(*) OVER (PARTITION BY symbol) AS nb FROM bars WHERE open_time > (SELECT max(ts) FROM events) - INTERVAL 15 HOUR)
SELECT symbol, open_time, {r('close AS current_price')}, volume <> 0 AS usable, volume <> 0 AS consistent FROM seen WHERE k = 1 AND nb >= 13""")
def _(spark, sf):
    """Newest features of every symbol -> predicted return -> predicted price; rows without a window are flagged."""
    rows = _training(spark, sf)
    model = ML.fit(ML.assemble(rows.where("target IS NOT NULL"), FEATURES), "target", {"maxDepth": 3, "maxIter": 5})
    live = X.live_features(bars_1h(spark, sf), "1h", N, _as_of(spark, sf), cell_s=MONTH).where("enough")
    made = X.with_columns(live, {k: F.when(F.col("window").isNotNull(), c) for k, c in X.log_returns(N).items() if k in FEATURES})
    out = ML.infer(X.with_technical(made, N), model, FEATURES)
    same = F.abs(F.log(F.col("predicted_price") / F.col("current_price")) - F.col("predicted_return")) < 1e-9
    return out.select("symbol", "open_time", "current_price", "usable", F.coalesce(same, F.lit(False)).alias("consistent"))
