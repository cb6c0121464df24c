"""Splits, searches, gates and drift checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.functions.safe import ieee_div, ln
from candlespark.operators import gates as G
from candlespark.operators import metrics as M
from candlespark.operators import search as S
from candlespark.operators import sketches as K
from candlespark.operators import splits as V
from candlespark.operators.blocks import over_blocks
from candlespark.plans.evaluation_queries import EVAL, configs
from candlespark.plans.feature_queries import _as_of
from candlespark.plans.registry import query, r
from candlespark.plans.tables import BARS, BARS_1D, MONTH, PAIRS, YEAR, bars_1d, bars_1h, pairs
from candlespark.session import cut_lineage, shared_dir

TSS = BARS + """, ix AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars),
fd AS (SELECT *, unnest(range(5)) AS fold, n // 6 AS sz FROM ix), st AS (SELECT *, n - (5 - fold) * sz AS s FROM fd),
sp AS (SELECT symbol, open_time, fold::INTEGER AS fold, CASE WHEN i < s - 24 {max} THEN 'train' WHEN i >= s AND i < s + sz THEN 'test' END AS role FROM st)"""


@query("time_series_split", f"WITH {TSS.replace('{max}', '')} SELECT * FROM sp WHERE role IS NOT NULL")
def _(spark, sf):
    """Five expanding folds with a gap of 24 rows."""
    return V.time_series_split(bars_1h(spark, sf), 5, gap=24, cell_s=MONTH).select("symbol", "open_time", "fold", "role")


@query("time_series_split_max_train", f"WITH {TSS.replace('{max}', 'AND i >= s - 24 - 200')} SELECT * FROM sp WHERE role IS NOT NULL")
def _(spark, sf):
    """The same with at most 200 training rows."""
    out = V.time_series_split(bars_1h(spark, sf), 5, gap=24, max_train=200, cell_s=MONTH)
    return out.select("symbol", "open_time", "fold", "role")


@query("coverage_plan", f"""
WITH {BARS_1D}, n AS (SELECT symbol, count(*) AS n_rows, floor(count(*) * 0.4)::BIGINT AS n_test_rows FROM bars GROUP BY 1),
s AS (SELECT *, unnest([30, 60, 90, 100000])::BIGINT AS test_size FROM n), f AS (SELECT *, greatest(1, n_test_rows // test_size) AS n_folds FROM s)
SELECT *, least(n_folds * test_size, n_rows) AS n_covered FROM f""")
def _(spark, sf):
    """Numbers of folds that keep the tested span the same for test windows of several sizes."""
    return V.coverage_plan(bars_1d(spark, sf), 0.4, [30, 60, 90, 100_000])


WF = BARS_1D + """, ix AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars),
fd AS (SELECT *, unnest(range(4)) AS fold, floor(n * 0.1)::BIGINT AS t FROM ix), b AS (SELECT *, n - (4 - fold) * t AS lo FROM fd),
sp AS (SELECT symbol, open_time, fold::INTEGER AS fold, CASE WHEN i < lo - 20 - t - 20 {slide} THEN 'train'
  WHEN i >= lo - 20 - t AND i < lo - 20 THEN 'validation' WHEN i >= lo AND i < lo + t THEN 'test' END AS role FROM b)"""


@query("walk_forward_expanding", f"""
WITH {WF.replace('{slide}', '')} SELECT symbol, fold, role, min(open_time) AS first_time, max(open_time) AS last_time, count(*) AS n_rows
FROM sp WHERE role IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """Purged walk-forward; validation is as long as the test."""
    gap = V.purge_gap(5, [10, 15], margin=5)
    return V.split_report(V.walk_forward(bars_1d(spark, sf), 0.1, 4, gap, cell_s=YEAR))


@query("walk_forward_sliding", f"""
WITH {WF.replace('{slide}', 'AND i >= greatest(0, lo - 40 - t - 300)')} SELECT symbol, fold, role, min(open_time) AS first_time, max(open_time) AS last_time,
  count(*) AS n_rows FROM sp WHERE role IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """The same with 300 training rows that slide along."""
    return V.split_report(V.walk_forward(bars_1d(spark, sf), 0.1, 4, 20, train_rows=300, cell_s=YEAR))


@query("split_integrity", f"""
WITH {WF.replace('{slide}', '')}, q AS (SELECT * FROM sp WHERE role IS NOT NULL),
k AS (SELECT symbol, fold, count(*) FILTER (WHERE c > 1) AS rows_in_two_roles FROM (SELECT symbol, fold, open_time, count(*) AS c FROM q GROUP BY ALL) GROUP BY ALL),
e AS (SELECT symbol, fold, max(open_time) FILTER (WHERE role = 'train') AS train_end, min(open_time) FILTER (WHERE role = 'test') AS test_start FROM q GROUP BY ALL)
SELECT symbol, fold, train_end, test_start, rows_in_two_roles, train_end + INTERVAL 5 DAY < test_start AS horizon_clear FROM e JOIN k USING (symbol, fold)""")
def _(spark, sf):
    """No row has two roles, no training target reaches into the test."""
    return V.integrity(V.walk_forward(bars_1d(spark, sf), 0.1, 4, 20, cell_s=YEAR), 5 * 86_400)


LEAKS = """{src}, q AS (SELECT * FROM {split}), p AS (
  SELECT a.{keys}, a.open_time, a.{role}, b.{role} AS other_{role}, count(*) FILTER (WHERE b.open_time > a.open_time - {h} AND b.open_time < a.open_time + {h}) AS label,
    count(*) FILTER (WHERE b.open_time >= a.open_time - {h} - {w} AND b.open_time < a.open_time) AS feature
  FROM q a JOIN q b ON {same} AND a.{role} <> b.{role} AND b.open_time BETWEEN a.open_time - {h} - {w} AND a.open_time + {h} GROUP BY ALL),
l AS (SELECT * FROM (UNPIVOT p ON label, feature INTO NAME kind VALUE n_other) WHERE n_other > 0)"""


@query("split_overlaps", f"""
WITH {LEAKS.format(src=WF.replace('{slide}', '').replace('20', '4'), split="(SELECT * FROM sp WHERE role IS NOT NULL)", keys='symbol, a.fold', role='role', same='a.symbol = b.symbol AND a.fold = b.fold', h='INTERVAL 5 DAY', w='INTERVAL 10 DAY')}
SELECT symbol, fold, role, other_role, kind, open_time, n_other FROM l""")
def _(spark, sf):
    """Folds with a gap of 4 days, outcomes over 5 and features over 10: each row that sees another role's outcomes."""
    split = V.walk_forward(bars_1d(spark, sf), 0.1, 4, 4, cell_s=YEAR)
    return V.overlaps(split, 5 * 86_400, 10 * 86_400, cell_s=YEAR)


@query("split_overlaps_purged", f"""
WITH {LEAKS.format(src=WF.replace('{slide}', ''), split="(SELECT * FROM sp WHERE role IS NOT NULL)", keys='symbol, a.fold', role='role', same='a.symbol = b.symbol AND a.fold = b.fold', h='INTERVAL 12 DAY', w='INTERVAL 15 DAY')}
SELECT symbol, fold, role, other_role, kind, min(open_time) AS first_time, max(open_time) AS last_time, count(*) AS n_rows, max(n_other) AS most_others FROM l GROUP BY ALL""")
def _(spark, sf):
    """With the gap of 20 days no outcomes overlap; features of 15 days still reach outcomes of 12."""
    split = V.walk_forward(bars_1d(spark, sf), 0.1, 4, 20, cell_s=YEAR)
    return V.overlap_report(V.overlaps(split, 12 * 86_400, 15 * 86_400, cell_s=YEAR))


STAGES = PAIRS + """, ends AS (SELECT max(open_time) + INTERVAL 1 MICROSECOND AS z FROM pairs),
sg AS (SELECT pairs.*, CASE WHEN open_time < z - INTERVAL 14 DAY - INTERVAL 12 HOUR THEN 'inner'
  WHEN open_time >= z - INTERVAL 14 DAY AND open_time < z - INTERVAL 7 DAY - INTERVAL 12 HOUR THEN 'evaluation'
  WHEN open_time >= z - INTERVAL 7 DAY THEN 'deployment' END AS stage FROM pairs, ends)"""


def _stages(spark, sf):
    rows = pairs(spark, sf)
    return V.three_stage(rows, *V.stage_bounds(rows, 7 * 86_400), 12 * 3600)


@query("three_stage_partition", f"""
WITH {STAGES} SELECT symbol, stage, count(*) AS n_rows, min(open_time) AS first_time, max(open_time) AS last_time FROM sg WHERE stage IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """Inner, evaluation and deployment stages with gaps."""
    return _stages(spark, sf).groupBy("symbol", "stage").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


@query("stage_overlaps", f"""
WITH {LEAKS.format(src=STAGES, split="(SELECT symbol, open_time, stage FROM sg WHERE stage IS NOT NULL)", keys='symbol', role='stage', same='a.symbol = b.symbol', h='INTERVAL 24 HOUR', w='INTERVAL 6 HOUR')}
SELECT symbol, stage, other_stage, kind, open_time, n_other FROM l""")
def _(spark, sf):
    """Stages 12 hours apart under outcomes of 24 hours: the rows on both sides of each border."""
    return V.overlaps(_stages(spark, sf), 24 * 3_600, 6 * 3_600, ["symbol"], role="stage", cell_s=MONTH)


@query("stage_degradation", f"""
WITH {STAGES}, m AS (SELECT symbol, stage, avg(abs(y_true - y_pred)) AS mae, corr(y_true, y_pred) AS pearson_r FROM sg WHERE stage IS NOT NULL GROUP BY ALL),
u AS (SELECT symbol, stage, unnest(['mae', 'pearson_r']) AS metric, unnest([mae, pearson_r]) AS v FROM m),
p AS (SELECT symbol, metric, max(v) FILTER (WHERE stage = 'evaluation') AS evaluation, max(v) FILTER (WHERE stage = 'deployment') AS deployment FROM u GROUP BY ALL)
SELECT symbol, metric, {r('evaluation', 'deployment', 'deployment - evaluation AS gap', '(deployment - evaluation) / abs(evaluation) AS relative_gap')} FROM p""")
def _(spark, sf):
    """Gap between evaluation and deployment per metric."""
    rep = M.evaluate(_stages(spark, sf), ["symbol", "stage"])
    return V.stage_degradation(rep, ["mae", "pearson_r"])


# ------------------------------------------------------------------- search
# The search grid.
GRID = {"learning_rate": [0.01, 0.05, 0.1], "depth": [3, 5, 7], "leaves": [15, 31, 63], "trees": [100, 300, 500]}
# A grid point scores by how close it is to a mild optimum and by the data of its symbol.
SCORE = "s.v * (1 - abs(learning_rate - 0.05)) - 0.01 * abs(depth - 5) - 0.001 * abs(leaves - 31) + 0.00001 * trees"
RESULTS = BARS + f""", g AS (SELECT l.x AS learning_rate, d.x AS depth, f.x AS leaves, t.x AS trees FROM (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS x) l,
  (SELECT unnest([3, 5, 7]) AS x) d, (SELECT unnest([15, 31, 63]) AS x) f, (SELECT unnest([100, 300, 500]) AS x) t),
s AS (SELECT symbol, avg(close) / (avg(close) + stddev_pop(close)) AS v FROM bars GROUP BY 1),
res AS (SELECT 'lr' || learning_rate || '-d' || depth || '-l' || leaves || '-t' || trees AS config, g.*, avg({SCORE}) AS score FROM g, s GROUP BY ALL)"""


def _results(spark, sf):
    """Grid results: each configuration with a score that depends on the bars."""
    stats = bars_1h(spark, sf).groupBy("symbol").agg((F.avg("close") / (F.avg("close") + F.stddev_pop("close"))).alias("v"))
    # Literal lists exploded per symbol: 81 rows for each of the symbols.
    d = stats
    for name, values in GRID.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    config = F.concat(*[x for n, p in (("learning_rate", "lr"), ("depth", "-d"), ("leaves", "-l"), ("trees", "-t")) for x in (F.lit(p), F.col(n).cast("string"))])
    score = (
        F.col("v") * (1 - F.abs(F.col("learning_rate") - 0.05)) - 0.01 * F.abs(F.col("depth") - 5)
        - 0.001 * F.abs(F.col("leaves") - 31) + 0.00001 * F.col("trees")
    )
    return d.groupBy(config.alias("config"), *GRID).agg(F.avg(score).alias("score"))


@query("param_grid", f"WITH {RESULTS} SELECT config, learning_rate, depth, leaves, trees, {r('score')} FROM res")
def _(spark, sf):
    """All 81 configurations with their scores on the bars."""
    return _results(spark, sf)


@query("narrowed_ranges", f"""
WITH {RESULTS}, p AS (SELECT *, percent_rank() OVER (ORDER BY score DESC) AS pr FROM res),
u AS (SELECT unnest(['learning_rate', 'depth', 'leaves', 'trees']) AS param, unnest([learning_rate, depth, leaves, trees]::DOUBLE[]) AS v FROM p WHERE pr <= 0.2)
SELECT param, {r('min(v) AS low', 'max(v) AS high')}, count(*) AS n FROM u GROUP BY 1""")
def _(spark, sf):
    """Parameter ranges of the best fifth."""
    return S.narrow(_results(spark, sf), "score", list(GRID))


def _near_sql() -> str:
    parts = []
    for p, vals in GRID.items():
        others = " AND ".join(f"a.{q} = b.{q}" for q in GRID if q != p)
        pos = f"list_position({[float(v) for v in vals]}::DOUBLE[], {{}}.{p}::DOUBLE)"
        parts.append(
            f"SELECT a.config, '{p}' AS param, max(a.score - b.score) AS wd, count(*) AS k FROM res a JOIN res b ON {others} "
            f"AND abs({pos.format('a')} - {pos.format('b')}) = 1 GROUP BY 1"
        )
    return " UNION ALL ".join(parts)


# A grid of predictors on the bars: minus ``scale`` times the return over ``lag`` bars, at most ``cap`` in size.
PREDICTORS = {"lag": [1, 2, 4], "scale": [0.1, 0.3, 1.0], "cap": [0.2, 0.5, 5.0]}
SCORED = BARS + """, g AS (SELECT * FROM (SELECT unnest([1, 2, 4]) AS lag), (SELECT unnest([0.1, 0.3, 1.0])::DOUBLE AS scale), (SELECT unnest([0.2, 0.5, 5.0])::DOUBLE AS cap)),
st AS (SELECT symbol, open_time, ln(lead(close) OVER w) - ln(close) AS y, ln(close) - ln(lag(close, 1) OVER w) AS s1, ln(close) - ln(lag(close, 2) OVER w) AS s2, ln(close) - ln(lag(close, 4) OVER w) AS s4
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
pr AS (SELECT lag, scale, cap, y, least(greatest(-scale * CASE lag WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s4 END, -cap), cap) AS p FROM st, g WHERE y IS NOT NULL AND s4 IS NOT NULL),
gr AS (SELECT lag, scale, cap, count(*) AS n_samples, sqrt(sum(abs(y) * (y - p) ** 2) / sum(abs(y))) AS wm, sqrt(sum(abs(y) ** 3) / sum(abs(y))) AS wb FROM pr GROUP BY ALL),
sc AS (SELECT 'lag' || lag || '-scale' || scale || '-cap' || cap AS config, lag, scale, cap, n_samples, round((wb - wm) / wb, 9) AS score FROM gr)"""


def _scored(spark, sf):
    """Each configuration of the grid with the graded report of its predictions."""

    def columns(d, w):
        step = {k: ln("close") - ln(F.lag("close", k).over(w)) for k in PREDICTORS["lag"]}
        return d.select("*", (ln(F.lead("close").over(w)) - ln("close")).alias("y_true"), *[c.alias(f"s{k}") for k, c in step.items()])

    d = over_blocks(bars_1h(spark, sf).select("symbol", "open_time", "close"), ["symbol"], "open_time", 4, 1, columns, cell_s=MONTH)
    d = d.where("y_true IS NOT NULL AND s4 IS NOT NULL")
    for name, values in PREDICTORS.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    step = F.coalesce(*[F.when(F.col("lag") == k, F.col(f"s{k}")) for k in PREDICTORS["lag"]])
    pred = F.least(F.greatest(-F.col("scale") * step, -F.col("cap")), F.col("cap"))
    names = [x for n in PREDICTORS for x in (F.lit(f"-{n}" if n != "lag" else n), F.col(n).cast("string"))]
    runs = d.select(F.concat(*names).alias("config"), *PREDICTORS, "symbol", "open_time", "y_true", pred.alias("y_pred"))
    report = M.evaluate(runs, ["config", *PREDICTORS], cell_s=MONTH // 30, pool=["symbol"])
    return report.withColumn("score", F.round("wrmse_improvement", 9))


@query("graded_grid", f"WITH {SCORED} SELECT config, lag, scale, cap, n_samples, {r('score')} FROM sc")
def _(spark, sf):
    """A grid of predictors, each scored by its report over all symbols."""
    return _scored(spark, sf).select("config", *PREDICTORS, "n_samples", "score")


@query("graded_grid_ranges", f"""
WITH {SCORED}, q AS (SELECT *, percent_rank() OVER (ORDER BY score DESC) AS k FROM sc),
u AS (SELECT unnest(['lag', 'scale', 'cap']) AS param, unnest([lag, scale, cap]::DOUBLE[]) AS v FROM q WHERE k <= 0.2)
SELECT param, {r('min(v) AS low', 'max(v) AS high')}, count(*) AS n FROM u GROUP BY 1""")
def _(spark, sf):
    """Parameter ranges of the best fifth by reported improvement."""
    return S.narrow(_scored(spark, sf), "score", list(PREDICTORS))


@query("graded_grid_sensitivity", f"""
WITH {SCORED}, ix AS (SELECT *, list_position([1, 2, 4], lag) AS il, list_position([0.1, 0.3, 1.0]::DOUBLE[], scale) AS is_, list_position([0.2, 0.5, 5.0]::DOUBLE[], cap) AS ic FROM sc),
nb AS (SELECT a.config, CASE WHEN a.il <> b.il THEN 'lag' WHEN a.is_ <> b.is_ THEN 'scale' ELSE 'cap' END AS param, a.score - b.score AS d
  FROM ix a JOIN ix b ON abs(a.il - b.il) + abs(a.is_ - b.is_) + abs(a.ic - b.ic) = 1)
SELECT config, param, {r('max(d) AS worst_drop')}, count(*) AS n_neighbours FROM nb GROUP BY ALL""")
def _(spark, sf):
    """Worst drop of the reported improvement one grid step away."""
    return S.sensitivity(cut_lineage(_scored(spark, sf).select("config", *PREDICTORS, "score"), "grid"), "score", PREDICTORS, "config")


@query("parameter_sensitivity", f"WITH {RESULTS}, nb AS ({_near_sql()}) SELECT config, param, {r('wd AS worst_drop')}, k AS n_neighbours FROM nb")
def _(spark, sf):
    """Worst score drop one grid step away."""
    return S.sensitivity(_results(spark, sf), "score", GRID, "config")


CONFIG_PAIRS = PAIRS.replace("pairs AS (", "pairs0 AS (", 1) + """, pairs AS (SELECT symbol, open_time, y_true, y_pred * k AS y_pred, 'k' || i AS config
  FROM pairs0, (SELECT unnest([-1.0, 0.5, 1.0, 2.0, 4.0]) AS k, unnest([1, 2, 3, 4, 5]) AS i))""".replace("pairs0 AS (", "pairs0 AS (")


def _config_reports(spark, sf):
    c = configs(spark, sf)
    return M.evaluate(c.withColumn("config", F.concat_ws("-", "config", "symbol")), ["config"], cell_s=MONTH)


CONFIG_EVAL = CONFIG_PAIRS.replace("'k' || i AS config", "'k' || i || '-' || symbol AS config") + ", " + EVAL.replace("{k}", "config")


@query("leaderboard_top5", f"WITH {CONFIG_EVAL} SELECT config, num_passed, {r('score', 'directional_accuracy')}, grade FROM final ORDER BY num_passed DESC, score DESC, config LIMIT 5")
def _(spark, sf):
    """The five best configurations by passes, then score."""
    top = S.leaderboard(_config_reports(spark, sf), "config", 5)
    return top.select("config", "num_passed", "score", "directional_accuracy", "grade")


@query("quality_gates", f"""
WITH {CONFIG_EVAL} SELECT config, directional_accuracy >= 0.55 AS directional_accuracy_ok, wrmse_improvement >= 0.01 AS wrmse_improvement_ok,
  da_pvalue <= 0.01 AS da_pvalue_ok, directional_accuracy >= 0.55 AND wrmse_improvement >= 0.01 AND da_pvalue <= 0.01 AS all_pass FROM final""")
def _(spark, sf):
    """Independent thresholds, all of which must hold."""
    limits = {"directional_accuracy": ("min", 0.55), "wrmse_improvement": ("min", 0.01), "da_pvalue": ("max", 0.01)}
    return G.gates(_config_reports(spark, sf), limits).select("config", *[f"{m}_ok" for m in limits], "all_pass")


@query("stability_gate", f"""
WITH {PAIRS}, w AS (SELECT symbol, date_trunc('week', open_time) AS wk, count(*) FILTER (WHERE y_true <> 0 AND sign(y_true) = sign(y_pred)) / count(*) FILTER (WHERE y_true <> 0) AS da
  FROM pairs GROUP BY ALL)
SELECT symbol, {r('min(da) AS worst_da', 'max(da) AS best_da')}, count(*) AS n_periods, min(da) >= 0.6 AS stable FROM w GROUP BY 1""")
def _(spark, sf):
    """The worst week must reach the threshold."""
    return G.stability(pairs(spark, sf), ["symbol"], F.date_trunc("week", "open_time"), 0.6)


@query("regime_gate", f"""
WITH {PAIRS}, v AS (SELECT *, CASE WHEN count(y_true) OVER f = 24 THEN stddev_samp(y_true) OVER f END AS vol FROM pairs
  WINDOW f AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, floor(3 * (rank() OVER (PARTITION BY symbol ORDER BY vol) - 1) / count(*) OVER (PARTITION BY symbol)) AS b FROM v WHERE vol IS NOT NULL),
g AS (SELECT symbol, ['low', 'mid', 'high'][b::INTEGER + 1] AS regime, count(*) AS n, count(*) FILTER (WHERE y_true <> 0 AND sign(y_true) = sign(y_pred)) / count(*) FILTER (WHERE y_true <> 0) AS da
  FROM t GROUP BY ALL)
SELECT symbol, regime, n, {r('da')}, da >= 0.6 AS ok FROM g""")
def _(spark, sf):
    """Hit rate per regime of trailing volatility."""
    return G.regime_gate(G.regimes(pairs(spark, sf), ["symbol"], cell_s=MONTH), ["symbol"], 0.6)


@query("rolling_live_accuracy", f"""
WITH {PAIRS}, a AS (SELECT *, CASE WHEN count(*) OVER f = 48 THEN avg(CASE WHEN y_true <> 0 THEN (sign(y_true) = sign(y_pred))::INTEGER END) OVER f END AS da
  FROM pairs WINDOW f AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT symbol, open_time, round(da, 6) + 0.0 AS rolling_da, coalesce(da < 0.6, false) AS trigger FROM a""")
def _(spark, sf):
    """Hit rate of the last 48 rows and where it falls below the gate."""
    out = G.rolling_accuracy(pairs(spark, sf), ["symbol"], 48, 0.6, cell_s=MONTH)
    return out.select("symbol", "open_time", "rolling_da", "trigger")


@query("feature_drift", f"""
WITH {PAIRS}, x AS (SELECT symbol, open_time >= TIMESTAMP '2024-01-20' AS live, y_pred AS f FROM pairs),
b AS (SELECT unnest(range(10)) AS b), s AS (SELECT DISTINCT symbol FROM x),
c AS (SELECT symbol, least(greatest(floor((f + 1.0) / 0.2), 0), 9)::BIGINT AS b, count(*) FILTER (WHERE NOT live) AS o, count(*) FILTER (WHERE live) AS n FROM x GROUP BY ALL),
k AS (SELECT s.symbol, b.b, coalesce(o, 0) AS o, coalesce(n, 0) AS n FROM s CROSS JOIN b LEFT JOIN c ON c.symbol = s.symbol AND c.b = b.b),
q AS (SELECT *, (o + 0.5) / (sum(o) OVER w + 5) AS so, (n + 0.5) / (sum(n) OVER w + 5) AS sn FROM k WINDOW w AS (PARTITION BY symbol)),
p AS (SELECT symbol, sum((sn - so) * ln(sn / so)) AS psi, sum(o)::BIGINT AS n_train, sum(n)::BIGINT AS n_live FROM q GROUP BY 1),
m AS (SELECT symbol, avg(f) FILTER (WHERE NOT live) AS mo, avg(f) FILTER (WHERE live) AS mn, stddev_samp(f) FILTER (WHERE NOT live) AS sdo, stddev_samp(f) FILTER (WHERE live) AS sdn FROM x GROUP BY 1)
SELECT symbol, n_train, n_live, {r('psi', '(mn - mo) / sdo AS mean_shift', 'sdn / sdo AS std_ratio')} FROM p JOIN m USING (symbol)""")
def _(spark, sf):
    """Population stability index and moment shift, training against live."""
    p = pairs(spark, sf)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return G.drift(p.where(F.col("open_time") < cut), p.where(F.col("open_time") >= cut), "y_pred", ["symbol"], 10, -1.0, 1.0)


# Cells of ``sketches.cell_of`` at an accuracy of 0.01.
CELL = """CASE WHEN v = 0 THEN 0 WHEN v IS NULL OR isnan(v) THEN NULL
  ELSE sign(v) * (ceil(ln(abs(v)) / ln(1.01 / 0.99)) + ceil(746.0 / ln(1.01 / 0.99)) + 1) END::BIGINT"""
SKETCH = PAIRS + f""", x AS (SELECT symbol, open_time >= TIMESTAMP '2024-01-20' AS live, date_trunc('day', open_time)::TIMESTAMP AS day, unnest(['y_pred', 'y_true']) AS feature, unnest([CASE WHEN hour(open_time) = 3 THEN NULL ELSE y_pred END, y_true]) AS v FROM pairs),
y AS (SELECT *, {CELL} AS cell FROM x)"""


@query("feature_drift_sketched", f"""
WITH {SKETCH}, o AS (SELECT symbol, feature, cell, count(*) AS o FROM y WHERE NOT live GROUP BY ALL), n AS (SELECT symbol, feature, day, cell, count(*) AS n FROM y WHERE live GROUP BY ALL),
wd AS (SELECT DISTINCT symbol, feature, day FROM n),
c AS (SELECT symbol, feature, day, cell, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n FROM (SELECT symbol, feature, day, cell, o, 0 AS n FROM o JOIN wd USING (symbol, feature) UNION ALL SELECT symbol, feature, day, cell, 0, n FROM n) GROUP BY ALL),
k AS (SELECT *, sum(o) OVER g AS tot_o, sum(n) OVER g AS tot_n, sum(o) OVER u AS co, sum(n) OVER u AS cn FROM c WHERE cell IS NOT NULL WINDOW g AS (PARTITION BY symbol, feature, day), u AS (PARTITION BY symbol, feature, day ORDER BY cell)),
b AS (SELECT symbol, feature, day, least(floor((co - o) * 10 / tot_o), 9) AS b, tot_o, tot_n, sum(o) AS o, sum(n) AS n, max(abs(co / tot_o - cn / tot_n)) AS gap FROM k GROUP BY ALL),
q AS (SELECT *, (o + 0.5) / (tot_o + 0.5 * count(*) OVER g) AS so, (n + 0.5) / (tot_n + 0.5 * count(*) OVER g) AS sn FROM b WINDOW g AS (PARTITION BY symbol, feature, day)),
p AS (SELECT symbol, feature, day, sum((sn - so) * ln(sn / so)) AS psi, max(gap) AS ks FROM q GROUP BY ALL),
m AS (SELECT symbol, feature, day, sum(o)::BIGINT AS n_train, sum(n)::BIGINT AS n_live, sum(n) FILTER (WHERE cell IS NULL) AS mn, sum(o) FILTER (WHERE cell IS NULL) AS mo FROM c GROUP BY ALL)
SELECT symbol, feature, day, n_train, n_live, {r('psi', 'ks', 'coalesce(mn, 0) / n_live - coalesce(mo, 0) / n_train AS missing_shift')} FROM p JOIN m USING (symbol, feature, day)""")
def _(spark, sf):
    """Live days against the sketch stored with the model: bins of equal training shares, training rows are not read again."""
    path = shared_dir(spark, "sketches")
    p = pairs(spark, sf).withColumn("y_pred", F.when(F.hour("open_time") != 3, F.col("y_pred")))
    cut, names = F.lit("2024-01-20").cast("timestamp_ntz"), ["y_pred", "y_true"]
    early, late = (p.where(F.col("open_time") < cut).where((F.day("open_time") < 10) == first) for first in (True, False))
    K.store(K.merged(*[K.sketch(part, ["symbol"], names) for part in (early, late)]), path, "m1")
    live = p.where(F.col("open_time") >= cut).withColumn("day", F.date_trunc("day", "open_time").cast("timestamp_ntz"))
    return K.drift(K.stored(spark, path, "m1"), K.sketch(live, ["symbol", "day"], names), ["symbol"], ["day"])


@query("sketched_quantiles", f"""
WITH {SKETCH}, k AS (SELECT symbol, feature, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, feature) AS n FROM x WHERE v IS NOT NULL WINDOW w AS (PARTITION BY symbol, feature ORDER BY v)),
s AS (SELECT k.*, s.share::DOUBLE AS share FROM k, (SELECT unnest([0.0, 0.1, 0.5, 0.99]) AS share) s),
h AS (SELECT *, {CELL} AS cell FROM s WHERE i = greatest(ceil(share * n), 1))
SELECT symbol, feature, share, {r('CASE WHEN cell = 0 THEN 0.0 ELSE sign(cell) * exp((abs(cell) - ceil(746.0 / ln(1.01 / 0.99)) - 1) * ln(1.01 / 0.99)) * 0.99 END AS value')} FROM h""")
def _(spark, sf):
    """Quantiles of the sketches: each stands for the cell of the exact order statistic."""
    p = pairs(spark, sf).withColumn("y_pred", F.when(F.hour("open_time") != 3, F.col("y_pred")))
    return K.quantiles(K.sketch(p, ["symbol"], ["y_pred", "y_true"]), ["symbol"], [0.0, 0.1, 0.5, 0.99])


@query("model_staleness", """
WITH m AS (SELECT user_id % 30 AS model_id, max(ts) AS trained_at FROM events WHERE event_type = 'signup' GROUP BY 1), nw AS (SELECT max(ts) AS t FROM events)
SELECT model_id, trained_at, round((epoch_us(t) - epoch_us(trained_at)) / 86400e6, 6) + 0.0 AS age_days, (epoch_us(t) - epoch_us(trained_at)) / 86400e6 > 0.5 AS stale FROM m, nw""")
def _(spark, sf):
    """Age of each model and whether it is due for training again."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'signup'")
    models = e.groupBy((F.col("user_id") % 30).alias("model_id")).agg(F.max("ts").alias("trained_at"))
    return G.staleness(models, _as_of(spark, sf), 43_200)


COMBINE = BARS + """, c AS (SELECT symbol, open_time, unnest(['trend', 'level', 'noise']) AS part, unnest([open / close, high / low, -low / close]) AS y_pred, unnest([1.0, 2.0, 0.5]) AS wt FROM bars)"""


@query("combined_subpredictions", f"""
WITH {COMBINE} SELECT symbol, open_time, {r('sum(y_pred) AS by_sum', 'sum(y_pred * wt) / sum(wt) AS by_weight', 'product(y_pred) AS by_product')} FROM c GROUP BY ALL""")
def _(spark, sf):
    """Sub-predictions joined by sum, weighted mean and product; a price of 0 makes them infinite or NaN."""
    b = bars_1h(spark, sf)
    items = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("y_pred"), F.lit(k).alias("wt")) for n, v, k in (
        ("trend", ieee_div("open", "close"), 1.0), ("level", ieee_div("high", "low"), 2.0), ("noise", ieee_div(-F.col("low"), "close"), 0.5))])
    parts = b.select("symbol", "open_time", F.explode(items).alias("i")).select("symbol", "open_time", "i.*")
    keys = ["symbol", "open_time"]
    out = G.combine(parts, keys, "sum").withColumnRenamed("y_pred", "by_sum")
    out = out.join(G.combine(parts, keys, "mean", weight="wt").withColumnRenamed("y_pred", "by_weight"), keys)
    return out.join(G.combine(parts, keys, "product").withColumnRenamed("y_pred", "by_product"), keys)


@query("config_results_keyed", f"""
WITH {RESULTS} SELECT sha256('{{"learning_rate":' || learning_rate || ',"depth":' || depth || ',"leaves":' || leaves || ',"trees":' || trees || '}}') AS config_key, {r('score')} FROM res""")
def _(spark, sf):
    """Results keyed by the hash of the configuration."""
    return _results(spark, sf).select(S.config_id(list(GRID)).alias("config_key"), "score")
