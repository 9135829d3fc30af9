"""Training and evaluation.

Data never leaves the executors: a linear fit needs only the means and the
centred scatter of features and label (k <= 31 here), which tasks condense and
merge, and the k x k solve runs on the driver. Predictions are
column expressions, so scoring stays in whole-stage codegen. Boosted trees
use MLlib. Metrics are one aggregate each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import round_half_even
from fieldcast.operators import scoring as M


# ------------------------------------------------------------------ T1-T4
def preseason_dataset(context: DataFrame, players: DataFrame, stats: DataFrame,
                      target_weeks: int = S.TARGET_WEEKS, min_games: int = S.MIN_TARGET_GAMES) -> DataFrame:
    """Context rows paired with that season's actual points per game
    (weeks <= target_weeks, at least min_games games)."""
    early = stats.where(F.col("week") <= target_weeks).groupBy("player_id", "season").agg(
        F.avg("fantasy_points").alias("actual_ppg"), F.count(F.lit(1)).alias("games_played")) \
        .where(F.col("games_played") >= min_games)
    return context.join(players.select("player_id", "position"), "player_id") \
        .join(early, ["player_id", "season"]) \
        .select("player_id", "season", "position", *S.PRESEASON_FEATURE_ORDER, "actual_ppg", "games_played")


def preseason_prepare(ds: DataFrame, keep: Sequence[str] = ("player_id", "season", "actual_ppg")) -> DataFrame:
    """Flags -> int, declared defaults (M2), draft decay (M3), rows
    without a target dropped."""
    flags = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("is_rookie", "qb_changed")}
    vec = M.draft_decay(M.preseason_defaults(ds.withColumns(flags), keep=keep))
    return vec.where(F.col("actual_ppg").isNotNull())


def time_split(df: DataFrame, holdout_weeks: int = 4, week: str = "week") -> DataFrame:
    """is_valid = week > max(week) - holdout_weeks (max as a scalar subquery)."""
    cut = df.select(F.max(week)).scalar() - holdout_weeks
    return df.withColumn("is_valid", F.col(week) > cut)


def season_split(df: DataFrame, season: str = "season") -> DataFrame:
    """T4: the latest season is the holdout."""
    return df.withColumn("is_valid", F.col(season) == df.select(F.max(season)).scalar())


# ------------------------------------------------------------------ T5 / T7
@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray                     # raw-unit coefficients
    intercept: float
    means: np.ndarray
    version: str = "ridge"
    framework: str = "linear"
    meta: dict = field(default_factory=dict)

    @property
    def baseline(self) -> float:
        """Prediction at the training means (the attribution baseline)."""
        return float(self.intercept + self.coef @ self.means)

    def predict(self, name: str = "prediction") -> Column:
        expr = F.lit(float(self.intercept))
        for f, c in zip(self.features, self.coef):
            expr = expr + F.col(f).cast("double") * F.lit(float(c))
        return expr.alias(name)

    def score(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict())

    def coefficients(self, spark) -> DataFrame:
        rows = [(f, float(c), float(m)) for f, c, m in zip(self.features, self.coef, self.means)]
        return spark.createDataFrame(rows, "feature string, coef double, mean double")


def gram(df: DataFrame, features: Sequence[str], label: str, collected: int = 64) -> dict[str, np.ndarray]:
    """Counts, means and the centred scatter of features and label (the label last).

    Each task condenses its rows to (n, means, scatter about its own means);
    two such states combine exactly without sums of raw products, so nothing
    cancels at large means or many rows. States are merged over a shuffle until
    at most `collected` of them reach the driver, whatever the input's size.
    Nulls count as 0; rows with a null label are left out.
    """
    k = len(features) + 1
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.where(F.col(label).isNotNull()).select(*columns, F.col(label).cast("double").alias("y"))
    state = "n double, mean array<double>, scatter array<double>"

    def condense(batches):
        return _state_rows((np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows), k)

    def combine(batches):
        total = None
        for b in batches:
            for n, mean, scatter in zip(*[c.to_pylist() for c in b.columns]):
                total = merged_moments(total, (n, np.array(mean), np.array(scatter).reshape(k, k)))
        yield from _state_batch(total)

    states = rows.mapInArrow(condense, state)
    met = states.repartition(collected).mapInArrow(combine, state).collect()
    total = None
    for r in sorted(met, key=lambda r: (r["n"], r["mean"])):
        total = merged_moments(total, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
    n, mean, scatter = total if total else (0.0, np.zeros(k), np.zeros((k, k)))
    return {"n": n, "mean": mean[:-1], "label_mean": mean[-1], "scatter": scatter[:-1, :-1], "cross": scatter[:-1, -1]}


def merged_moments(a, b):
    """(n, means, centred scatter) of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _state_rows(blocks, k: int):
    total = None
    for x in blocks:
        x = np.asfortranarray(x)   # sums run along the columns, pairwise
        mean = x.mean(axis=0)
        total = merged_moments(total, (float(len(x)), mean, (x - mean).T @ (x - mean)))
    yield from _state_batch(total)


def _state_batch(total):
    import pyarrow as pa

    if total is not None:
        n, mean, scatter = total
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])],
                                         ["n", "mean", "scatter"])


def _constrained_solve(a: np.ndarray, c: np.ndarray, signs: np.ndarray, iters: int = 200_000,
                       tol: float = 1e-10) -> np.ndarray:
    """min 1/2 b'Ab - c'b subject to signs[j] * b[j] >= 0 (0 = free), by
    cyclic coordinate descent (A is positive definite thanks to the ridge)."""
    b = np.zeros(len(c))
    for _ in range(iters):
        delta = 0.0
        for j in range(len(c)):
            if a[j, j] <= 0:
                continue
            new = b[j] + (c[j] - a[j] @ b) / a[j, j]
            if signs[j] > 0:
                new = max(new, 0.0)
            elif signs[j] < 0:
                new = min(new, 0.0)
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta < tol:
            return b
    raise RuntimeError(f"the constrained fit has not converged after {iters} rounds (last step {delta:g})")


def fit_linear(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0,
               directions: Mapping[str, int] | None = None, version: str = "ridge") -> LinearModel:
    """T5 (directions=None): ridge on standardised features (population std,
    intercept unpenalised), alpha as in the reference's Ridge(alpha=1).
    T7: the same objective with sign constraints per feature (+1 the
    projection may only rise with the feature, -1 only fall, 0 free). A
    linear model meets a sign constraint for every row, not just on average."""
    features = list(features)
    g = gram(df, features, label)
    n = g["n"]
    if n == 0:
        raise ValueError("no training rows")
    mx, my, cov = g["mean"], g["label_mean"], g["scatter"]
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    sd[sd == 0] = 1.0
    a = cov / np.outer(sd, sd) + alpha * np.eye(len(features))
    c = g["cross"] / sd
    if directions:
        signs = np.array([float(directions.get(f, 0)) for f in features])
        bz = _constrained_solve(a, c, signs)
    else:
        bz = np.linalg.solve(a, c)
    coef = bz / sd
    return LinearModel(features, coef, float(my - coef @ mx), mx, version=version,
                       framework="monotone_linear" if directions else "linear")


# ------------------------------------------------------------------ T6 / T11
def train_gbt(df: DataFrame, features: Sequence[str], label: str, valid_col: str = "is_valid",
              max_iter: int = 200, max_depth: int = 4, step: float = 0.05, seed: int = 42):
    """Boosted trees with early stopping on the holdout rows (MLlib
    validationIndicatorCol). Returns the fitted PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                       validationIndicatorCol=valid_col, maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step, seed=seed, validationTol=0.001)
    return Pipeline(stages=[asm, gbt]).fit(df.withColumn(valid_col, F.col(valid_col).cast("boolean")))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Importances of a fitted tree model as a table, largest first."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


# ------------------------------------------------------------------ T8 / T9 / T12
def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = (),
                       digits: int = 4) -> DataFrame:
    """Rmse, mae, r2, residual_std (population), n_valid in one aggregate
    (grouped by `by` for slices)."""
    e = F.col(pred) - F.col(label)
    agg = df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_ss_res"), (F.count(F.lit(1)) * F.var_pop(label)).alias("_ss_tot"),
        F.stddev_pop(e).alias("residual_std"), F.count(F.lit(1)).alias("n_valid"))
    r2 = F.when(F.col("_ss_tot") > 0, 1 - F.col("_ss_res") / F.col("_ss_tot")).otherwise(F.lit(0.0))
    rd = lambda c: round_half_even(c, digits)
    return agg.select(*by, rd("rmse").alias("rmse"), rd("mae").alias("mae"), rd(r2).alias("r2"),
                      rd("residual_std").alias("residual_std"), "n_valid")


def naive_metrics(df: DataFrame, label: str, naive_col: str, name: str) -> DataFrame:
    """A baseline is the metrics of an existing column."""
    return regression_metrics(df, label, naive_col).select(F.lit(name).alias("model"), "*")


def slice_metrics(df: DataFrame, label: str, pred: str, slice_col: str, min_rows: int = 1) -> DataFrame:
    """Metrics per slice; slices of fewer than `min_rows` rows are
    refused (metrics null, `refused` true). By default every slice is reported."""
    m = regression_metrics(df, label, pred, by=[slice_col])
    ok = F.col("n_valid") >= min_rows
    return m.select(slice_col, *[F.when(ok, F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "residual_std")],
                    "n_valid", (~ok).alias("refused"))


# ------------------------------------------------------------------ T10 / T13
def bake_off(results: DataFrame) -> DataFrame:
    """Per kind, models sorted by rmse, lift vs that kind's baseline,
    winner = best non-baseline. `results`: kind, model, framework, rmse, mae,
    is_baseline."""
    base = results.where("is_baseline").groupBy("kind").agg(F.min("rmse").alias("_base"))
    w = Window.partitionBy("kind").orderBy("rmse", "model")
    wt = Window.partitionBy("kind", "is_baseline").orderBy("rmse", "model")
    out = results.join(F.broadcast(base), "kind", "left").withColumns({
        "lift_pct": F.when(~F.col("is_baseline"),
                           F.bround((F.col("_base") - F.col("rmse")) / F.col("_base") * 100, 1)),
        "position": F.row_number().over(w),
        "winner": (~F.col("is_baseline")) & (F.row_number().over(wt) == 1),
    })
    return out.drop("_base")


def training_source_gate(df: DataFrame, min_rows: int = S.MIN_TRAINING_ROWS) -> bool:
    """Enough rows to train? Reads at most `min_rows` rows."""
    return df.limit(min_rows).count() >= min_rows


# ------------------------------------------------------------------ T14
def monotone_audit(rows: DataFrame, key: Sequence[str], feature: str, lo: float, hi: float, steps: int,
                   score, direction: int) -> DataFrame:
    """Sweep `feature` over [lo, hi] for every row (others fixed), score
    with `score` (DataFrame -> DataFrame with `prediction`), and count the
    steps where the projection moves against `direction`."""
    key = list(key)
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    swept = rows.withColumn("_step", F.explode(grid)) \
        .withColumn(feature, F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col("_step") / F.lit(max(steps - 1, 1)))
    scored = score(swept)
    w = Window.partitionBy(*key).orderBy("_step")
    diff = F.col("prediction") - F.lag("prediction").over(w)
    bad = F.when(diff * F.lit(direction) < -1e-9, 1).otherwise(0)
    return scored.withColumn("_bad", bad).groupBy(*key).agg(
        F.sum("_bad").cast("int").alias("violations"), F.min("prediction").alias("min_prediction"),
        F.max("prediction").alias("max_prediction")).withColumn("feature", F.lit(feature))


def monotone_audits(rows: DataFrame, key: Sequence[str], directions: Mapping[str, int], steps: int, score,
                    lo_hi: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """T14 for every feature of `directions`: (feature, direction, rows, violations, largest).

    A feature is swept from its smallest to its largest value in `rows` (or over
    `lo_hi`). Rows are spread once over features and steps and scored once;
    `largest` is the largest move against the direction.
    """
    names = list(directions)
    ends = rows.agg(*[F.min(f).cast("double").alias(f"a{i}") for i, f in enumerate(names)],
                    *[F.max(f).cast("double").alias(f"z{i}") for i, f in enumerate(names)]).first()
    span = {f: (lo_hi or {}).get(f, (ends[f"a{i}"] or 0.0, ends[f"z{i}"] or 0.0)) for i, f in enumerate(names)}
    sweeps = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(int(d)).alias("direction"), F.lit(float(span[f][0])).alias("lo"),
                                F.lit(float(span[f][1])).alias("hi")) for f, d in directions.items()])
    swept = rows.withColumn("_s", F.explode(sweeps)).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * F.col("_step") / F.lit(max(steps - 1, 1))
    scored = score(swept.withColumns({f: F.when(F.col("_s.feature") == f, at).otherwise(F.col(f).cast("double")) for f in names}))
    w = Window.partitionBy(*key, "_s.feature").orderBy("_step")
    against = (F.lag("prediction").over(w) - F.col("prediction")) * F.col("_s.direction")
    moved = scored.withColumn("_against", F.coalesce(against, F.lit(0.0)))
    return moved.groupBy(F.col("_s.feature").alias("feature"), F.col("_s.direction").alias("direction")).agg(
        F.count_if(F.col("_step") == 0).alias("rows"), F.count_if(F.col("_against") > 1e-9).alias("violations"),
        F.greatest(F.max("_against"), F.lit(0.0)).alias("largest"))
