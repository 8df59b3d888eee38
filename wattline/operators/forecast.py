"""Walk-forward forecasting: folds, feature pruning, additive and boosted models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from math import ceil, pi

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import ForecastConfig
from ..functions import chunks
from ..functions.order_stats import quantile
from ..functions.staging import scratch, stage
from ..schema import DEMAND, KEYS, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, RENEWABLE, TS
from .features import model_columns

TARGETS = {PRED_DEMAND: DEMAND, PRED_RENEWABLE: RENEWABLE, PRED_PRICE: PRICE}
ROW = chunks.ROW


# ---------------------------------------------------------------- folds


def series_lengths(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def walk_forward_folds(lengths: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS) -> DataFrame:
    """Rolling (train, test) row offsets per series; rows after the last full test window stay unused.

    The train window shrinks to what fits before one test window; a series too short for that gets no fold.
    """
    if fc.train_days < 1 or fc.test_days < 1:
        raise ValueError("walk-forward windows must be positive")
    test = F.lit(fc.test_days * 24).cast("long")
    train = F.least(F.lit(fc.train_days * 24).cast("long"), F.greatest(F.col("rows") - test, F.lit(0)))
    steps = F.floor((F.col("rows") - test - F.col("_train")) / test)
    fold = (
        lengths.withColumn("_train", train)
        .where(F.col("_train") > 0)
        .select(*keys, "_train", F.explode(F.sequence(F.lit(0), steps)).alias("fold"))
    )
    end = F.col("_train") + F.col("fold") * test
    return fold.select(
        *keys,
        F.col("fold").cast("long").alias("fold"),
        (end - F.col("_train")).alias("train_start"),
        end.alias("train_end"),
        end.alias("test_start"),
        (end + test).alias("test_end"),
    )


@dataclass(frozen=True)
class TimeFolds:
    """Walk-forward windows in hours since ``start``, the same for all series: what pooled models are cut by."""

    start: int
    train: int
    test: int
    count: int

    def hour(self, ts: str = TS) -> Column:
        return chunks.hour_index(ts) - F.lit(self.start)

    def train_window(self, fold: int, ts: str = TS) -> Column:
        return self.hour(ts).between(fold * self.test, fold * self.test + self.train - 1)

    def test_window(self, fold: int, ts: str = TS) -> Column:
        first = fold * self.test + self.train
        return self.hour(ts).between(first, first + self.test - 1)


def time_folds(df: DataFrame, fc: ForecastConfig = ForecastConfig(), ts: str = TS) -> TimeFolds:
    """Folds over the hours from the first to the last row of all series.

    Row numbers would do for one series. Pooled, a series that starts late would lend its later hours to the
    training of folds whose test window lies before them.
    """
    if fc.train_days < 1 or fc.test_days < 1:
        raise ValueError("walk-forward windows must be positive")
    hour, test = chunks.hour_index(ts), fc.test_days * 24
    ends = df.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
    hours = 0 if ends["a"] is None else ends["b"] - ends["a"] + 1
    train = min(fc.train_days * 24, hours - test)
    if train <= 0:
        need = max(fc.test_days * 48, (fc.train_days + fc.test_days) * 24)
        raise ValueError(f"not enough hours for walk-forward training: {hours}; need at least {need}")
    return TimeFolds(int(ends["a"]), int(train), test, int((hours - test - train) // test + 1))


def require_folds(folds: DataFrame, fc: ForecastConfig = ForecastConfig()) -> DataFrame:
    if folds.isEmpty():
        need = max(fc.test_days * 48, (fc.train_days + fc.test_days) * 24)
        raise ValueError(f"not enough rows for walk-forward training; need at least {need} hourly rows")
    return folds


def first_train_rows(lengths: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS) -> DataFrame:
    """Rows of the first train window of each series."""
    test, train = max(fc.test_days, 1) * 24, max(fc.train_days, 1) * 24
    feasible = F.when(F.col("rows") > test, F.col("rows") - test).otherwise(F.col("rows"))
    return lengths.select(
        *keys, "rows", F.greatest(F.least(F.lit(train).cast("long"), feasible), F.lit(2).cast("long")).alias("fit_rows")
    )


def adjust_train_days(rows: int, fc: ForecastConfig = ForecastConfig()) -> ForecastConfig:
    """Shrink the train window of a run to the usable rows; at least two test windows are needed."""
    test = fc.test_days * 24
    if rows < 2 * test:
        raise ValueError(f"not enough hourly rows: have {rows}, need at least {2 * test}")
    if rows >= max(2 * test, (fc.train_days + fc.test_days) * 24):
        return fc
    return replace(fc, train_days=max(1, max(rows - test, test) // 24))


# ---------------------------------------------------------------- feature pruning


def _pair_sums(x: np.ndarray) -> np.ndarray:
    """Pairwise-complete sums of one chunk: counts, sums, squares and products, p x p each."""
    mask = np.isfinite(x).astype(float)
    v = np.where(mask > 0, x, 0.0)
    return np.stack([mask.T @ mask, v.T @ mask, (v * v).T @ mask, v.T @ v])


def _correlations(sums: np.ndarray) -> np.ndarray:
    n, s, q, p = sums
    with np.errstate(all="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        return np.abs(cov / np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0)))


def greedy_keep(names, std, corr, threshold: float, near_constant: float) -> list[tuple]:
    """(feature, kept, reason, partner, abs correlation) in feature order; the earlier feature wins."""
    kept: list[int] = []
    out = []
    for i, name in enumerate(names):
        if not np.isfinite(std[i]) or std[i] <= near_constant:
            out.append((name, False, "near_constant", None, None))
            continue
        partner = next((j for j in kept if np.isfinite(corr[i, j]) and corr[i, j] > threshold), None)
        if partner is None:
            kept.append(i)
            out.append((name, True, "kept", None, None))
        else:
            out.append((name, False, "correlated", names[partner], float(corr[i, partner])))
    if not kept:
        return [(n, True, "unpruned", None, None) for n in names]
    return out


def prune_features(
    df: DataFrame, cols, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS, pooled: bool = False
) -> DataFrame:
    """Which features survive, judged on the first train window of each series only.

    Each chunk of a series is reduced to pairwise sums; a series (or, ``pooled``, the whole frame) is
    the sum of its chunks. What meets in one task is p x p numbers per chunk, never the rows. The window of a
    pooled pruning is the first one on the common clock, so a late series adds nothing from after it.
    """
    cols = list(cols)
    if pooled:
        clock = time_folds(df, fc, ts)
        head = df.select(*keys, ts, *cols).where(clock.hour(ts) < clock.train)
    else:
        rows = chunks.number_rows(df.select(*keys, ts, *cols), keys, ts)
        fit = first_train_rows(series_lengths(df, keys), fc, keys).drop("rows")
        head = chunks.attach(rows, fit, keys, ts).where(F.col(ROW) < F.col("fit_rows"))
    head = chunks.split(head, ts).drop(chunks.HALO)
    centre = head.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols]).first()
    shift = np.array([float(centre[c]) for c in cols])
    p = len(cols)

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = _pair_sums(pdf[cols].to_numpy(dtype=float) - shift)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "sums": [sums.ravel()]})

    key_ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    parts = head.groupBy(*chunks.chunk_keys(keys)).applyInPandas(reduce_chunk, f"{key_ddl}sums array<double>")
    group = [] if pooled else list(keys)
    flat = parts.select(*group, F.posexplode("sums").alias("pos", "v"))
    total = flat.groupBy(*group, "pos").agg(F.sum("v").alias("v"))
    packed = total.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    packed = packed.select(*group, F.col("m.v").alias("sums"))

    def decide(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                s = np.asarray(row["sums"], dtype=float).reshape(4, p, p)
                n, m, q = (np.diag(x) for x in s[:3])
                with np.errstate(all="ignore"):
                    std = np.sqrt(np.maximum(q - m * m / n, 0) / (n - 1))
                picks = greedy_keep(cols, std, _correlations(s), fc.correlation_threshold, fc.near_constant_std)
                out = pd.DataFrame(picks, columns=["feature", "kept", "reason", "correlated_with", "abs_correlation"])
                out.insert(0, "position", range(p))
                for g in reversed(group):
                    out.insert(0, g, row[g])
                yield out

    group_ddl = "" if pooled else key_ddl
    return packed.mapInPandas(
        decide,
        f"{group_ddl}position int, feature string, kept boolean, reason string, correlated_with string, "
        "abs_correlation double",
    )


def kept_features(pruned: DataFrame) -> list[str]:
    """Names kept by a pooled pruning, in order; bounded by the number of columns."""
    return [r.feature for r in pruned.where("kept").orderBy("position").collect()]


def correlation_matrix(df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """Pairwise correlations per series, long format; one aggregate pass for a modest number of columns."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.groupBy(*keys).agg(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("corr")).alias(f"_c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_c{i}") for i in range(len(pairs))])))


# ---------------------------------------------------------------- additive model


def additive_basis(df: DataFrame, regressors, knots: int, daily: int, weekly: int, ts: str = TS):
    """Trend, hinges, Fourier terms and regressors as columns; returns (frame, names)."""
    hour = chunks.hour_index(ts).cast("double")
    made = {"_b_one": F.lit(1.0), "_b_trend": F.col(ROW) / F.col("_rows")}
    for i in range(1, knots + 1):
        made[f"_b_hinge{i}"] = F.greatest(F.col(ROW) / F.col("_rows") - F.lit(i / (knots + 1)), F.lit(0.0))
    for name, period, order in (("day", 24, daily), ("week", 168, weekly)):
        for k in range(1, order + 1):
            angle = hour * F.lit(2 * pi * k / period)
            made[f"_b_{name}_sin{k}"], made[f"_b_{name}_cos{k}"] = F.sin(angle), F.cos(angle)
    names = [*made, *regressors]
    return df.withColumns(made), names


def _solve(gram: np.ndarray, p: int, targets: int, ridge: float) -> np.ndarray:
    """Ridge on standardised columns from summed products; column 0 is the intercept."""
    xx, xy = gram[:p, :p], gram[:p, p:]
    n = max(xx[0, 0], 1.0)
    mean = xx[0] / n
    std = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0))
    std[std < 1e-9] = 1.0
    mean, std = mean.copy(), std.copy()
    mean[0], std[0] = 0.0, 1.0
    # Change of basis: z_j = (x_j - mean_j) / std_j, with z_0 = 1.
    t = np.diag(1.0 / std)
    t[1:, 0] = -mean[1:] / std[1:]
    zz, zy = t @ xx @ t.T, t @ xy
    penalty = np.eye(p) * ridge * n
    penalty[0, 0] = 0.0
    w = np.linalg.lstsq(zz + penalty, zy, rcond=None)[0]
    return (t.T @ w).T.reshape(targets, p)


def fit_additive(
    df: DataFrame, regressors=(), fc: ForecastConfig = ForecastConfig(), targets=None, keys=KEYS, ts: str = TS,
    knots: int = 4, daily: int = 4, weekly: int = 3, ridge: float = 1e-3,
):
    """Walk-forward additive regression of all targets for every series and fold at once.

    Folds overlap, so rows are not repeated per fold: each stretch between fold edges is reduced to
    one matrix of summed products, a fold adds up the stretches of its train window, and one small
    solve per (series, fold) gives the coefficients. Returns (out-of-fold predictions, coefficients).
    """
    targets = dict(targets or TARGETS)
    regressors = list(regressors)
    lengths = series_lengths(df, keys)
    rows = chunks.number_rows(df, keys, ts)
    rows = chunks.attach(rows, lengths.withColumnRenamed("rows", "_rows"), keys, ts)
    shifts = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in [*regressors, *targets.values()]]).first()
    centred = {f"_r_{c}": F.coalesce(F.col(c) - F.lit(float(shifts[c])), F.lit(0.0)) for c in regressors}
    rows = rows.withColumns(centred)
    rows, names = additive_basis(rows, [f"_r_{c}" for c in regressors], knots, daily, weekly, ts)
    ys = list(targets.values())
    p, m = len(names), len(ys)
    test, train = fc.test_days * 24, fc.train_days * 24
    # Stretches between consecutive fold edges: starts at multiples of the test length, ends offset by
    # the train length. Every fold boundary is an edge, so a stretch lies wholly in or out of a fold.
    width = F.least(F.lit(train), F.greatest(F.col("_rows") - F.lit(test), F.lit(0)))
    lap, rest = F.floor(F.col(ROW) / F.lit(test)), F.pmod(width, F.lit(test))
    piece = lap * 2 + (F.pmod(F.col(ROW), F.lit(test)) >= rest).cast("long")
    rows = stage(rows.withColumns({"_piece": piece, "_width": width.cast("long")}))

    def reduce_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[ys].to_numpy(dtype=float)
        ok = np.isfinite(y).all(axis=1)
        x = np.hstack([pdf[names].to_numpy(dtype=float), y])[ok]
        head = {k: [pdf[k].iloc[0]] for k in (*keys, "_piece", "_rows", "_width")}
        return pd.DataFrame({**head, "_at": [int(pdf[ROW].min())], "gram": [(x.T @ x).ravel()]})

    key_ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    grams = rows.select(*keys, "_piece", "_rows", "_width", ROW, *names, *ys).groupBy(*keys, "_piece").applyInPandas(
        reduce_piece, f"{key_ddl}_piece long, _rows long, _width long, _at long, gram array<double>"
    )
    # The folds whose train window covers a stretch follow from its first row.
    at, span, n = F.col("_at"), F.col("_width"), F.col("_rows")
    lo = F.greatest(F.floor((at - span) / F.lit(test)) + 1, F.lit(0))
    hi = F.least(F.floor(at / F.lit(test)), F.floor((n - test - span) / F.lit(test)))
    per_fold = grams.where((span > 0) & (hi >= lo)).withColumn("fold", F.explode(F.sequence(lo, hi)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0).reshape(p + m, p + m)
        coef = _solve(gram, p, m, ridge)
        head = {k: [pdf[k].iloc[0]] for k in (*keys, "fold")}
        return pd.DataFrame({**head, "coef": [coef.ravel()]})

    coefs = per_fold.select(*keys, "fold", "gram").groupBy(*keys, "fold").applyInPandas(
        solve, f"{key_ddl}fold long, coef array<double>"
    )
    coefs = stage(coefs)
    # A test row has exactly one fold, given by its offset.
    fold_of = F.floor((F.col(ROW) - F.col("_width")) / F.lit(test))
    tested = rows.withColumn("fold", fold_of).join(coefs, [*keys, "fold"])
    preds = {}
    for j, pred in enumerate(targets):
        preds[pred] = sum((F.col(n) * F.col("coef")[j * p + i] for i, n in enumerate(names)), F.lit(0.0))
    drop = [n for n in names if n.startswith("_")]
    scored = tested.withColumns(preds).drop("coef", "_piece", "_rows", "_width", ROW, *drop)
    labels = ["intercept", *[n.removeprefix("_b_").removeprefix("_r_") for n in names[1:]]]
    table = coefs.select(
        *keys,
        "fold",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("target"), F.lit(labels[i]).alias("term"), F.col("coef")[j * p + i].alias("effect"))
                    for j, t in enumerate(ys)
                    for i in range(p)
                ]
            )
        ).alias("_c"),
    ).select(*keys, "fold", "_c.*")
    return scored, table


def regressor_effects(coefs: DataFrame, regressors, n: int = 20, keys=KEYS) -> DataFrame:
    """The n largest regressor coefficients of the last fold, by absolute value, per series and target."""
    last = coefs.groupBy(*keys).agg(F.max("fold").alias("fold"))
    w = Window.partitionBy(*keys, "target").orderBy(F.abs("effect").desc(), F.col("term"))
    return (
        coefs.join(last, [*keys, "fold"])
        .where(F.col("term").isin(list(regressors)))
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= n)
        .drop("fold")
    )


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class BoostParams:
    trees: int = 300
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9


# The search grid, the default first.
GRID = (
    BoostParams(),
    BoostParams(trees=500, depth=4),
    BoostParams(depth=4, step=0.1),
    BoostParams(trees=500, step=0.03),
    BoostParams(trees=200, depth=8),
    BoostParams(trees=400, depth=3, step=0.1),
)
#: Fits that the driver starts side by side; Spark shares its executors among their tasks.
PARALLEL_FITS = 6
#: Rows of a train window in one task. Each level of a tree is a job over them, thousands a fit.
FIT_ROWS = 16384
#: Trees between checkpoints of a fit; every job carries the trees since the last one.
CHECKPOINT_TREES = 3
MIN_TUNING_FIT_ROWS = 48
MIN_TUNING_VALIDATION_ROWS = 24
MIN_VALIDATION_ROWS = 8
MIN_FIT_ROWS = 16


def assembled(df: DataFrame, cols) -> DataFrame:
    doubles = df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in cols})
    names = [f"_x_{c}" for c in cols]
    out = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(doubles)
    return out.drop(*names)


def booster(target: str, params: BoostParams, seed: int, out: str = "_pred") -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features", labelCol=target, predictionCol=out, maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.step, subsamplingRate=params.row_share, featureSubsetStrategy=str(params.column_share), seed=seed,
        checkpointInterval=CHECKPOINT_TREES,
    )


def fold_frame(df: DataFrame, cols, fc: ForecastConfig, keys=KEYS, ts: str = TS) -> tuple[DataFrame, TimeFolds]:
    """Staged rows with assembled features, and the folds that all fits on them share.

    A fit draws its share of the rows by their place, so they are dealt out by key and time and put in order.
    """
    rows = stage(assembled(df, cols).repartition(*keys, ts).sortWithinPartitions(*keys, ts))
    return rows, time_folds(rows, fc, ts)


def fit_boosted(
    df: DataFrame, cols, target: str, pred: str, fc: ForecastConfig = ForecastConfig(),
    params: BoostParams = BoostParams(), keys=KEYS, ts: str = TS, early_stopping: bool = False,
    tolerance: float = 0.01, frame=None, final: bool = True, parallel: int = PARALLEL_FITS,
):
    """Out-of-fold predictions (keys, ts, pred) and, if asked, a final model over all rows.

    One model per fold is trained on the train window of all series together, cut by time; Spark ML spreads each
    fit over the cluster and up to ``parallel`` fits run side by side. Every fold writes its predictions to one
    table, so nothing of a fitted model is in the plan of what follows. With ``early_stopping`` the last 15%
    of each train window decide when to stop, and too short windows train a fixed ten rounds.
    """
    rows, clock = frame or fold_frame(df, cols, fc, keys, ts)
    out = scratch(rows.sparkSession, "fold-predictions")

    def one(fold: int) -> None:
        train = rows.where(clock.train_window(fold, ts) & F.col(target).isNotNull())
        fitted = _fit(train, target, params, fc, early_stopping, tolerance, clock.hour(ts), fold * clock.test, clock.train)
        part = fitted.transform(rows.where(clock.test_window(fold, ts)))
        part.select(*keys, ts, F.col("_pred").alias(pred)).write.parquet(f"{out}/fold={fold}")

    side_by_side(rows.sparkSession, [lambda k=k: one(k) for k in range(clock.count)], parallel)
    parts = rows.sparkSession.read.parquet(out).select(*keys, ts, pred)
    model = fit_final(rows, target, fc, params, early_stopping, tolerance, clock, ts) if final else None
    return parts, model


def side_by_side(spark: SparkSession, jobs: list, parallel: int) -> list:
    """Run driver-side calls that each start Spark jobs, a few at a time; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def fit_final(rows: DataFrame, target: str, fc, params, early_stopping: bool, tolerance: float, clock: TimeFolds, ts: str = TS):
    """A model over all rows of a fold frame."""
    hours = (clock.count - 1) * clock.test + clock.train + clock.test
    return _fit(rows.where(F.col(target).isNotNull()), target, params, fc, early_stopping, tolerance, clock.hour(ts), 0, hours)


def _fit(train, target, params, fc, early_stopping, tolerance, hour, first: int, hours: int):
    """``train`` covers ``hours`` from hour ``first`` on."""
    model = booster(target, params, fc.seed)
    if early_stopping:
        tail = max(int(hours * 0.15), MIN_VALIDATION_ROWS)
        train = train.withColumn("_late", hour >= first + hours - tail)
        few = train.agg(F.count_if(~F.col("_late")).alias("n")).first()["n"] < MIN_FIT_ROWS
        if few:
            model.setMaxIter(min(params.trees, 10))
        else:
            model.setValidationIndicatorCol("_late").set(model.validationTol, tolerance)
    return model.fit(packed(train))


def packed(train: DataFrame) -> DataFrame:
    """The same rows in as many tasks as their number asks for, however many the staged frame was written in."""
    return train.coalesce(max(1, ceil(train.count() / FIT_ROWS)))


def tune(
    df: DataFrame, cols, target: str, fc: ForecastConfig = ForecastConfig(), grid=GRID, keys=KEYS, ts: str = TS,
    frame=None, parallel: int = PARALLEL_FITS,
) -> tuple[BoostParams, list[dict]]:
    """Fit each candidate on the head of the first train window, score it on the tail; ties keep the first.

    The window is cut by time over all series, and candidates are fitted side by side. Returns the default without
    a search when the window is too short for both parts.
    """
    rows, clock = frame or fold_frame(df, cols, fc, keys, ts)
    tail = max(int(clock.train * fc.validation_fraction), MIN_TUNING_VALIDATION_ROWS)
    cut, hour = clock.train - tail, clock.hour(ts)
    known = rows.where(F.col(target).isNotNull())
    head, check = known.where((hour >= 0) & (hour < cut)), known.where((hour >= cut) & (hour < clock.train))
    if cut < MIN_TUNING_FIT_ROWS or head.isEmpty():
        return BoostParams(), []

    def score(params: BoostParams) -> float:
        scored = booster(target, params, fc.seed).fit(head).transform(check)
        mae = scored.agg(F.avg(F.abs(F.col("_pred") - F.col(target))).alias("mae")).first()["mae"]
        return float("inf") if mae is None else mae

    maes = side_by_side(rows.sparkSession, [lambda p=p: score(p) for p in grid], parallel)
    log = [{"params": p, "validation_mae": m} for p, m in zip(grid, maes)]
    best = min(range(len(log)), key=lambda i: (maes[i], i), default=None)
    return (BoostParams() if best is None or maes[best] == float("inf") else log[best]["params"]), log


def search_log(spark, log) -> DataFrame:
    rows = [
        (e["params"].trees, e["params"].depth, e["params"].step, float(e["validation_mae"])) for e in log
    ]
    return spark.createDataFrame(rows, "trees int, depth int, step double, validation_mae double")


def feature_importance(model, cols, spark, n: int = 20) -> DataFrame:
    """The n most important features; one number per column."""
    values = sorted(zip(cols, model.featureImportances.toArray()), key=lambda x: -x[1])[:n]
    return spark.createDataFrame([(c, float(v)) for c, v in values], "feature string, importance double")


def ablation_impact(model, df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """Mean absolute change of the prediction over all rows when one feature is replaced by its median in the series.

    Each row carries its own prediction through the replacements, so nothing is joined back.
    A feature that is null in a whole series stays null there.
    """
    cols, keys = list(cols), list(keys)
    base = model.transform(assembled(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]), cols))
    # Rows have no order here: parts by hash serve where chunks of time would.
    values = F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_i", "_v")
    long = df.select(*keys, F.pmod(F.xxhash64(*cols), F.lit(64)).alias(chunks.CHUNK), values)
    middle = quantile(long, [*keys, "_i"], TS, F.col("_v"), 0.5, "_m")
    medians = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_m"))).alias(f"_m_{c}") for i, c in enumerate(cols)])
    rows = base.select(*keys, *cols, F.col("_pred").alias("_base")).join(medians, keys)
    spread = rows.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in cols]))).select(
        "feature", "_base", *[F.when(F.col("feature") == c, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    )
    scored = model.transform(assembled(spread, cols))
    return scored.groupBy("feature").agg(F.avg(F.abs(F.col("_pred") - F.col("_base"))).alias("ablation_impact"))


# ---------------------------------------------------------------- trainers


def selected_columns(features: DataFrame, fc: ForecastConfig, keys=KEYS, ts: str = TS) -> list[str]:
    return kept_features(prune_features(features, model_columns(features, keys), fc, keys, ts, pooled=True))


def train_additive(features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS, **options):
    cols = selected_columns(features, fc, keys, ts)
    return fit_additive(features, cols, fc, keys=keys, ts=ts, **options)[0]


def train_boosted(
    features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS,
    params: BoostParams = BoostParams(), early_stopping: bool = False, search=None, cols=None,
):
    """Scored rows with the three predictions; rows outside the test windows are left out."""
    cols = list(cols or selected_columns(features, fc, keys, ts))
    scored, frame = features, fold_frame(features, cols, fc, keys, ts)
    share = max(1, PARALLEL_FITS // len(TARGETS))

    def one(pred: str, target: str) -> DataFrame:
        best = tune(features, cols, target, fc, search, keys, ts, frame, share)[0] if search else params
        return fit_boosted(features, cols, target, pred, fc, best, keys, ts, early_stopping, frame=frame, final=False, parallel=share)[0]

    jobs = [lambda p=p, t=t: one(p, t) for p, t in TARGETS.items()]
    for part in side_by_side(features.sparkSession, jobs, len(TARGETS)):
        scored = scored.join(part, [*keys, ts], "left")
    return scored.na.drop(subset=list(TARGETS))


def train_early_stopping(features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS, **options):
    return train_boosted(features, fc, keys, ts, early_stopping=True, **options)


def train_recurrent(features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS, **options):
    from .recurrent import train_recurrent as train

    return train(features, fc, keys, ts, **options)


TRAINERS = {
    "boosted": train_boosted, "early_stopping": train_early_stopping, "additive": train_additive, "recurrent": train_recurrent,
}


def train_with_model(key: str, features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS, **options):
    if key not in TRAINERS:
        raise ValueError(f"unsupported model: {key}; known: {sorted(TRAINERS)}")
    return TRAINERS[key](features, fc, keys, ts, **options)
