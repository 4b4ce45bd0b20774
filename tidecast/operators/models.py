"""Model forecasts. The per-entity library fits of classic pipelines become one distributed
MLlib fit over all series; thresholds, gates and blends work on its columns."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast import rules
from tidecast.functions.stats import clip, is_weekend, order_stats, ratio
from tidecast.operators import linear
from tidecast.operators.features import SHIFT_FEATURES, interpolate
from tidecast.session import PART_ROWS, parts

# Importance limit, features never pruned, gates of the residual models.
MIN_IMPORTANCE = 0.005
PROTECTED = ["shift_id", "weekday", "is_weekend", "is_holiday", "holiday_impact", "weighted_lag"]
MIN_FEATURES = 6
MIN_R2 = 0.10
MIN_GAIN = 0.05


def _assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    d = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=cols, outputCol=out).transform(d)


#: Features that a partition of ``PART_ROWS`` rows holds; wider rows have more partitions.
PART_COLUMNS = 12


def _parts(df: DataFrame, cols: list[str]) -> int:
    return parts(df) if len(cols) <= PART_COLUMNS else parts(df, PART_ROWS * PART_COLUMNS // len(cols))


def feature_columns(train: DataFrame, without: list[str]) -> list[str]:
    """Numeric columns of training rows that have data, but for the label, identifiers and what is only
    known with the label (``without``)."""
    numbers = [f.name for f in train.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]
    known = train.agg(*[F.count(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if known[c]]


def _training(df: DataFrame, cols: list[str], *kept: str) -> DataFrame:
    """Rows to fit on, kept in memory: what the fits read, dealt out in partitions of a bounded number
    of rows and features. ``kept``: columns beside the features."""
    keys = [k for k in ("entity", "item", "date", "shift") if k in df.columns]
    return _assemble(df.repartition(_parts(df, cols), *keys), cols).select(*kept, "features").persist()


def _grouped(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Rows to fit boosted trees on: one for each set of feature values, with the mean of the label and the
    number of rows as its weight. Squared errors have the same trees on both, as what differs within a
    group no split can tell apart. Item lines are mostly of series with one row, whose groups do not grow."""
    d = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols], F.col(label).cast("double").alias("__y"))
    d = d.repartition(_parts(df, cols), *cols).groupBy(*cols)
    d = d.agg(F.avg("__y").alias(label), F.count("__y").cast("double").alias("weight"))
    return _assemble(d, cols).select(label, "weight", "features").persist()


def gbt(label: str = "guests", weight: str | None = None, iters: int = 20, depth: int = 4, features: str = "features", seed: int = 7):
    m = GBTRegressor(featuresCol=features, labelCol=label, maxIter=iters, maxDepth=depth, stepSize=0.15, seed=seed)
    return m.setWeightCol(weight) if weight else m


def predict(model, df: DataFrame, name: str) -> DataFrame:
    """Non-negative prediction as column ``name``."""
    return model.transform(df).withColumn(name, F.when(F.col("prediction").isNotNull(), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction")


class NoFit:
    """Stands for a model where there is nothing to learn from: its predictions are null."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(None).cast("double"))


def fit_or_none(estimator, train: DataFrame):
    """The fitted estimator, or :class:`NoFit` on an empty training slice."""
    return NoFit() if train.isEmpty() else estimator.fit(train)


def fit_together(pairs: list[tuple], threads: int | None = None) -> list:
    """Fitted models of (estimator, training rows), as jobs side by side; without a number of ``threads``,
    as many as the largest rows allow."""
    if not pairs:
        return []
    threads = threads or min(side_by_side(rows) for rows in {id(t): t for _, t in pairs}.values())
    run = inheritable_thread_target(pairs[0][1].sparkSession)(fit_or_none)
    with ThreadPoolExecutor(threads) as pool:
        return [j.result() for j in [pool.submit(run, e, t) for e, t in pairs]]


def side_by_side(rows: DataFrame, threads: int = 4) -> int:
    """Fits on ``rows`` to run at once: fewer as their partitions grow beyond the session's number, as each
    fit then fills the cores and keeps a copy of its rows in memory."""
    return max(1, threads * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts(rows))


def cut_dates(df: DataFrame, shares: list[float]) -> Column:
    """First dates at which each share of the rows is reached, from counts per date, as an array."""
    c = df.groupBy("date").agg(F.count("*").alias("k"))
    c = c.withColumns({"u": F.sum("k").over(W.orderBy("date")), "t": F.sum("k").over(W.partitionBy())})
    return c.agg(F.array(*[F.min(F.when(F.col("u") >= x * F.col("t"), F.col("date"))) for x in shares])).scalar()


def cut_date(df: DataFrame, share: float) -> Column:
    """First date at which ``share`` of the rows is reached."""
    return F.get(cut_dates(df, [share]), F.lit(0))


def gbt_forecast(features: DataFrame, horizon: DataFrame, cols: list[str] | None = None, weight: str | None = "sample_weight") -> DataFrame:
    """Boosted trees over all shift series; weak features are dropped and the fit repeated.
    Without training rows the forecast is null."""
    cols = cols or SHIFT_FEATURES
    kept = ["guests", *([weight] if weight else [])]
    train = _training(features, cols, *kept)
    if train.isEmpty():
        train.unpersist()
        return predict(NoFit(), _assemble(horizon, cols), "forecast").drop("features")
    first = gbt(weight=weight).fit(train)
    imp = first.featureImportances.toArray()
    ranked = sorted(zip(cols, imp), key=lambda x: -x[1])
    keep = [c for c in cols if c in PROTECTED or imp[cols.index(c)] >= MIN_IMPORTANCE]
    for c, _ in ranked:
        if len(keep) >= MIN_FEATURES:
            break
        if c not in keep:
            keep.append(c)
    if len(keep) == len(cols):
        model = first
    else:
        some = VectorSlicer(inputCol="features", outputCol="some", indices=[cols.index(c) for c in keep]).transform(train)
        model = gbt(weight=weight).fit(some.select(*kept, F.col("some").alias("features")))
    train.unpersist()
    used = cols if len(keep) == len(cols) else keep
    return predict(model, _assemble(horizon, used), "forecast").drop("features")


# Shares of the base models where nothing tells them apart; the survey's fourth
# model (.10) has no counterpart here, so they are scaled to 1.
STACK_SHARES = {"p_gbt": 0.35, "p_forest": 0.30, "p_linear": 0.25}


def cross_fitted(data: DataFrame, makers: dict, label: str, origins: list[float]) -> DataFrame:
    """Predictions of every maker for the rows behind the first origin, each from a fit on the rows
    before its own fold begins. ``data`` has assembled features and a date."""
    data = data.withColumn("__cuts", cut_dates(data, origins))
    data = data.withColumn("__fold", F.size(F.filter("__cuts", lambda c: c <= F.col("date"))))
    numbers = range(1, len(origins) + 1)
    models = iter(fit_together([(make(), data.where(F.col("__fold") < k)) for k in numbers for make in makers.values()], side_by_side(data)))
    folds = []
    for k in numbers:
        part = data.where(F.col("__fold") == k)
        for name in makers:
            part = predict(next(models), part, name)
        folds.append(part.select("date", "__fold", label, *makers))
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    return out


def stack_weights(crossed: DataFrame, names: list[str], label: str, shares: dict[str, float]) -> dict[str, float]:
    """Non-negative least squares weights of the base predictions; without any rows, or where no
    base helps, the fixed shares."""
    known = crossed.na.drop(subset=[*names, label])
    row = linear.gram(known, [], names, label).first()
    m = np.array(row["m"], float) if row["n"] else np.zeros((len(names), len(names) + 1))
    w = linear.non_negative(m[:, :-1], m[:, -1])
    if not w.sum():
        w = np.array([shares[n] for n in names]) / sum(shares[n] for n in names)
    return {n: float(x) for n, x in zip(names, w, strict=True)}


def stack_forecast(features: DataFrame, horizon: DataFrame, cols: list[str] | None = None, origins: list[float] | None = None) -> DataFrame:
    """Two-level forecast. Each base predicts rows that lie behind what it was fitted on (rolling
    origin); non-negative least squares on these predictions weighs the bases, which are then
    fitted on everything. The weights are columns ``w_...``. Without training rows the forecast is null."""
    cols = cols or SHIFT_FEATURES
    data = _training(features, cols, "date", "guests")
    makers = {
        "p_gbt": lambda: gbt(), "p_forest": lambda: RandomForestRegressor(labelCol="guests", numTrees=20, maxDepth=6, seed=7),
        "p_linear": lambda: LinearRegression(labelCol="guests", regParam=1.0),
    }
    weights = stack_weights(cross_fitted(data, makers, "guests", origins or [0.6, 0.8]), list(makers), "guests", STACK_SHARES)
    out = _assemble(horizon, cols)
    for name, model in zip(makers, fit_together([(make(), data) for make in makers.values()], side_by_side(data)), strict=True):
        out = predict(model, out, name)
    data.unpersist()
    total = sum((F.lit(w) * F.col(n) for n, w in weights.items()), F.lit(0.0))
    return out.drop("features").withColumns({"forecast": total} | {f"w{n[1:]}": F.lit(w) for n, w in weights.items()})


def fourier(date: Column, yearly: int = 4, weekly: int = 3) -> dict[str, Column]:
    t = F.unix_date(date)
    cols = {}
    for k in range(1, yearly + 1):
        cols[f"y_sin{k}"], cols[f"y_cos{k}"] = F.sin(2 * F.pi() * k * t / 365.25), F.cos(2 * F.pi() * k * t / 365.25)
    for k in range(1, weekly + 1):
        cols[f"w_sin{k}"], cols[f"w_cos{k}"] = F.sin(2 * F.pi() * k * t / 7), F.cos(2 * F.pi() * k * t / 7)
    return cols


CHANGES = (0.2, 0.4, 0.6, 0.8)
#: Ridge of the level, the slope, its changes, the weekly and the yearly season and of holidays.
SEASON_RIDGE = {"level": 1e-6, "slope": 0.1, "change": 30.0, "weekly": 0.5, "yearly": 5.0, "holiday": 0.5}


def seasonal_columns(cal: bool) -> tuple[dict[str, Column], list[float]]:
    """Features of a date within an entity's history ``t0`` to ``t1``, and their ridge."""
    t = F.datediff("date", "t0") / F.greatest(F.datediff("t1", "t0"), F.lit(1))
    cols = {"one": F.lit(1.0), "t": t} | {f"t{i}": F.greatest(t - c, F.lit(0.0)) for i, c in enumerate(CHANGES)}
    ridge = [SEASON_RIDGE["level"], SEASON_RIDGE["slope"]] + [SEASON_RIDGE["change"]] * len(CHANGES)
    season = fourier(F.col("date"))
    cols |= season
    ridge += [SEASON_RIDGE["yearly" if n.startswith("y") else "weekly"] for n in season]
    if cal:
        cols["hol"] = F.coalesce(F.col("is_holiday").cast("double"), F.lit(0.0))
        ridge.append(SEASON_RIDGE["holiday"])
    return cols, ridge


def seasonal_forecast(day: DataFrame, horizon: DataFrame, cal: DataFrame | None = None, min_days: int = 14) -> DataFrame:
    """Additive trend with changes of slope, weekly and yearly season, and holidays, fitted to every
    entity's own days (ridge, closed form); entities with fewer than ``min_days`` get no value."""
    seen = day.where("guests > 0")
    span = seen.groupBy("entity").agg(
        F.avg("guests").alias("level"), F.count("*").alias("days"), F.min("date").alias("t0"), F.max("date").alias("t1")
    ).where(F.col("days") >= min_days)
    cols, ridge = seasonal_columns(cal is not None)
    hol = cal.select("date", "is_holiday") if cal is not None else None

    def frame(d: DataFrame, *kept: str) -> DataFrame:
        d = d.select("entity", "date", *kept).join(span, "entity")
        d = d.join(hol, "date", "left") if hol is not None else d
        return d.select("entity", "date", *kept, "level", *[c.alias(n) for n, c in cols.items()])

    train = frame(seen, "guests").withColumn("y", F.col("guests") / F.col("level"))
    coef = linear.gram(train, ["entity"], list(cols), "y").select("entity", linear.solve(F.col("m"), ridge).alias("coef"))
    out = frame(horizon).join(coef, "entity").withColumn(
        "forecast", F.greatest(F.lit(0.0), linear.dot(F.col("coef"), [F.col(n) for n in cols]) * F.col("level"))
    )
    return horizon.join(out.select("entity", "date", "forecast"), ["entity", "date"]).select(*horizon.columns, "forecast")


LAGS = 14
AR_RIDGE, AR_LIMIT = 1.0, 5.0


def ar_columns() -> dict[str, Column]:
    """What a day is beside its past: level, weekly season, part of the year, holiday."""
    return {"one": F.lit(1.0)} | fourier(F.col("date"), yearly=2) | {"hol": F.coalesce("hol", F.lit(0.0)), "imp": F.coalesce(F.col("impact") - 1, F.lit(0.0))}


def ar_moments(scaled: DataFrame) -> DataFrame:
    """Sums over the entities for every date that has ``LAGS`` days before it: rows ``n``, the value
    ``lag0`` and each lag, and the products ``p_i_j`` of any two of them.

    scaled: entity, date, y on every day of an entity, and its number of days ``n``. A day is the lag
    ``i`` of the day ``i`` later, so its products with the days before it are summed once, and dealt
    out to the dates they are lags of where there is little left: a row per date and distance to
    the ends of a series, for which only distances up to ``LAGS`` tell days apart.
    """
    w = W.partitionBy("entity").orderBy("date")
    place = F.row_number().over(w)
    d = scaled.select(
        "date", "y", F.least(place - 1, F.lit(LAGS)).alias("before"), F.least(F.col("n") - place, F.lit(LAGS)).alias("behind"),
        *[(F.col("y") * (F.lag("y", k).over(w) if k else F.col("y"))).alias(f"q{k}") for k in range(LAGS + 1)],
    )
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("y", *(f"q{k}" for k in range(LAGS + 1)))]]
    g = d.groupBy("date", "before", "behind").agg(*sums)
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(LAGS))).alias("i")).where((F.col("before") >= LAGS - F.col("i")) & (F.col("behind") >= F.col("i")))
    sums = [F.sum(c).alias(c) for c in ("n", "y", *(f"q{k}" for k in range(LAGS + 1)))]
    g = g.groupBy(F.expr("date_add(date, i)").alias("date"), "i").agg(*sums)
    at = lambda i, c: F.sum(F.when(F.col("i") == i, F.col(c)))
    return g.groupBy("date").agg(
        at(0, "n").alias("n"), *[at(i, "y").alias(f"lag{i}") for i in range(LAGS + 1)],
        *[at(i, f"q{j - i}").alias(f"p_{i}_{j}") for i in range(LAGS + 1) for j in range(i, LAGS + 1)],
    )


def ar_gram(moments: DataFrame, own: list[str]) -> DataFrame:
    """(n, m) as of :func:`linear.gram` for the lags, then the ``own`` columns of a date, and the label
    ``lag0``, from the sums of each date (:func:`ar_moments`)."""
    names = [*(f"lag{i}" for i in range(1, LAGS + 1)), *own, "lag0"]

    def product(a: str, b: str) -> Column:
        i, j = (int(x[3:]) if x.startswith("lag") else None for x in (a, b))
        if i is None and j is None:
            return F.col("n") * F.col(a) * F.col(b)
        return F.col(a) * F.col(b) if i is None or j is None else F.col(f"p_{min(i, j)}_{max(i, j)}")

    return linear.gram_of(moments, names, product, F.sum("n"))


def global_forecast(day: DataFrame, cal: DataFrame, horizon: DataFrame, min_days: int = 60, min_entities: int = 5) -> DataFrame:
    """One autoregression for all suitable entities: long enough, not constant, with weekdays and
    weekends, and at least ``min_entities`` of them.

    The gap-filled series, in parts of their mean, are explained by their last ``LAGS`` days and the
    calendar; the coefficients come from one sum over all days. From an entity's last day on, every
    day is forecast from the ones before it, forecast or not, up to its last wanted date. Dates that
    are not behind its last day get no value.
    """
    full = interpolate(day)
    ok = full.groupBy("entity").agg(
        F.count("*").alias("n"), F.stddev_pop("guests").alias("sd"), F.avg("guests").alias("level"),
        F.count_if(is_weekend(F.col("date"))).alias("we"), F.count_if(~is_weekend(F.col("date"))).alias("wd"),
    ).where((F.col("n") >= min_days) & (F.col("sd") > 0) & (F.col("we") > 0) & (F.col("wd") > 0)).select("entity", "n", "level")
    ok = ok.where(ok.agg(F.count("*")).scalar() >= min_entities)
    c = cal.select("date", F.col("is_holiday").cast("double").alias("hol"), F.col("holiday_impact").alias("impact"))
    w = W.partitionBy("entity").orderBy("date")
    scaled = full.join(ok, "entity").withColumn("y", F.col("guests") / F.col("level"))
    own = ar_columns()
    train = ar_moments(scaled).join(c, "date", "left").withColumns(own)
    coef = ar_gram(train, list(own)).where("n > 0").select(linear.solve(F.col("m"), [AR_RIDGE] * (LAGS + len(own))).alias("coef"))
    # one row; without any it is null, and so are the forecasts
    coef = coef.agg(F.first("coef")).scalar()

    end = horizon.groupBy("entity").agg(F.max("date").alias("until"))
    recent = scaled.withColumn("rn", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("rn") <= LAGS)
    past = recent.groupBy("entity", "level").agg(F.max("date").alias("last"), F.sort_array(F.collect_list(F.struct("date", "y")))["y"].alias("past"))
    steps = past.join(end, "entity").where("until > last").select("entity", "level", "past", F.explode(F.sequence(F.date_add("last", 1), "until")).alias("date"))
    steps = steps.join(c, "date", "left").withColumn("coef", coef)
    pull = linear.dot(F.slice("coef", LAGS + 1, len(own)), list(own.values()))
    runs = steps.withColumn("u", pull).groupBy("entity", "level", "past", "coef").agg(F.sort_array(F.collect_list(F.struct("date", "u"))).alias("days"))

    def next_day(acc: Column, x: Column) -> Column:
        # the newest day has the first coefficient
        terms = F.zip_with(F.reverse(F.slice(acc, -LAGS, LAGS)), F.slice("coef", 1, LAGS), lambda v, a: v * a)
        value = F.aggregate(terms, x["u"], lambda s, v: s + v)
        return F.concat(acc, F.array(F.when(value.isNotNull(), clip(value, 0.0, AR_LIMIT))))

    runs = runs.withColumn("values", F.aggregate("days", F.col("past"), next_day))
    out = runs.select("entity", "level", F.posexplode("days").alias("k", "d"), "values").select(
        "entity", F.col("d.date").alias("date"), (F.get("values", F.col("k") + LAGS) * F.col("level")).alias("forecast")
    )
    return horizon.select("entity", "date").join(out, ["entity", "date"]).where("forecast is not null")


def item_forecast(features: DataFrame, future: DataFrame, cols: list[str], seasonal: DataFrame | None = None, label: str = "quantity") -> DataFrame:
    """Three boosted models over all item series, null-safe equal-weight mean, mixed .7/.3
    with the seasonal value where there is one."""
    train, groups = _training(features, cols, label), _grouped(features, cols, label)
    # the forest draws rows, so it gets every row
    models = {
        "m1": (gbt(label, "weight", iters=15, depth=3), groups), "m2": (gbt(label, "weight", iters=15, depth=5, seed=11), groups),
        "m3": (RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=5, seed=7), train),
    }
    out = _assemble(future, cols)
    for name, m in zip(models, fit_together(list(models.values())), strict=True):
        out = predict(m, out, name)
    groups.unpersist()
    train.unpersist()
    ms = [F.col(n) for n in models]
    total = sum((F.coalesce(m, F.lit(0.0)) for m in ms), F.lit(0.0))
    n = sum((m.isNotNull().cast("int") for m in ms), F.lit(0))
    out = out.withColumn("mean", ratio(total, n.cast("double"))).drop("features")
    if seasonal is None:
        return out.withColumn("forecast", F.col("mean"))
    s = seasonal.withColumnRenamed("forecast", "season")
    j = out.join(s, ["entity", "date"], "left")
    return j.withColumn("forecast", F.when(F.col("season").isNull(), F.col("mean")).otherwise(0.7 * F.col("mean") + 0.3 * F.col("season")))


def meta_forecast(features: DataFrame, future: DataFrame, cols: list[str], ctx: list[str], label: str = "quantity", min_rows: int = 14) -> DataFrame:
    """Second level for the item line, learned on dates the base models did not see. With one date
    only, which nothing lies before, the bases learn from it and their mean stands."""
    data = _training(features, cols, "entity", "date", label, *[c for c in ctx if c != label])
    data = data.withColumn("__cut", cut_date(features, 0.8))
    early, late = data.where("date < __cut"), data.where("date >= __cut")
    early = data if early.isEmpty() else early
    a, b = fit_or_none(gbt(label, iters=12, depth=3), early), fit_or_none(gbt(label, iters=12, depth=5, seed=11), early)
    hold = predict(b, predict(a, late, "b1"), "b2").drop("features")
    names = ["b1", "b2", *ctx]
    enough = hold.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    learn = _assemble(hold.join(enough, "entity", "left_semi"), names, "meta")
    if learn.isEmpty():  # nothing to learn the second level from: mean of the bases
        data.unpersist()
        both = predict(b, predict(a, _assemble(future, cols), "b1"), "b2").drop("features")
        return both.withColumn("forecast", (F.col("b1") + F.col("b2")) / 2)
    meta = gbt(label, iters=10, depth=3, features="meta").fit(learn)
    data.unpersist()
    out = predict(b, predict(a, _assemble(future, cols), "b1"), "b2").drop("features")
    return predict(meta, _assemble(out, names, "meta"), "forecast").drop("meta")


# -- clusters and transfer --------------------------------------------------------------------


def cluster_features(day: DataFrame, trend: DataFrame, min_days: int = 14) -> DataFrame:
    """Level, weekday shares, weekend ratio, spread and trend score per entity."""
    wd = F.weekday("date")
    means = [F.coalesce(F.avg(F.when(wd == i, F.col("guests"))), F.lit(0.0)).alias(f"w{i}") for i in range(7)]
    g = day.groupBy("entity").agg(
        F.count("*").alias("n"), F.avg("guests").alias("avg_daily"), F.stddev_samp("guests").alias("sd"), *means
    ).where((F.col("n") >= min_days) & (F.col("avg_daily") >= 1))
    one = F.lit(1.0)
    total = F.greatest(sum((F.col(f"w{i}") for i in range(7)), F.lit(0.0)), one)
    weekday = sum((F.col(f"w{i}") for i in range(5)), F.lit(0.0)) / 5
    return g.join(trend.select("entity", "trend_score"), "entity").select(
        "entity", "avg_daily", *[(F.col(f"w{i}") / total).alias(f"share{i}") for i in range(7)],
        ((F.col("w5") + F.col("w6")) / 2 / F.greatest(weekday, one)).alias("weekend_ratio"),
        (F.col("sd") / F.greatest("avg_daily", one)).alias("volatility"), "trend_score",
    )


def clusters(feats: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(entity, cluster) by k-means on scaled features, and the cluster profiles."""
    names = [c for c in feats.columns if c != "entity"]
    kinds = feats.select(*names).distinct().limit(k).count()
    if kinds < 2:  # nothing to tell entities apart by
        got = feats.withColumn("cluster", F.lit(0))
    else:
        v = _assemble(feats, names, "raw")
        scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
        got = KMeans(k=kinds, seed=42).fit(scaled).transform(scaled).withColumnRenamed("prediction", "cluster")
    prof = got.groupBy("cluster").agg(
        F.count("*").alias("members"), F.avg("avg_daily").alias("avg_daily"), F.avg("weekend_ratio").alias("weekend_ratio"),
        F.avg("volatility").alias("volatility"),
    )
    return got.select("entity", "cluster"), prof


def _median_without_me(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of the other members' values for every row of a group.

    Leaving one value out moves the median by at most one rank, so three order statistics of
    the group are enough: no pairs are built."""
    half = lambda t: F.floor((t - 1) / 2)
    q = order_stats(values, keys, value, {
        "q0": lambda t: F.greatest(half(t) - F.when(t % 2 == 0, 0).otherwise(1), F.lit(0)),
        "q1": half, "q2": lambda t: F.least(half(t) + 1, t - 1),
    })
    j = values.join(q, keys)
    x, t = F.col(value), F.col("__total")
    # Even size: n-1 is odd, one middle value. Odd size: the mean of the two around the gap.
    even = F.when(x <= F.col("q1"), F.col("q2")).otherwise(F.col("q1"))
    odd = F.when(x < F.col("q1"), (F.col("q1") + F.col("q2")) / 2).when(x > F.col("q1"), (F.col("q0") + F.col("q1")) / 2).otherwise(
        (F.col("q0") + F.col("q2")) / 2)
    m = F.when(t > 1, F.when(t % 2 == 0, even).otherwise(odd))
    return j.withColumn("others", m).drop("q0", "q1", "q2", "__total")


def transfer(state: DataFrame, members: DataFrame, good: float = 20.0) -> DataFrame:
    """Priors for entities without good own corrections: own value mixed with the median of
    the cluster's other members. state: entity, overall_bias, correction_factor, last_mape."""
    s = members.join(state, "entity", "left")
    known = s.where("overall_bias is not null").select("entity", "cluster", "overall_bias", "correction_factor")
    b = _median_without_me(known.select("entity", "cluster", F.col("overall_bias").alias("v")), ["cluster"], "v").select("entity", F.col("others").alias("ob"))
    c = _median_without_me(known.select("entity", "cluster", F.col("correction_factor").alias("v")), ["cluster"], "v").select("entity", F.col("others").alias("oc"))
    whole = known.groupBy("cluster").agg(F.count("*").alias("with_data"))
    # Entities without own state see all members: their group median needs no one left out.
    qb = order_stats(known, ["cluster"], "overall_bias", {"l": lambda t: F.floor((t - 1) / 2), "h": lambda t: F.ceil((t - 1) / 2)})
    qc = order_stats(known, ["cluster"], "correction_factor", {"l": lambda t: F.floor((t - 1) / 2), "h": lambda t: F.ceil((t - 1) / 2)})
    mb = qb.select("cluster", ((F.col("l") + F.col("h")) / 2).alias("mb"))
    mc = qc.select("cluster", ((F.col("l") + F.col("h")) / 2).alias("mc"))
    j = s.join(b, "entity", "left").join(c, "entity", "left").join(mb, "cluster", "left").join(mc, "cluster", "left").join(whole, "cluster", "left")
    own = F.col("overall_bias").isNotNull()
    w = F.when(own, 0.6).otherwise(0.2)
    pb = F.when(own, F.col("ob")).otherwise(F.col("mb"))
    pc = F.when(own, F.col("oc")).otherwise(F.col("mc"))
    fine = own & (F.coalesce("last_mape", F.lit(0.0)) < good)
    return j.where(~fine & pb.isNotNull()).select(
        "entity", "cluster", (w * F.coalesce("overall_bias", F.lit(0.0)) + (1 - w) * pb).alias("overall_bias"),
        (w * F.coalesce("correction_factor", F.lit(1.0)) + (1 - w) * pc).alias("correction_factor"),
    )


def transfer_weekday(keys: DataFrame, members: DataFrame, min_members: int = 3) -> DataFrame:
    """Median weekday bias of the cluster's other members, from at least ``min_members``."""
    k = keys.where("scope = 'weekday'").join(members, "entity").select("entity", "cluster", "key", F.col("value").alias("v"))
    n = k.groupBy("cluster", "key").agg(F.count("*").alias("n")).where(F.col("n") - 1 >= min_members)
    m = _median_without_me(k.join(n, ["cluster", "key"], "left_semi"), ["cluster", "key"], "v")
    return m.select("entity", F.col("key").alias("weekday"), F.col("others").alias("value"))


# -- residual models ------------------------------------------------------------------------------


def _gated(train: DataFrame, cols: list[str], label: str, share: float = 0.8):
    """Fit on the first ``share`` of the dates; the model only when R2 on the rest passes
    and it beats no correction."""
    data = _assemble(train, cols).withColumn("__cut", cut_date(train, share)).persist()
    model = fit_or_none(gbt(label, iters=15, depth=3), data.where("date < __cut"))
    ev = model.transform(data.where("date >= __cut")).agg(
        F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("mae"), F.avg(F.abs(label)).alias("base"),
        F.coalesce(1 - ratio(F.sum((F.col(label) - F.col("prediction")) ** 2), F.var_pop(label) * F.count("*")), F.lit(0.0)).alias("r2"),
    ).first()
    data.unpersist()
    passed = None not in (ev["r2"], ev["mae"], ev["base"]) and ev["r2"] >= MIN_R2 and ev["mae"] <= ev["base"] * (1 - MIN_GAIN)
    return model, bool(passed), float(ev["r2"] or 0.0)


RESIDUAL_COLS = ["weekday_no", "shift_id", "is_weekend", "weekend_evening", "volume", "lag_rows_1", "lag_rows_2", "lag_rows_4", "mean_before"]


def residual_columns(lagged: DataFrame) -> DataFrame:
    """Features of the residual model; the running mean is the one known before the row."""
    w = W.partitionBy("entity", "shift").orderBy("date")
    avg = F.avg("actual").over(W.partitionBy("entity"))
    wd = F.weekday("date")
    eve = F.col("shift") == "EVENING"
    return lagged.withColumns(
        {
            "weekday_no": wd, "shift_id": eve.cast("int"), "is_weekend": (wd >= 5).cast("int"),
            "weekend_evening": ((wd >= 5) & eve).cast("int"), "volume": F.when(avg < 30, 0).when(avg >= 50, 2).otherwise(1),
            "mean_before": F.lag("mean_rows_4").over(w),
        }
    )


def residual_correct(history: DataFrame, pred: DataFrame) -> DataFrame:
    """Shift residual model: learned when it passes its gate, applied to weekday rows of large
    entities and to weekend evenings within the limits of the segment.

    pred: entity, date, shift, forecast and the feature columns of :func:`residual_columns`."""
    model, ok, r2 = _gated(history.where("mean_before is not null"), RESIDUAL_COLS, "residual")
    p = model.transform(_assemble(pred, RESIDUAL_COLS))
    big = F.col("forecast") >= rules.RESIDUAL_LARGE
    wk = ~is_weekend(F.col("date"))
    eve = F.col("shift") == "EVENING"
    seg = F.when(wk & big & eve, "weekday_evening").when(wk & big & ~eve, "weekday_morning").when(~wk & eve, "weekend_evening")
    lim = F.element_at(F.create_map(*[F.lit(x) for pair in rules.RESIDUAL_LIMITS.items() for x in pair]), seg)
    c = F.when((seg == "weekday_morning") & (F.col("prediction") > 0), F.col("prediction") * rules.RESIDUAL_MORNING_DAMPING).otherwise(F.col("prediction"))
    c = clip(c, -F.abs("forecast") * lim, F.abs("forecast") * lim)
    apply = F.lit(ok) & seg.isNotNull() & (F.abs(c) >= rules.RESIDUAL_LEAST)
    return p.withColumns(
        {
            "corrected": F.when(apply, F.greatest(F.lit(0.0), F.bround(F.col("forecast") + c, 0))).otherwise(F.col("forecast")),
            "gate_passed": F.lit(ok), "gate_r2": F.lit(r2),
        }
    ).drop("features", "prediction")


ERROR_COLS = ["weekday_no", "shift_id", "is_weekend", "pred", "overall_bias", "correction_factor", "last_mape"]


def error_model(history: DataFrame, state: DataFrame, pred: DataFrame, today: str, days: int = 90, limit: float = 0.6) -> DataFrame:
    """Second residual model on the forecast and the learned state, last ``days`` days."""
    wd = F.weekday("date")

    def frame(d):
        j = d.join(state.select("entity", "overall_bias", "correction_factor", "last_mape"), "entity", "left")
        return j.withColumns({"weekday_no": wd, "shift_id": (F.col("shift") == "EVENING").cast("int"), "is_weekend": (wd >= 5).cast("int")})

    recent = history.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days))
    model, ok, r2 = _gated(frame(recent).withColumn("residual", F.col("actual") - F.col("pred")), ERROR_COLS, "residual")
    p = model.transform(_assemble(frame(pred), ERROR_COLS))
    c = clip(F.col("prediction"), -limit * F.col("pred"), limit * F.col("pred"))
    return p.withColumns(
        {"corrected": F.when(F.lit(ok), F.greatest(F.lit(0.0), F.col("pred") + c)).otherwise(F.col("pred")), "gate_passed": F.lit(ok), "gate_r2": F.lit(r2)}
    ).drop("features", "prediction")


# -- tuning ----------------------------------------------------------------------------------------


def tune(features: DataFrame, cols: list[str], grid: list[dict], folds: int = 3, halve: bool = True, threads: int = 4) -> DataFrame:
    """Walk-forward MAE of parameter sets, the worse half stopping after each fold.

    Fold i trains on the dates before the i-th slice and tests on it. The sets that are left run as
    jobs side by side, each fit being distributed itself; after a fold, the better half of them (by
    the mean over the folds so far, the earlier set first) goes on, one at least. With ``halve`` off
    every set runs through all folds. A fold without rows to learn from or to test on counts for none.
    """
    spark = features.sparkSession
    dates = features.select("date").distinct()
    slices = folds + 1
    rank = F.ntile(slices).over(W.orderBy("date"))
    sliced = features.join(F.broadcast(dates.withColumn("slice", rank)), "date")
    data = _training(sliced, cols, "slice", "guests")

    def error(i: int, fold: int) -> float | None:
        train = data.where(F.col("slice") <= fold)
        model = fit_or_none(gbt(**grid[i]), train)
        return model.transform(data.where(F.col("slice") == fold + 1)).agg(F.avg(F.abs(F.col("guests") - F.col("prediction")))).first()[0]

    found: dict[int, list[float]] = {i: [] for i in range(len(grid))}
    left = list(found)
    with ThreadPoolExecutor(threads) as pool:
        for fold in range(1, folds + 1):
            jobs = [pool.submit(inheritable_thread_target(spark)(error), i, fold) for i in left]
            for i, job in zip(left, jobs, strict=True):
                if job.result() is not None:
                    found[i].append(float(job.result()))
            if halve:
                left = sorted(sorted(left, key=lambda i: (np.mean(found[i]) if found[i] else np.inf, i))[: -(-len(left) // 2)])
    data.unpersist()
    # the best of those that went furthest; the others stopped because they were worse
    mean = {i: float(np.mean(e)) if e else None for i, e in found.items()}
    known = [i for i in left if mean[i] is not None]
    best = min(known, key=lambda i: (mean[i], i)) if known else None
    rows = [(i, grid[i]["iters"], grid[i]["depth"], len(found[i]), mean[i], i == best) for i in found]
    return spark.createDataFrame(rows, "params int, iters int, depth int, folds int, mae double, best boolean")


def tune_weights(comparison: DataFrame) -> DataFrame:
    """Strategy weights from the errors of both sources (ensemble_wmape, ai_wmape)."""
    e, a = F.col("ensemble_wmape"), F.col("ai_wmape")
    ml = F.coalesce(clip(ratio(a, e + a), 0.2, 0.8), F.lit(0.5))
    s = lambda name, w: F.struct(F.lit(name).alias("strategy"), w.alias("ml_weight"))
    arr = F.array(
        s("ENSEMBLE_EQUAL", ml), s("ENSEMBLE_WEIGHTED", ml), s("AI_ONLY", F.lit(0.0)),
        s("AI_PRIMARY_ML_SECONDARY", F.least(F.lit(0.4), ml)), s("ML_PRIMARY_AI_VALIDATE", F.greatest(F.lit(0.6), ml)),
    )
    return comparison.select(F.inline(arr)).withColumn("ai_weight", 1 - F.col("ml_weight"))
