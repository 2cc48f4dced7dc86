"""Leakage-free history features of hourly series.

All windows end one hour before the row they describe and reach back 168 hours at most, so they run per
(series, chunk) with a 168-hour overlap: one shuffle and one sort serve every feature, and a single very long
series is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.calendar import with_cyclical, with_feature_calendar, with_interactions
from gridmeter.operators.chunks import CHUNK, chunk_of, chunk_window, gather, hour_index, spread
from gridmeter.operators.stats import percentiles
from gridmeter.session import cut_lineage

S, TS, E = "series_id", "ts", "energy_kwh"
HISTORY = 168

# The lag, window and span lists of the two feature tables.
BASIC_LAGS = [1, 3, 6, 12, 24, 48, 72, 168]
BASIC_ROLLING = [3, 6, 12, 24, 168]
ADVANCED_LAGS = [1, 2, 3, 4, 6, 8, 12, 18, 24, 36, 48, 72, 96, 120, 144, 168]
STRICT_MEANS = [3, 6, 12, 24, 48, 72, 168]
STRICT_DEVIATIONS = [6, 12, 24, 48, 168]
STRICT_ORDER = [24, 168]
EWM_SPANS = [3, 6, 12, 24, 48]
SAME_HOUR_LAGS = [24, 48, 72, 96, 120, 144, 168]

# Columns of a cleaned table that describe the target hour itself and must not become features.
NOT_FEATURES = [
    S, TS, E, "avg_global_active_power", "avg_global_reactive_power", "avg_voltage", "avg_global_intensity",
    "total_sub_metering_1", "total_sub_metering_2", "total_sub_metering_3", "is_long_gap", "is_energy_outlier",
]


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that may be used as features."""
    dropped = set(NOT_FEATURES) | set(exclude)
    return [c for c in df.columns if c not in dropped]


def _lag_columns(lags: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(E, k).over(chunk_window(S, TS)) for k in lags}


def _past(width: int):
    return chunk_window(S, TS).rowsBetween(-width, -1)


def with_lags(grid: DataFrame, lags: Sequence[int] = BASIC_LAGS) -> DataFrame:
    """Values `k` hours earlier on a complete hourly index."""
    return gather(spread(grid, hour_index(TS), back=max(lags)).withColumns(_lag_columns(lags)))


def _rolling_columns() -> dict[str, Column]:
    out = {f"rolling_mean_{w}": F.avg(E).over(_past(w)) for w in BASIC_ROLLING}
    out["rolling_std_24"] = F.stddev_samp(E).over(_past(24))
    out["rolling_min_24"] = F.min(E).over(_past(24))
    out["rolling_max_24"] = F.max(E).over(_past(24))
    return out


def with_rolling(grid: DataFrame) -> DataFrame:
    """Statistics of the hours before; nulls are skipped and short windows allowed."""
    return gather(spread(grid, hour_index(TS), back=HISTORY).withColumns(_rolling_columns()))


def with_trend(df: DataFrame, p90: str = "p90") -> DataFrame:
    """Trends and previous-hour peak flag from existing lags; an unknown previous hour counts as no peak."""
    return df.withColumns({
        "trend_3h": F.col("lag_1") - F.col("lag_3"),
        "trend_24h": F.col("lag_1") - F.col("lag_24"),
        "is_high_demand_previous_hour": F.coalesce(F.col("lag_1") >= F.col(p90), F.lit(False)).cast("int"),
    })


def with_p90(df: DataFrame) -> DataFrame:
    """Attach the 90th percentile of the series itself."""
    return df.join(percentiles(df, {"p90": 0.9}), S)


def basic_features(clean: DataFrame) -> DataFrame:
    """Calendar, lags, rolling statistics and trends, before incomplete rows are dropped."""
    windows = gather(
        spread(clean, hour_index(TS), back=HISTORY).withColumns({**_lag_columns(BASIC_LAGS), **_rolling_columns()})
    )
    dated = with_cyclical(with_feature_calendar(windows, TS))
    return with_trend(dated.join(percentiles(clean, {"p90": 0.9}), S)).drop("p90")


def drop_incomplete(features: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the burn-in and every row that still has a null."""
    return features.na.drop("any", subset=list(cols) if cols else None)


def incomplete_report(features: DataFrame) -> DataFrame:
    """Rows removed by `drop_incomplete` and null cells before and after, in one pass."""
    nulls = F.lit(0)
    for c in features.columns:
        nulls = nulls + F.col(c).isNull().cast("int")
    counted = features.select(S, nulls.alias("_nulls"))
    return counted.groupBy(S).agg(
        F.count("*").alias("input_records"),
        F.count_if(F.col("_nulls") == 0).alias("output_records"),
        F.count_if(F.col("_nulls") > 0).alias("rows_removed"),
        F.sum("_nulls").alias("missing_values_before"),
        F.lit(0).cast("long").alias("missing_values_after"),
    )


def advanced_lags(grid: DataFrame) -> DataFrame:
    return with_lags(grid, ADVANCED_LAGS)


def _when_full(width: int, stat: Column) -> Column:
    """Keep a window statistic only if all of its `width` hours are known."""
    return F.when(F.count(E).over(_past(width)) == width, stat)


def _strict_columns() -> dict[str, Column]:
    out = {f"roll_mean_{w}": _when_full(w, F.avg(E).over(_past(w))) for w in STRICT_MEANS}
    out |= {f"roll_std_{w}": _when_full(w, F.stddev_samp(E).over(_past(w))) for w in STRICT_DEVIATIONS}
    return out


def _strict_order_columns() -> dict[str, Column]:
    out = {}
    for w in STRICT_ORDER:
        out[f"roll_min_{w}"] = _when_full(w, F.min(E).over(_past(w)))
        out[f"roll_max_{w}"] = _when_full(w, F.max(E).over(_past(w)))
        out[f"roll_median_{w}"] = _when_full(w, F.percentile(E, F.lit(0.5)).over(_past(w)))
    return out


def strict_rolling(grid: DataFrame) -> DataFrame:
    """Rolling mean and deviation of the hours before; any unknown hour or short window gives null."""
    return gather(spread(grid, hour_index(TS), back=HISTORY).withColumns(_strict_columns()))


def strict_rolling_order(grid: DataFrame) -> DataFrame:
    return gather(spread(grid, hour_index(TS), back=HISTORY).withColumns(_strict_order_columns()))


def history_features(lagged: DataFrame, p90: str = "p90") -> DataFrame:
    """Trends, same-hour and previous-day summaries from the advanced lags; nulls propagate."""
    lag = {k: F.col(f"lag_{k}") for k in ADVANCED_LAGS}
    same_hour = sum((lag[k] for k in SAME_HOUR_LAGS[1:]), lag[SAME_HOUR_LAGS[0]]) / len(SAME_HOUR_LAGS)
    day_total = lag[36] + lag[48]
    return lagged.withColumns({
        "trend_1h": lag[1] - lag[2],
        "trend_3h": lag[1] - lag[4],
        "same_hour_avg_7d": same_hour,
        "same_hour_avg_14d": same_hour,
        "prev_day_total": day_total,
        "prev_day_mean": day_total / 2,
        "prev_day_max": F.when(day_total.isNotNull(), F.greatest(lag[36], lag[48])),
        "prev_day_min": F.when(day_total.isNotNull(), F.least(lag[36], lag[48])),
        "prev_week_same_hour": lag[168],
        "prev_week_same_hour_avg": lag[168],
        "is_peak_prev_hour": (lag[1] >= F.col(p90)).cast("int"),
    })


# --- exponential means -----------------------------------------------------------------------------------------
SLICE = 24
MEAN_FIELD = "{}:double"


def _decay(span: int, gap: Column) -> tuple[float, Column]:
    """Weight of a new value, and what hours without one leave of the old mean's weight."""
    alpha = 2.0 / (span + 1)
    return alpha, F.pow(F.lit(1 - alpha), gap.cast("double"))


def _blend(span: int, mean: Column, gap: Column, value: Column) -> Column:
    """Mean after a known value; the first value of a series is its first mean."""
    alpha, old = _decay(span, gap)
    return F.coalesce((old * mean + alpha * value) / (old + alpha), value)


def _chunk_maps(chunks: DataFrame, spans: Sequence[int]) -> DataFrame:
    """What a chunk does to the means that reach it: the first known value, then one affine map `mean -> keep * mean + add`."""
    start = F.struct(
        F.lit(None).cast("long").alias("first_h"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("long").alias("last_h"),
        *[F.lit(v).alias(f"{n}_{s}") for s in spans for n, v in (("keep", 1.0), ("add", 0.0))],
    )

    def step(acc: Column, row: Column) -> Column:
        value, gap = row[E].cast("double"), row["_h"] - acc["last_h"]
        parts = [F.coalesce(acc["first_h"], row["_h"]).alias("first_h"), F.coalesce(acc["first"], value).alias("first"), row["_h"].alias("last_h")]
        for s in spans:
            alpha, old = _decay(s, gap)
            keep = F.coalesce(old / (old + alpha), F.lit(1.0))
            new = F.when(gap.isNotNull(), (1 - keep) * value).otherwise(F.lit(0.0))
            parts += [(acc[f"keep_{s}"] * keep).alias(f"keep_{s}"), (acc[f"add_{s}"] * keep + new).alias(f"add_{s}")]
        return F.when(value.isNotNull(), F.struct(*parts)).otherwise(acc)

    return chunks.select(S, CHUNK, F.aggregate("_rows", start, step).alias("_map"))


def _carried(maps: DataFrame, spans: Sequence[int]) -> DataFrame:
    """Means and last known hour that reach every chunk: one fold over the maps of a series, six and a half a year."""
    means = [f"mean_{s}" for s in spans]
    fields = [MEAN_FIELD.format(n) for n in means]
    emitted = f"array<struct<chunk:bigint,last_h:bigint,{','.join(fields)}>>"
    start = F.struct(
        F.lit(None).cast("long").alias("last_h"), *[F.lit(None).cast("double").alias(m) for m in means],
        F.array().cast(emitted).alias("out"),
    )

    def step(acc: Column, chunk: Column) -> Column:
        done = chunk["_map"]
        gap = done["first_h"] - acc["last_h"]
        here = F.struct(chunk[CHUNK].alias("chunk"), acc["last_h"].alias("last_h"), *[acc[m].alias(m) for m in means])
        after = [
            F.coalesce(
                _blend(s, acc[m], gap, done["first"]) * done[f"keep_{s}"] + done[f"add_{s}"], acc[m],
            ).alias(m) for s, m in zip(spans, means)
        ]
        return F.struct(
            F.coalesce(done["last_h"], acc["last_h"]).alias("last_h"), *after, F.concat(acc["out"], F.array(here)).alias("out"),
        )

    ordered = maps.groupBy(S).agg(F.array_sort(F.collect_list(F.struct(CHUNK, "_map"))).alias("_maps"))
    every = ordered.select(S, F.explode(F.aggregate("_maps", start, step)["out"]).alias("_c"))
    return every.select(S, F.col("_c.chunk").alias(CHUNK), F.col("_c").alias("_seed"))


def _means_before(spans: Sequence[int], rows: str = "_rows", known: str = "_seed") -> Column:
    """Means before every row of a chunk. Folded by slices, so that lists which grow by one element stay short."""
    means = [f"mean_{s}" for s in spans]
    emitted = f"array<struct<{','.join(MEAN_FIELD.format(n) for n in means)}>>"
    empty = F.array().cast(emitted).alias("out")

    def step(acc: Column, row: Column) -> Column:
        value, gap = row[E].cast("double"), row["_h"] - acc["last_h"]
        known = value.isNotNull()
        return F.struct(
            F.when(known, row["_h"]).otherwise(acc["last_h"]).alias("last_h"),
            *[F.when(known, _blend(s, acc[m], gap, value)).otherwise(acc[m]).alias(m) for s, m in zip(spans, means)],
            F.concat(acc["out"], F.array(F.struct(*[acc[m].alias(m) for m in means]))).alias("out"),
        )

    def slice_step(acc: Column, first: Column) -> Column:
        start = F.struct(acc["last_h"].alias("last_h"), *[acc[m].alias(m) for m in means], empty)
        done = F.array(F.aggregate(F.slice(rows, first, SLICE), start, step))  # a lambda's argument is evaluated once, not once a field
        return F.transform(done, lambda part: F.struct(
            part["last_h"].alias("last_h"), *[part[m].alias(m) for m in means], F.concat(acc["out"], part["out"]).alias("out"),
        ))[0]

    seed = F.struct(F.col(f"{known}.last_h").alias("last_h"), *[F.col(f"{known}.{m}").alias(m) for m in means], empty)
    return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(SLICE)), seed, slice_step)["out"]


def _means_after(rows: Column, spans: Sequence[int]) -> Column:
    """Means after the rows of a series in time order; nothing is kept on the way. Hours that follow each other need no power."""
    means = [f"mean_{s}" for s in spans]
    start = F.struct(F.lit(None).cast("long").alias("last_h"), *[F.lit(None).cast("double").alias(m) for m in means])

    def step(acc: Column, row: Column) -> Column:
        value, gap = row[E].cast("double"), row["_h"] - acc["last_h"]

        def after(mean_of: Callable[[int, Column], Column]) -> Column:
            return F.struct(row["_h"].alias("last_h"), *[mean_of(s, acc[m]).alias(m) for s, m in zip(spans, means)])

        def following(span: int, mean: Column) -> Column:
            alpha = 2.0 / (span + 1)
            mixed, weight = F.lit(1 - alpha) * mean + F.lit(alpha) * value, 1 - alpha + alpha
            return mixed if weight == 1 else mixed / F.lit(weight)

        return F.when(value.isNull(), acc).when(gap == 1, after(following)).otherwise(after(lambda s, mean: _blend(s, mean, gap, value)))

    return F.aggregate(rows, start, step)


def with_ewm(grid: DataFrame, spans: Sequence[int] = EWM_SPANS) -> DataFrame:
    """Exponential means (alpha = 2 / (span + 1)) of the hours before; unknown hours only let the old weight decay.

    An affine scan in built-in expressions: a chunk's rows lie in one array, its effect on a mean is one affine map, the maps of
    a series are composed once, and every chunk is then folded from the means that reach it. Rows are shuffled once, and neither
    a long series nor a hot one needs a single task. Expects a complete hourly index.
    """
    spans = list(spans)
    tagged = grid.withColumn("_h", hour_index(TS)).withColumn(CHUNK, chunk_of(F.col("_h")))
    rest = [c for c in grid.columns if c != S]
    # Read by the maps and by the folds themselves, so it is settled once.
    chunks = cut_lineage(tagged.groupBy(S, CHUNK).agg(F.array_sort(F.collect_list(F.struct("_h", *rest))).alias("_rows")))
    seeded = chunks.join(_carried(_chunk_maps(chunks, spans), spans), [S, CHUNK])
    rows = seeded.select(S, F.explode(F.arrays_zip("_rows", _means_before(spans).alias("_means"))).alias("_z"))
    out = {f"ewm_{s}": F.col(f"_z._means.mean_{s}") for s in spans}
    return rows.select(
        *[S if c == S else F.col(f"_z._rows.{c}").alias(c) for c in grid.columns], *[v.alias(n) for n, v in out.items()],
    )


# --- the end of a series ---------------------------------------------------------------------------------------
def series_ends(grid: DataFrame, hours: int, ewm: bool = True) -> DataFrame:
    """One row a series, from one aggregate of its hours: what the feature rows of its last `hours` hours are made of.

    `available_hours`, `last_ts` and `threshold` (90th percentile) describe the whole series, `_last` holds the rows of its last hours, `_values` the energies of these
    and of the `HISTORY` rows before them, `_means` the exponential means that reach them. A series lies in one array on the way,
    one row an hour, as it does for its percentiles.
    """
    rest = [c for c in grid.columns if c != S]
    row = F.struct(hour_index(TS).alias("_h"), *rest)
    whole = grid.groupBy(S).agg(
        F.count("*").alias("available_hours"), F.max(TS).alias("last_ts"), F.percentile(E, F.array(F.lit(0.9)))[0].alias("threshold"),
        F.sort_array(F.collect_list(F.when(F.col(TS).isNotNull(), row))).alias("_rows"),
    )
    first = hour_index("last_ts") - hours
    before = F.size("_rows") - F.size(F.filter("_rows", lambda r: r["_h"] > F.col("_first")))
    whole = whole.withColumn("_first", first).withColumn("_before", before)
    reach = F.greatest(F.col("_before") - HISTORY, F.lit(0))
    means = [_means_after(F.slice("_rows", F.lit(1), F.col("_before")), EWM_SPANS).alias("_means")] if ewm else []
    return whole.select(
        S, "available_hours", "last_ts", "threshold", F.slice("_rows", F.col("_before") + 1, F.size("_rows")).alias("_last"),
        F.transform(F.slice("_rows", reach + 1, F.size("_rows")), lambda r: r[E]).alias("_values"), *means,
    )


def _end_rows(ends: DataFrame, future: bool = False) -> DataFrame:
    """Lags, strict statistics and exponential means of the last hours; with `future` also of the hour after them, whose energy is unknown."""
    kinds = {c.name: c.dataType for c in ends.schema["_last"].dataType.elementType if c.name != "_h"}
    rows = F.col("_last")
    if future:
        known = {"_h": hour_index("last_ts") + 1, TS: F.col("last_ts") + F.expr("INTERVAL 1 HOUR")}
        following = F.struct(known["_h"].alias("_h"), *[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
        rows = F.concat(rows, F.array(following))
    spans = EWM_SPANS if "_means" in ends.columns else []
    ready = ends.filter(F.col(S).isNotNull() & F.col("last_ts").isNotNull()).select(
        S, "threshold", "last_ts", "_values", rows.alias("_rows"), (F.size("_values") - F.size("_last")).alias("_before"), *(["_means"] if spans else []),
    )
    statistics = F.arrow_udf(_past_statistics, "array<double>")
    ready = ready.withColumn("_found", statistics(F.col("_values").cast("array<double>"), "_before", F.size("_rows")))
    zipped = F.arrays_zip("_rows", _means_before(spans, "_rows", "_means").alias("_now")) if spans else F.arrays_zip("_rows")
    each = ready.select("*", F.posexplode(zipped).alias("_j", "_z"))
    return each.select(
        S, *[F.col(f"_z._rows.{c}").alias(c) for c in kinds], *[F.col(f"_z._now.mean_{s}").alias(f"ewm_{s}") for s in spans],
        *[F.get("_values", F.col("_before") + F.col("_j") - k).alias(f"lag_{k}") for k in ADVANCED_LAGS],
        *[F.get("_found", F.col("_j") * len(STATISTICS) + i).alias(n) for i, n in enumerate(STATISTICS)],
        "last_ts", F.col("threshold").alias("_threshold"),
    )


#: The columns of `_strict_columns` and `_strict_order_columns`.
STATISTICS = [
    *[f"roll_mean_{w}" for w in STRICT_MEANS], *[f"roll_std_{w}" for w in STRICT_DEVIATIONS],
    *[f"roll_{n}_{w}" for w in STRICT_ORDER for n in ("min", "max", "median")],
]


def _past_statistics(values: pa.Array, before: pa.Array, rows: pa.Array) -> pa.Array:
    """`STATISTICS` of each series' rows, one row after the other, from the values before them: `before` for the first row, one more for each other.

    Framed windows would fill their frames for every hour a row reaches as well, not for the last ones only. The digits are theirs: values
    are added one by one from the oldest on, deviations by the recurrence of the built-in `stddev_samp`, for all rows of a batch at once.
    """
    unknown = values.flatten().is_null().to_numpy(zero_copy_only=False)
    flat, offsets = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy().astype(np.int64)
    counts = rows.to_numpy().astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
    have = np.repeat(before.to_numpy().astype(np.int64), counts) + nth
    end = np.repeat(offsets[:-1] - offsets[0], counts) + have
    after_unknown = np.concatenate([[0], np.maximum.accumulate(np.where(unknown, np.arange(1, len(flat) + 1), 0))])
    run = np.minimum(have, end - after_unknown[end])  # values known without a hole
    out, missing = np.zeros((len(end), len(STATISTICS))), np.ones((len(end), len(STATISTICS)), dtype=bool)

    def put(name: str, at: np.ndarray, found: np.ndarray) -> None:
        column = STATISTICS.index(name)
        out[at, column], missing[at, column] = found, False

    with np.errstate(all="ignore"):
        for width in sorted({*STRICT_MEANS, *STRICT_DEVIATIONS}):
            at = np.flatnonzero(run >= width)
            first, total, mean, square = end[at] - width, np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
            for k in range(width):
                x = flat[first + k]
                total += x
                if width in STRICT_DEVIATIONS:
                    delta = x - mean
                    part = delta / (k + 1.0)
                    mean += part
                    square += delta * (delta - part)
            if width in STRICT_MEANS:
                put(f"roll_mean_{width}", at, total / width)
            if width in STRICT_DEVIATIONS:
                put(f"roll_std_{width}", at, np.sqrt(square / (width - 1.0)))
        for width in STRICT_ORDER:
            whole = np.flatnonzero(run >= width)
            for at in np.array_split(whole, len(whole) // 8192 + 1):
                ranked = np.sort(flat[(end[at] - width)[:, None] + np.arange(width)], axis=1)  # NaN comes last, as in Spark
                put(f"roll_min_{width}", at, ranked[:, 0])
                put(f"roll_max_{width}", at, ranked[:, -1])
                put(f"roll_median_{width}", at, ranked[:, (width - 1) // 2] * 0.5 + ranked[:, width // 2] * 0.5)
    ends = pa.array(np.concatenate([[0], counts.cumsum() * len(STATISTICS)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), mask=missing.ravel()))


def advanced_features(grid: DataFrame, p90: str | None = None, ewm: bool = True, last: int | None = None) -> DataFrame:
    """The whole advanced feature table (65 features) for a complete hourly series.

    `p90` names a column that holds the peak threshold; without it the series' own 90th percentile is used. `last` keeps the
    last so many hours of each series and makes no others, see `series_ends`.
    """
    if last is not None:
        return _described(_end_rows(series_ends(grid, last, ewm)), p90 or "_threshold").drop("_threshold", "last_ts")
    windows = {**_lag_columns(ADVANCED_LAGS), **_strict_columns(), **_strict_order_columns()}
    rows = gather(spread(with_ewm(grid) if ewm else grid, hour_index(TS), back=HISTORY).withColumns(windows))
    if p90 is None:
        return _described(rows, "_threshold", percentiles(grid, {"_threshold": 0.9})).drop("_threshold")
    return _described(rows, p90)


def end_features(ends: DataFrame) -> DataFrame:
    """Advanced features of the last hours of `series_ends` and of the hour after them, whose energy is unknown; `last_ts` is kept."""
    rows = _described(_end_rows(ends, future=True), "_threshold").drop("_threshold")
    return rows.select(*[c for c in rows.columns if c != "last_ts"], "last_ts")


def _described(rows: DataFrame, p90: str, thresholds: DataFrame | None = None) -> DataFrame:
    """Calendar, trends and summaries beside lags and window statistics; exponential means come last."""
    means = [c for c in rows.columns if c in {f"ewm_{s}" for s in EWM_SPANS}]
    named = with_feature_calendar(rows, TS).drop("year", "day", "day_of_month", "week_of_year")
    dated = with_interactions(with_cyclical(named.withColumnRenamed("day_of_week", "dow"), "dow"), "dow")
    out = history_features(dated if thresholds is None else dated.join(thresholds, S), p90)
    return out.select(*[c for c in out.columns if c not in means], *means)


def locf_zero(df: DataFrame) -> DataFrame:
    """Carry the last known value forward in every column but the keys, then fill what is left with zero.

    Carried in two levels: inside chunks by a window, across chunks by the last known value of earlier chunks.
    """
    cols = [c for c in df.columns if c not in (S, TS)]
    tagged = df.withColumn(CHUNK, chunk_of(hour_index(TS)))
    w = chunk_window(S, TS)
    lasts = tagged.groupBy(S, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(TS))).alias(f"_last_{c}") for c in cols]
    )
    earlier = Window.partitionBy(S).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(S, CHUNK, *[F.last(f"_last_{c}", True).over(earlier).alias(f"_carry_{c}") for c in cols])
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(carry, [S, CHUNK])
    return joined.select(
        S, TS,
        *[F.coalesce(F.last(c, True).over(inside), F.col(f"_carry_{c}"), F.lit(0)).cast(df.schema[c].dataType).alias(c)
          for c in cols],
    )


def align_to(keys: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of `df` for a list of (series, timestamp) keys; keys without a row give nulls."""
    return keys.select(S, TS).join(df, [S, TS], "left")


def ma7_strict(daily: DataFrame, day: str = "date", value: str = "total_energy_kwh") -> DataFrame:
    """Seven-day mean, null until seven days exist or if one of them is null. Daily rows are few per series."""
    w = Window.partitionBy(S).orderBy(day).rowsBetween(-6, 0)
    return daily.withColumn("rolling_7d", F.when(F.count(value).over(w) == 7, F.avg(value).over(w)))


def ma7_partial(daily: DataFrame, day: str = "date", value: str = "total_energy_kwh") -> DataFrame:
    w = Window.partitionBy(S).orderBy(day).rowsBetween(-6, 0)
    return daily.withColumn("avg7", F.avg(value).over(w))

