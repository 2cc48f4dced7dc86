"""Load shifting: pair expensive high-demand hours with cheaper hours, and what that would save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.tariff import DEFAULT_TARIFF, Tariff, tou_period, tou_rate
from gridmeter.operators.costs import tou_cost

S, TS = "series_id", "ts"

# Fixed values of the published savings scenarios.
DEFAULT_FRACTION = 0.20
SCENARIO_FRACTIONS = [0.10, 0.20, 0.30]


def match_hours(pred: DataFrame, tariff: Tariff = DEFAULT_TARIFF, skip_empty: bool = False) -> DataFrame:
    """Source and destination hours that the highest-first greedy would pair, as ranks and one equi-join.

    Destinations are taken cheapest rate first and, within a rate, smallest prediction first. The k-th source that may
    still use a rate therefore gets its k-th destination, and sources beyond the last one move on to the next rate.
    A destination predicted at zero can take nothing but stays the first choice, so it stops every source that reaches
    its rate; `skip_empty` leaves such hours out.
    """
    hour = F.hour(TS)
    priced = pred.select(
        S, TS, "predicted", "threshold", tou_rate(hour, tariff).alias("_rate"), tou_period(hour, tariff).alias("_period"),
    )
    targets = priced.filter((F.col("predicted") < F.col("threshold")) & (F.col("_period") != "peak"))
    if skip_empty:
        targets = targets.filter(F.col("predicted") > 0)
    by_size = Window.partitionBy(S, "_rate").orderBy("predicted", TS)
    targets = targets.select(
        S, F.col("_rate").alias("destination_rate"), F.row_number().over(by_size).alias("_rank"),
        F.col(TS).alias("destination_ts"), F.col("predicted").alias("destination_predicted_kwh"),
    )
    tiers = sorted({rate for period, rate in tariff.period_rates.items() if period != "peak"})
    room = targets.groupBy(S).agg(*[
        agg.alias(name)
        for i, tier in enumerate(tiers)
        for name, agg in (
            (f"_room_{i}", F.count_if(F.col("destination_rate") == tier)),
            (f"_stop_{i}", F.count_if((F.col("destination_rate") == tier) & (F.col("destination_predicted_kwh") <= 0)) > 0),
        )
    ])
    sources = priced.filter((F.col("predicted") > F.col("threshold")) & (F.col("predicted") > 0)).join(room, S)
    sources = sources.withColumns({"_tier": F.lit(None).cast("double"), "_rank": F.lit(None).cast("long"),
                                   "_done": F.lit(False)})
    highest_first = Window.partitionBy(S).orderBy(F.desc("predicted"), TS).rowsBetween(Window.unboundedPreceding, 0)
    for i, tier in enumerate(tiers):
        may_use = ~F.col("_done") & (F.col("_rate") > tier)
        sources = sources.withColumn("_turn", F.sum(may_use.cast("long")).over(highest_first))
        stopped = may_use & F.col(f"_stop_{i}")
        served = may_use & ~F.col(f"_stop_{i}") & (F.col("_turn") <= F.col(f"_room_{i}"))
        sources = sources.withColumns({
            "_tier": F.when(served, F.lit(tier)).otherwise(F.col("_tier")),
            "_rank": F.when(served, F.col("_turn")).otherwise(F.col("_rank")),
            "_done": F.col("_done") | stopped | served,
        })
    chosen = sources.filter(F.col("_tier").isNotNull()).select(
        S, F.col(TS).alias("source_ts"), F.col("predicted").alias("source_predicted_kwh"), "threshold",
        F.col("_rate").alias("source_rate"), F.col("_tier").alias("destination_rate"), "_rank",
    )
    return chosen.join(targets, [S, "destination_rate", "_rank"]).drop("_rank")


def _priced_shifts(pairs: DataFrame, fraction) -> DataFrame:
    amount = F.least(
        F.col("source_predicted_kwh") * fraction,
        F.col("source_predicted_kwh") - F.col("threshold"),
        F.col("destination_predicted_kwh") * fraction,
    )
    sized = pairs.withColumn("shiftable_energy_kwh", amount).filter(F.col("shiftable_energy_kwh") > 0)
    before = F.col("shiftable_energy_kwh") * F.col("source_rate")
    after = F.col("shiftable_energy_kwh") * F.col("destination_rate")
    return sized.withColumns({
        "estimated_cost_before": before, "estimated_cost_after": after, "estimated_savings": before - after,
    })


def load_shifts(
    pred: DataFrame, fraction: float = DEFAULT_FRACTION, tariff: Tariff = DEFAULT_TARIFF, skip_empty: bool = False,
) -> DataFrame:
    """Recommended shifts; `pred` has predicted and threshold per (series, hour)."""
    return _priced_shifts(match_hours(pred, tariff, skip_empty), F.lit(float(fraction)))


def shift_sensitivity(
    pred: DataFrame, fractions: Sequence[float] = SCENARIO_FRACTIONS, tariff: Tariff = DEFAULT_TARIFF,
) -> DataFrame:
    """Savings per shiftable fraction. Which hours pair up does not depend on the fraction, so matching runs once."""
    each = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("shiftable_fraction")
    shifts = _priced_shifts(match_hours(pred, tariff).select("*", each), F.col("shiftable_fraction"))
    sums = shifts.groupBy(S, "shiftable_fraction").agg(
        F.sum("shiftable_energy_kwh").alias("energy_shifted_kwh"), F.sum("estimated_savings").alias("simulated_savings"),
    )
    baseline = tou_cost(pred, "predicted", tariff).groupBy(S).agg(F.sum("simulated_cost").alias("_baseline"))
    return baseline.select("*", each).join(sums, [S, "shiftable_fraction"], "left").select(
        S, "shiftable_fraction",
        F.coalesce("energy_shifted_kwh", F.lit(0.0)).alias("energy_shifted_kwh"),
        F.coalesce("simulated_savings", F.lit(0.0)).alias("simulated_savings"),
        F.when(F.col("_baseline") > 0, F.coalesce("simulated_savings", F.lit(0.0)) / F.col("_baseline") * 100)
        .otherwise(F.lit(0.0)).alias("savings_percentage"),
    )


def daily_savings(costs: DataFrame, shifts: DataFrame) -> DataFrame:
    """Baseline and optimised cost per day; savings count on the day of the source hour."""
    daily = costs.groupBy(S, F.to_date(TS).alias("date")).agg(F.sum("simulated_cost").alias("baseline_cost"))
    saved = shifts.groupBy(S, F.to_date("source_ts").alias("date")).agg(
        F.sum("estimated_savings").alias("_saved"), F.sum("shiftable_energy_kwh").alias("_moved"),
    )
    savings, moved = F.coalesce("_saved", F.lit(0.0)), F.coalesce("_moved", F.lit(0.0))
    return daily.join(saved, [S, "date"], "left").select(
        S, "date", "baseline_cost",
        (F.col("baseline_cost") - savings).alias("optimized_simulated_cost"),
        savings.alias("estimated_savings"),
        F.when(F.col("baseline_cost") > 0, savings / F.col("baseline_cost") * 100).otherwise(F.lit(0.0))
        .alias("savings_percentage"),
        moved.alias("energy_shifted"),
    )
