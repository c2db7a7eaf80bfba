"""Leakage-safe features, labels, splits, baselines, the evaluation of forecasts, and decision simulations.

Everything that looks back holds the series fixed and moves only the day of observation; windows end before or at the
row's own day, labels are equi-joins on a later day, and splits keep a gap as long as the longest horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_median
from ..functions.stats import n_rows, quantile, r6
from ..functions.timeaxis import bucket


def daily_snapshot(obs: DataFrame, series: list[str], day: str, at: str, tie: str) -> DataFrame:
    """One record for each series and day: the latest, with why it was chosen."""
    w = Window.partitionBy(*series, day)
    ranked = obs.withColumn("_k", F.row_number().over(w.orderBy(F.desc(at), F.desc(tie)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter("_k = 1").withColumn("snapshot_reason", F.when(F.col("_n") > 1, "latest_of_day").otherwise("only_of_day")).drop("_k", "_n")


def calendar_features(df: DataFrame, day: str) -> DataFrame:
    d = F.col(day)
    season = F.when(F.month(d).isin(12, 1, 2), "winter").when(F.month(d).isin(3, 4, 5), "spring").when(F.month(d).isin(6, 7, 8), "summer").otherwise("autumn")
    return df.select("*", F.weekday(d).alias("dow"), F.dayofweek(d).isin(6, 7).alias("is_weekend"), F.month(d).alias("month"), F.weekofyear(d).alias("week"), F.quarter(d).alias("quarter"), season.alias("season"))


def nearest_holidays(df: DataFrame, day: str, city: str, holidays: DataFrame) -> DataFrame:
    """Days since the last and to the next holiday, Tet and festival of a row's city: a two-sided as-of match over sorted dates.

    holidays: holiday_date, city (null: everywhere), is_tet, is_festival. Adds for each of holiday, tet and festival
    days_since_ and days_to_ (0 on the day itself; null beyond the calendar or without a city's entry), days_to_nearest_,
    and is_holiday and is_eve. Dates of holidays and the distinct (city, day) of the rows are put in one order of days per
    city, in which the last one seen from either side is carried along, so no row meets a range of dates. A row without a
    city has the holidays of everywhere; a null day has nulls; repeated rows stay; extra columns of holidays are left out.
    """
    place = F.coalesce(F.col(city).cast("string"), F.lit(""))
    wanted = df.select(place.alias("_city"), F.col(day).alias("_day")).filter("_day is not null").distinct()
    kinds = {"holiday": F.lit(True), "tet": F.coalesce("is_tet", F.lit(False)), "festival": F.coalesce("is_festival", F.lit(False))}
    marked = holidays.filter("holiday_date is not null").select(F.col("city").alias("_c"), F.col("holiday_date").alias("_day"), *[c.alias(f"_{k}") for k, c in kinds.items()])
    own = marked.filter("_c is not null").withColumnRenamed("_c", "_city")
    general = marked.filter("_c is null").drop("_c")
    everywhere = wanted.select("_city").distinct().crossJoin(F.broadcast(general))  # a calendar's dates for each city
    flags = [f"_{k}" for k in kinds]
    days = wanted.select("*", F.lit(True).alias("_row"), *[F.lit(False).alias(f) for f in flags]).unionByName(own.unionByName(everywhere).withColumn("_row", F.lit(False)))
    one = days.groupBy("_city", "_day").agg(F.bool_or("_row").alias("_row"), *[F.bool_or(f).alias(f) for f in flags])
    w = Window.partitionBy("_city").orderBy("_day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    told = []
    for k in kinds:
        at = F.when(F.col(f"_{k}"), F.col("_day"))
        told += [F.date_diff("_day", F.last(at, ignorenulls=True).over(back)).alias(f"days_since_{k}"), F.date_diff(F.first(at, ignorenulls=True).over(ahead), "_day").alias(f"days_to_{k}")]
    near = one.select("_city", "_day", "_row", *told).filter("_row").drop("_row")
    near = near.select("*", *[F.least(f"days_since_{k}", f"days_to_{k}").alias(f"days_to_nearest_{k}") for k in kinds])
    out = df.withColumn("_city", place).withColumn("_day", F.col(day)).join(near, ["_city", "_day"], "left").drop("_city", "_day")
    tomorrow = F.date_add(day, 1)
    eve = days.filter("_holiday").select(F.col("_city").alias("_ec"), F.col("_day").alias("_ed")).distinct()
    out = out.join(eve, (place == F.col("_ec")) & (tomorrow == F.col("_ed")), "left").withColumn("is_eve", F.col("_ed").isNotNull()).drop("_ec", "_ed")
    return out.withColumn("is_holiday", F.coalesce(F.col("days_since_holiday") == 0, F.lit(False)))


def lead_features(df: DataFrame, lead: str) -> DataFrame:
    return df.select("*", bucket(lead).alias("lead_bucket"), F.coalesce(F.col(lead) <= 3, F.lit(False)).alias("is_last_minute"))


def price_history(snapshot: DataFrame, series: list[str], day: str, price: str, lags: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """Lags by exact days, rolling means, deviation, extremes, ratio to the month's mean, velocity and days since the last change. One sort serves all."""
    rows = snapshot.withColumn("_n", F.unix_date(day).cast("long"))
    w = Window.partitionBy(*series).orderBy("_n")
    back = lambda a, b: w.rangeBetween(-a, -b)
    p = F.col(price)
    out = rows.select("*", *[F.max(price).over(back(k, k)).alias(f"lag_{k}") for k in lags])
    changed = F.when(~p.eqNullSafe(F.lag(price).over(w)) & F.lag("_n").over(w).isNotNull(), F.col("_n"))
    out = out.select(
        "*", r6(F.avg(price).over(back(7, 1))).alias("mean_7"), r6(F.avg(price).over(back(14, 1))).alias("mean_14"), r6(F.stddev_samp(price).over(back(7, 1))).alias("std_7"), F.min(price).over(back(14, 1)).alias("min_14"), F.max(price).over(back(14, 1)).alias("max_14"),
        r6(F.try_divide(p, F.avg(price).over(back(30, 1)))).alias("ratio_30"), changed.alias("_changed"),
    )
    last = F.last("_changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("velocity_7", r6((p - F.col("lag_7")) / 7)).withColumn("days_since_change", (F.col("_n") - last).cast("int")).drop("_n", "_changed")


def competitor_set(hotels: DataFrame, score_gap: float = 0.5, least_reviews: int = 50, least: int = 5, most: int = 15) -> DataFrame:
    """Hotels of the same city with a near review score: at most `most` for each, none where fewer than `least` qualify. Nearest first, ties by hotel_id.

    Hotels of one score of a city are folded: their number and the least most + 1 of their ids. The nearest hotels then
    lie within so many scores on either side, and how many qualify is a sum over a range of scores; both are windows over a
    city's scores, dealt out in bins of the gap to which the scores of the bins beside are carried. So no hotel meets
    another one before it is of the set. Hotels without a city or score have no set; an empty table stays empty.
    """
    unit = 1_000_000
    at = F.round(F.col("review_score") * unit).cast("long")
    known = hotels.filter(F.col("city").isNotNull() & F.col("review_score").isNotNull()).select("hotel_id", "city", at.alias("_at"), (F.col("review_count") >= least_reviews).alias("_may"))
    gap = round(score_gap * unit)
    first = known.filter("_may").withColumn("_part", F.pmod(F.xxhash64("hotel_id"), F.lit(32)))
    for by in (["city", "_at", "_part"], ["city", "_at"]):  # a score that many hotels share is ranked in parts first
        ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("hotel_id")))
        first = ranked.filter(F.col("_k") <= most + 1)
    ids = first.groupBy("city", "_at").agg(F.array_sort(F.collect_list("hotel_id")).alias("_ids"))
    points = known.groupBy("city", "_at").agg(F.count_if(F.coalesce("_may", F.lit(False))).alias("_n")).join(ids, ["city", "_at"], "left")
    bin_of = F.floor(F.col("_at") / gap) if gap else F.col("_at")
    carried = points.withColumn("_own", bin_of).withColumn("_bin", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1) if gap else F.array("_own")))
    w = Window.partitionBy("city", "_bin").orderBy("_at")
    near = F.struct("_at", "_ids")
    beside = carried.filter("_n > 0")
    # scores without a candidate take no place among the neighbours: they look at both sides of the candidates' order
    seen = carried.withColumn("_c", F.sum((F.col("_n") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = seen.withColumn("_within", F.sum("_n").over(w.rangeBetween(-gap, gap))).filter("_bin = _own")
    order = beside.withColumn("_c", F.row_number().over(w)).withColumn("_around", F.collect_list(near).over(w.rowsBetween(-most - 1, most + 1)))
    met = counted.filter("_within > 0").select("city", "_bin", "_at", "_within", F.greatest("_c", F.lit(1)).alias("_c")).join(order.select("city", "_bin", "_c", "_around"), ["city", "_bin", "_c"])
    away = lambda x: F.abs(x["_at"] - F.col("_at"))
    others = F.flatten(F.transform(F.filter("_around", lambda x: away(x) <= gap), lambda x: F.transform(x["_ids"], lambda i: F.struct(away(x).alias("d"), i.alias("competitor_id")))))
    listed = met.select("city", "_at", "_within", F.slice(F.array_sort(others), 1, most + 1).alias("_list"))
    mine = known.join(listed, ["city", "_at"]).filter(F.col("_within") - F.coalesce("_may", F.lit(False)).cast("int") >= least)
    out = mine.select("hotel_id", F.posexplode(F.slice(F.filter("_list", lambda x: x["competitor_id"] != F.col("hotel_id")), 1, most)).alias("_k", "_m"))
    return out.select("hotel_id", F.col("_m.competitor_id").alias("competitor_id"), (F.col("_k") + 1).cast("int").alias("rank"))


def _r4(x: Column) -> Column:
    """Four places; the tiny shift keeps exact halves from falling either way with the order of a sum."""
    return F.round(x + 1e-9, 4)


def set_features(prices: DataFrame, sets: DataFrame, day: str) -> DataFrame:
    """A hotel's day price against its set's. prices: hotel_id, day, price, sold_out_share."""
    other = prices.select(F.col("hotel_id").alias("competitor_id"), day, F.col("price").alias("_p"), F.col("sold_out_share").alias("_s"))
    rows = prices.join(sets, "hotel_id").join(other, ["competitor_id", day])
    out = rows.groupBy("hotel_id", day, "price").agg(n_rows().alias("n_competitors"), _r4(F.avg("_p")).alias("set_mean"), r6(quantile("_p", 0.5)).alias("set_median"), F.min("_p").alias("set_min"), F.max("_p").alias("set_max"), _r4(F.avg("_s")).alias("set_sold_out_share"), F.count_if(F.col("_p") < F.col("price")).alias("_below"))
    return out.withColumn("own_to_set", _r4(F.try_divide(F.col("price"), F.col("set_mean")))).withColumn("position", r6(F.col("_below") / F.col("n_competitors"))).drop("_below")


def set_history(compared: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Adds the set's mean of exactly so many days before, and its velocity a day since; null where the hotel has no row of that day."""
    before = compared.select("hotel_id", F.date_add(day, days).alias(day), F.col("set_mean").alias(f"set_mean_lag_{days}"))
    out = compared.join(before, ["hotel_id", day], "left")
    return out.withColumn(f"set_velocity_{days}", r6((F.col("set_mean") - F.col(f"set_mean_lag_{days}")) / days))


def by_horizon(labelled: DataFrame, keep: list[str], horizons: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """A row for each horizon of each labelled row: horizon, actual, direction and the columns to keep. Without a label there is none."""
    each = F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"label_h{k}").cast("double").alias("actual"), F.col(f"direction_h{k}").alias("direction")) for k in horizons])
    return labelled.select(*keep, F.explode(each).alias("_h")).select(*keep, "_h.*").filter("actual is not null")


def labels(snapshot: DataFrame, series: list[str], day: str, price: str, record: str, horizons: tuple[int, ...] = (1, 3, 7, 14), flat: float = 0.02) -> DataFrame:
    """For each horizon the price that many days later, its record, change in money and as a share, and direction (up, down, flat within 2 %)."""
    out = snapshot
    for k in horizons:
        later = snapshot.select(*series, F.date_sub(day, k).alias(day), F.col(price).alias(f"label_h{k}"), F.col(record).alias(f"label_record_h{k}"))
        out = out.join(later, [*series, day], "left").withColumn(f"has_label_h{k}", F.col(f"label_h{k}").isNotNull())
        change = F.try_divide(F.col(f"label_h{k}") - F.col(price), F.col(price))
        out = out.withColumn(f"delta_h{k}", r6(F.col(f"label_h{k}") - F.col(price))).withColumn(f"pct_h{k}", r6(change)).withColumn(f"direction_h{k}", F.when(change > flat, "up").when(change < -flat, "down").when(change.isNotNull(), "flat"))
    return out


def chronological_split(df: DataFrame, day: str, train: float = 0.70, valid: float = 0.15, gap: int = 14) -> DataFrame:
    """train, valid, test or purge by day: cut-offs at quantiles of the distinct days, with a gap before each later part."""
    days = df.select(day).distinct().agg(F.percentile(F.unix_date(day), F.array(F.lit(train), F.lit(train + valid))).alias("_q"))
    cut = df.crossJoin(F.broadcast(days.select(F.floor(F.col("_q")[0]).alias("_a"), F.floor(F.col("_q")[1]).alias("_b"))))
    n = F.unix_date(day)
    part = F.when(n <= F.col("_a") - gap, "train").when(n <= F.col("_a"), "purge").when(n <= F.col("_b") - gap, "valid").when(n <= F.col("_b"), "purge").otherwise("test")
    return cut.withColumn("split", part).drop("_a", "_b")


def baselines(snapshot: DataFrame, series: list[str], day: str, price: str) -> DataFrame:
    """Forecasts by persistence, the median of the history, and the same weekday a week before."""
    w = Window.partitionBy(*series).orderBy("_n")
    rows = snapshot.withColumn("_n", F.unix_date(day).cast("long"))
    out = rows.select("*", F.col(price).alias("persistence"), F.max(price).over(w.rangeBetween(-7, -7)).alias("week_before"))
    return running_median(out, series, ["_n"], price, "historical_median", inclusive=True).withColumn("historical_median", r6("historical_median")).drop("_n")


def metrics(df: DataFrame, actual: str, forecast: str, *by: str) -> DataFrame:
    """Accuracy within 20 %, MAE, RMSE, MAPE, sMAPE and R² for each group and for all."""
    y, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    rows = df.filter(y.isNotNull() & f.isNotNull())
    out = rows.rollup(*by) if by else rows.groupBy()
    wide = out.agg(n_rows().alias("n"), *_errors(y, f), *[F.grouping(c).alias(f"_g_{c}") for c in by])
    keys = [F.when(F.col(f"_g_{c}") == 1, "(all)").otherwise(F.col(c).cast("string")).alias(c) for c in by]
    return wide.select(*keys, "n", "accuracy_20", "mae", "rmse", "mape", "smape", "r2")


def metrics_by(df: DataFrame, actual: str, forecast: str, over: str, dimensions: dict[str, Column]) -> DataFrame:
    """metrics() for each value of `over` and, within it, for all rows and for each value of each dimension: over, dimension, value.

    Rows are told once a dimension before they are summed, so that one aggregate serves all; a null value is (unknown).
    """
    told = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("(all)").alias("value")), *[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("(unknown)")).alias("value")) for n, c in dimensions.items()])
    rows = df.withColumn("_d", F.explode(told)).select("*", "_d.dimension", "_d.value")
    y, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    known = rows.filter(y.isNotNull() & f.isNotNull())
    return known.groupBy(over, "dimension", "value").agg(n_rows().alias("n"), *_errors(y, f))


def _errors(y: Column, f: Column) -> list[Column]:
    err = F.abs(y - f)
    mse = F.avg(err * err)
    return [r6(F.avg((err <= 0.2 * F.abs(y)).cast("double"))).alias("accuracy_20"), r6(F.avg(err)).alias("mae"), r6(F.sqrt(mse)).alias("rmse"), r6(F.avg(F.try_divide(err, F.abs(y)))).alias("mape"), r6(F.avg(F.try_divide(2 * err, F.abs(y) + F.abs(f)))).alias("smape"), r6(1 - F.try_divide(mse, F.var_pop(y))).alias("r2")]


def direction_confusion(df: DataFrame, actual: str, forecast: str, *by: str) -> DataFrame:
    """What was said against what came, by the columns given; rows without either direction are left out."""
    out = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).groupBy(*by, F.col(actual).alias("actual")).pivot(forecast, ["up", "flat", "down"]).agg(n_rows()).fillna(0)
    return out.select(*by, "actual", *[F.col(c).alias(f"said_{c}") for c in ("up", "flat", "down")])


def direction_accuracy(df: DataFrame, actual: str, forecast: str, *by: str) -> DataFrame:
    """Rows with both directions, and the share of them that agree; by the columns given."""
    both = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    return both.groupBy(*by).agg(n_rows().alias("n"), r6(F.avg((F.col(actual) == F.col(forecast)).cast("double"))).alias("direction_accuracy"))


def direction(now: str, then: str, flat: float = 0.02) -> Column:
    change = F.try_divide(F.col(then) - F.col(now), F.col(now))
    return F.when(change > flat, "up").when(change < -flat, "down").when(change.isNotNull(), "flat")


def pricing_opportunity(rows: DataFrame, own: str, own_next: str, set_now: str, set_next: str, least_gap: float = 0.05) -> DataFrame:
    """Where a hotel's next move differs from its set's predicted one: the gap and what to do about it."""
    move = lambda a, b: F.try_divide(F.col(b) - F.col(a), F.col(a))
    out = rows.withColumn("own_move", r6(move(own, own_next))).withColumn("set_move", r6(move(set_now, set_next))).withColumn("gap", r6(F.col("set_move") - F.col("own_move")))
    return out.withColumn("advice", F.when(F.col("gap") >= least_gap, "raise").when(F.col("gap") <= -least_gap, "lower").otherwise("hold"))


def alert_leads(rows: DataFrame, series: list[str], day: str, state: str, event: str) -> DataFrame:
    """For each row whose `event` is true: since when its state has held on every day up to it, and how many days that is ahead.

    Gaps and islands: days of one state in a row share their day less their rank among the series' days of that state. rows
    has one row a series and day; a null state is a state of its own; a null event is none; an empty table stays empty.
    """
    same = Window.partitionBy(*series, state).orderBy(day)
    island = rows.withColumn("_island", F.date_sub(day, F.row_number().over(same)))
    since = island.withColumn("alert_since", F.min(day).over(Window.partitionBy(*series, state, "_island")))
    return since.filter(event).withColumn("lead_days", F.date_diff(day, "alert_since")).drop("_island")


def booking_timing(rows: DataFrame, series: list[str], day: str, price: str, forecast: str) -> DataFrame:
    """For each series the price at the first forecast that says prices won't fall (else the last price), against the first price and the least in hindsight."""
    said = F.coalesce(F.col(forecast) >= F.col(price), F.lit(False))
    out = rows.groupBy(*series).agg(F.min_by(price, day).alias("first_price"), F.min(price).alias("best_price"), F.coalesce(F.min_by(price, F.when(said, F.col(day))), F.max_by(price, day)).alias("booked_price"), F.min_by(day, F.struct(price, day)).alias("best_day"))
    return out.withColumn("saving", r6(F.try_divide(F.col("first_price") - F.col("booked_price"), F.col("first_price")))).withColumn("regret", r6(F.try_divide(F.col("booked_price") - F.col("best_price"), F.col("best_price"))))


def position_alerts(compared: DataFrame, most: float = 0.2) -> DataFrame:
    """Days on which a hotel's price is far from its set's."""
    return compared.filter(F.abs(F.col("own_to_set") - 1) >= most).withColumn("alert", F.when(F.col("own_to_set") > 1, "above_set").otherwise("below_set"))


def external_context(df: DataFrame, weather: DataFrame, arrivals: DataFrame, day: str, seen: str, city: str = "city") -> DataFrame:
    """Adds the weather forecast for a row's `day` and the last known month of arrivals, by city, as known on the day the row was seen.

    weather: city, day, issued_on and measures; of the forecasts for the row's day the last one issued on or before the
    day seen counts. arrivals: city, month (its first day), arrivals; a month is known when it is over, and the last
    month before the one seen in counts. Rows without a city, or with nothing known, stay with nulls; repeated rows stay.
    Forecasts of a (city, day) are folded into one array, so that a join multiplies no rows.
    """
    measures = [c for c in weather.columns if c not in ("city", "day")]
    told = weather.groupBy(F.col("city").alias("_city"), F.col("day").alias("_day")).agg(F.array_sort(F.collect_list(F.struct("issued_on", *[c for c in measures if c != "issued_on"]))).alias("_told"))
    known = arrivals.select(F.col("city").alias("_place"), F.add_months("month", 1).alias("_month"), F.col("arrivals").alias("arrivals_last_month"))
    rows = df.join(told, (F.col(city) == F.col("_city")) & (F.col(day) == F.col("_day")), "left").join(known, (F.col(city) == F.col("_place")) & (F.trunc(seen, "month") == F.col("_month")), "left")
    usable = F.filter("_told", lambda x: x["issued_on"] <= F.col(seen))
    return rows.withColumn("weather", F.when(F.size(usable) > 0, F.element_at(usable, -1))).drop("_city", "_day", "_told", "_place", "_month")
