"""Running medians of ordered series, in n log n and with long series split."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT, CHUNK = 512, 4096


def _medians(values: list[float | None], middle: list[float], below: int, before: int, inclusive: bool) -> list[float | None]:
    """The median of what came before each value (or up to it), of a chunk that `before` values precede.

    middle: of these the ones around their median, ascending, so many that the median can't leave them within the chunk;
    below: how many are less than those.
    """
    above = before - below - len(middle) > 0
    out, n = [], before

    def median() -> float | None:
        return (middle[(n - 1) // 2 - below] + middle[n // 2 - below]) / 2 if n else None

    for v in values:
        if not inclusive:
            out.append(median())
        if v is not None:
            n += 1
            if below and v < middle[0]:
                below += 1
            elif not (above and v > middle[-1]):
                insort(middle, v, lo=bisect_left(middle, v))
        if inclusive:
            out.append(median())
    return out


def _chunk(value: str, name: str, chunk: int, inclusive: bool, rows: pa.Table, middle: pa.Table) -> pa.Table:
    rows = rows.sort_by("_pos")
    if not rows.num_rows:
        return rows.append_column(name, pa.array([], pa.float64()))
    told = sorted(middle["_v"].to_pylist())
    below = min(middle["_below"].to_pylist(), default=0)
    out = _medians(rows[value].cast(pa.float64()).to_pylist(), told, below, rows["_chunk"][0].as_py() * chunk, inclusive)
    return rows.append_column(name, pa.array(out, pa.float64()))


def running_median(df: DataFrame, key: list[str], order: list[str], value: str, name: str, inclusive: bool, short: int = SHORT, chunk: int = CHUNK) -> DataFrame:
    """Adds the median of a series' values before each row, or up to it if inclusive, interpolated as by percentile(0.5).

    order should tell the rows of a series apart; null values are not counted but get a median too; before the first value
    it is null. A null in the key is a key of its own; an empty table stays empty.

    Series of up to `short` rows take a framed percentile. A longer one is cut into chunks of `chunk` values that are
    worked out apart, each in one sorted list: a chunk starts from those values before it that lie around their median,
    as far as the chunk can move it. Which these are is told by counts of (chunk, range of ranks), summed over earlier
    chunks, so a chunk is sent a few times its own size at any length of the series.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = df.withColumn("_pos", F.row_number().over(w)).withColumn("_before", F.coalesce(F.count(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    few = rows.filter(F.col("_rows") <= short).withColumn(name, F.percentile(value, F.lit(0.5)).over(upto)).drop("_pos", "_before", "_rows")

    series = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    long = rows.filter(F.col("_rows") > short).withColumn("_series", series).withColumn("_chunk", F.floor(F.col("_before") / chunk).cast("int")).drop("_before", "_rows")
    ranked = long.filter(F.col(value).isNotNull()).select("_series", "_chunk", F.col(value).cast("double").alias("_v")).withColumn("_bin", F.floor((F.row_number().over(Window.partitionBy("_series").orderBy("_v")) - 1) / chunk).cast("int"))
    cells = ranked.groupBy("_series", "_chunk", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    ends = cells.groupBy("_series").agg(F.max("_chunk").alias("_c"), F.max("_bin").alias("_b")).filter("_c > 0")
    dense = ends.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_c")))).withColumn("_bin", F.explode(F.sequence(F.lit(0), F.col("_b")))).join(cells, ["_series", "_chunk", "_bin"], "left")
    earlier = dense.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy("_series", "_bin").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = earlier.withColumn("_to", F.sum("_n").over(Window.partitionBy("_series", "_chunk").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    half, reach = F.col("_chunk") * chunk / 2, chunk // 2 + 2
    wanted = placed.filter((F.col("_n") > 0) & (F.col("_to") > half - reach) & (F.col("_to") - F.col("_n") < half + reach)).select("_series", F.col("_chunk").alias("_of"), "_bin", (F.col("_to") - F.col("_n")).alias("_below"))
    middle = wanted.join(ranked.withColumnRenamed("_chunk", "_from"), ["_series", "_bin"]).filter("_from < _of").select(F.col("_series").alias("_s"), "_of", "_below", "_v")
    schema = T.StructType([*long.schema.fields, T.StructField(name, T.DoubleType())])
    many = long.groupBy("_series", "_chunk").cogroup(middle.groupBy("_s", "_of")).applyInArrow(lambda a, b: _chunk(value, name, chunk, inclusive, a, b), schema)
    return few.unionByName(many.drop("_pos", "_series", "_chunk"))
