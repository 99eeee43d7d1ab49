"""Operators over one global order, without moving all rows to one task.

Rows are cut into ranges of the whole sort key, ties included, so a value that very many rows
share is cut as well. The sorted rows are written once; their places in it, and running sums
within a range, need no further order. What ranges owe each other - counts and sums of those
before - is a table with a row for each range (and group). Rows some places before or after
are seen in blocks of places, each with a margin of its neighbours' rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.scratch import materialize

#: Places in a block of rows that see each other.
BLOCK = 50_000


def sorted_rows(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """df as written in the order of (by, order): __range and __place in it. `order` ends in a unique key. Of the columns only those in `keep` are written, if it is given."""
    keys = [*map(F.col, by), *order]
    at = F.monotonically_increasing_id()  # the range, and below it the place
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select(*(df.columns if keep is None else keep), F.shiftright(at, 33).alias("__range"), at.bitwiseAND((1 << 33) - 1).alias("__place")))


def joined(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of table, whose keys are unique; null keys meet as well. A table without group keys is as small as the number of ranges."""
    named = table.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(F.broadcast(named) if keys == ["__range"] else named, on, how).drop(*[f"__k_{k}" for k in keys])


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, position: str | None = "pos", by: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """df with its 0-based place in the order and running sums (own row included), in each group of `by`; of the columns those in `keep` (all, if it isn't given), with which `by` and sums must do."""
    sums, keys = dict(sums or {}), [*by, "__range"]
    rows = sorted_rows(df, order, by, keep)
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
    totals = totals.select(*keys, (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__n"), *[F.coalesce(F.sum(f"__s_{k}").over(ahead), F.lit(0)).alias(f"__s_{k}") for k in sums])
    w = Window.partitionBy(*keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    out = joined(rows.withColumns({k: F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()}) if sums else rows, totals, keys)
    if position:
        out = out.withColumn(position, F.col("__place") + F.col("__n"))
    return out.withColumns({k: F.col(k) + F.col(f"__s_{k}") for k in sums}).drop("__range", "__place", "__n", *[f"__s_{k}" for k in sums])


def lagged(rows: DataFrame, position: str, found: Mapping[str, tuple[Column, int]], by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """rows with, for each name: (value, k), the value k places before (after, if k is negative) in the group; null where there is none."""
    before, after = max(0, *[k for _, k in found.values()]), max(0, *[-k for _, k in found.values()])
    block = max(block, before, after, 1)
    own = F.floor(F.col(position) / block).cast("long")
    inside = F.col(position) - own * block
    at = lambda k: F.struct((own + k).alias("block"), F.lit(k == 0).alias("own"))
    places = F.array_compact(F.array(at(0), F.when(inside >= block - before, at(1)), F.when(inside < after, at(-1))))
    w = Window.partitionBy(*by, "__at.block").orderBy(position)
    seen = rows.withColumn("__at", F.explode(places))
    return seen.withColumns({name: F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w) for name, (c, k) in found.items()}).where("__at.own").drop("__at")


def lagged_mean(df: DataFrame, order: Sequence[Column], value: Column, rows: int, name: str, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Mean of `value` (of integers) over the previous `rows` rows of the order, null for the first: the running sums of two rows before."""
    got = lagged(running(df, order, {"__sum": value.cast("long")}, "__pos", by), "__pos", {"__hi": (F.col("__sum"), 1), "__lo": (F.col("__sum"), rows + 1)}, by, block)
    n = F.least(F.col("__pos"), F.lit(rows))
    return got.withColumn(name, F.when(n > 0, (F.col("__hi") - F.coalesce("__lo", F.lit(0))) / n)).drop("__pos", "__sum", "__hi", "__lo")


def asof_backward(probes: DataFrame, keys: DataFrame, on: str, values: Sequence[str], tie: Column, default: Mapping[str, Column] | None = None, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """probes with `values` of the last row of keys (of the same `by`) whose `on` is at or before the probe's; with `strict`, before it.

    Of keys with the same `on`, the one of largest `tie` counts. Null probes find nothing. Both
    sides are sorted together; the last key of a range is handed on to those after it.
    """
    packed = keys.where(F.col(on).isNotNull()).groupBy(*by, F.col(on).cast("double").alias("__k")).agg(F.max_by(F.struct(*values), tie).alias("__v"))
    right = packed.select(*by, "__k", "__v", F.lit(0).alias("__side"), F.lit(None).cast(probes.schema).alias("__p"))
    left = probes.select(*by, F.col(on).cast("double").alias("__k"), F.lit(None).cast(packed.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"), F.struct(*probes.columns).alias("__p"))
    # A hash parts equal probes into ranges; it doesn't matter which comes first.
    order = [F.col("__k").asc_nulls_first(), F.desc("__side") if strict else F.asc("__side"), F.xxhash64("__p")]
    both, group = sorted_rows(right.unionByName(left), order, by), [*by, "__range"]
    ends = both.groupBy(*group).agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__place"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, F.last("__end", True).over(before).alias("__end"))
    w = Window.partitionBy(*group).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    got = joined(both.withColumn("__found", F.last("__v", True).over(w)).where("__side = 1"), ends, group)
    got = got.withColumn("__found", F.when(F.col("__k").isNotNull(), F.coalesce("__found", "__end")))
    default = default or {}
    return got.select("__p.*", *[F.coalesce(F.col("__found")[v], default[v]).alias(v) if v in default else F.col("__found")[v].alias(v) for v in values])


def _counted_times(df: DataFrame, t: str) -> DataFrame:
    """Distinct times and how many rows are at or before each: counts before order."""
    return running(df.where(F.col(t).isNotNull()).groupBy(F.col(t).cast("double").alias("__t")).agg(F.count("*").alias("__n")), [F.col("__t")], {"__upto": F.col("__n")}, None)


def _upto(times: DataFrame, bounds: Mapping[str, Column], strict: bool) -> DataFrame:
    """__t and, for each name: bound (of __t), the number of rows at or before it; with `strict`, before it."""
    probes = times.select("__t", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("at")) for k, c in bounds.items()])).alias("x")).select("__t", "x.name", "x.at")
    got = asof_backward(probes, times.select(F.col("__t").alias("at"), "__upto"), "at", ["__upto"], F.col("__upto"), {"__upto": F.lit(0)}, strict=strict)
    return got.groupBy("__t").agg(*[F.max(F.when(F.col("name") == k, F.col("__upto"))).alias(k) for k in bounds])


def time_counts(df: DataFrame, t: str, key: str, widths: Mapping[str, float], position: str | None = None) -> DataFrame:
    """For each width w: rows at or before the own place in the order of (t, key) with time >= t - w; null for null times.

    The own place less the number of rows before t - w. The latter follows from counts of
    distinct times, so only places are found by sorting rows; `position` names them in the result.
    """
    got = placed_counts(running(df, [F.col(t).asc_nulls_last(), F.col(key)], position="__pos"), t, "__pos", widths)
    return got.withColumnRenamed("__pos", position) if position else got.drop("__pos")


def placed_counts(placed: DataFrame, t: str, position: str, widths: Mapping[str, float]) -> DataFrame:
    """time_counts of rows whose place in the order of (t, key) is known."""
    # The last place at a time says how many rows are at or before it.
    times = materialize(placed.where(F.col(t).isNotNull()).groupBy(F.col(t).cast("double").alias("__t")).agg((F.max(position) + 1).alias("__upto")))
    before = materialize(_upto(times, {f"__b_{k}": F.col("__t") - F.lit(float(w)) for k, w in widths.items()}, True))
    got = placed.join(before, F.col(t).cast("double") == F.col("__t"), "left")
    return got.withColumns({k: F.col(position) + 1 - F.col(f"__b_{k}") for k in widths}).drop("__t", *[f"__b_{k}" for k in widths])


def centered_counts(df: DataFrame, t: str, name: str, reach: float) -> DataFrame:
    """Other rows with a time within `reach` on either side; null for null times."""
    times = materialize(_counted_times(df, t))
    high, low = _upto(times, {"__high": F.col("__t") + F.lit(float(reach))}, False), _upto(times, {"__low": F.col("__t") - F.lit(float(reach))}, True)
    got = df.join(materialize(high.join(low, "__t")), F.col(t).cast("double") == F.col("__t"), "left")
    return got.withColumn(name, F.col("__high") - F.col("__low") - 1).drop("__t", "__high", "__low")


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], by_range: int | None = None, weight: str | None = None) -> DataFrame:
    """column_name, share, value: exact quantiles of numeric columns, between two values in proportion; no row for a column without a value.

    Distinct values are counted and put in order by ranges, for all columns at once. How many rows
    each range holds says which range has the rows that a share falls between; only that range's
    values are added up. Nulls are left out, NaN is the largest value. A row counts as often as its `weight` says.
    """
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).select("x.column_name", "x.v", "w")
    counts = cells.where("v IS NOT NULL").groupBy("column_name", "v").agg(F.sum("w").alias("n"))
    ordered = sorted_rows(counts, [F.col("v")], ["column_name"])
    # A row for each column and range; then one for each column and share.
    ranges = ordered.groupBy("column_name", "__range").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column_name")
    ranges = ranges.select("column_name", "__range", "n", (F.sum("n").over(w.orderBy("__range")) - F.col("n")).alias("ahead"), F.sum("n").over(w).alias("all"))
    at = F.lit(0.0) + (F.col("all") - 1) * F.col("share")
    wanted = ranges.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).where("k >= ahead AND k < ahead + n")
    wanted = wanted.select("column_name", "__range", "share", (F.col("k") - F.col("ahead")).alias("k"), F.when(F.col("k") > F.floor(at), at - F.floor(at)).otherwise(F.floor(at) + 1 - at).alias("weight"))
    few = F.broadcast(wanted)  # two rows for each column and share at most
    some = ordered.join(F.broadcast(wanted.select("column_name", "__range").distinct()), ["column_name", "__range"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("column_name", "__range").orderBy("__place"))
    found = some.withColumn("upto", upto).withColumnRenamed("n", "m").join(few, ["column_name", "__range"]).where("k < upto AND k >= upto - m")
    return found.groupBy("column_name", "share").agg(F.when(F.min("v") == F.max("v"), F.max("v")).otherwise(F.sum(F.col("v") * F.col("weight"))).alias("value"))
