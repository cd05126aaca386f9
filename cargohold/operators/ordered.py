"""Order-dependent operators that don't put a key's rows into one task.

Rows are dealt by ranges of (keys, order). Each range is worked on by itself,
and what a range needs from those before it (a sum, a count, a last row) is
carried over. A border between two ranges lies within one key at most, so what is
carried is one row per range at most, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargohold.scratch import written

_PART = "__part"


def _ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn(_PART, F.spark_partition_id()), "ranged")


def _carried(ends: DataFrame, keys: list[str], carry: Column) -> DataFrame:
    """(part, keys, __b) of the ranges that a key goes on in: carry, a window expression's column, over what its earlier ranges end with."""
    w = Window.partitionBy(*keys).orderBy(_PART)
    return ends.withColumn("__first", F.lag(_PART).over(w).isNull()).withColumn("__b", carry.over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("NOT __first").select(_PART, *keys, "__b")


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __b, null where nothing is carried; keys may be null. carried has fewer rows than there are ranges."""
    names = [_PART, *keys]
    small = F.broadcast(carried.select(*(F.col(n).alias(f"__r_{i}") for i, n in enumerate(names)), "__b"))
    on = [rows[n].eqNullSafe(small[f"__r_{i}"]) for i, n in enumerate(names)]
    return rows.join(small, on, "left").drop(*(f"__r_{i}" for i in range(len(names))))


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows before, of the same keys (G1: sizes to offsets).

    order must tell rows apart; nulls in value count as zero.
    """
    rows = _ranged(df.withColumn("__v", F.coalesce(value, F.lit(0))), keys, order)
    by = [_PART, *keys]
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = _carried(rows.groupBy(*by).agg(F.sum("__v").alias("__t")), keys, F.sum("__t"))
    return _with_carried(rows.withColumn("__i", inside), before, keys).withColumn(name, F.col("__i") + F.coalesce("__b", F.lit(0))).drop("__v", "__i", "__b", _PART)


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... within keys (G4: occurrence numbers)."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def previous(df: DataFrame, keys: list[str], order: list[str | Column], column: str, name: str) -> DataFrame:
    """df with `name`: column in the row before, of the same keys; null in the first (G2: change detection)."""
    rows = _ranged(df, keys, order)
    by = [_PART, *keys]
    cell = F.struct(F.col(column).alias("v"))
    w = Window.partitionBy(*by).orderBy(*order)
    inside = rows.withColumn("__i", F.lag(cell).over(w))
    keyed = [F.col(o) if isinstance(o, str) else o for o in order]
    ends = rows.groupBy(*by).agg(F.max_by(cell, F.struct(*(k.alias(f"o{i}") for i, k in enumerate(keyed)))).alias("__e"))
    before = _carried(ends, keys, F.last("__e", ignorenulls=True))
    return _with_carried(inside, before, keys).withColumn(name, F.coalesce("__i", "__b")["v"]).drop("__i", "__b", _PART)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, take: list[str], forward: bool = False) -> DataFrame:
    """left with the columns `take` of the nearest right row of the same keys.

    forward: the right row with the smallest right_on that is not below left_on
    (E6: a file's medium); else the largest not above it. Of right rows with
    equal right_on the one with the smallest `take` counts. Left rows without a
    partner, or with a null left_on, have nulls; null right_on match nothing.
    """
    sign = F.lit(-1) if forward else F.lit(1)
    answer = F.struct(*take)
    l_rows = left.withColumn("__at", F.col(left_on) * sign).withColumn("__side", F.lit(1)).withColumn("__a", F.lit(None).cast(right.select(answer.alias("a")).schema["a"].dataType))
    near = right.filter(F.col(right_on).isNotNull()).groupBy(*keys, right_on).agg(F.min(answer).alias("__a"))
    r_rows = near.select(*keys, (F.col(right_on) * sign).alias("__at"), F.lit(0).alias("__side"), "__a")
    rows = _ranged(l_rows.filter("__at IS NOT NULL").unionByName(r_rows, allowMissingColumns=True), keys, ["__at", "__side"])
    by = [_PART, *keys]
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("__i", F.last("__a", ignorenulls=True).over(w)).filter("__side = 1")
    ends = rows.groupBy(*by).agg(F.max_by("__a", F.when(F.col("__side") == 0, F.col("__at"))).alias("__e"))
    before = _carried(ends, keys, F.last("__e", ignorenulls=True))
    found = _with_carried(inside, before, keys).withColumn("__f", F.coalesce("__i", "__b")).unionByName(l_rows.filter("__at IS NULL"), allowMissingColumns=True)
    return found.select(*(F.col(c) for c in left.columns), *(F.col("__f")[c].alias(c) for c in take))


def gaps(df: DataFrame, keys: list[str], position: str, least: int, name: str) -> DataFrame:
    """The distinct positions of df with `name`: the gap from position + least to the next position at or beyond that (G3 after G5)."""
    places = df.select(*keys, position).distinct()
    ahead = places.select(*keys, F.col(position).alias("__next"))
    found = asof(places.withColumn("__from", F.col(position) + least), ahead, keys, "__from", "__next", ["__next"], forward=True)
    return found.withColumn(name, F.col("__next") - F.col("__from")).drop("__from", "__next")


#: A range takes up to so many cells, and the next level's cells are so much wider.
CELLS = 8


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, first: str, last: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """points joined to every range with first <= at <= last (E9, E10, D-19).

    Ranges are cut into cells, so it is an equi-join on cells; width should be
    about a range's usual length. Longer ranges have wider cells, so that each
    takes CELLS + 1 at most; points are asked for once at each level of width
    that there is, which are few. Null or reversed bounds match nothing.
    """
    keys = keys or []
    known = ranges.filter(F.col(first) <= F.col(last))
    level = F.greatest(F.ceil(F.log(float(CELLS), F.greatest((F.col(last) - F.col(first) + 1) / (width * CELLS), F.lit(1.0))) - 1e-9), F.lit(0)).cast("int")
    known = known.withColumn("__level", level)
    levels = sorted(r[0] for r in known.select("__level").distinct().collect())  # at most 21: bounds are 64-bit numbers

    def cell(place: Column) -> Column:
        return F.floor(place / (F.pow(F.lit(float(CELLS)), F.col("__level")) * width))

    cells = known.withColumn("__cell", F.explode(F.sequence(cell(F.col(first)), cell(F.col(last)))))
    asked = points.withColumn("__level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>"))).withColumn("__cell", cell(F.col(at)))
    return asked.join(cells, [*keys, "__level", "__cell"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("__cell", "__level")
