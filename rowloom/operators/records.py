"""Record operators on DataFrames: positional reads, lookups, set operations, non-transactional changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of the first order column that work along an order of a whole table is dealt out by.
RANGES = 256


def reversed_key(kind: str, c: Column) -> Column:
    """A key of a column of a Spark type that sorts the other way round, nulls last, as a descending sort does.

    Texts sort by the complement of their bytes' digits, an end mark above all digits putting longer ones first.
    """
    base = kind.split("(")[0]
    if base in ("tinyint", "smallint", "int", "bigint"):
        out = F.bitwise_not(c)
    elif base == "decimal":
        out = -c
    elif base in ("float", "double"):
        return F.struct(c.isNull().alias("n"), (~F.isnan(c)).alias("f"), (-F.nanvl(c, F.lit(0.0))).alias("k"))
    elif base == "boolean":
        out = ~c
    elif base == "date":
        out = F.bitwise_not(F.unix_date(c))
    elif base == "timestamp":
        out = F.bitwise_not(F.unix_micros(c))
    elif base == "timestamp_ntz":
        out = F.bitwise_not(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c))
    elif base in ("string", "binary"):
        out = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    else:
        raise TypeError(f"no descending order of {kind}")
    return F.struct(c.isNull().alias("n"), out.alias("k"))


def order_key(df: DataFrame, order: list[tuple[Column, bool]]) -> Column:
    """One struct that sorts as an order of (column, descending) over df does."""
    kinds = df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(order)]).dtypes
    return F.struct(*[(reversed_key(t, c) if down else c).alias(f"s{i}") for i, ((c, down), (_, t)) in enumerate(zip(order, kinds))])


def _number(kind: str, c: Column) -> Column | None:
    """A number that never falls where a column of a type rises; None if there is none. Of texts, what the first bytes tell."""
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")) and not kind.startswith("interval"):
        return c
    if kind == "boolean":
        return c.cast("int")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return None


def ranged(df: DataFrame, first: Column, ranges: int = RANGES) -> DataFrame | None:
    """df with __range, which rises with a column: quantiles of it cut the rows into ranges, found by one aggregate and joined
    as one row. None if the column's type has no quantiles. Equal values stay in one range.
    """
    key = _number(df.select(first.alias("k")).dtypes[0][1], first)
    if key is None:
        return None
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(key, shares, 1000)).alias("__bounds"))
    place = F.when(key.isNull(), -1).otherwise(F.size(F.filter(F.coalesce("__bounds", F.array()), lambda b: b < key)))
    return df.crossJoin(F.broadcast(bounds)).withColumn("__range", place).drop("__bounds")


def running_sum(df: DataFrame, value: Column, order: list[tuple[Column, bool]], name: str, ranges: int = RANGES) -> DataFrame:
    """df with the sum of value over all rows up to and with each, along an order of (column, descending); null values add nothing.

    A window over a whole table would run in one task: each range of the first order column has its own window, and the
    sums of the ranges before it, a few rows, are added.
    """
    first, down = order[0]
    own = [c.desc() if d else c.asc() for c, d in order]
    dealt = ranged(df, first, ranges)
    if dealt is None:
        return df.withColumn(name, F.sum(F.coalesce(value, F.lit(0))).over(Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.withColumn("__value", F.coalesce(value, F.lit(0)))
    sums = dealt.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy(F.col("__range").desc() if down else F.col("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*own).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("__inside", inside).join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return out.withColumn(name, F.col("__start") + F.col("__inside")).drop("__range", "__r", "__value", "__start", "__inside")


def beside(df: DataFrame, order: list[str], value: Column, following: bool, name: str, ranges: int = RANGES) -> DataFrame:
    """df with the value (a struct) of the next row along an ascending order of the whole table, or of the one before.

    Each range of the first order column has its own window; a range's outermost row, found by one aggregate, is carried
    over its border.
    """
    move, w = (F.lead if following else F.lag), Window.orderBy(*order)
    dealt = ranged(df, F.col(order[0]), ranges)
    if dealt is None:
        return df.withColumn(name, move(value).over(w))
    pick = F.min_by if following else F.max_by
    edges = dealt.groupBy("__range").agg(pick(value, F.struct(*order)).alias("__edge"))
    over = edges.select(F.col("__range").alias("__r"), move("__edge").over(Window.orderBy("__range")).alias("__over"))
    inside = move(value).over(Window.partitionBy("__range").orderBy(*order))
    out = dealt.withColumn("__inside", inside).join(F.broadcast(over), F.col("__range") == F.col("__r"))
    return out.withColumn(name, F.coalesce("__inside", "__over")).drop("__range", "__r", "__inside", "__over")


def neighbours(df: DataFrame, order: list[str], columns: list[str], partition: list[str] | None = None) -> DataFrame:
    """df with next_<c> and prev_<c> of the given columns along an order, of the whole table or within a partition."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns], *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    value = F.struct(*columns)
    out = beside(beside(df, order, value, True, "__next"), order, value, False, "__prev")
    return out.select(*df.columns, *[F.col("__next")[c].alias(f"next_{c}") for c in columns], *[F.col("__prev")[c].alias(f"prev_{c}") for c in columns])


def first_match(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], order: list[str], keep_all: bool = False) -> DataFrame:
    """Each left row with its first right row: the right side is reduced to one row a key before the join, so nothing multiplies."""
    keys = [r for _, r in on]
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in right.columns if c not in keys]), F.struct(*order)).alias("_r"))
    renamed = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_r")
    cond = None
    for i, (a, _) in enumerate(on):
        c = left[a] == renamed[f"_k{i}"]
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "left" if keep_all else "inner").select(*[left[c] for c in left.columns], *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_r.*")


def unique_match(df: DataFrame, condition: Column, no_error: bool = False) -> DataFrame:
    """The only row that meets a condition: no row if there is none, an error (or with no_error no row) if there are more."""
    few = df.where(condition).limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return (few.where("_n = 1") if no_error else few.where(F.assert_true(F.col("_n") <= 1, F.lit("more than one row")).isNull())).drop("_n")


def append_if_absent(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """df and those rows of new whose keys it doesn't have."""
    return df.unionByName(new.join(df.select(*keys), keys, "left_anti"))


def merge(df: DataFrame, changes: DataFrame, keys: list[str], remove: Column) -> DataFrame:
    """Changes by key: rows marked by remove go, known keys take the non-null new values, others come in. changes: one row a key."""
    values = [c for c in df.columns if c not in keys]
    gone = changes.where(remove).select(*keys)
    new = changes.where(~remove)
    marked = new.select(*keys, F.struct(*values).alias("_new"))
    old = df.join(gone, keys, "left_anti").join(marked, keys, "left")
    return old.select(*keys, *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in values]).unionByName(new.select(*df.columns).join(df.select(*keys), keys, "left_anti"))


def create(df: DataFrame, **values) -> DataFrame:
    """df and one new row; fields not given are null."""
    one = df.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(one)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """df without the rows that meet a condition; rows for which it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """df with new values where a condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def break_totals(df: DataFrame, breaks: list[str], value: str) -> DataFrame:
    """Totals, counts, averages and extremes of a value by break fields, with the sub-totals above them."""
    v = F.col(value)
    return df.rollup(*breaks).agg(F.sum(v).alias("total"), F.count(v).alias("count"), F.avg(v).alias("average"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def marked(df: DataFrame, by: list[Column], order: Column, first: str, last: str) -> DataFrame:
    """df with whether a row is the first, and the last, of its group along an order without ties.

    The groups' outermost rows come from one aggregate, combined before its shuffle, and are joined back: a large group
    is no window of one task.
    """
    keys = [c.alias(f"__b{i}") for i, c in enumerate(by)]
    ends = df.groupBy(*keys).agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & c.eqNullSafe(F.col(f"__b{i}"))
    out = df.join(ends, cond).withColumn(first, order.eqNullSafe(F.col("__low"))).withColumn(last, order.eqNullSafe(F.col("__high")))
    return out.drop("__low", "__high", *[f"__b{i}" for i in range(len(by))])


def break_marks(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with first_of and last_of of a break field along an order without ties."""
    return marked(df, [F.col(by)], F.struct(*order), "first_of", "last_of")


def current_changed(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row differs between two snapshots."""
    values = [c for c in before.columns if c not in keys]
    a, b = (d.select(*keys, F.struct(*values).alias(n)) for d, n in ((before, "_a"), (now, "_b")))
    return a.join(b, keys).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
