"""What the operators of this package share: tables, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own setting; in local mode without one a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/rowloom-{spark.sparkContext.applicationId}"
    return where


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; a left-over table harms nothing
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the tables written inside; what held before is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Cut:
    """A table written to the shared folder and read again, so that lost executors cost no recomputation.

    `df` reads it; `drop()` deletes it once nothing reads it any more (rounds of a loop). The shuffle files that it was made
    from go once it is written.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/rowloom/{uuid.uuid4().hex}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if not _MADE:
            atexit.register(drop_since, 0)
        _MADE.append(self)

    def drop(self) -> None:
        if self in _MADE:
            _MADE.remove(self)
        _delete(self.spark, self.path)


#: The tables that are still there, oldest first; what is left goes when the driver ends.
_MADE: list[Cut] = []


def made() -> int:
    """How many tables there are: a mark for `drop_since`."""
    return len(_MADE)


def drop_since(mark: int, keep: Cut | None = None) -> None:
    """Delete the tables written since a mark but one: once a result is written, nothing reads those it was made from."""
    for one in _MADE[mark:]:
        if one is not keep:
            one.drop()


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df


def let(value: Column, body) -> Column:
    """Evaluate `value` once for each row and hand it to `body` as a lambda variable.

    A plain column reference may be inlined into a lambda by the optimizer and then be computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that `scan` folds at a time.
SCAN = 128


def scan(values: Column, op) -> Column:
    """Running results of an associative op over an array, in time that grows with its length.

    A fold that appends copies what it has at every step, so blocks of SCAN are folded apart; the results of the blocks
    before are added to each.
    """

    def folded(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(op(F.try_element_at(acc, F.lit(-1)), x)))

        return F.aggregate(xs, F.filter(xs, lambda _: F.lit(False)), step)

    def of_blocks(blocks: Column) -> Column:
        def of_ends(ends: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(let(F.get(ends, i - 1), lambda before: F.transform(b, lambda x: op(before, x))))))

        return let(folded(F.transform(blocks, lambda b: F.element_at(b, -1))), of_ends)

    def of_values(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(SCAN)), lambda i: i < F.size(xs))
        return let(F.transform(starts, lambda i: folded(F.slice(xs, i + 1, F.lit(SCAN)))), of_blocks)

    return let(values, of_values)


def last_at_or_before(starts: Column, x: Column) -> Column:
    """How many elements of an ascending array are at most x: its last such element has this place, by halving steps."""

    def step(n: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(starts, n + width - 1) <= x, F.lit(False)), n + width).otherwise(n)

    widths = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda w: w <= F.size(starts))
    return F.aggregate(widths, F.lit(0), step)


def words(text: Column) -> Column:
    """The words of a text in order, as an array; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns a, b (long). Returns node, root (the smallest node reachable) for every node with an edge other than
    to itself. Each round is two aggregations with map-side combine and two equi-joins on node ids (skewed stars are
    split by adaptive execution); rounds are written to the shared folder. Nothing is collected but two numbers a round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Cut(e)
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.union(now.df.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        middle = Cut(large)
        low = middle.df.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.df.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = Cut(small)
        now.drop()
        middle.drop()
        now, before = after, mark
        mark = _mark(now.df)
        if mark == before:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free hash of the edges: equal marks mean that a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
