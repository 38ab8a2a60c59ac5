"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import SPACES, cut, table

#: Weights by the sources' code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target stops at so many times its size.
MOST_EPOCHS = 3
#: Put before an id when its random key is made; another salt gives another mix.
SALT = "mix:"
#: Hexadecimal digits of a key that name its range: 16 to this power ranges a source.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    """Words of a text: the places where a word begins. One scan, no array of words."""
    return F.when(F.length(F.translate(text, SPACES, "")) > 0, F.size(F.split(F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, key (a hash-random order of the ids) of every row of docs; whole texts, no shuffle."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.md5(F.concat(F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return picked.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size, target from source, source_size: shares by weight of the whole size, stopped at MOST_EPOCHS sizes.

    What a stopped source leaves is reshared by weight until none is above: at the end each source has the smaller of
    its stop and level * weight. Sources in the order of stop / weight are stopped from the front, so prefix sums give
    the level. The windows hold one row a source, after aggregation.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    w = by_source.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS)))))
    w = w.withColumn("stop", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("own_level", left / weight_left).withColumn("open", F.col("own_level") * F.col("weight") <= F.col("stop"))
    w = w.withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("stop") / F.col("weight")).alias("ratio"), F.col("own_level").alias("level")))).over(every)["level"])
    share = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return w.select("source", "source_size", F.when(F.col("total") > 0, share).otherwise(0.0).alias("target"))


def _with_range(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.substring("key", 1, RANGE_DIGITS))


def plan(found: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, budget, epochs (whole passes), cut_key, cut_id, cut_size, cut_rest, cut_rows.

    Rows whose (key, doc_id, size) is below the cut's are taken once more, rows at the cut share cut_rest words.
    Keys are random, so ranges of their first digits divide each source evenly, a hot one too: sizes are summed by
    (source, range), prefix sums over the ranges find the one in which the budget ends, and only that range is sorted.
    """
    ranges = cut(_with_range(found).groupBy("source", "part").agg(F.sum("size").alias("words")))
    by_source = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_source = by_source.withColumn("budget", F.round("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    by_source = cut(by_source.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    summed = ranges.withColumn("before", upto - F.col("words"))
    s, r = by_source.alias("s"), summed.alias("r")
    ends = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).where("rest > before and rest <= before + words").select(F.col("r.source").alias("end_source"), F.col("part").alias("end_part"), F.col("before").alias("end_before"), F.col("rest").alias("end_rest"))
    rows = _with_range(found).join(ends, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("part") == F.col("end_part")))
    groups = rows.groupBy("end_source", "key", "doc_id", "size").agg(F.count("*").alias("n"), F.first("end_before").alias("end_before"), F.first("end_rest").alias("end_rest"))
    run = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("end_source").orderBy("key", "doc_id", "size")) + F.col("end_before")
    at = groups.withColumn("upto", run).withColumn("words", F.col("size") * F.col("n")).where("end_rest > upto - words and end_rest <= upto")
    at = at.select("end_source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), (F.col("end_rest") - F.col("upto") + F.col("words")).alias("cut_rest"), F.col("n").alias("cut_rows"))
    return by_source.join(at, F.col("source").eqNullSafe(F.col("end_source")), "left").select("source", "source_size", "target", "budget", "epochs", "cut_key", "cut_id", "cut_size", "cut_rest", "cut_rows")


def taken(size: Column) -> Column:
    """Words that the mix takes of a row (columns of plan() beside key and doc_id)."""
    c = F.col
    null_first = c("doc_id").isNull() & c("cut_id").isNotNull()
    below = (c("key") < c("cut_key")) | ((c("key") == c("cut_key")) & (null_first | (c("doc_id") < c("cut_id")) | (c("doc_id").eqNullSafe(c("cut_id")) & (size < c("cut_size")))))
    at = (c("key") == c("cut_key")) & c("doc_id").eqNullSafe(c("cut_id")) & (size == c("cut_size"))
    part = F.floor(c("cut_rest") / c("cut_rows"))
    return c("epochs") * size + F.when(F.coalesce(at, F.lit(False)), part).when(F.coalesce(below, F.lit(False)), size).otherwise(0).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (long: words taken, repeats counted).

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Rows with a null or repeated doc_id
    share a key; equal rows at the cut share its words evenly. An empty table gives no rows; other columns are ignored. A
    text of any length is measured whole; one that holds more words than its source's target is taken in part.
    """
    found = cut(sizes(docs, id_col, text_col, source_col))
    by_source = cut(plan(found)).withColumnRenamed("source", "of_source")
    joined = found.join(by_source, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "size", "source_size", "target", taken(F.col("size")).cast("long").alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, same columns: each row as often as the mix takes it, the one at a cut once more if half of it or more fits.

    A row without words takes no budget: it is repeated as a row of one word at its key would be.
    """
    found = cut(sizes(docs, id_col, text_col, source_col))
    names = [f"_rowloom_{c}" for c in ("source", "source_size", "target", "budget", "epochs", "cut_key", "cut_id", "cut_size", "cut_rest", "cut_rows")]
    by_source = cut(plan(found)).toDF(*names)
    state = F.struct(*[F.col(n).alias(n.removeprefix("_rowloom_")) for n in names]).alias("p")
    own = F.struct(*[F.col(c).alias(c) for c in docs.columns]).alias("row")
    rows = docs.join(by_source, F.col(source_col).cast("string").eqNullSafe(F.col(names[0]))).select(own, state)
    key = F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(f"row.{id_col}").cast("long").cast("string"), F.lit("null"))).cast("binary"))
    flat = rows.select("row", F.col(f"row.{id_col}").cast("long").alias("doc_id"), key.alias("key"), n_words(F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))).alias("size"), "p.epochs", "p.cut_key", "p.cut_id", "p.cut_size", "p.cut_rest", "p.cut_rows")
    size = F.greatest("size", F.lit(1).cast("long"))
    times = F.floor(taken(size) / size + F.lit(0.5)).cast("int")
    return flat.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight, CAST((SELECT sum(size) FROM d) AS DOUBLE) AS total FROM s),
lv AS (SELECT 0 AS round, CAST(total / sum(weight) AS DOUBLE) AS level FROM w GROUP BY total
  UNION ALL
  SELECT round + 1, (SELECT any_value(total) - coalesce(sum(3.0 * source_size) FILTER (WHERE lv.level * weight > 3.0 * source_size), 0) FROM w)
    / (SELECT sum(weight) FILTER (WHERE lv.level * weight <= 3.0 * source_size) FROM w) FROM lv WHERE round < 60),
lvl AS (SELECT arg_max(level, round) AS level FROM lv),
t AS (SELECT source, source_size, CASE WHEN total > 0 THEN least(3.0 * source_size, level * weight) ELSE 0.0 END AS target FROM w, lvl),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""
