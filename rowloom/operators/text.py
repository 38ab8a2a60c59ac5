"""Token tables and line maps of many source texts."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.lexer import SYMBOLS, columns, tokenize

#: The token classes of plans.lexer for Java's matcher: possessive groups neither recurse nor backtrack on long tokens.
_JAVA = (
    r"""[ \t\n\r]++|//[^\n]*+\n?|/\*[\s\S]*?\*/|/\*[\s\S]*|"(?:[^"~]++|~[\s\S])*+"|'(?:[^'~]++|~[\s\S])*+'|["'][\s\S]*|[0-9]++(?:\.[0-9]++)?"""
    r"""|(?:[Nn][Oo]|[Ss][Hh][Aa][Rr][Ee]|[Ee][Xx][Cc][Ll][Uu][Ss][Ii][Vv][Ee])[ \t]++[Ll][Oo][Cc][Kk](?![A-Za-z0-9_-])|[A-Za-z_][A-Za-z0-9_-]*+|\{&[^}]*+\}?|&[A-Za-z0-9-]*+|\+=|-=|\*=|/=|>=|<=|<>|::|[\s\S]"""
)

TOKENS = "id long, idx int, kind string, start int, end int, text string, int_value long, decimal_value string, string_value string, bool_value boolean"
#: Tokens of a batch that a task hands on.
BATCH = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the cores if it has no shuffle to do so anyway: one small file must not keep one core busy alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


class _Table:
    """Token columns of several texts, handed on as one batch."""

    def __init__(self, places: bool):
        self.places, self.names = places, [c.split()[0] for c in TOKENS.split(", ")] + (["line", "column"] if places else [])
        self.clear()

    def clear(self) -> None:
        self.lists: list[list] = [[] for _ in range(10)]
        self.at: list[list] = [[], []]

    def add(self, key: int | None, text: str, known: dict[str, str]) -> None:
        kinds, starts, ends, texts, values = columns(text, known)
        raw = text.encode("utf-8", "surrogatepass") if self.places or not text.isascii() else text
        n, size = len(kinds) + 1, len(raw)
        types = set(map(type, values))
        pick = lambda kind: [v if type(v) is kind else None for v in values] if kind in types else [None] * (n - 1)
        decimals = [None if v is None else str(v) for v in pick(Decimal)]
        for out, column in zip(self.lists, (repeat(key, n), range(n), kinds, starts, ends, texts, pick(int), decimals, pick(str), pick(bool))):
            out.extend(column)
        for out, end in zip(self.lists[2:], ("Eof", size, size, "", None, None, None, None)):
            out.append(end)
        if self.places:  # a token's line is one more than the line feeds before it, its column counts bytes from the last
            feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            begins = np.concatenate(([0], feeds + 1))
            at = np.array([*starts, size], np.int64)
            line = np.searchsorted(feeds, at, side="left")
            self.at[0].extend((line + 1).tolist())
            self.at[1].extend((at - begins[line] + 1).tolist())

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        cols = [pa.array(c, k) for c, k in zip(self.lists, kinds)] + ([pa.array(c, pa.int32()) for c in self.at] if self.places else [])
        self.clear()
        return pa.RecordBatch.from_arrays(cols, names=self.names)


def tokens(df: DataFrame, id_col: str, text_col: str, keywords: dict[str, str] | None = None, places: bool = False) -> DataFrame:
    """One row for each token of each text: id, idx from 0, kind, byte offsets, text and the literal's value. No shuffle.

    places: also line and column (bytes, from 1) of each token's start, counted while the text is at hand.
    """
    from rowloom.operators.keywords import builtin_spellings

    known = keywords if keywords is not None else builtin_spellings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Table(places)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                out.add(key, text.as_py() or "", known)
                if len(out.lists[0]) >= BATCH:
                    yield out.batch()
        yield out.batch()

    schema = f"{TOKENS}, line int, column int" if places else TOKENS
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def register(spark: SparkSession, keywords: dict[str, str] | None = None) -> None:
    """abl_tokens(text) as a table function for SQL, used with LATERAL."""
    from pyspark.sql.functions import udtf

    from rowloom.operators.keywords import builtin_spellings

    known = keywords if keywords is not None else builtin_spellings()

    class Tokens:
        def eval(self, text: str):
            for i, t in enumerate(tokenize(text or "", known)):
                yield i, t.kind, t.start, t.end, t.text

    spark.udtf.register("abl_tokens", udtf(Tokens, returnType="idx int, kind string, start int, end int, text string"))


def kind_counts(found: DataFrame) -> DataFrame:
    """kind, n: most frequent first."""
    return found.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")


def _kind(t: Column, known: Column) -> Column:
    """The kind of a token's text; known: its kind in the dictionary, if any."""
    c = F.substring(t, 1, 1)
    number = t.try_cast("decimal(38,0)")
    symbols = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    locks = F.when(F.startswith(F.lower(t), F.lit("no")), "NoLock").when(F.startswith(F.lower(t), F.lit("share")), "ShareLock").otherwise("ExclusiveLock")
    return (
        F.when(F.startswith(t, F.lit("//")), "Comment")
        .when(F.startswith(t, F.lit("/*")), F.when(F.endswith(t, F.lit("*/")) & (F.length(t) > 3), "Comment").otherwise("Invalid"))
        .when(c.isin('"', "'"), F.when(t.rlike("""^(?:"(?:[^"~]++|~[\\s\\S])*+"|'(?:[^'~]++|~[\\s\\S])*+')$"""), "StringLiteral").otherwise("Invalid"))
        .when(c.rlike("[0-9]"), F.when(F.contains(t, F.lit(".")), "DecimalLiteral").when((number >= 1 << 31) & (number <= (1 << 63) - 1), "BigIntLiteral").otherwise("IntegerLiteral"))
        .when(c.rlike("[A-Za-z_]"), F.when(t.rlike("[ \\t]"), locks).otherwise(F.coalesce(known, F.lit("Identifier"))))
        .when(F.startswith(t, F.lit("{&")), F.coalesce(known, F.lit("Preprop")))
        .when(c == "&", F.coalesce(known, F.lit("Invalid")))
        .otherwise(F.coalesce(F.try_element_at(symbols, t), F.lit("Invalid")))
    )


def kind_totals(df: DataFrame, text_col: str, keywords: dict[str, str] | None = None) -> DataFrame:
    """kind, n over all tokens of all texts, without token rows leaving the JVM.

    Texts are cut into tokens by one pattern, equal tokens are counted where they arise, and kinds are told for
    different tokens only; the dictionary is a broadcast join.
    """
    from rowloom.operators.keywords import builtin_spellings

    known = list((keywords if keywords is not None else builtin_spellings()).items())
    spelled = df.sparkSession.createDataFrame(known, "_word string, _kind string")
    texts = spread(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("x")))
    each = texts.select(F.explode(F.regexp_extract_all("x", F.lit(_JAVA), F.lit(0))).alias("t"))
    counts = each.where(~F.substring("t", 1, 1).isin(" ", "\t", "\n", "\r")).groupBy("t").agg(F.count("*").alias("n"))
    named = counts.join(F.broadcast(spelled), F.lower("t") == F.col("_word"), "left").select(_kind(F.col("t"), F.col("_kind")).alias("kind"), "n")
    ends = df.agg(F.count("*").alias("n")).select(F.lit("Eof").alias("kind"), "n").where("n > 0")
    return named.groupBy("kind").agg(F.sum("n").alias("n")).union(ends).orderBy(F.col("n").desc(), "kind")


def suspicious(found: DataFrame) -> DataFrame:
    """Numeric tokens without a value whose text isn't led by a digit."""
    numeric = F.col("kind").isin("IntegerLiteral", "BigIntLiteral", "DecimalLiteral")
    return found.where(numeric & F.col("int_value").isNull() & F.col("decimal_value").isNull() & ~F.col("text").rlike("^[0-9]"))


def line_starts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line from 1, line_start: the byte offset of every line; only a line feed ends one, an empty text has one."""
    from pyspark.sql import Window

    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("p", "x"))
    before = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("x") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("id", (F.col("p") + 1).alias("line"), start.alias("line_start"))


def lookup(df: DataFrame, text_col: str, offset_col: str) -> DataFrame:
    """df with line and column (bytes, from 1) of an offset in its own text: no join.

    The line is one more than the line feeds before the offset; the column counts from the last of them.
    """
    head = F.substring(F.encode(F.col(text_col), "UTF-8"), F.lit(1), F.col(offset_col).cast("int"))
    marks = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\n]", ""))
    tail = F.octet_length(F.encode(F.substring_index(F.decode(head, "ISO-8859-1"), "\n", -1), "ISO-8859-1"))
    return df.withColumn("line", marks + 1).withColumn("column", tail + 1)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """Each left row with the right row of its key with the greatest start at or before it: a sort-based as-of join.

    Both sides are one stream by key, ordered by position, starts before the rows at them; the last start is carried
    forward. No range join and no pairs beyond the result.
    """
    from pyspark.sql import Window

    rest = [c for c in right.columns if c not in (key, start)]
    r = right.select(F.col(key), F.col(start).alias("_at"), F.struct(start, *rest).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    lft = left.select(F.col(key), F.col(at).alias("_at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(key).orderBy("_at", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lft).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return both.select("_l.*", *[F.col("_r")[c].alias(c) for c in (start, *rest)])


def dump(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The token listing of texts: id, idx, kind, line, column, shown (40 characters at most, line ends escaped), flagged. No shuffle."""
    found = tokens(df, id_col, text_col, places=True)
    shown = F.when(F.octet_length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.replace("text", F.lit("\n"), F.lit("\\n")))
    odd = F.col("kind").isin("IntegerLiteral", "BigIntLiteral", "DecimalLiteral") & F.col("int_value").isNull() & F.col("decimal_value").isNull() & ~F.col("text").rlike("^[0-9]")
    return found.select("id", "idx", "kind", "line", "column", shown.alias("shown"), odd.alias("flagged"))
