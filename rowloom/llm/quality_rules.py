"""Quality rules as a bitmask ledger: every rule once, then versioned policies and ablations as bit operations.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import SPACES, cut, let, table, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule names by bit. The first two are the base rules; a rule keeps its bit for ever, new ones are appended.
RULES = ("too_few_words", "repeated_windows", "symbol_words", "repeated_lines", "word_length", "shouting")

#: Rules in force by policy version.
POLICIES = {
    1: ("too_few_words", "repeated_windows"),
    2: ("too_few_words", "repeated_windows", "symbol_words", "repeated_lines", "word_length", "shouting"),
}
CURRENT = 2


def mask(version: int) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[version])


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(w: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Windows are hashed and sorted with their positions, so equal ones become neighbours; the positions of those, sorted
    again, give the words they cover. A text without equal windows is not sorted.
    """
    n = F.size(w)
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                return F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))

            at = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, of_sorted))

    return let(hashes, of_hashes)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every whole text: one pass, no shuffle."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    by_word = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return picked.select(
        "doc_id",
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count(F.col("text"), UPPER).cast("long").alias("n_upper"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def failures() -> dict[str, Column]:
    """Each rule's failure condition over the measurements."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbol_words": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (c("word_chars") > 20 * c("n_words")) | (c("word_chars") < 2 * c("n_words")),
        "shouting": 2 * c("n_upper") > c("word_chars"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the measurements, failed_bits (bit k set: rule RULES[k] failed).

    Null text counts as empty (no words: fails too_few_words); a null doc_id stays null; repeated rows each get a row;
    an empty table gives no rows; other columns are ignored. A text of any length that a row can hold is measured whole.
    """
    fails = failures()
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed_bits", bits)


def decide(found: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy version; nothing is measured again."""
    return found.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(mask(1))) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(version) | mask(1))) == 0)


def ablations(found: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rows that only this rule rejects), kept_without it, kept.

    Rows are first counted by their masked bits (at most 2 to the number of rules groups, combined before the shuffle).
    """
    m = mask(version)
    by_bits = found.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    each = by_bits.select("bits", "n", rules).select("bits", "n", "r.*")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
        total(F.col("bits") == 0).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept"]
    return decide(ledger(table(spark, sf_dir, "documents"))).select(*columns)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's rules with what each rejects, alone or not, over all documents: the ledger is made once."""
    found = cut(ledger(table(spark, sf_dir, "documents")).select("failed_bits"))
    each = [ablations(found, v).select(F.lit(v).alias("version"), "rule", "n_failed", "n_only", "kept_without", "kept") for v in POLICIES]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
  + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::INT + 32 * (2 * n_upper > word_chars)::INT AS BIGINT) AS failed_bits FROM m)
"""

ORACLE_SQL = {
    "op9_quality_rules": _LEDGER_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM f",
    "quality_ablations": _LEDGER_SQL
    + ", p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({v}, '{r}', {1 << RULES.index(r)}, {mask(v)})" for v, rules in POLICIES.items() for r in rules)
    + ") t(version, rule, bit, mask)) SELECT version, rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits & mask = bit) AS n_only,"
    + " count(*) FILTER (WHERE failed_bits & mask & ~bit = 0) AS kept_without, count(*) FILTER (WHERE failed_bits & mask = 0) AS kept FROM f, p GROUP BY version, rule",
}
