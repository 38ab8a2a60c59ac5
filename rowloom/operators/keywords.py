"""Keyword dictionaries as DataFrames: titles to types, enrichment, alternate forms, overrides, spellings, collisions, categories.

A keyword row is name, reserved, min_abbreviation, keyword_type, doc_url and seq (its place in the source, for first-wins rules).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYWORD = "seq long, name string, reserved boolean, min_abbreviation string, keyword_type string, doc_url string"

#: Keywords that the grammar uses, name[:shortest spelling], by type. Larger dictionaries are read from files.
BUILTIN = {
    "Operator": "BEGINS EQ NE LT LE GT GE MATCHES CONTAINS MODULO:mod",
    "Statement": "ACCUMULATE:accumu ASSIGN CASE CREATE DELETE:del DISPLAY:disp DO END EXPORT FIND FOR IMPORT INSERT LEAVE MESSAGE NEXT PROCEDURE PUT RELEASE REPEAT RETURN RUN SET UPDATE EXCLUSIVE-LOCK PREV",
    "Function": "ACCUM ALIAS CAST CHR CONNECTED DATASERVERS DBCODEPAGE DBCOLLATION DBPARAM DBRESTRICTIONS:dbrest DBTASKID DBTYPE DBVERSION:dbvers ENCODE ETIME FILL FIRST GATEWAYS:gateway INPUT IS-ATTR-SPACE:is-attr "
    "IS-LEAD-BYTE KBLABEL KEYCODE KEYFUNCTION:keyfunc KEYLABEL KEYWORD LAST LASTKEY LAST-OF LDBNAME LINE-COUNTER:line-count LOOKUP MEMBER MESSAGE-LINES NOW NUM-ALIASES:num-ali NUM-DBS OPSYS PAGE-NUMBER:page-num PDBNAME "
    "PROC-HANDLE:proc-ha PROC-STATUS:proc-st PROGRAM-NAME PROGRESS PROVERSION:provers RETRY R-INDEX SDBNAME SEARCH SETUSERID:setuser TIME TO-ROWID TRIM USERID",
    "Attribute": "AMBIGUOUS:ambig AVAILABLE:avail ENTRY INDEX LABEL LOCKED NUM-ENTRIES PARAMETER:param QUERY RECID ROWID TABLE TRANSACTION",
    "Property": "ASCENDING:asc VALUE NULL",
    "Option": "NO-ERROR",
    "Widget": "TEXT",
    "Preprocessor": "&ELSE &ELSEIF &ENDIF &GLOBAL-DEFINE:&glob &IF &MESSAGE &SCOPED-DEFINE:&scop &THEN &UNDEFINE:&undef",
    "": "ALL AND ANY AS BETWEEN BREAK BY CAN-FIND DEFINE:def DESCENDING:desc DISTINCT EACH ELSE EXCEPT EXISTS FALSE FIRST-OF FROM GROUP HAVING IF IN INITIAL:init INPUT-OUTPUT:input-o INTO IS JOIN LIKE NO-LOCK NO-PREFETCH NO-UNDO "
    "NO-WAIT NOT OF OR OTHERWISE OUTPUT SELECT SHARE-LOCK SOME THEN TO TRUE UNION UNIQUE USE-INDEX VALUES WHEN WHERE WHILE WITH YES",
}

#: Title endings and their types; longer endings before the shorter ones that they hold.
TITLE_TYPES = (
    ("function", "Function"), ("statement", "Statement"), ("method", "Method"), ("property", "Property"), ("attribute", "Attribute"), ("event", "Event"), ("option", "Option"), ("phrase", "Phrase"),
    ("widget", "Widget"), ("type", "Type"), ("operator", "Operator"), ("system handle", "Handle"), ("handle", "Handle"), ("preprocessor directive", "Preprocessor"), ("preprocessor", "Preprocessor"),
)

#: Names of symbols that are keywords.
SYMBOL_NAMES = {
    "+": "Plus", "-": "Minus", "*": "Star", "/": "Slash", "%": "Percent", "=": "Equals", "<": "LessThan", ">": "GreaterThan", "<=": "LessThanOrEqual", ">=": "GreaterThanOrEqual", "<>": "NotEqual",
    "+=": "PlusEquals", "-=": "MinusEquals", "*=": "StarEquals", "/=": "SlashEquals", ":": "Colon", "::": "DoubleColon", ".": "Period", "?": "Question", "@": "At", "[": "LeftBracket", "]": "RightBracket",
    "{": "LeftBrace", "}": "RightBrace", "(": "LeftParen", ")": "RightParen", ",": "Comma", "^": "Caret", "~": "Tilde", "//": "LineComment", "/*": "BlockCommentStart", "*/": "BlockCommentEnd",
}

#: Names that get the prefix Kw.
PREFIXED = (
    "As Async Await Box Break Const Continue Crate Dyn Else Enum Extern False Fn For If Impl In Let Loop Match Mod Move Mut Pub Ref Return Self Static Struct Super Trait True Type Unsafe Use Where While Yield"
).split()

_TYPE_NAMES = sorted({t for _, t in TITLE_TYPES} | {"System"})


def variant_name(name: str) -> str:
    """A keyword's kind: its symbol's name, or its words run together with capitals."""
    if name in SYMBOL_NAMES:
        return SYMBOL_NAMES[name]
    parts = "".join(c if c.isalnum() else " Preproc " if c == "&" else " " for c in name).split()
    out = "".join("Preproc" if p == "Preproc" else p[0].upper() + p[1:].lower() for p in parts)
    if not out:
        return "Unknown"
    return f"Kw{out}" if out[0].isdigit() or out in PREFIXED else out


@cache
def builtin_spellings() -> dict[str, str]:
    """Kind by lower-case spelling of the built-in keywords, abbreviations included; the first keyword wins a spelling."""
    out: dict[str, str] = {}
    for names in BUILTIN.values():
        for item in names.split():
            name, _, short = item.partition(":")
            low, kind = name.lower(), variant_name(name)
            for n in range(len(short or low), len(low) + 1):
                out.setdefault(low[:n], kind)
    return out


def builtin(spark: SparkSession) -> DataFrame:
    """The built-in keywords as rows."""
    rows = [(item.partition(":")[0], item.partition(":")[2] or None, kind or None) for kind, names in BUILTIN.items() for item in names.split()]
    return spark.createDataFrame([(i, n, True, a, k, None) for i, (n, a, k) in enumerate(rows)], KEYWORD)


def titles(index: DataFrame) -> DataFrame:
    """name (upper case), keyword_type, doc_url from title and url: the first ending that fits decides; others drop out."""
    t = F.trim("title")
    kind = name = None
    for ending, kind_name in TITLE_TYPES:
        hit, rest = F.endswith(t, F.lit(f" {ending}")), F.upper(F.substring(t, F.lit(1), F.length(t) - len(ending) - 1))
        kind = F.when(hit, kind_name) if kind is None else kind.when(hit, kind_name)
        name = F.when(hit, rest) if name is None else name.when(hit, rest)
    return index.select(name.alias("name"), kind.alias("keyword_type"), F.col("url").alias("doc_url")).where("keyword_type is not null")


def type_name(word: Column) -> Column:
    """A type word in any case to a type; unknown words stay."""
    out = None
    for t in _TYPE_NAMES:
        out = F.when(F.lower(word) == t.lower(), t) if out is None else out.when(F.lower(word) == t.lower(), t)
    return out.otherwise(word)


def kind_of(name: Column) -> Column:
    """variant_name as a column."""
    marked = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " preproc "), "[^\\p{L}\\p{N}]+", " ")))
    joined = F.replace(marked, F.lit(" "), F.lit(""))
    worded = F.when(joined == "", "Unknown").when(joined.rlike("^[0-9]") | joined.isin(PREFIXED), F.concat(F.lit("Kw"), joined)).otherwise(joined)
    symbols = F.create_map(*[F.lit(x) for pair in SYMBOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(symbols, name), worded)


def is_symbol(name: Column) -> Column:
    return name.isin(list(SYMBOL_NAMES))


def is_preprocessor(name: Column) -> Column:
    return F.startswith(name, F.lit("&")) | F.startswith(name, F.lit("{&"))


def enrich(keywords: DataFrame, info: DataFrame) -> DataFrame:
    """Left join with typed titles by upper-case name; of several titles the last url in order wins."""
    best = info.groupBy(F.upper("name").alias("_name")).agg(F.max(F.struct("doc_url", "keyword_type")).alias("i"))
    joined = keywords.join(best, F.upper("name") == F.col("_name"), "left")
    return joined.select("seq", "name", "reserved", "min_abbreviation", F.coalesce("i.keyword_type", "keyword_type").alias("keyword_type"), F.coalesce("i.doc_url", "doc_url").alias("doc_url"))


def alternates(keywords: DataFrame, info: DataFrame) -> DataFrame:
    """name, alternate: the form with hyphens for blanks, or blanks for hyphens, where the titles have it (a semi join)."""
    up = F.upper("name")
    other = F.when(F.contains(up, F.lit(" ")), F.replace(up, F.lit(" "), F.lit("-"))).when(F.contains(up, F.lit("-")), F.replace(up, F.lit("-"), F.lit(" ")))
    forms = keywords.select(up.alias("name"), other.alias("alternate")).where("alternate is not null").distinct()
    return forms.join(info.select(F.upper("name").alias("alternate")), "alternate", "left_semi").select("name", "alternate")


def merge(keywords: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes (action remove, override or add, name, reserved, keyword_type, min_abbreviation, doc_url).

    Removals by anti join; overrides by left join, a null leaves a value and an empty abbreviation clears it; additions
    where the name wasn't there before any removal, the first of several.
    """
    up = F.upper("name").alias("_name")
    gone = changes.where("action = 'remove'").select(up)
    over = changes.where("action = 'override'").select(up, F.col("reserved").alias("o_reserved"), F.col("min_abbreviation").alias("o_abbreviation"), F.col("keyword_type").alias("o_type"), F.col("doc_url").alias("o_url"))
    left = keywords.withColumn("_name", F.upper("name"))
    kept = left.join(gone, "_name", "left_anti").join(over, "_name", "left")
    changed = kept.select("seq", "name", F.coalesce("o_reserved", "reserved").alias("reserved"), F.when(F.col("o_abbreviation") == "", F.lit(None)).otherwise(F.coalesce("o_abbreviation", "min_abbreviation")).alias("min_abbreviation"), F.coalesce(type_name(F.col("o_type")), F.col("keyword_type")).alias("keyword_type"), F.coalesce("o_url", "doc_url").alias("doc_url"))
    first = Window.partitionBy(F.upper("name")).orderBy("seq")
    adds = changes.where("action = 'add'").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").withColumn("_name", F.upper("name")).join(left.select("_name"), "_name", "left_anti")
    new = adds.select(F.lit(1 << 40).cast("long") + F.col("seq"), "name", F.coalesce("reserved", F.lit(False)), F.when(F.col("min_abbreviation") != "", F.col("min_abbreviation")), type_name(F.col("keyword_type")), "doc_url")
    return changed.union(new)


def spellings(keywords: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """spelling, kind, seq: each keyword's prefixes from its abbreviation's length to the whole, and those of its alternate form."""
    k = keywords.where(~is_symbol(F.col("name")))
    least = F.length(F.coalesce("min_abbreviation", "name"))
    base = k.select("seq", kind_of(F.col("name")).alias("kind"), F.lower("name").alias("form"), least.alias("least"))
    if other is not None:
        alt = k.join(other.select(F.col("name").alias("_name"), "alternate"), F.upper("name") == F.col("_name")).select("seq", kind_of(F.col("name")), F.lower("alternate"), least)
        base = base.union(alt)
    cuts = F.when(F.col("least") <= F.length("form"), F.sequence(F.col("least"), F.length("form")))
    return base.select("seq", "kind", "form", F.explode(cuts).alias("n")).select(F.expr("substring(form, 1, n)").alias("spelling"), "kind", "seq").distinct()


def first_wins(found: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row a key, the first in source order."""
    return found.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")


def collisions(found: DataFrame) -> DataFrame:
    """spelling, kinds: spellings that several kinds claim."""
    return found.groupBy("spelling").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).where("size(kinds) > 1")


def arms(found: DataFrame) -> DataFrame:
    """kind, spellings: each kind's spellings, shorter ones first, joined by " | "."""
    pairs = F.array_sort(F.collect_set(F.struct(F.length("spelling").alias("n"), "spelling")))
    return found.groupBy("kind").agg(F.array_join(F.transform(pairs, lambda p: p["spelling"]), " | ").alias("spellings"))


def categories(keywords: DataFrame) -> DataFrame:
    """category, kinds: kinds by category, the first keyword of a kind deciding."""
    k = first_wins(keywords.withColumn("kind", kind_of(F.col("name"))), "kind")
    known = F.col("keyword_type").isin([t for t in _TYPE_NAMES if t not in ("System", "Preprocessor")])
    category = F.when(is_symbol(F.col("name")), "Punctuation").when(is_preprocessor(F.col("name")), "Preprocessor").when(known, F.col("keyword_type")).otherwise("Other")
    return k.groupBy(category.alias("category")).agg(F.array_join(F.array_sort(F.collect_list("kind")), " | ").alias("kinds"), F.count("*").alias("n"))


def atoms(keywords: DataFrame) -> DataFrame:
    """atom: lower-case names and abbreviations, each once, quotes and backslashes escaped."""
    raw = keywords.select(F.lower("name").alias("atom")).union(keywords.where("min_abbreviation is not null").select(F.lower("min_abbreviation")))
    return raw.distinct().select(F.replace(F.replace("atom", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')).alias("atom"))


def callable_kinds(keywords: DataFrame) -> DataFrame:
    """kind of the function keywords, each once."""
    return keywords.where("keyword_type = 'Function'").where(~is_symbol(F.col("name"))).select(kind_of(F.col("name")).alias("kind")).distinct()


def summary(keywords: DataFrame) -> DataFrame:
    """total, reserved, abbreviated, typed, functions."""
    return keywords.agg(F.count("*").alias("total"), F.count_if(F.col("reserved")).alias("reserved"), F.count("min_abbreviation").alias("abbreviated"), F.count("keyword_type").alias("typed"), F.count_if(F.col("keyword_type") == "Function").alias("functions"))


#: Views of a dictionary by name.
VIEWS = {"atoms": atoms, "callable": callable_kinds, "summary": summary, "kind": categories, "match": lambda k: arms(first_wins(spellings(k), "spelling"))}


def view(name: str, keywords: DataFrame) -> dict[str, DataFrame]:
    """One view, or with "all" every one."""
    return {n: VIEWS[n](keywords) for n in (VIEWS if name == "all" else [name])}
