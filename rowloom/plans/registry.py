"""The registered queries, most of them program texts, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import aggregates
from rowloom.operators import keywords as K
from rowloom.operators import records as R
from rowloom.operators import text as T
from rowloom.plans import lowering
from rowloom.plans.catalog import Catalog, star
from rowloom.plans.token_sql import TOKENS
from rowloom.sources import files
from rowloom.streaming import events as E

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(name: str, program: str, sql: str, buffers: dict | None = None, post=None) -> None:
    """Register a program whose last loop or FIND gives rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = star(spark, sf_dir)
        for b, t in (buffers or {}).items():
            catalog.define_buffer(b, t)
        env = lowering.run(catalog, program)
        out = env.rows[-1] if env.rows else next(reversed(env.records.values()))
        return post(out) if post else out

    _QUERIES[name], _SQL[name] = query, sql


def values(name: str, program: str, names: dict[str, str], sql: str) -> None:
    """Register a program by the variables it leaves, cast to types, as one row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lowering.run(star(spark, sf_dir), program).value(*names)
        return out.select(*[_cast(n, t).alias(n) for n, t in names.items()])

    _QUERIES[name], _SQL[name] = query, sql


def _cast(n: str, t: str):
    return F.round(F.col(n).cast("double"), int(t[5:])) if t.startswith("round") else F.col(n).cast(t)


def projection(name: str, buffer: str, sql: str, where: str | None = None, types: dict | None = None, **columns: str) -> None:
    """Register expressions of the language over a table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lowering.project(star(spark, sf_dir), buffer, where, **columns)
        return out.select(*[_cast(c, types[c]).alias(c) if types and c in types else F.col(c) for c in out.columns])

    _QUERIES[name], _SQL[name] = query, sql


def frame(name: str, sql: str | None = None):
    """Register a Python function (spark, sf_dir) -> DataFrame."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


# -- scans and predicates
rows("foreach_scan", "FOR EACH nation NO-LOCK: END.", "SELECT * FROM nation")
rows("where_compare", "FOR EACH orders WHERE orders.o_totalprice > 1000 AND orders.o_totalprice LE 90000 AND orders.o_custkey GE 10 AND o_custkey < 900 AND o_orderkey NE 7 AND NOT (o_orderstatus = 'P') NO-LOCK: END.",
     "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 90000 AND o_custkey >= 10 AND o_custkey < 900 AND o_orderkey <> 7 AND NOT (o_orderstatus = 'P')")
rows("where_begins", 'FOR EACH part WHERE part.p_type BEGINS "S": DISPLAY p_partkey p_type. END.', "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
rows("where_matches", 'FOR EACH customer WHERE c_name MATCHES "*1.5": DISPLAY c_custkey c_name. END.', "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_5'")
rows("where_contains", 'FOR EACH documents WHERE documents.text CONTAINS "License": DISPLAY doc_id. END.', "SELECT doc_id FROM documents WHERE contains(text, 'License')")
rows("where_and_or_not", "FOR EACH customer WHERE c_acctbal < 0 OR c_nationkey = 3 AND NOT (c_mktsegment = 'BUILDING'): END.", "SELECT * FROM customer WHERE c_acctbal < 0 OR (c_nationkey = 3 AND NOT c_mktsegment = 'BUILDING')")
projection("not_precedence", "customer", "SELECT c_custkey, (NOT (c_acctbal > 0)) = (c_nationkey > 9) AS flag FROM customer", c_custkey="c_custkey", flag="NOT (c_acctbal > 0) = (c_nationkey > 9)")
projection("unknown_test", "orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS NULL AS is_f, NULLIF(o_orderstatus, 'F') IS NOT NULL AS not_f FROM orders",
           o_orderkey="o_orderkey", is_f="(IF o_orderstatus = 'F' THEN ? ELSE o_orderstatus) = ?", not_f="(IF o_orderstatus = 'F' THEN ? ELSE o_orderstatus) <> ?")
rows("where_between", "FOR EACH part WHERE p_size BETWEEN 5 AND 9: DISPLAY p_partkey p_size. END.", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
rows("where_like", "FOR EACH part WHERE p_brand LIKE '%2_': DISPLAY p_partkey p_brand. END.", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%2_'")
rows("where_in", "FOR EACH nation WHERE n_nationkey IN (1, 5, 9) OR n_name IS NULL: END.", "SELECT * FROM nation WHERE n_nationkey IN (1, 5, 9) OR n_name IS NULL")
rows("message", "VAR INT n. FOR EACH region: n = n + 1. END. MESSAGE 'regions' n VIEW-AS ALERT-BOX.", "SELECT 'regions' AS expr_1, count(*) AS n FROM region")
rows("bare_logical", "FOR EACH customer: IF NOT (c_acctbal > 0 AND c_nationkey < 12) THEN NEXT. DISPLAY c_custkey. END.", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey < 12")

# -- expressions
projection("arith_projection", "lineitem", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_quantity AS neg, l_quantity / 4 AS quarter FROM lineitem",
           types={"net": "round4"}, l_orderkey="l_orderkey", net="l_extendedprice * (1 - l_discount) + l_tax", neg="- l_quantity", quarter="l_quantity / 4")
projection("modulo", "orders", "SELECT o_orderkey, o_orderkey % 7 AS r, CAST((-o_orderkey) % 7 AS BIGINT) AS s FROM orders", types={"r": "long", "s": "long"}, o_orderkey="o_orderkey", r="o_orderkey MOD 7", s="(- o_orderkey) MODULO 7")
projection("ternary_nested", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band FROM customer",
           c_custkey="c_custkey", band="IF c_acctbal < 0 THEN 'owes' ELSE IF c_acctbal < 1000 THEN 'low' ELSE 'high'")
projection("string_concat", "customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS tag FROM customer", c_custkey="c_custkey", tag="c_name + '/' + c_mktsegment")
projection("string_functions", "part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, substr(p_name, 2, 4) AS s, CAST(length(p_name) AS INT) AS n, replace(p_name, 'a', 'o') AS r, repeat('ab', 3) AS f, CAST(p_size AS VARCHAR) AS st, '\"' || p_brand || '\"' AS q, chr(65) AS c, ascii(p_name) AS a FROM part",
           p_partkey="p_partkey", u="CAPS(p_name)", l="LC(p_brand)", t="TRIM('  ' + p_name + ' ')", lt="LEFT-TRIM('  x ')", rt="RIGHT-TRIM(' x  ')", s="SUBSTRING(p_name, 2, 4)", n="LENGTH(p_name)", r="REPLACE(p_name, 'a', 'o')", f="FILL('ab', 3)", st="STRING(p_size)", q="QUOTER(p_brand)", c="CHR(65)", a="ASC(p_name)")
projection("list_functions", "part", "SELECT p_partkey, split_part(p_name, ' ', 2) AS e, CAST(len(string_split(p_name, ' ')) AS INT) AS n, CAST(coalesce(list_position(string_split(p_name, ' '), 'ring'), 0) AS INT) AS k, CAST(strpos(p_name, 'r') AS INT) AS i, CAST(CASE WHEN strpos(reverse(p_name), 'r') = 0 THEN 0 ELSE length(p_name) - strpos(reverse(p_name), 'r') + 1 END AS INT) AS ri FROM part",
           p_partkey="p_partkey", e="ENTRY(2, p_name, ' ')", n="NUM-ENTRIES(p_name, ' ')", k="LOOKUP('ring', p_name, ' ')", i="INDEX(p_name, 'r')", ri="R-INDEX(p_name, 'r')")
projection("math_functions", "orders", "SELECT o_orderkey, abs(o_totalprice - 50000) AS a, round(sqrt(o_totalprice), 4) AS q, trunc(o_totalprice * 10) / 10 AS t, pow(2, o_orderkey % 5) AS e, round(log(2, o_totalprice), 6) AS g, least(o_totalprice, 1000) AS lo, greatest(o_totalprice, 1000) AS hi, CAST(trunc(o_totalprice) AS BIGINT) AS i FROM orders",
           types={"q": "round4", "g": "round6", "e": "double", "i": "long"}, o_orderkey="o_orderkey", a="ABS(o_totalprice - 50000)", q="SQRT(o_totalprice)", t="TRUNCATE(o_totalprice, 1)", e="EXP(2, o_orderkey MOD 5)", g="LOG(o_totalprice, 2)", lo="MINIMUM(o_totalprice, 1000)", hi="MAXIMUM(o_totalprice, 1000)", i="INT64(o_totalprice)")
projection("round_decimal", "part", "SELECT p_partkey, round(CAST(p_size AS DECIMAL(18,3)) / 8, 1) AS r FROM part", types={"r": "double"}, p_partkey="p_partkey", r="ROUND(p_size / 8.0, 1)")
projection("date_functions", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, make_date(2020, 2, 29) AS dt, o_orderdate + INTERVAL 3 MONTH AS later, CAST(date_diff('day', o_orderdate, o_orderdate + INTERVAL 40 DAY) AS BIGINT) AS days, make_timestamp(1999, 12, 31, 23, 59, 58.0) AS ts FROM orders",
           types={"days": "long"}, o_orderkey="o_orderkey", y="YEAR(o_orderdate)", m="MONTH(o_orderdate)", d="DAY(o_orderdate)", w="WEEKDAY(o_orderdate)", dt="DATE(2, 29, 2020)", later="ADD-INTERVAL(o_orderdate, 3, 'months')", days="INTERVAL(ADD-INTERVAL(o_orderdate, 40, 'days'), o_orderdate, 'days')", ts="DATETIME(12, 31, 1999, 23, 59, 58)")
projection("array_access", "embeddings", "SELECT vec_id, embedding[1] AS first, embedding[2] + embedding[3] AS s FROM embeddings", vec_id="vec_id", first="embedding[1]", s="embedding[2] + embeddings.embedding[3]")
rows("case_when_or", "FOR EACH orders: CASE o_orderstatus: WHEN 'F' OR WHEN 'O' THEN orders.o_orderpriority = 'known'. OTHERWISE DO: orders.o_orderpriority = 'other'. END. END CASE. DISPLAY o_orderkey o_orderpriority. END.",
     "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' ELSE 'other' END AS o_orderpriority FROM orders")
rows("field_assignment", "FOR EACH customer WHERE c_nationkey < 5 EXCLUSIVE-LOCK: IF c_acctbal < 0 THEN customer.c_acctbal = 0. customer.c_mktsegment = CAPS(SUBSTRING(c_mktsegment, 1, 3)). END.",
     "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, upper(substr(c_mktsegment, 1, 3)) AS c_mktsegment FROM customer WHERE c_nationkey < 5")
rows("multi_assign", "FOR EACH supplier: ASSIGN supplier.s_acctbal = s_acctbal * 2 supplier.s_name = 'S' + STRING(s_suppkey). END.", "SELECT s_suppkey, 'S' || s_suppkey AS s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier")

# -- conversions, the clock, members and methods
projection("conversions", "orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS i, o_totalprice AS d, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 2 = 0 AS b FROM orders",
           types={"d": "double"}, o_orderkey="o_orderkey", i="INTEGER(o_totalprice)", d="DECIMAL(o_totalprice)", s="STRING(o_orderkey)", b="LOGICAL(IF o_orderkey MOD 2 = 0 THEN 'yes' ELSE 'no')")
projection("clock_functions", "orders", "SELECT o_orderkey, true AS t, true AS n, true AS r, CAST((hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) * 1000 AS INT) AS ms, true AS e FROM orders",
           o_orderkey="o_orderkey", t="TODAY > DATE(1, 1, 2020)", n="NOW > DATETIME(1, 1, 2020, 0, 0, 0)", r="RANDOM(2, 4) BETWEEN 2 AND 4", ms="MTIME(o_orderdate)", e="ETIME >= 0")
projection("method_calls", "customer", "SELECT c_custkey, substr(c_name, 2, 5) AS s, CAST(length(c_mktsegment) AS INT) AS n FROM customer", c_custkey="c_custkey", s="c_name:SUBSTRING(2, 5)", n="c_mktsegment:LENGTH()")


@frame("member_access", "SELECT o_orderkey, o_custkey AS who, upper(o_orderpriority) AS p FROM orders WHERE o_totalprice > 50000")
def _member_access(spark, sf):
    packed = _table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderpriority").alias("level")).alias("more")).alias("info"))
    catalog = Catalog(spark, {"packed": packed}, {"packed": ("o_orderkey",)})
    return lowering.run(catalog, "FOR EACH packed WHERE info:price > 50000: DISPLAY o_orderkey info:cust LABEL 'who' CAPS(info:more:level) LABEL 'p'. END.").rows[0]


@frame("current_changed", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _current_changed(spark, sf):
    customer = _table(spark, sf, "customer")
    return R.current_changed(customer, R.update(customer, F.col("c_acctbal") < 0, c_mktsegment=F.lit("NONE")), ["c_custkey"])


# -- joins
rows("foreach_of", "FOR EACH nation: FOR EACH customer OF nation: END. END.", "SELECT n.*, c.* FROM nation n JOIN customer c ON c_nationkey = n_nationkey")
rows("nested_foreach_two", "FOR EACH region WHERE r_regionkey > 0: FOR EACH nation OF region: DISPLAY r_name n_name. END. END.", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey > 0")
rows("nested_foreach_three", "FOR EACH customer WHERE c_nationkey = 3: FOR EACH orders OF customer: FOR EACH lineitem OF orders WHERE l_quantity > 10: DISPLAY c_custkey o_orderkey l_partkey l_quantity. END. END. END.",
     "SELECT c_custkey, o_orderkey, l_partkey, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 3 AND l_quantity > 10")
rows("theta_nested", "FOR EACH nation: FOR EACH region WHERE region.r_regionkey < nation.n_regionkey: DISPLAY n_name r_name. END. END.", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey < n_regionkey")
rows("find_lookup_join", "FOR EACH customer: FIND FIRST orders WHERE orders.o_custkey = customer.c_custkey. DISPLAY c_custkey o_orderkey. END.", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
rows("find_last_join", "FOR EACH customer: FIND LAST orders OF customer. DISPLAY c_custkey o_orderkey o_totalprice. END.", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) = 1")
rows("find_no_error_left", "FOR EACH customer: FIND FIRST orders WHERE o_custkey = c_custkey NO-ERROR. DISPLAY (AVAILABLE orders) LABEL 'found' c_custkey o_orderkey. END.",
     "SELECT c_custkey, min(o_orderkey) AS o_orderkey, min(o_orderkey) IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
rows("can_find_semi", "FOR EACH customer WHERE CAN-FIND(FIRST orders WHERE o_custkey = c_custkey AND o_totalprice > 150000): DISPLAY c_custkey. END.", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
rows("can_find_anti", "FOR EACH customer WHERE NOT CAN-FIND(FIRST orders OF customer) AND c_acctbal > 0: DISPLAY c_custkey. END.", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
rows("for_first", "FOR EACH customer, FIRST orders OF customer: DISPLAY c_custkey o_orderkey. END.", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
rows("self_join_buffer", "FOR EACH nation, EACH neighbour WHERE neighbour.n_regionkey = nation.n_regionkey AND neighbour.n_nationkey > nation.n_nationkey: DISPLAY nation.n_name LABEL 'a' neighbour.n_name LABEL 'b'. END.",
     "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON y.n_regionkey = x.n_regionkey AND y.n_nationkey > x.n_nationkey", {"neighbour": "nation"})

# -- positional reads
rows("find_first", "FIND FIRST orders WHERE o_totalprice > 100000 NO-LOCK.", "SELECT * FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 1")
rows("find_last", "FIND LAST customer WHERE c_nationkey = 7.", "SELECT * FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey DESC LIMIT 1")
rows("find_next", "FIND FIRST orders WHERE o_orderstatus = 'O'. FIND NEXT orders WHERE o_orderstatus = 'O'.", "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1 OFFSET 1")
rows("find_prev", "FIND LAST orders WHERE o_orderstatus = 'F'. FIND PREV orders WHERE o_orderstatus = 'F'.", "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1")
rows("find_by_key", "FIND customer 42.", "SELECT * FROM customer WHERE c_custkey = 42")
rows("find_unique", "FIND nation WHERE n_nationkey = 7.", "SELECT * FROM nation WHERE n_nationkey = 7")
rows("find_no_error", "FIND nation WHERE n_nationkey = 700 NO-ERROR.", "SELECT * FROM nation WHERE n_nationkey = 700")
rows("find_then_children", "FIND FIRST customer WHERE c_nationkey = 3. FOR EACH orders OF customer: DISPLAY o_orderkey. END.", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3)")
rows("next_of_each", "FOR EACH nation: FIND NEXT after NO-ERROR. FIND PREV before NO-ERROR. DISPLAY nation.n_nationkey after.n_name LABEL 'next_name' before.n_name LABEL 'prev_name'. END.",
     "SELECT n_nationkey, lead(n_name) OVER (ORDER BY n_nationkey) AS next_name, lag(n_name) OVER (ORDER BY n_nationkey) AS prev_name FROM nation", {"after": "nation", "before": "nation"})

# -- accumulation
values("accum_sum", "DEFINE VARIABLE total AS DECIMAL NO-UNDO. FOR EACH orders WHERE orders.o_totalprice > 1000 NO-LOCK: total = total + orders.o_totalprice. END.", {"total": "round0"}, "SELECT round(sum(o_totalprice), 0) AS total FROM orders WHERE o_totalprice > 1000")
values("accum_count", "DEFINE VARIABLE n AS INTEGER. FOR EACH customer: n = n + 1. END.", {"n": "long"}, "SELECT count(*) AS n FROM customer")
values("accum_empty", "VAR INT n = 5. FOR EACH customer WHERE c_custkey < 0: n = n + 1. END.", {"n": "long"}, "SELECT CAST(5 AS BIGINT) AS n")
values("accum_conditional", "VAR INT good. VAR DECIMAL owed. FOR EACH customer: IF c_acctbal > 0 THEN good = good + 1. ELSE owed = owed - c_acctbal. END.", {"good": "long", "owed": "round1"},
       "SELECT count(*) FILTER (WHERE c_acctbal > 0) AS good, round(-sum(c_acctbal) FILTER (WHERE NOT c_acctbal > 0), 1) AS owed FROM customer")
values("accum_max", "VAR DECIMAL m. VAR DECIMAL lo = 1000000. FOR EACH part: IF p_retailprice > m THEN m = p_retailprice. lo = MINIMUM(lo, p_retailprice). END.", {"m": "double", "lo": "double"}, "SELECT max(p_retailprice) AS m, min(p_retailprice) AS lo FROM part")
values("last_assignment", "VAR CHARACTER who. FOR EACH customer WHERE c_acctbal > 0: who = customer.c_name. END.", {"who": "string"}, "SELECT arg_max(c_name, c_custkey) AS who FROM customer WHERE c_acctbal > 0")
values("accum_nested", "VAR DECIMAL total. FOR EACH customer WHERE c_nationkey = 5: FOR EACH orders OF customer: total = total + o_totalprice. END. END.", {"total": "round0"}, "SELECT round(sum(o_totalprice), 0) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 5")
values("accum_then_average", "VAR DECIMAL total. VAR INT n. VAR DECIMAL mean. FOR EACH orders: ASSIGN total = total + o_totalprice n = n + 1. END. mean = total / n.", {"mean": "round2"}, "SELECT round(avg(o_totalprice), 2) AS mean FROM orders")
values("compound_assignment", "VAR DECIMAL a. VAR INT b = 100. FOR EACH lineitem: a += l_quantity. b -= 1. END.", {"a": "double", "b": "long"}, "SELECT sum(l_quantity) AS a, 100 - count(*) AS b FROM lineitem")
rows("filter_by_total", "VAR DECIMAL top. FOR EACH orders: top = MAXIMUM(top, o_totalprice). END. FOR EACH orders WHERE o_totalprice > top * 0.9: DISPLAY o_orderkey. END.", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) * 0.9")
rows("accumulate_total", "FOR EACH customer: ACCUMULATE c_acctbal (TOTAL COUNT AVERAGE MINIMUM MAXIMUM). END.", "SELECT round(sum(c_acctbal), 1) AS c_acctbal_total, count(c_acctbal) AS c_acctbal_count, round(avg(c_acctbal), 4) AS c_acctbal_average, min(c_acctbal) AS c_acctbal_minimum, max(c_acctbal) AS c_acctbal_maximum FROM customer",
     post=lambda d: d.withColumn("c_acctbal_total", F.round("c_acctbal_total", 1)).withColumn("c_acctbal_average", F.round("c_acctbal_average", 4)))
values("accum_after", "VAR DECIMAL mean. FOR EACH customer: ACCUMULATE c_acctbal (TOTAL COUNT). END. mean = (ACCUM TOTAL c_acctbal) / (ACCUM COUNT c_acctbal).", {"mean": "round4"}, "SELECT round(avg(c_acctbal), 4) AS mean FROM customer")
rows("accumulate_rollup", "FOR EACH lineitem BREAK BY l_returnflag BY l_linestatus: ACCUMULATE l_quantity (SUB-TOTAL SUB-COUNT). END.", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sub_total, count(l_quantity) AS l_quantity_sub_count FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")

# -- control flow
values("leave_prefix", "VAR INT n. FOR EACH orders: IF o_totalprice > 190000 THEN LEAVE. n = n + 1. END.", {"n": "long"}, "SELECT count(*) AS n FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 190000), 1e18)")
values("leave_after", "VAR INT n. VAR INT k. FOR EACH orders: n = n + 1. IF o_totalprice > 190000 THEN LEAVE. k = k + 1. END.", {"n": "long", "k": "long"},
       "SELECT count(*) FILTER (WHERE c IS NULL OR o_orderkey <= c) AS n, count(*) FILTER (WHERE c IS NULL OR o_orderkey < c) AS k FROM orders, (SELECT min(o_orderkey) AS c FROM orders WHERE o_totalprice > 190000)")
values("next_skip", "VAR INT n. FOR EACH customer: IF c_mktsegment = 'BUILDING' THEN NEXT. n = n + 1. END.", {"n": "long"}, "SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'")
rows("return_in_loop", "FOR EACH part BY p_retailprice DESCENDING: IF p_size = 1 THEN RETURN. DISPLAY p_partkey. END.",
     "WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey FROM r WHERE k < coalesce((SELECT min(k) FROM r WHERE p_size = 1), 1e18)")
values("do_counting", "VAR INT total. DO i = 1 TO 100: total = total + i * i. END.", {"total": "long"}, "SELECT CAST(sum(i * i) AS BIGINT) AS total FROM range(1, 101) t(i)")
values("do_by_step", "VAR INT total. DO i = 100 TO 1 BY -3: IF i MOD 2 = 0 THEN total = total + i. END.", {"total": "long"}, "SELECT CAST(sum(i) AS BIGINT) AS total FROM (SELECT 100 - 3 * k AS i FROM range(0, 34) t(k)) WHERE i % 2 = 0")
values("repeat_while", "VAR INT a = 27. VAR INT n. REPEAT WHILE a <> 1: IF a MOD 2 = 0 THEN a = a / 2. ELSE a = 3 * a + 1. n = n + 1. END.", {"n": "long"},
       "WITH RECURSIVE t(a, n) AS (SELECT 27, 0 UNION ALL SELECT CASE WHEN a % 2 = 0 THEN a // 2 ELSE 3 * a + 1 END, n + 1 FROM t WHERE a <> 1) SELECT CAST(max(n) AS BIGINT) AS n FROM t")
values("do_while_leave", "VAR INT x = 1. VAR INT n. DO WHILE TRUE: n = n + 1. x = x * 3. IF x > 5000 THEN LEAVE. END.", {"x": "long", "n": "long"}, "SELECT CAST(6561 AS BIGINT) AS x, CAST(8 AS BIGINT) AS n")
values("procedure_params", "DEFINE VARIABLE s AS DECIMAL. PROCEDURE spent: DEFINE INPUT PARAMETER who AS INTEGER. DEFINE OUTPUT PARAMETER total AS DECIMAL. FOR EACH orders WHERE o_custkey = who: total = total + o_totalprice. END. END PROCEDURE. RUN spent (INPUT 7, OUTPUT s).",
       {"s": "round1"}, "SELECT round(sum(o_totalprice), 1) AS s FROM orders WHERE o_custkey = 7")
values("run_dynamic", "VAR CHARACTER which = 'cou'. VAR INT n. PROCEDURE count: DEFINE OUTPUT PARAMETER k AS INTEGER. FOR EACH supplier: k = k + 1. END. END PROCEDURE. RUN VALUE(which + 'nt') (OUTPUT n).", {"n": "long"}, "SELECT count(*) AS n FROM supplier")
values("array_variable", "DEFINE VARIABLE a AS INTEGER EXTENT 3 INITIAL [4, 5, 6]. VAR INT s. a[2] = 50. s = a[1] + a[2] + a[3].", {"s": "long"}, "SELECT CAST(60 AS BIGINT) AS s")

# -- order, groups, sets
rows("break_by_first_last", "FOR EACH orders BREAK BY o_custkey: IF NOT (FIRST-OF(o_custkey) OR LAST-OF(o_custkey)) THEN NEXT. DISPLAY o_custkey o_orderkey. END.",
     "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")

# -- queries in SQL form: groups, sets, subqueries, joins of all kinds, windows
rows("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer.", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
rows("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier.", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
rows("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders.", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
rows("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal LT 0 INTERSECT SELECT s_nationkey FROM supplier.", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
rows("group_having", "VAR INT least = 12. SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 0) AS total FROM orders NO-LOCK GROUP BY o_custkey HAVING COUNT(*) GT least.",
     "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1 HAVING count(*) > 12")
rows("select_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_totalprice > 180000) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2).",
     "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2)")
rows("select_in_like", 'SELECT p_partkey FROM part WHERE p_size IN (SELECT s_nationkey FROM supplier) AND p_brand LIKE "%2_" AND p_retailprice BETWEEN 100 AND 1500 AND p_name IS NOT NULL.', "SELECT p_partkey FROM part WHERE p_size IN (SELECT s_nationkey FROM supplier) AND p_brand LIKE '%2_' AND p_retailprice BETWEEN 100 AND 1500 AND p_name IS NOT NULL")
rows("select_outer_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000.", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
rows("select_full_join", "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s FULL OUTER JOIN nation AS n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000.", "SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
rows("select_cross_join", "SELECT region.r_name, nation.n_name FROM region CROSS JOIN nation.", "SELECT r_name, n_name FROM region CROSS JOIN nation")
rows("select_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS.", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
rows("select_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS custs FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority).", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
rows("select_grouping_sets", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ()).", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
rows("select_rank", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders.",
     "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INT) AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS s FROM orders",
     post=lambda d: d.withColumn("s", F.round("s", 4)))
rows("select_any_all", "SELECT n_name FROM nation WHERE n_nationkey >= (SELECT MAX(s_nationkey) FROM supplier) OR n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2).", "SELECT n_name FROM nation WHERE n_nationkey >= (SELECT max(s_nationkey) FROM supplier) OR n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
values("select_into", "VAR INT n. VAR DECIMAL top. SELECT COUNT(*), MAX(o_totalprice) INTO n, top FROM orders WHERE o_orderstatus = 'F'.", {"n": "long", "top": "double"}, "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F'")


@frame("user_aggregate", "SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def _user_aggregate(spark, sf):
    """An aggregate written in Python, over groups of a few orders each."""
    aggregates.register(spark, "value_spread", lambda v: float(v.max() - v.min()), "double")
    return lowering.run(star(spark, sf), "SELECT o_custkey, ROUND(value_spread(o_totalprice), 2) AS spread FROM orders GROUP BY o_custkey.").rows[0]


# -- temp-tables, buffers, datasets, records made, changed and deleted, functions
_RICH = "DEFINE TEMP-TABLE rich NO-UNDO FIELD k AS INT64 FIELD nm AS CHARACTER FIELD bal AS DECIMAL INDEX pk IS PRIMARY UNIQUE k. FOR EACH customer WHERE c_acctbal > 5000: CREATE rich. ASSIGN rich.k = c_custkey rich.nm = CAPS(c_mktsegment). rich.bal = c_acctbal * 2. END."
rows("temp_table", _RICH + " FOR EACH rich WHERE rich.k > 3, EACH orders WHERE orders.o_custkey = rich.k: DISPLAY k nm o_orderkey. END.", "SELECT c_custkey AS k, upper(c_mktsegment) AS nm, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND c_custkey > 3")
rows("create_records", _RICH + " CREATE rich. rich.k = -1. rich.nm = 'one' + 'more'. RELEASE rich. DO i = 1 TO 3: CREATE rich. rich.k = - 10 * i. END. SELECT k, nm FROM rich.",
     "SELECT c_custkey AS k, upper(c_mktsegment) AS nm FROM customer WHERE c_acctbal > 5000 UNION ALL VALUES (-1, 'onemore'), (-10, NULL), (-20, NULL), (-30, NULL)")
rows("delete_records", _RICH + " FOR EACH rich, FIRST orders WHERE o_custkey = k: IF o_totalprice > 100000 THEN DELETE rich. END. FIND FIRST rich. DELETE rich. SELECT k FROM rich.",
     "WITH d AS (SELECT c_custkey AS k, arg_min(o_totalprice, o_orderkey) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1), r AS (SELECT k FROM d WHERE p IS NULL OR p <= 100000) SELECT k FROM r WHERE k > (SELECT min(k) FROM r)")
rows("update_records", _RICH + " FOR EACH rich WHERE bal > 15000: rich.nm = 'top'. IF k MOD 2 = 0 THEN rich.bal = 0. END. SELECT k, nm, CAST(bal AS DOUBLE) AS bal FROM rich.",
     "SELECT c_custkey AS k, CASE WHEN c_acctbal * 2 > 15000 THEN 'top' ELSE upper(c_mktsegment) END AS nm, CASE WHEN c_acctbal * 2 > 15000 AND c_custkey % 2 = 0 THEN 0.0 ELSE CAST(CAST(c_acctbal * 2 AS DECIMAL(18, 4)) AS DOUBLE) END AS bal FROM customer WHERE c_acctbal > 5000")
rows("undo_changes", _RICH + " DO TRANSACTION: FOR EACH rich: DELETE rich. END. UNDO, LEAVE. END. SELECT COUNT(*) AS n FROM rich.", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
rows("catch_errors", "VAR INT n = 1. DO ON ERROR UNDO, LEAVE: n = 2. FOR EACH customer: n = nosuchname. END. CATCH e AS Progress.Lang.Error: n = n + 10. END CATCH. FINALLY: n = n + 100. END FINALLY. END. DISPLAY n.", "SELECT 111 AS n")
rows("dataset_relation", "DEFINE BUFFER big FOR orders. DEFINE DATASET ds FOR part, supplier DATA-RELATION r FOR part, supplier RELATION-FIELDS (p_size, s_nationkey). FOR EACH part WHERE p_size < 12, EACH supplier OF part: DISPLAY p_partkey s_suppkey. END.",
     "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_nationkey = p_size WHERE p_size < 12")
rows("function_returns", "FUNCTION band RETURNS CHARACTER (INPUT x AS DECIMAL, INPUT lim AS DECIMAL): VAR DECIMAL y = 0. y = x - lim. IF y < 0 THEN RETURN 'under'. CASE lim: WHEN 1000 THEN RETURN 'over'. END CASE. RETURN 'far'. END FUNCTION. FOR EACH customer: DISPLAY c_custkey band(c_acctbal, 1000) LABEL 'b'. END.",
     "SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'under' ELSE 'over' END AS b FROM customer")
rows("display_except", "FOR EACH customer WHERE c_acctbal < 0: DISPLAY customer EXCEPT c_name c_mktsegment. END.", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0")
rows("display_format", "FOR EACH orders: DISPLAY o_orderkey o_orderdate FORMAT '99/99/9999' LABEL 'd' o_orderpriority FORMAT 'x(3)' LABEL 'p' o_orderkey FORMAT '999999' LABEL 'z' (o_totalprice > 50000) FORMAT 'yes/no' LABEL 'y'. END.",
     "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS d, left(o_orderpriority, 3) AS p, printf('%06d', o_orderkey) AS z, CASE WHEN o_totalprice > 50000 THEN 'yes' ELSE 'no' END AS y FROM orders")
rows("skip_rows", "FOR EACH nation BY n_name SKIP 20: DISPLAY n_name. END.", "SELECT n_name FROM nation ORDER BY n_name OFFSET 20")
rows("ambiguous_find", "FOR EACH nation: FIND supplier WHERE supplier.s_nationkey = nation.n_nationkey NO-ERROR. DISPLAY (AMBIGUOUS supplier) LABEL 'many' n_nationkey s_suppkey. END.",
     "SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN any_value(s_suppkey) END AS s_suppkey, count(s_suppkey) > 1 AS many FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")

# -- descending orders of any type
rows("leave_descending_text", "FOR EACH customer BY c_name DESCENDING: IF c_acctbal < 0 THEN LEAVE. DISPLAY c_custkey. END.",
     "WITH r AS (SELECT *, row_number() OVER (ORDER BY c_name DESC, c_custkey) AS k FROM customer) SELECT c_custkey FROM r WHERE k < coalesce((SELECT min(k) FROM r WHERE c_acctbal < 0), 1e18)")
values("last_by_date_descending", "VAR INT n. VAR CHARACTER who. FOR EACH orders BY o_orderdate DESCENDING: n = o_orderkey. END. FOR EACH nation BY n_name DESCENDING: who = n_name. END.", {"n": "long", "who": "string"},
       "SELECT (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 1) AS n, (SELECT min(n_name) FROM nation) AS who")
rows("running_total_by_text", "VAR DECIMAL seen. FOR EACH supplier BY s_name DESCENDING: seen = seen + s_nationkey. supplier.s_acctbal = seen. DISPLAY s_suppkey s_acctbal. END.", "SELECT s_suppkey, CAST(sum(s_nationkey) OVER (ORDER BY s_name DESC, s_suppkey) AS DOUBLE) AS s_acctbal FROM supplier", post=lambda d: d.withColumn("s_acctbal", F.col("s_acctbal").cast("double")))
rows("next_of_all", "FOR EACH orders: FIND NEXT after NO-ERROR. FIND PREV before NO-ERROR. DISPLAY orders.o_orderkey after.o_custkey LABEL 'n' before.o_custkey LABEL 'p'. END.",
     "SELECT o_orderkey, lead(o_custkey) OVER (ORDER BY o_orderkey) AS n, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders", {"after": "orders", "before": "orders"})
rows("break_by_text_descending", "FOR EACH customer BREAK BY c_mktsegment BY c_name DESCENDING: IF FIRST-OF(c_mktsegment) THEN DISPLAY c_mktsegment c_custkey. END.", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC, c_custkey) = 1")


@frame("neighbours", "SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER w AS next_o_orderkey, lag(o_orderkey) OVER w AS prev_o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _neighbours(spark, sf):
    return R.neighbours(_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], ["o_orderkey"], ["o_custkey"])


@frame("first_match", "SELECT c_custkey, o_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def _first_match(spark, sf):
    return R.first_match(_table(spark, sf, "customer").select("c_custkey"), _table(spark, sf, "orders").select("o_custkey", "o_orderkey"), [("c_custkey", "o_custkey")], ["o_orderkey"], keep_all=True)


@frame("break_totals", "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 0) AS total, count(o_totalprice) AS count, round(avg(o_totalprice), 2) AS average, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def _break_totals(spark, sf):
    return R.break_totals(_table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice").withColumn("total", F.round("total", 0)).withColumn("average", F.round("average", 2))


@frame("record_merge", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT BETWEEN 20 AND 22 UNION ALL SELECT n_nationkey + 100, 'new ' || n_name, n_regionkey FROM nation WHERE n_nationkey >= 23")
def _record_merge(spark, sf):
    nation = _table(spark, sf, "nation")
    low = nation.where("n_nationkey < 5").select("n_nationkey", F.concat(F.lit("new "), "n_name").alias("n_name"), "n_regionkey", F.lit(False).alias("gone"))
    mid = nation.where("n_nationkey between 20 and 22").select("n_nationkey", "n_name", "n_regionkey", F.lit(True))
    high = nation.where("n_nationkey >= 23").select(F.col("n_nationkey") + 100, F.concat(F.lit("new "), "n_name"), "n_regionkey", F.lit(False))
    return R.merge(nation, low.union(mid).union(high), ["n_nationkey"], F.col("gone"))


@frame("append_if_absent", "SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey >= 10")
def _append_if_absent(spark, sf):
    nation = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return R.append_if_absent(nation.where("k < 10"), nation.select("k", F.lower("n_name").alias("n_name")), ["k"])


@frame("record_changes", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 9, 'made'")
def _record_changes(spark, sf):
    region = R.create(_table(spark, sf, "region"), r_regionkey=9, r_name="made")
    return R.update(R.delete(region, F.col("r_regionkey") == 3), F.col("r_regionkey") == 1, r_name=F.lit("changed"))


# -- joins, orders and running values of whole tables
rows("running_total", "VAR INT seen. FOR EACH customer: seen = seen + c_nationkey. customer.c_nationkey = seen. DISPLAY c_custkey c_nationkey. END.", "SELECT c_custkey, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) AS BIGINT) AS c_nationkey FROM customer")
rows("leave_inner", "FOR EACH customer: FOR EACH orders OF customer: IF o_orderstatus = 'F' THEN LEAVE. DISPLAY c_custkey o_orderkey. END. END.",
     "SELECT c_custkey, o_orderkey FROM customer JOIN orders o ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = c_custkey WHERE f IS NULL OR o_orderkey < f")
rows("foreach_of_where", "FOR EACH customer, EACH orders OF customer WHERE o_totalprice > 100000: DISPLAY c_custkey o_orderkey o_totalprice. END.", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000")
rows("find_unique_join", "FOR EACH orders: FIND customer o_custkey. DISPLAY o_orderkey c_name. END.", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
rows("order_by", "FOR EACH customer BY c_mktsegment BY c_acctbal DESCENDING: DISPLAY c_custkey c_mktsegment. END.", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC")


# -- texts
@frame("token_kind_counts", f"{TOKENS} SELECT kind, count(*) AS n FROM tok GROUP BY 1")
def _token_kind_counts(spark, sf):
    return T.kind_totals(_table(spark, sf, "documents"), "text")


@frame("token_spans", f'{TOKENS} SELECT id, idx, kind, start_ AS start, end_ AS "end" FROM tok')
def _token_spans(spark, sf):
    return T.tokens(_table(spark, sf, "documents"), "doc_id", "text").select("id", "idx", "kind", "start", "end")


@frame("token_rows", f"""{TOKENS} SELECT id, idx, kind, start_ AS start, end_ AS "end", coalesce(t, '') AS text, CASE WHEN kind IN ('IntegerLiteral', 'BigIntLiteral') THEN TRY_CAST(t AS BIGINT) END AS int_value,
  CASE WHEN kind = 'DecimalLiteral' THEN t END AS decimal_value, CASE WHEN kind = 'StringLiteral' THEN substr(t, 2, length(t) - 2) END AS string_value, CASE kind WHEN 'KwTrue' THEN true WHEN 'KwFalse' THEN false END AS bool_value FROM tok""")
def _token_rows(spark, sf):
    return T.tokens(_table(spark, sf, "documents"), "doc_id", "text")


@frame("suspicious_tokens", "SELECT p_partkey AS id, p_size AS idx FROM part WHERE p_size % 4 < 3 AND p_size % 3 = 0 AND p_size % 5 <> 0 AND NOT regexp_matches(p_name, '^[0-9]')")
def _suspicious_tokens(spark, sf):
    """A token table made of parts, with numeric kinds that lack a value: the lexer itself leaves none."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "IntegerLiteral").when(size % 4 == 1, "BigIntLiteral").when(size % 4 == 2, "DecimalLiteral").otherwise("Identifier")
    found = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), size.alias("idx"), kind.alias("kind"), F.when(size % 3 != 0, size.cast("long")).alias("int_value"), F.when(size % 5 == 0, "1.5").alias("decimal_value"), F.col("p_name").alias("text"))
    return T.suspicious(found).select("id", "idx")


@frame("token_table_function", "SELECT n_nationkey, CAST(1 + (length(n_name) - length(replace(n_name, ' ', ''))) AS BIGINT) AS n FROM nation")
def _token_table_function(spark, sf):
    T.register(spark)
    _table(spark, sf, "nation").createOrReplaceTempView("rowloom_nation")
    return spark.sql("SELECT n_nationkey, count_if(kind <> 'Eof') AS n FROM rowloom_nation, LATERAL abl_tokens(n_name) GROUP BY n_nationkey")


@frame("token_dump", f"""{TOKENS} SELECT id, idx, kind, line, col AS "column", CASE WHEN strlen(t) > 40 THEN substr(t, 1, 40) || '...' ELSE replace(coalesce(t, ''), chr(10), '\\n') END AS shown,
  kind IN ('IntegerLiteral', 'BigIntLiteral') AND NOT regexp_matches(t, '^[0-9]') AS flagged FROM tok""")
def _token_dump(spark, sf):
    return T.dump(_table(spark, sf, "documents"), "doc_id", "text")


_LINES = """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT id, CAST(line AS INT) AS line, CAST(coalesce(sum(strlen(x) + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM l"""


@frame("line_index", _LINES)
def _line_index(spark, sf):
    return T.line_starts(_table(spark, sf, "documents"), "doc_id", "text")


@frame("offset_to_line", f"""WITH s AS ({_LINES}), o AS (SELECT doc_id AS id, CAST(strlen(text) // 2 AS BIGINT) AS at FROM documents)
SELECT o.id, o.at, s.line, s.line_start, CAST(o.at - s.line_start + 1 AS BIGINT) AS "column" FROM o ASOF JOIN s ON o.id = s.id AND o.at >= s.line_start""")
def _offset_to_line(spark, sf):
    docs = _table(spark, sf, "documents")
    offsets = docs.select(F.col("doc_id").alias("id"), F.floor(F.octet_length("text") / 2).cast("long").alias("at"))
    found = T.as_of(offsets, T.line_starts(docs, "doc_id", "text"), "id", "at", "line_start")
    return found.withColumn("column", F.col("at") - F.col("line_start") + 1)


@frame("offset_lookup", f"""WITH s AS ({_LINES}), o AS (SELECT doc_id AS id, CAST(strlen(text) // 3 AS BIGINT) AS at FROM documents)
SELECT o.id, CAST(s.line AS INT) AS line, CAST(o.at - s.line_start + 1 AS INT) AS "column" FROM o ASOF JOIN s ON o.id = s.id AND o.at >= s.line_start""")
def _offset_lookup(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.floor(F.octet_length("text") / 3).cast("long").alias("at"))
    return T.lookup(docs, "text", "at").select("id", "line", "column")


@frame("dictionary_lookup", f"""{TOKENS}, w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z_-]+'))) AS spelling FROM documents)
SELECT spelling, coalesce(any_value(known), 'Identifier') AS kind, count(*) AS n FROM w LEFT JOIN known ON spelling = word GROUP BY 1""")
def _dictionary_lookup(spark, sf):
    """Every word of the documents, counted, with its kind in the built-in dictionary."""
    spelled = K.first_wins(K.spellings(K.builtin(spark)), "spelling").select("spelling", "kind")
    words = _table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_-]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("spelling")).agg(F.count("*").alias("n"))
    return words.join(F.broadcast(spelled), "spelling", "left").select("spelling", F.coalesce("kind", F.lit("Identifier")).alias("kind"), "n")


# -- keyword dictionaries, from the names of the part table
def _names(spark, sf):
    """Keyword rows made of part names: two-word names with an abbreviation of four letters."""
    part = _table(spark, sf, "part")
    parts = F.split("p_name", " ")
    return part.groupBy(F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("name")).agg(F.min("p_partkey").alias("seq")).select("seq", "name", F.lit(True).alias("reserved"), F.when(F.col("seq") % 2 == 0, F.substring("name", 1, 4)).alias("min_abbreviation"), F.lit(None).cast("string").alias("keyword_type"), F.lit(None).cast("string").alias("doc_url"))


_NAMES = "k AS (SELECT concat_ws('-', nullif(split_part(p_name, ' ', 1), ''), nullif(split_part(p_name, ' ', 2), '')) AS name, min(p_partkey) AS seq FROM part GROUP BY 1)"
_SPELLED = f"""WITH {_NAMES}, b AS (SELECT seq, name, lower(name) AS form, CASE WHEN seq % 2 = 0 THEN least(4, length(name)) ELSE length(name) END AS least FROM k),
s AS (SELECT seq, name, substr(form, 1, n) AS spelling FROM (SELECT *, unnest(range(least, length(form) + 1)) AS n FROM b))"""
_KIND = "array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(name, '-')], '')"


@frame("prefix_expansion", f"{_SPELLED} SELECT DISTINCT spelling, {_KIND} AS kind, seq FROM s")
def _prefix_expansion(spark, sf):
    return K.spellings(_names(spark, sf))


@frame("collision_report", f"{_SPELLED} SELECT spelling, array_to_string(list_sort(list(DISTINCT {_KIND})), ',') AS kinds FROM s GROUP BY 1 HAVING count(DISTINCT {_KIND}) > 1")
def _collision_report(spark, sf):
    return K.collisions(K.spellings(_names(spark, sf))).withColumn("kinds", F.array_join("kinds", ","))


@frame("first_wins_dedup", f"{_SPELLED} SELECT spelling, {_KIND} AS kind, seq FROM s QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY seq) = 1")
def _first_wins_dedup(spark, sf):
    return K.first_wins(K.spellings(_names(spark, sf)), "spelling")


@frame("spelling_arms", f"{_SPELLED}, w AS (SELECT spelling, {_KIND} AS kind FROM s QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY seq) = 1) SELECT kind, string_agg(spelling, ' | ' ORDER BY length(spelling), spelling) AS spellings FROM w GROUP BY 1")
def _spelling_arms(spark, sf):
    return K.view("match", _names(spark, sf))["match"]


@frame("keyword_enrich", f"WITH {_NAMES} SELECT seq, name, CASE WHEN seq % 3 = 0 THEN 'Function' END AS keyword_type, CASE WHEN seq % 3 = 0 THEN 'u' || seq END AS doc_url FROM k")
def _keyword_enrich(spark, sf):
    names = _names(spark, sf)
    index = names.where("seq % 3 = 0").select(F.concat(F.lower("name"), F.lit(" function ")).alias("title"), F.concat(F.lit("u"), "seq").alias("url"))
    return K.enrich(names, K.titles(index.union(names.select(F.concat("name", F.lit(" nothing")), F.lit("x"))))).select("seq", "name", "keyword_type", "doc_url")


@frame("alternate_forms", f"WITH {_NAMES} SELECT upper(name) AS name, replace(upper(name), '-', ' ') AS alternate FROM k WHERE seq % 2 = 1 AND contains(name, '-')")
def _alternate_forms(spark, sf):
    names = _names(spark, sf)
    return K.alternates(names, names.where("seq % 2 = 1").select(F.replace("name", F.lit("-"), F.lit(" ")).alias("name")))


@frame("keyword_merge", f"""WITH {_NAMES} SELECT name, seq % 5 <> 1 AS reserved, CASE WHEN seq % 2 = 0 AND seq % 5 <> 1 THEN substr(name, 1, 4) END AS min_abbreviation, CASE WHEN seq % 5 = 1 THEN 'Handle' END AS keyword_type FROM k WHERE seq % 5 <> 0
UNION ALL SELECT name || '-X', true, 'AB', 'Event' FROM k WHERE seq % 7 = 0""")
def _keyword_merge(spark, sf):
    names = _names(spark, sf)
    none = F.lit(None).cast("string")

    def change(where, action, name, reserved, kind, short):
        return names.where(where).select("seq", F.lit(action).alias("action"), name.alias("name"), reserved.alias("reserved"), kind.alias("keyword_type"), short.alias("min_abbreviation"), none.alias("doc_url"))

    no, up = F.lit(None).cast("boolean"), F.lower("name")
    changes = change("seq % 5 = 0", "remove", up, no, none, none).union(change("seq % 5 = 1", "override", up, F.lit(False), F.lit("handle"), F.lit("")))
    changes = changes.union(change("seq % 7 = 0", "add", F.concat("name", F.lit("-X")), F.lit(True), F.lit("EVENT"), F.lit("AB"))).union(change("seq % 5 = 0", "add", F.col("name"), F.lit(True), none, none))
    return K.merge(names, changes).select("name", "reserved", "min_abbreviation", "keyword_type")


@frame("keyword_atoms", f"WITH {_NAMES} SELECT lower(name) AS atom FROM k UNION SELECT lower(substr(name, 1, 4)) FROM k WHERE seq % 2 = 0")
def _keyword_atoms(spark, sf):
    return K.atoms(_names(spark, sf))


@frame("keyword_summary", f"WITH {_NAMES} SELECT count(*) AS total, count(*) AS reserved, count(*) FILTER (WHERE seq % 2 = 0) AS abbreviated, count(*) FILTER (WHERE seq % 3 <> 2) AS typed, count(*) FILTER (WHERE seq % 3 = 0) AS functions FROM k")
def _keyword_summary(spark, sf):
    return K.summary(_names(spark, sf).withColumn("keyword_type", F.when(F.col("seq") % 3 == 0, "Function").when(F.col("seq") % 3 == 1, "Event")))


@frame("keyword_categories", f"WITH {_NAMES} SELECT CASE WHEN seq % 3 = 0 THEN 'Function' ELSE 'Other' END AS category, string_agg({_KIND}, ' | ' ORDER BY {_KIND}) AS kinds, count(*) AS n FROM k GROUP BY 1")
def _keyword_categories(spark, sf):
    return K.categories(_names(spark, sf).withColumn("keyword_type", F.when(F.col("seq") % 3 == 0, "Function")))


@frame("callable_kinds", f"WITH {_NAMES} SELECT DISTINCT {_KIND} AS kind FROM k WHERE seq % 3 = 0")
def _callable_kinds(spark, sf):
    return K.callable_kinds(_names(spark, sf).withColumn("keyword_type", F.when(F.col("seq") % 3 == 0, "Function")))


# -- files: written to the shared folder and read again
@frame("csv_round_trip", "SELECT p_partkey, p_name, p_brand FROM part")
def _csv_round_trip(spark, sf):
    """EXPORT of all parts by a program, IMPORT into a temp-table."""
    path, catalog = files.scratch(spark, "parts"), star(spark, sf)
    lowering.run(catalog, f"OUTPUT TO '{path}'. FOR EACH part: EXPORT DELIMITER ',' p_partkey p_name p_brand. END. OUTPUT CLOSE.")
    return lowering.run(catalog, f"DEFINE TEMP-TABLE back FIELD p_partkey AS INT64 FIELD p_name AS CHARACTER FIELD p_brand AS CHARACTER. INPUT FROM '{path}'. IMPORT DELIMITER ',' back. FOR EACH back: END.").rows[-1]


@frame("orc_round_trip", "SELECT * FROM supplier")
def _orc_round_trip(spark, sf):
    path = files.scratch(spark, "suppliers")
    _table(spark, sf, "supplier").write.orc(path)
    return files.orc(spark, path)


@frame("source_text_tokens", "SELECT n_name AS text, CAST(0 AS INT) AS idx FROM nation")
def _source_text_tokens(spark, sf):
    """Source files read whole and cut into tokens: the names of nations, a line each."""
    path = files.scratch(spark, "source")
    files.write_lines(_table(spark, sf, "nation").select(F.col("n_name").alias("line")), path)
    found = T.tokens(files.source_texts(spark, f"{path}/*.txt").select(F.lit(1).alias("id"), "source"), "id", "source")
    return found.where("kind <> 'Eof'").select("text", F.lit(0).alias("idx"))


@frame("json_index_entries", "SELECT 'all' AS title, '/' AS url UNION ALL SELECT r_name, 'r' || r_regionkey FROM region UNION ALL SELECT n_name, 'n' || n_nationkey FROM nation")
def _json_index_entries(spark, sf):
    """A nested index of regions and their nations, written as JSON and flattened."""
    nation = _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("n"), "n_nationkey").alias("url"))).alias("childEntries"))
    region = _table(spark, sf, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("title"), F.concat(F.lit("r"), "r_regionkey").alias("url"), "childEntries")
    whole = region.agg(F.to_json(F.struct(F.lit("all").alias("title"), F.lit("/").alias("url"), F.collect_list(F.struct("title", "url", "childEntries")).alias("childEntries"))).alias("line"))
    path = files.scratch(spark, "index")
    files.write_lines(whole, path)
    return files.json_index(spark, f"{path}/*.txt")


@frame("keyword_list_file", "SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN left(s_name, 4) END AS min_abbreviation FROM supplier")
def _keyword_list_file(spark, sf):
    """An aligned list with a header line, written as text and read as keyword rows."""
    lines = _table(spark, sf, "supplier").select(F.concat(F.lit("  "), "s_name", F.lit("     "), F.when(F.col("s_suppkey") % 2 == 0, F.left("s_name", F.lit(4))).otherwise("")).alias("line"), F.col("s_suppkey").alias("k"))
    path = files.scratch(spark, "keywords")
    files.write_lines(_table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("  Name     Short").alias("line"), F.lit(-1).cast("long").alias("k")).union(lines).coalesce(1).sortWithinPartitions("k").select("line"), path)
    return files.keyword_list(spark, f"{path}/*.txt").select("name", "min_abbreviation")


# -- beyond the language: event-time windows
@frame("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def _event_windows(spark, sf):
    return E.windowed(_table(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 3).alias("total"))


@frame("event_sliding_windows", """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total
FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL""")
def _event_sliding_windows(spark, sf):
    return E.windowed(_table(spark, sf, "events"), "1 hour", "30 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 3).alias("total"))


@frame("event_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _event_sessions(spark, sf):
    found = E.sessions(_table(spark, sf, "events"))
    return found.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: a three-level nested loop as one join."""
    return _QUERIES["nested_foreach_three"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
