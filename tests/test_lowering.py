import datetime

import pytest
from pyspark.sql import functions as F

from rowloom.plans.catalog import Catalog
from rowloom.plans.lowering import LoweringError, like_pattern, project, run


@pytest.fixture(scope="module")
def catalog(spark):
    customer = spark.createDataFrame([(1, "Ann", 10.0, True), (2, "Bob", -5.0, False), (3, None, None, True), (4, "Bea", 7.5, None)], "num int, name string, balance double, active boolean")
    order = spark.createDataFrame([(10, 1, 5.0, datetime.date(2024, 1, 31)), (11, 1, 7.0, None), (12, 2, 1.0, None), (13, 9, 2.0, None)], "id int, num int, price double, day date")
    return Catalog(spark, {"customer": customer, "order": order}, {"customer": ("num",), "order": ("id",)}, {("order", "customer"): (("num", "num"),)})


def got(df):
    return [tuple(r) for r in df.collect()]


def test_scan_and_null_conditions(catalog):
    assert [r[0] for r in got(run(catalog, "FOR EACH customer WHERE customer.active: END.").rows[0])] == [1, 3]
    assert [r[0] for r in got(run(catalog, "FOR EACH customer WHERE name = ?: END.").rows[0])] == [3]
    out = run(catalog, "FOR EACH customer: IF balance < 0 THEN NEXT. DISPLAY num. END.").rows[0]
    assert [r[0] for r in got(out)] == [1, 3, 4]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as k", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    catalog = Catalog(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": ("k",)})
    out = run(catalog, "FOR EACH t WHERE t.k > 3 AND t.s BEGINS '1': DISPLAY k. END.").rows[0]
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThan(k,3)" in plan and "StringStartsWith(s,1)" in plan and "Python" not in plan


def test_shared_names_are_prefixed(catalog):
    out = run(catalog, "FOR EACH customer: FOR EACH order OF customer: END. END.").rows[0]
    assert out.columns == ["customer_num", "name", "balance", "active", "id", "order_num", "price", "day"] and out.count() == 3


def test_sums_over_no_rows_keep_the_start(catalog):
    env = run(catalog, "VAR INT n = 4. VAR DECIMAL m = 2. FOR EACH customer WHERE num > 99: n = n + 1. m = MAXIMUM(m, balance). END.")
    assert [float(x) for x in got(env.value("n", "m"))[0]] == [4, 2]


def test_last_value_null_and_missing(catalog):
    env = run(catalog, "VAR CHAR a = 'start'. VAR CHAR b = 'start'. FOR EACH customer WHERE num < 4: a = name. IF num > 50 THEN b = name. END.")
    assert got(env.value("a", "b")) == [(None, "start")]


def test_min_and_max_by_comparison(catalog):
    env = run(catalog, "VAR DECIMAL hi = -100. VAR DECIMAL lo = 100. FOR EACH customer: IF balance > hi THEN hi = balance. IF lo >= balance THEN lo = balance. END.")
    assert [float(x) for x in got(env.value("hi", "lo"))[0]] == [10, -5]


def test_leave_that_never_fires_and_at_the_first_row(catalog):
    assert got(run(catalog, "VAR INT n. FOR EACH customer: IF num > 9 THEN LEAVE. n = n + 1. END.").value("n")) == [(4,)]
    assert got(run(catalog, "VAR INT n. VAR INT k. FOR EACH customer: k = k + 1. IF num = 1 THEN LEAVE. n = n + 1. END.").value("n", "k")) == [(0, 1)]


def test_rejected_loops(catalog):
    for body in ("x = x * 2 + balance.", "x = y. y = x + 1.", "IF x > 3 THEN x = x + 1."):
        with pytest.raises(LoweringError):
            run(catalog, f"VAR DECIMAL x. VAR DECIMAL y. FOR EACH customer: {body} END.")


def test_find_family(catalog):
    assert got(run(catalog, "FIND LAST customer WHERE balance > 0.").records["customer"])[0][0] == 4
    assert got(run(catalog, "FIND customer 77 NO-ERROR.").records["customer"]) == []
    with pytest.raises(Exception, match="more than one"):
        run(catalog, "FIND customer WHERE num < 3.").records["customer"].collect()
    assert run(catalog, "FIND customer WHERE num < 3 NO-ERROR.").records["customer"].collect() == []
    assert got(run(catalog, "FIND FIRST customer. FIND NEXT customer. FIND NEXT customer. FIND PREV customer.").records["customer"])[0][0] == 2
    with pytest.raises(Exception, match="more than one"):
        run(catalog, "FOR EACH customer: FIND order WHERE order.num = customer.num. DISPLAY id. END.").rows[0].collect()


def test_lookup_without_match(catalog):
    text = "FOR EACH customer: FIND FIRST order OF customer{}. DISPLAY customer.num LABEL 'n' id. END."
    assert sorted(got(run(catalog, text.format("")).rows[0])) == [(1, 10), (2, 12)]
    assert sorted(got(run(catalog, text.format(" NO-ERROR")).rows[0]), key=str) == [(1, 10), (2, 12), (3, None), (4, None)]


def test_case_and_if_branches_exclude_each_other(catalog):
    text = "FOR EACH customer: CASE num: WHEN 1 THEN customer.name = 'one'. WHEN 1 OR WHEN 2 THEN customer.name = 'two'. OTHERWISE customer.name = 'more'. END CASE. DISPLAY name. END."
    assert got(run(catalog, text).rows[0]) == [("one",), ("two",), ("more",), ("more",)]


def test_procedure_in_a_loop_and_outside(catalog):
    text = """VAR DECIMAL t. PROCEDURE add: DEFINE INPUT PARAMETER x AS DECIMAL. t = t + x * 2. END PROCEDURE.
    FOR EACH order WHERE price > 1: RUN add (price). END."""
    assert float(got(run(catalog, text).value("t"))[0][0]) == 28
    text = "VAR INT a = 2. PROCEDURE twice: DEFINE INPUT-OUTPUT PARAMETER x AS INTEGER. x = x * 2. END PROCEDURE. RUN twice (INPUT-OUTPUT a). RUN twice (INPUT-OUTPUT a)."
    assert got(run(catalog, text).value("a")) == [(8,)]


def test_return_value(catalog):
    assert run(catalog, "VAR INT a = 3. IF a > 2 THEN RETURN a * 2. RETURN 0.").returned.value == 6


def test_counting_loops(catalog):
    assert got(run(catalog, "VAR INT s. DO i = 10 TO 1 BY -4: s = s + i. END.").value("s", "i")) == [(18, -2)]
    assert got(run(catalog, "VAR INT s. DO i = 5 TO 1: s = s + i. END.").value("s")) == [(0,)]
    assert got(run(catalog, "VAR INT s = 1. DO i = 1 TO 5: s = s * i. END.").value("s")) == [(120,)]


@pytest.mark.parametrize(("pattern", "want"), [("*a.b*", "%a_b%"), ("50%~*", "50\\%*"), ("a_b", "a\\_b"), ("~.x", ".x")])
def test_matches_patterns(pattern, want):
    assert like_pattern(pattern) == want


def test_dynamic_matches(spark):
    t = spark.createDataFrame([("a.c", "a.*"), ("abc", "a.c"), ("a(c", "a(c"), ("xabc", "a*")], "s string, p string")
    out = project(Catalog(spark, {"t": t}, {"t": ("s",)}), "t", hit="s MATCHES p")
    assert [r[0] for r in out.collect()] == [True, True, True, False]


def test_functions(spark):
    t = spark.createDataFrame([("a,b,c", 3)], "s string, n int")
    c = Catalog(spark, {"t": t}, {"t": ("s",)})
    cases = {
        "ENTRY(2, s)": "b", "NUM-ENTRIES(s)": 3, "LOOKUP('c', s)": 3, "LOOKUP('x', s)": 0, "NUM-ENTRIES('')": 0, "INDEX(s, ',')": 2, "R-INDEX(s, ',')": 4, "R-INDEX(s, 'x')": 0, "SUBSTRING(s, 3)": "b,c",
        "TRUNCATE(-1.29, 1)": -1.2, "MAXIMUM(1, n, 2)": 3, "INTEGER('7')": 7, "QUOTER('x')": '"x"', "FILL('ab', 2)": "abab", "LENGTH('é')": 1, "IF n > 2 THEN 'y' ELSE 'n'": "y", "MONTH(DATE(2, 29, 2020))": 2, "s:LENGTH()": 5,
    }
    out = project(c, "t", **{f"c{i}": e for i, e in enumerate(cases)}).first()
    assert [float(x) if isinstance(y, float) else x for x, y in zip(out, cases.values())] == list(cases.values())
    with pytest.raises(LookupError):
        project(c, "t", x="KEYLABEL(1)")
    assert 1 <= project(c, "t", r="RANDOM(1, 6)").first()[0] <= 6


def test_break_marks_and_order(catalog):
    text = "FOR EACH order BREAK BY order.num BY id DESCENDING: DISPLAY id (FIRST-OF(order.num)) LABEL 'f'. END.".replace("id (FIRST", "(FIRST").replace("LABEL 'f'.", "LABEL 'f' id.")
    assert got(run(catalog, text).rows[0]) == [(True, 11), (False, 10), (True, 12), (True, 13)]


def test_lock_words_change_nothing(catalog):
    plans = {run(catalog, f"FOR EACH customer {lock}: DISPLAY num. END.").rows[0].count() for lock in ("NO-LOCK", "SHARE-LOCK", "EXCLUSIVE-LOCK", "NO LOCK", "")}
    assert plans == {4}


def test_temp_views_are_tables(spark):
    spark.range(3).select(F.col("id").alias("k")).createOrReplaceTempView("tt_person")
    assert got(run(spark, "VAR INT n. FOR EACH tt_person: n = n + k. END.").value("n")) == [(3,)]


def test_export_and_import(spark, tmp_path):
    """EXPORT writes a loop's rows, IMPORT reads them into a temp-table."""
    catalog = Catalog(spark, {"t": spark.createDataFrame([(1, 'a "b" c'), (2, None), (3, "é, x")], "k int, v string")}, {"t": ("k",)})
    path = str(tmp_path / "out")
    run(catalog, f"OUTPUT TO '{path}'. FOR EACH t WHERE k > 1 OR v <> '': EXPORT DELIMITER ',' k v. END. OUTPUT CLOSE.")
    env = run(catalog, f"DEFINE TEMP-TABLE back FIELD k AS INTEGER FIELD v AS CHARACTER INDEX i IS PRIMARY k. INPUT FROM '{path}'. REPEAT: CREATE back. IMPORT DELIMITER ',' back. END. INPUT CLOSE. FOR EACH back WHERE k > 0: DISPLAY back. END.")
    assert sorted(map(tuple, env.rows[-1].collect())) == [(1, 'a "b" c'), (2, None), (3, "é, x")]
    with pytest.raises(LoweringError):
        run(catalog, "FOR EACH t: EXPORT k. END.")


def test_created_records_hold_what_they_are_given(spark):
    catalog = Catalog(spark, {"t": spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, g int")}, {"t": ("k",)})
    env = run(catalog, "DEFINE TEMP-TABLE s LIKE t FIELD n AS CHARACTER. FOR EACH t: IF g = 0 THEN NEXT. CREATE s. s.k = k * 2. IF g = 1 THEN s.n = 'one'. END. CREATE s. s.k = 99. EMPTY TEMP-TABLE t. FOR EACH s: END. FOR EACH t: END.")
    assert sorted(map(tuple, env.rows[0].collect())) == [(2, None, "one"), (4, None, None), (8, None, "one"), (10, None, None), (14, None, "one"), (16, None, None), (99, None, None)]
    assert env.rows[1].count() == 0


@pytest.mark.parametrize("fault", ["VAR INT n. FOR EACH t: n = f(k, 1). END.", "SELECT k FROM t WHERE k > ALL (SELECT k FROM t).", "DELETE t.", "FOR EACH t: DELETE u. END.", "IMPORT t."])
def test_faults_of_statements(spark, fault):
    catalog = Catalog(spark, {"t": spark.createDataFrame([(1,)], "k int")}, {"t": ("k",)})
    with pytest.raises((LoweringError, LookupError)):
        run(catalog, "FUNCTION f RETURNS INTEGER (x AS INTEGER): RETURN x + 1. END FUNCTION. " + fault)


def test_functions_and_transactions_on_the_driver(spark):
    env = run(Catalog(spark), "FUNCTION twice RETURNS INTEGER (INPUT x AS INTEGER): VAR INT y. y = x * 2. RETURN y. END FUNCTION. VAR INT a = 3. VAR INT b. b = twice(twice(a)). DO TRANSACTION: b = 0. UNDO. END. DO ON ERROR UNDO, LEAVE: a = 5. END.")
    assert (env.vars["a"].value, env.vars["b"].value) == (5, 12)
