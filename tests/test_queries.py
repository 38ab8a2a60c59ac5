"""Every registered query of the language against its DuckDB SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

from rowloom.plans import registry

DATA = Path(os.environ.get("ROWLOOM_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect()) == sorted(repr(plain(tuple(r[i] for i in at))) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_relational_queries_stay_in_the_jvm(spark):
    for name in ("nested_foreach_three", "accum_conditional", "leave_after", "find_no_error_left", "can_find_semi", "running_total", "string_functions", "token_kind_counts", "line_index"):
        plan = registry.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_columns_are_pruned(spark):
    plan = registry.queries()["nested_foreach_three"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize(("name", "driving"), [("running_total", "customer"), ("find_unique_join", "orders"), ("order_by", "customer")])
def test_whole_tables_drive(spark, name, driving):
    assert registry.queries()[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/{driving}.parquet").count()


@pytest.mark.parametrize("name", ["leave_inner", "foreach_of_where"])
def test_whole_joins_pass_the_prefix(spark, name):
    assert registry.queries()[name](spark, str(DATA)).where("c_custkey > 100").count() > 0


def brute_tokens(text):
    """(kind, start, end, text, value) read character by character, for words, numbers, strings, comments and marks in ASCII."""
    at, out = 0, []
    while at < len(text):
        c, to = text[at], at + 1
        if c in " \n":
            at = to
            continue
        if c.isalpha():
            while to < len(text) and (text[to].isalnum() or text[to] in "_-"):
                to += 1
            kind, value = "Identifier", None
        elif c.isdigit():
            while to < len(text) and text[to].isdigit():
                to += 1
            kind, value = "IntegerLiteral", int(text[at:to])
        elif c == '"':
            to = text.index('"', to) + 1
            kind, value = "StringLiteral", text[at + 1 : to - 1]
        elif text.startswith("/*", at):
            to = text.index("*/", to) + 2
            kind, value = "Comment", None
        else:
            kind, value = "Invalid", None
        out.append((kind, at, to, text[at:to], value))
        at = to
    return [*out, ("Eof", len(text), len(text), "", None)]


def test_token_rows_of_whole_texts(spark, tmp_path):
    texts = {1: 'zork 42 "a b"\n/* note */ qux-1 #', 2: "", 3: "plugh " * 5000 + "7", 4: "xyzzy 10 #$"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["token_rows"](spark, str(tmp_path)).collect()
    for i, text in texts.items():
        rows = sorted((r for r in got if r.id == i), key=lambda r: r.idx)
        want = brute_tokens(text)
        value = [r.int_value if r.int_value is not None else r.string_value for r in rows]
        assert [r.idx for r in rows] == list(range(len(want)))
        assert [(r.start, r.end, r.text, v) for r, v in zip(rows, value)] == [w[1:] for w in want]
        assert all(r.kind == w[0] for r, w in zip(rows, want) if w[0] != "Invalid")
