import json

from pyspark.sql import functions as F

from rowloom.operators import keywords as K
from rowloom.operators import records as R
from rowloom.operators import text as T
from rowloom.plans.lexer import LineMap, tokenize
from rowloom.sources import files
from rowloom.streaming import events as E


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_token_table(spark):
    df = spark.createDataFrame([(1, "é = 1.\n// x"), (2, None), (3, "")], "id long, text string")
    rows = T.tokens(df, "id", "text").collect()
    for key, text in ((1, "é = 1.\n// x"), (2, ""), (3, "")):
        assert [(r.kind, r.start, r.end, r.text) for r in rows if r.id == key] == [(t.kind, t.start, t.end, t.text) for t in tokenize(text)]
    assert {r.int_value for r in rows if r.kind == "IntegerLiteral"} == {1}


def test_kind_totals_agree_with_the_token_table(spark):
    texts = ["", None, "x = 1. // c", "/* a */ 'q~'r' \"open", "/*/ b", "NO  LOCK no-lock share\\tlock exclusive locks NO\nLOCK", "42.foo 3.5 2147483648 99999999999999999999 9223372036854775807", "{&a} {&b &if &zzz & {", "def Define é😀 ^ @ a-b _x", "a:b::c += -= <> <= >= [1] (2), ?", "'tail~", "'~", "/* open *", '"' + "~n" * 20000 + '"']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert got(T.kind_totals(df, "text")) == got(T.kind_counts(T.tokens(df, "id", "text")))


def test_line_maps(spark):
    texts = ["", "a\n", "a\r\nb", "héllo\nworld", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = sorted((i, n + 1, s) for i, t in enumerate(texts) for n, s in enumerate(LineMap(t).starts))
    assert got(T.line_starts(df, "id", "text")) == want
    offsets = spark.createDataFrame([(i, t, o) for i, t in enumerate(texts) for o in range(len(t.encode()) + 1)], "id long, text string, at int")
    for r in T.lookup(offsets, "text", "at").collect():
        assert (r.line, r.column) == LineMap(r.text).lookup(r.at)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 7), (3, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 9, "c")], "k int, s int, v string")
    assert sorted((tuple(r) for r in T.as_of(left, right, "k", "at", "s").collect()), key=str) == [(1, 0, 0, "a"), (1, 5, 5, "b"), (2, 7, None, None), (3, 1, None, None)]


def test_dump(spark):
    df = spark.createDataFrame([(1, "x\n'" + "y" * 50 + "'")], "id long, text string")
    rows = T.dump(df, "id", "text").orderBy("idx").collect()
    assert [(r.line, r.column) for r in rows] == [(1, 1), (2, 1), (2, 53)] and rows[1].shown.endswith("...") and not any(r.flagged for r in rows)


def test_kind_names(spark):
    names = ["+", "AUTO-RETURN", "&IF", "IF", "2ND", "<>", "ACTIVE WINDOW", "a_b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(K.kind_of(F.col("name"))).collect()] == [K.variant_name(n) for n in names] == ["Plus", "AutoReturn", "PreprocIf", "KwIf", "Kw2nd", "NotEqual", "ActiveWindow", "AB"]


def test_titles(spark):
    df = spark.createDataFrame([("Session system handle", "u"), (" ABS function ", "v"), ("&IF preprocessor directive", "w"), ("Overview", "x")], "title string, url string")
    assert got(K.titles(df)) == [("&IF", "Preprocessor", "w"), ("ABS", "Function", "v"), ("SESSION", "Handle", "u")]


def test_builtin_spellings_agree_with_the_relational_ones(spark):
    table = {r.spelling: r.kind for r in K.first_wins(K.spellings(K.builtin(spark)), "spelling").collect()}
    assert table == K.builtin_spellings()


def test_views(spark):
    found = K.view("all", K.builtin(spark))
    assert set(found) == {"atoms", "callable", "summary", "kind", "match"} and found["callable"].count() == 54


def test_merge(spark):
    base = spark.createDataFrame([(0, "A", True, "a", "Event", None), (1, "B", True, None, None, None)], K.KEYWORD)
    changes = spark.createDataFrame([(0, "remove", "b", None, None, None, None), (1, "override", "a", False, "weird", "", None), (2, "add", "B", True, None, None, None), (3, "add", "C", True, "handle", "", None), (4, "add", "c", False, None, None, None)], "seq long, action string, name string, reserved boolean, keyword_type string, min_abbreviation string, doc_url string")
    assert got(K.merge(base, changes).drop("seq", "doc_url")) == [("A", False, None, "weird"), ("C", True, None, "Handle")]


def test_alternate_spellings(spark):
    base = spark.createDataFrame([(0, "TO-DO", True, "TO-", None, None)], K.KEYWORD)
    alt = K.alternates(base, spark.createDataFrame([("To Do",)], "name string"))
    assert got(alt) == [("TO-DO", "TO DO")]
    assert {r.spelling for r in K.spellings(base, alt).collect()} == {"to-", "to-d", "to-do", "to ", "to d", "to do"}


def test_sources(spark, tmp_path):
    (tmp_path / "k.txt").write_text("  Name      Short\n  +     \n\n  AUTO RETURN     AUTO R\n")
    assert got(files.keyword_list(spark, str(tmp_path / "k.txt")).select("name", F.coalesce("min_abbreviation", F.lit("-")))) == [("+", "-"), ("AUTO RETURN", "AUTO R")]
    (tmp_path / "i.json").write_text(json.dumps({"title": "a", "url": "1", "childEntries": [{"title": "b", "url": "2", "childEntries": [{"title": "c", "url": "3", "childEntries": []}]}]}))
    assert got(files.json_index(spark, str(tmp_path / "i.json"))) == [("a", "1"), ("b", "2"), ("c", "3")]
    (tmp_path / "o.toml").write_text('[[add]]\nname = "X"\nreserved = true\n[[remove]]\nname = "Y"\n')
    assert got(files.toml_changes(spark, str(tmp_path / "o.toml")).select("action", "name")) == [("add", "X"), ("remove", "Y")]
    assert files.toml_changes(spark, str(tmp_path / "none.toml")) is None
    files.write_lines(spark.createDataFrame([("x",)], "line string"), str(tmp_path / "out"))
    assert files.source_texts(spark, str(tmp_path / "out" / "*.txt")).first().source == "x\n"
    files.export(spark.createDataFrame([(1, 'a "b" c')], "n int, s string"), str(tmp_path / "csv"))
    assert got(files.csv(spark, str(tmp_path / "csv"), "n int, s string")) == [(1, 'a "b" c')]


def test_records(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert got(R.create(df, k=3)) != got(df) and R.create(df, k=3).count() == 3
    assert got(R.delete(df, F.col("v") == "a")) == [(2, "b")]
    assert got(R.append_if_absent(df, spark.createDataFrame([(2, "x"), (4, "y")], "k int, v string"), ["k"])) == [(1, "a"), (2, "b"), (4, "y")]
    assert got(R.current_changed(df, R.update(df, F.col("k") == 2, v=F.lit("z")), ["k"])) == [(2,)]
    assert got(R.unique_match(df, F.col("k") == 1)) == [(1, "a")] and R.unique_match(df, F.col("k") > 0, no_error=True).count() == 0
    marks = R.break_marks(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, k int"), "g", ["k"])
    assert got(marks) == [("x", 1, True, False), ("x", 2, False, True), ("y", 3, True, True)]


def test_running_sums(spark):
    rows = [(k * 7 % 50 if k % 9 else None, k, float(k % 5) if k % 4 else None, f"s{k % 3}") for k in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, v double, s string").repartition(3)
    for first, down in (("k", False), ("k", True), ("s", False)):
        order = [(F.col(first), down), (F.col("i"), False)]
        out = R.running_sum(df, F.col("v"), order, "run", ranges=8).collect()
        nulls_low = sorted(out, key=lambda r: r.i)
        nulls_low.sort(key=lambda r: (r[first] is not None, r[first] if r[first] is not None else 0) if first == "k" else r.s, reverse=down)
        total = 0.0
        for r in nulls_low:
            total += r.v or 0
            assert r.run == total
    assert R.running_sum(df.limit(0), F.col("v"), [(F.col("k"), False)], "run").count() == 0


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-01 00:50:00", 1, "a", 2.0), (3, "2024-01-01 01:10:00", 2, "b", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "to_timestamp(t) ts", "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = E.read(spark, str(tmp_path / "e"), df.schema.simpleString()[7:-1].replace(":", " "))
    assert got(E.drain(E.windowed(stream), "w")) == got(E.windowed(df))
    assert E.windowed(df).count() == 2 and E.sessions(df).count() == 3


def test_reversed_keys(spark):
    """Descending order by an ascending sort of the key, for every type, nulls last."""
    import datetime as dt
    from decimal import Decimal

    cases = {
        "int": [3, -(2**31), 2**31 - 1, 0, None], "bigint": [2**63 - 1, -(2**63), 5, None], "decimal(38,2)": [Decimal("1.50"), Decimal("-9.25"), None], "double": [1.5, -2.0, float("inf"), float("-inf"), float("nan"), None],
        "boolean": [True, False, None], "date": [dt.date(2020, 1, 2), dt.date(1969, 1, 1), None], "timestamp_ntz": [dt.datetime(2020, 1, 1), dt.datetime(1900, 5, 5, 1, 2, 3, 4), None], "timestamp": [dt.datetime(2020, 1, 1), dt.datetime(1990, 5, 5, 1, 2, 3, 4), None],
        "string": ["", "a", "ab", "abc", "b", "é", "é\x00", "z", "日", None], "binary": [b"", b"\x00", b"\x00\x01", b"\xff", None],
    }
    for kind, values in cases.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        want = [r.i for r in df.orderBy(F.col("v").desc(), "i").collect()]
        assert [r.i for r in df.orderBy(R.order_key(df, [(F.col("v"), True)]), "i").collect()] == want, kind


def test_rows_beside(spark):
    """Next and previous rows over the borders of ranges, with hot values, texts and nulls as first keys."""
    rows = [(None if i % 17 == 0 else 5 if i % 3 else i % 40, i, f"w{i * 7 % 60:02d}" if i % 5 else "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, s string").repartition(4)
    for order in (["k", "i"], ["s", "i"]):
        out = R.beside(R.beside(df, order, F.struct("i", "k"), True, "n", ranges=8), order, F.struct("i", "k"), False, "p", ranges=8).collect()
        at = {r.i: r for r in out}
        by = [r.i for r in df.orderBy(*order).collect()]
        assert len(out) == 300
        for before, here, after in zip([None, *by], by, [*by[1:], None]):
            assert (at[here].n and at[here].n.i) == after and (at[here].p and at[here].p.i) == before
    assert R.neighbours(df.limit(0), ["k"], ["i"]).count() == 0
    both = {r.i: (r.next_i, r.prev_i) for r in R.neighbours(df, ["i"], ["i"]).collect()}
    assert both == {i: (i + 1 if i < 299 else None, i - 1 if i else None) for i in range(300)}


def test_database_tables(spark):
    """A table written to and read from a database in memory, by JDBC; ORC files."""
    url = "jdbc:derby:memory:rowloom;create=true"
    spark.range(5).selectExpr("cast(id as int) as k", "concat('v', id) as v").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    assert got(files.jdbc(spark, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where("K > 2")) == [(3, "v3"), (4, "v4")]


def test_deep_index(spark, tmp_path):
    entry = {"title": "leaf", "url": "u40"}
    for i in range(39, -1, -1):
        entry = {"title": f"t{i}", "url": f"u{i}", "childEntries": [entry, {"title": None, "url": "none"}]}
    (tmp_path / "i.json").write_text(json.dumps([entry, {"title": "second", "url": "s", "childEntries": []}]))
    assert {r.url for r in files.json_index(spark, str(tmp_path / "i.json")).collect()} == {f"u{i}" for i in range(41)} | {"s"}
