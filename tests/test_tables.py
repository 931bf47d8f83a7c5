"""Small cases with known results, and properties of differences and merges."""

from __future__ import annotations

import json
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canonical, staging, text
from tidemark.operators import apply, diff, mask, project, verify
from tidemark.operators.mask import MaskRule
from tidemark.operators.project import Filter
from tidemark.plans import report, schema
from tidemark.plans import sql as free_sql
from tidemark.plans.report import TableSelection
from tidemark.sources import databases, readers, writers

USERS = "id long, name string, age int"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "alice", 30), (2, "bob", 25), (3, "carol", 35)], USERS)


@pytest.fixture(scope="module")
def stale(spark):
    return spark.createDataFrame([(1, "alice-old", 99), (2, "bob", 25), (99, "extra", 0)], USERS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def counts(s):
    r = s.first()
    return r.inserted, r.updated, r.deleted


def test_mirror_of_users(users, stale):
    assert counts(diff.summary(users, stale, ["id"])) == (1, 1, 1)
    assert rows(apply.merged(users, stale, ["id"], True)) == rows(users)
    assert counts(diff.summary(users.where("id <> 2"), users, ["id"])) == (0, 0, 1)


def test_upsert_keeps_extra_rows(users, stale):
    assert rows(apply.merged(users, stale, ["id"])) == sorted([*rows(users), (99, "extra", 0)])


def test_copy_modes(spark, users):
    old = spark.createDataFrame([(1, "keep-old", 99)], USERS)
    assert rows(apply.copied(users, old, ["id"], "truncate")) == rows(users)
    assert rows(apply.copied(users, old, ["id"], "skip_existing")) == [(1, "keep-old", 99), (2, "bob", 25), (3, "carol", 35)]
    with pytest.raises(apply.KeyConflict):
        apply.copied(users, old, ["id"], "error")
    r = project.high_water(users, "id").first()
    assert (r.max_key, r.next_id) == (3, 4)


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_items_in_windows_of_seven(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shape = "id int, v string, n int"
        source = spark.range(1, 301).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 7).cast("int").alias("n"))
        target = spark.createDataFrame([(1, "CHANGED", 0), (50, "v50", 1), (299, "CHANGED", 3), (500, "EXTRA", 0), (501, "EXTRA2", 0)], shape)
        assert counts(diff.summary(source, target, ["id"])) == (297, 2, 2)
        placed = diff.windows(source, target, ["id"], 7)
        n = diff.window_counts(placed).first()
        assert (n.windows, n.diff_windows) == (44, 44)
        assert {r.id: r.chunk for r in placed.where("is_tail").collect()} == {500: 43, 501: 43}
        assert counts(diff.summary(source, apply.merged(source, target, ["id"], True), ["id"])) == (0, 0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_difference_properties(users, stale):
    assert diff.row_diff(users, users, ["id"]).isEmpty()
    ab, ba = counts(diff.summary(users, stale, ["id"])), counts(diff.summary(stale, users, ["id"]))
    assert ab == ba[::-1]
    assert verify.full(users, apply.merged(users, stale, ["id"], True), ["id"]).first().passed


def test_empty_sides(users):
    none = users.limit(0)
    assert counts(diff.summary(users, none, ["id"])) == (3, 0, 0)
    assert counts(diff.summary(none, users, ["id"])) == (0, 0, 3)
    assert diff.window_counts(diff.windows(none, none, ["id"], 5)).first().windows == 0
    assert diff.window_counts(diff.windows(none, users, ["id"], 2)).first().asDict() == {"windows": 2, "diff_windows": 2}


def test_change_set(spark, users):
    new = spark.createDataFrame([(9, "dave", 40)], USERS)
    up = spark.createDataFrame([(1, 31, ["age"])], "id long, age int, _set array<string>")
    gone = spark.createDataFrame([(3,)], "id long")
    assert rows(apply.change_set(users, ["id"], new, up, gone)) == [(1, "alice", 31), (2, "bob", 25), (9, "dave", 40)]
    with pytest.raises(ValueError):
        apply.change_set(users, [], updates=up)


def test_row_hash_ignores_order_and_tells_types_apart(spark):
    df = spark.createDataFrame([(1, "1", None)], "A int, b string, c string")
    other = df.select("c", "b", F.col("A").alias("a"))
    one = lambda d, cols: d.select(canonical.row_hash(d, cols).alias("h")).first().h
    assert one(df, ["A", "b", "c"]) == one(other, ["c", "b", "a"])
    texts = df.select(F.col("A").cast("string").alias("A"), "b", "c")
    assert one(df, ["A"]) != one(texts, ["A"])


def test_texts_of_doubles_are_those_of_sql(spark):
    values = [0.0, -0.0, 0.25, -999.85, 12345678.25, -1e9, 1e15, 1e16, 1.5e17, 2e23, 0.0001, 0.00025, 1e-5, -2.5e-7, 1e100, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.t for r in df.select("k", canonical.cell(F.col("v"), df.schema["v"].dataType).alias("t")).orderBy("k").collect()]
    with duckdb.connect() as con:
        expected = [con.execute("SELECT ?::DOUBLE::VARCHAR", [v]).fetchall()[0][0] or canonical.NULL for v in values]
    assert got == expected
    # keys and comparisons have one zero
    zeros = df.where("k < 2").select("v")
    assert zeros.select(canonical.key_text(zeros, ["v"])).distinct().count() == zeros.select(canonical.value_hash(zeros, ["v"])).distinct().count() == 1
    assert zeros.select(canonical.row_hash(zeros, ["v"])).distinct().count() == 2


def test_key_round_trip(spark):
    df = spark.createDataFrame([(123, "hello", None)], "a long, b string, c string")
    back = df.select(canonical.key_text(df, ["a", "b", "c"]).alias("k")).select(*canonical.key_values(F.col("k"), {f.name: f.dataType for f in df.schema.fields}))
    assert rows(back) == [(123, "hello", None)]


def test_guids_and_decimals_are_normalised(spark):
    shape = T.StructType([T.StructField("g", T.StringType(), True, {"role": "guid"})])
    df = spark.createDataFrame([("{6F9619FF-8B86-D011-B42D-00C04FC964FF}",), ("6f9619ff8b86d011b42d00c04fc964ff",)], shape)
    assert df.select(*canonical.cells(df, ["g"])).distinct().count() == 1
    d = spark.sql("select cast(20.00 as decimal(10,2)) a, cast(20 as decimal(10,0)) b, cast(100 as decimal(5,0)) c")
    assert d.select(*canonical.cells(d, ["a", "b", "c"])).first()[:] == ("20", "20", "100")


def test_masks(users):
    assert mask.matches("user_*", "user_name") and not mask.matches("email", "email2") and mask.matches("*NAME", "full_name")
    rules = [MaskRule("name", "random_letters", 5), MaskRule("age", "random_int", 10)]
    a, b = mask.masked(users, ["id"], rules), mask.masked(users, ["id"], rules)
    assert rows(a) == rows(b)
    assert all(len(r.name) == 5 and r.name.islower() and 0 <= r.age < 10 for r in a.collect())
    found = mask.issues(users, ["id"], [MaskRule("id", "random_int"), MaskRule("zip", "null"), MaskRule("name", "what")])
    assert sorted(r.level for r in found.collect()) == ["error", "warning", "warning"]


def test_filters(users):
    assert project.filtered(users, [Filter("name", "in", [])]).isEmpty()
    assert project.filtered(users, [Filter("name", "not_in", [])]).isEmpty()
    assert project.filtered(users, [Filter("age", ">", "oops")]).isEmpty()
    for bad in (Filter("nope", "=", 1), Filter("age", "between", 1)):
        with pytest.raises(ValueError):
            project.filtered(users, [bad])
    for bad in ("1=1; drop table x", "a -- b", "nope > 1"):
        with pytest.raises(ValueError):
            project.where_fragment(users, bad)


def test_key_predicates_reach_the_scan(spark, sf_dir):
    df = project.keyset_page(readers.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"]), ["o_orderkey"], [100], 10)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_csv_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,,c\n1,"x, ""y""\nz",3\n\n4,5\n')
    df = readers.import_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "col2", "c"]
    assert rows(df.na.fill("-")) == [("1", 'x, "y"\nz', "3"), ("4", "5", "-")]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"x": [1, 2]}}, {"a": null, "c": true}]')
    df = readers.import_json(spark, str(tmp_path / "a.json"))
    assert sorted(df.columns) == ["a", "b", "c"]
    assert {(r.a, r.b, r.c) for r in df.collect()} == {("1", '{"x": [1, 2]}', None), (None, None, "true")}


def test_inference(spark):
    df = spark.createDataFrame([("true", "1", "1.5", "2024-01-02", "x", None), ("False", "-7", "2", "2024-01-02T03:04:05", "", None)], "a string, b string, c string, d string, e string, f string")
    kinds = readers.inferred_types(df)
    assert [kinds[c].simpleString() for c in "abcdef"] == ["boolean", "bigint", "double", "timestamp_ntz", "string", "string"]


def test_nested_and_arrays(spark):
    df = spark.createDataFrame([(1, ["x", "y"], (1, "z"))], "id int, tags array<string>, meta struct<a:int,b:string>")
    assert rows(readers.nested_as_text(df)) == [(1, '["x","y"]', '{"a":1,"b":"z"}')]
    a = spark.sql("select array('a', '', 'NULL', null, 'q\"', 'b c', 'x,y') a, array(array(1, 2), array(3)) b, '[1, \"a b\", null]' j, 'plain' p")
    out = a.select(text.array_text(F.col("a"), a.schema["a"].dataType), text.array_text(F.col("b"), a.schema["b"].dataType), text.json_array_text(F.col("j")), text.json_array_text(F.col("p"))).first()
    assert out[:] == ('{a,"","NULL",NULL,"q\\"","b c","x,y"}', "{{1,2},{3}}", '{1,"a b",NULL}', "plain")


@pytest.mark.parametrize(("dialect", "expected"), [("postgresql", "(TRUE, 'it''s \\', decode('ff','hex'), NULL)"), ("mysql", "(1, 'it''s \\\\', X'ff', NULL)"), ("sqlserver", "(1, 'it''s \\', 0xff, NULL)"), ("clickhouse", "(1, 'it''s \\\\', unhex('ff'), NULL)")])
def test_literals(spark, dialect, expected):
    df = spark.createDataFrame([(True, "it's \\", bytearray(b"\xff"), None)], "a boolean, b string, c binary, d string")
    assert writers.insert_statements(df, "t", dialect).first().sql.endswith(f"VALUES {expected};")


def test_export_of_an_empty_table_has_a_header(spark, users, tmp_path):
    writers.export_csv(users.limit(0), str(tmp_path / "x"))
    assert readers.import_csv(spark, str(tmp_path / "x")).columns == ["id", "name", "age"]


@pytest.mark.parametrize(("dialect", "native", "expected"), [
    ("postgresql", "numeric(10,2)", ("Decimal", None, 10, 2)), ("postgresql", "character varying(255)", ("VarChar", 255, None, None)), ("postgresql", "int4[]", ("Json", None, None, None)), ("mysql", "tinyint(1)", ("Boolean", None, None, None)),
    ("mysql", "tinyint(4)", ("Int16", None, None, None)), ("mysql", "enum('a','b')", ("VarChar", 255, None, None)), ("sqlite", "VARCHAR(50)", ("VarChar", 50, None, None)), ("sqlite", "", ("Binary", None, None, None)), ("sqlite", "DECIMAL(10,2)", ("Decimal", None, 10, 2)),
    ("sqlserver", "nvarchar(max)", ("Text", None, None, None)), ("sqlserver", "money", ("Decimal", None, 19, 4)), ("clickhouse", "UInt64", ("Decimal", None, 20, 0)), ("duckdb", "hugeint", ("Decimal", None, 38, 0)), ("dm8", "DATE", ("DateTime", None, None, None)), ("mariadb", "geometry", ("Unknown", None, None, None)),
])
def test_types_to_canonical(spark, dialect, native, expected):
    df = spark.createDataFrame([("t", "c", native)], "`table` string, `column` string, native_type string")
    r = schema.to_canonical(df, dialect).first()
    assert (r.canonical, r.c_length, r.c_precision, r.c_scale) == expected


@pytest.mark.parametrize(("dialect", "canonical_", "numbers", "expected"), [
    ("mysql", "Decimal", (None, 70, 40), "decimal(65,30)"), ("mysql", "VarChar", (20000, None, None), "text"), ("sqlserver", "VarChar", (5000, None, None), "nvarchar(max)"), ("dm8", "VarChar", (9000, None, None), "CLOB"), ("duckdb", "Decimal", (None, 50, 2), "decimal(38,2)"),
    ("postgresql", "Decimal", (None, None, None), "numeric"), ("sqlite", "Int16", (None, None, None), "INTEGER"), ("clickhouse", "Decimal", (None, None, None), "decimal(18,6)"), ("mysql", "Binary", (100, None, None), "varbinary(100)"), ("sqlserver", "Guid", (None, None, None), "uniqueidentifier"),
])
def test_types_to_target(spark, dialect, canonical_, numbers, expected):
    df = spark.createDataFrame([(canonical_, *numbers)], "canonical string, c_length int, c_precision int, c_scale int")
    assert schema.to_target(df, dialect).first().target_type == expected


def test_renames_are_one_to_one_and_nearest_first(spark):
    shape = "`table` string, `column` string, position int, native_type string, nullable boolean"
    before = spark.createDataFrame([("t", "id", 0, "int", False), ("t", "a", 1, "text", True), ("t", "b", 2, "text", True)], shape)
    after = spark.createDataFrame([("t", "id", 0, "int", False), ("t", "x", 1, "text", True), ("t", "y", 2, "text", True)], shape)
    assert rows(schema.renames(before, after)) == [("t", "a", "x", "high"), ("t", "b", "y", "high")]


def test_conform(spark, users):
    target = spark.createDataFrame([], "ID int, name string, born date")
    kept, warnings = schema.conform(users, target)
    assert kept.columns == ["ID", "name", "born", "age"] and len(warnings) == 1
    assert schema.conform(users, target, drop_confirmed=True)[0].columns == ["ID", "name", "born"]


def test_sql_guard_and_cap(spark, users):
    assert free_sql.is_read_only(spark, "-- x\n (with a as (select 1) select * from a)") and not free_sql.is_read_only(spark, "delete from t") and not free_sql.is_read_only(spark, "")
    with pytest.raises(PermissionError):
        free_sql.query(spark, "drop table x", {}, read_only=True)
    found = free_sql.run(spark, "select * from users order by id", {"users": users}, 2)
    assert found.rows.count() == 2 and found.messages
    assert any("Scan" in r.plan for r in free_sql.explain(spark, "select count(*) from users", {"users": users}).collect())


def test_sync_goes_on_after_a_failure(spark, users, stale):
    done, rep = report.sync_tables(spark, {"u": users, "v": users}, {"u": stale, "v": users}, {"u": TableSelection(["id"], delete_extra=True, verify="full"), "v": TableSelection(["id"], method="full_copy"), "w": TableSelection(["id"])})
    assert rows(done["u"]) == rows(users)
    assert [(r.table, r.error is None) for r in rep.collect()] == [("u", True), ("v", False), ("w", False)]
    assert report.run_status(rep).first().status == "PartiallyFailed"


def test_catalogue_and_history(spark, users):
    assert rows(schema.catalog_columns(spark, {"u": users})) == [("u", "age", 3, "int"), ("u", "id", 1, "bigint"), ("u", "name", 2, "string")]


def test_replace_path_while_reading(spark, users, tmp_path):
    from tidemark.functions.staging import replace_path

    path = str(tmp_path / "t")
    users.write.parquet(path)
    replace_path(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("sql", ["from t insert into u select *", "with x as (select 1) insert into u select * from x", "insert overwrite u select 1", "update t set a = 1", "merge into t using u on t.a = u.a when matched then delete", "drop table t", "set a = b", "create table t as select 1", "from t insert into u select * insert into v select *", "cache table t", "nonsense"])
def test_statements_that_write(spark, sql):
    assert not free_sql.is_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["from t select a", "select 'insert into u' as x -- drop table t", "explain select 1", "show tables", "describe t", "values (1)", "table t", "with x as (select 1) select * from x union all select 2", "select `insert` from t"])
def test_statements_that_read(spark, sql):
    assert free_sql.is_read_only(spark, sql)


def test_limits_are_errors_beyond_their_bound(spark, users):
    for call in (lambda: free_sql.run(spark, "select 1", {}, 100_001), lambda: diff.diff_page(users, users, ["id"], "update", 201), lambda: report.run_history(users.selectExpr("id AS run_id", "age AS started"), limit=201), lambda: project.page(users, ["id"], limit=10_001)):
        with pytest.raises(ValueError):
            call()


def test_names_in_any_case_and_zeros(spark):
    source = spark.createDataFrame([(1, "a", 0.0), (2, "b", 1.0), (3, "c", 1.0)], "K int, NAME string, V double")
    target = spark.createDataFrame([(1, "a", -0.0), (2, "x", 1.0), (4, "d", 1.0)], "k int, name string, v double")
    for keys in (["k"], ["K"]):
        assert sorted((r[0], r.change_type) for r in diff.row_diff(source, target, keys).collect()) == [(2, "update"), (3, "insert"), (4, "delete")]
        assert [tuple(r) for r in diff.changed_cells(source, target, keys).collect()] == [(2, "name", "x", "b")]
        assert [r.NAME for r in diff.updated(source, target, keys).collect()] == ["b"] and diff.inserted(source, target, keys).count() == diff.deleted(source, target, keys).count() == 1
        assert sorted(tuple(r) for r in apply.merged(source, target, keys, True).select("k", "name").collect()) == [(1, "a"), (2, "b"), (3, "c")]
        assert apply.copied(source, target, keys, "skip_existing").count() == 4
    assert {r.only_source + r.only_target for r in diff.multiset_diff(source, target).collect()} == {1} and diff.multiset_diff(source, target).count() == 4


def test_multiset_diff_shuffles_rows_near_a_difference_only(spark, monkeypatch):
    source = spark.range(0, 5000).selectExpr("id % 1000 AS k", "concat('t', id % 1000) AS t")
    target = spark.range(0, 5000).selectExpr("id % 1000 AS k", "concat('t', id % 1000 + if(id < 3, 2000, 0)) AS t")
    wanted = {(0, "t0", 1, 0), (1, "t1", 1, 0), (2, "t2", 1, 0), (0, "t2000", 0, 1), (1, "t2001", 0, 1), (2, "t2002", 0, 1)}
    found = diff.multiset_diff(source, target)
    assert {tuple(r) for r in found.collect()} == wanted and "bitmap_construct_agg" in found._jdf.queryExecution().toString()
    assert diff.multiset_diff(source, source).isEmpty()
    monkeypatch.setattr(diff, "bits_for", lambda _: 0)  # a bitmap that leaves nothing out changes no result
    assert {tuple(r) for r in diff.multiset_diff(source, target).collect()} == wanted


def test_two_updates_of_one_key_are_refused(spark, users):
    up = spark.createDataFrame([(1, 31, ["age"]), (1, 32, ["age"])], "id long, age int, _set array<string>")
    with pytest.raises(apply.KeyConflict):
        apply.change_set(users, ["id"], updates=up)


def test_only_numbers_as_people_write_them_are_inferred(spark):
    df = spark.createDataFrame([("1d", "NaN", "1e5", "2f", "+.5", "Infinity")], [f"c{k}" for k in range(6)])
    kinds = readers.inferred_types(df)
    assert [kinds[f"c{k}"].simpleString() for k in range(6)] == ["string", "string", "double", "string", "double", "string"]


@pytest.mark.parametrize("broken", [False, True])
def test_csv_is_split_where_no_field_has_a_line_break(spark, tmp_path, broken):
    (tmp_path / "a.csv").write_text('a,b\n1,"he said ""hi"""\n' + ('2,"x\ny"\n' if broken else "") + "3,\n")
    df = readers.import_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", 'he said "hi"'), *([("2", "x\ny")] if broken else []), ("3", None)]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_merge_rewrites_the_partitions_that_change(spark, tmp_path):
    path = tmp_path / "t"
    shape = "id int, name string, part string"
    target = [(1, "a", "p"), (2, "b", "p"), (3, "c", "q"), (4, "d", "r"), (5, "e", None), (6, "f", "s"), (7, "g", "u")]
    source = [(1, "a", "p"), (2, "b", "p"), (3, "C", "q"), (4, "d", "r"), (6, "f", "v"), (7, "g", "u"), (8, "h", "w")]
    spark.createDataFrame(target, shape).write.partitionBy("part").parquet(str(path))
    before = files(path)
    out = {r.part: (r.inserted, r.updated, r.deleted) for r in apply.merge_into_path(spark.createDataFrame(source, shape), str(path), ["id"], ["part"], True).collect()}
    assert out == {"q": (0, 1, 0), None: (0, 0, 1), "s": (0, 1, 0), "v": (0, 1, 0), "w": (1, 0, 0)}
    assert sorted(tuple(r) for r in spark.read.parquet(str(path)).select("id", "name", "part").collect()) == sorted(source)
    after = files(path)
    untouched = {k: v for k, v in before.items() if k.split("/")[0] in ("part=p", "part=r", "part=u")}
    assert untouched and all(after.get(k) == v for k, v in untouched.items())
    assert not any(k.startswith(("part=s", "part=__")) for k in after)
    assert apply.merge_into_path(spark.createDataFrame(source, shape), str(path), ["id"], ["part"], True).isEmpty() and files(path) == after


def test_sync_writes_to_its_paths(spark, users, tmp_path):
    path = str(tmp_path / "u")
    users.limit(1).write.parquet(path)
    done, rep = report.sync_tables(spark, {"u": users}, {"u": spark.read.parquet(path)}, {"u": TableSelection(["id"])}, {"u": path})
    assert rep.first().inserted == 2 and rep.first().verified
    assert spark.read.parquet(path).count() == 3 == done["u"].count()


def test_old_staged_tables_are_cleared(spark, users):
    staging.snapshot(users)
    assert staging.clear_staged(spark, 24) == 0
    kept = staging.base_folder(spark)
    assert kept and staging.shared_folder(spark).startswith(kept)


@pytest.mark.parametrize("lines", [False, True])
def test_json_columns_come_as_first_seen(spark, tmp_path, lines):
    objects = ['{"z": 1, "b": {"y": [1, 2]}}', '{"a": null, "b": "t", "z": true}', '{"c d": 1.50, "a": "x"}']
    (tmp_path / "a.json").write_text("\n".join(objects) if lines else "[" + ",\n".join(objects) + "]")
    df = readers.import_json(spark, str(tmp_path / "a.json"), lines)
    assert df.columns == ["z", "b", "a", "c d"]
    assert [tuple(r) for r in df.collect()] == [("1", '{"y": [1, 2]}', None, None), ("true", "t", None, None), (None, None, "x", "1.50")]


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def stored(spark):
    """A database table: text keys with quotes, a null in the key."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    df = spark.createDataFrame([(f"o'{k % 3}" if k else None, k, f"n{k}") for k in range(20)], "a string, b long, c string")
    df.where("a is not null").repartition(1).write.format("jdbc").options(url=url, dbtable="t", createTableColumnTypes="a varchar(8), c varchar(8)", **DERBY).save()
    databases._execute(spark, url, DERBY, ["INSERT INTO t (\"b\", \"c\") VALUES (0, 'n0')"])
    return url, df


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["b", "a"], ["b"], ["c"]])
@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_databases_are_read_by_any_key(spark, stored, keys, partitions):
    url, df = stored
    found = readers.jdbc(spark, url, "t", keys, partitions, DERBY)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
    assert min(partitions, 2) <= found.rdd.getNumPartitions() <= min(partitions, 21)


def test_ranges_of_an_empty_table(spark, stored):
    url, _ = stored
    databases._execute(spark, url, DERBY, ["DELETE FROM t"])
    assert readers.jdbc(spark, url, "t", ["a", "b"], 3, DERBY).count() == 0
    assert readers.jdbc(spark, url, "t", "b", 3, DERBY).count() == 0


def test_changes_are_written_in_one_transaction(spark, stored):
    url, _ = stored
    upserts = spark.createDataFrame([("n5", 5, "five"), ("x", 100, "new")], "c string, b long, a string").select("a", "b", "c")
    gone = spark.createDataFrame([(7,), (7,), (8,), (999,)], "b long")
    assert databases.apply_changes(url, "t", ["b"], upserts, gone, properties=DERBY) == {"written": 2, "deleted": 2}
    now = {r.b: (r.a, r.c) for r in readers.jdbc(spark, url, "t", properties=DERBY).collect()}
    assert len(now) == 19 and now[5] == ("five", "n5") and now[100] == ("new", "x") and 7 not in now and 8 not in now
    with pytest.raises(apply.KeyConflict):
        databases.apply_changes(url, "t", ["b"], upserts.unionByName(upserts), properties=DERBY)
    with pytest.raises(ValueError, match="lack"):
        databases.apply_changes(url, "t", ["b"], upserts.drop("c"), properties=DERBY)


def test_a_failed_transaction_leaves_the_table(spark, stored):
    url, _ = stored
    with pytest.raises(Exception, match="NOWHERE"):
        databases._execute(spark, url, DERBY, ["DELETE FROM t", "DELETE FROM nowhere"])
    assert readers.jdbc(spark, url, "t", properties=DERBY).count() == 20


def test_result_as_one_json_array(users):
    text = writers.result_json(users.withColumn("x", F.lit(None).cast("int")), ["id"]).first().json
    assert json.loads(text)[1] == {"id": 2, "name": "bob", "age": 25, "x": None} and "\n" in text
    assert writers.result_json(users.limit(0), ["id"], pretty=False).first().json == "[]"
    with pytest.raises(Exception, match="more than 2 rows"):
        writers.result_json(users, ["id"], 2).collect()


@pytest.mark.parametrize("sql", ["execute immediate 'drop table x'", "call proc()", "begin drop table x; end", "set a.b = 1", "explain execute immediate 'drop table x'", "EXPLAIN FORMATTED insert into t select 1", "reset", "use x", "select 1; select 2"])
def test_statements_that_are_not_known_to_read(spark, sql):
    assert not free_sql.is_read_only(spark, sql)


RUNS_CODE = [
    "select transform(1) using 'cat' as (a)",
    "with a as (select transform(1) using 'cat' as (a)) select * from a",
    "select reflect('java.lang.System', 'getProperty', 'user.home')",
    "select 1 where exists (select `Java_Method`('java.util.UUID', 'randomUUID'))",
    "select max(a) over w from t window w as (order by try_reflect('java.util.UUID', 'randomUUID'))",
    "select identifier('reflect')('java.util.UUID', 'randomUUID')",
    "explain select transform(array(1), x -> system.builtin.reflect('java.util.UUID', 'randomUUID'))",
]


@pytest.mark.parametrize("sql", RUNS_CODE)
def test_queries_that_run_programs_are_refused(spark, sql):
    assert not free_sql.is_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["select 'reflect(' as reflect", "select transform(a, x -> x + 1) from t", "select sum(a) over w from t window w as (order by b)", "with r as (select 1 as a) select (select max(a) from r) from r"])
def test_like_them_but_harmless(spark, sql):
    assert free_sql.is_read_only(spark, sql)


def test_values_that_cannot_be_cast_are_differences(spark):
    source = spark.createDataFrame([(1, "n/a", "5"), (2, "7", "x"), (3, None, "1"), (4, "1.0", "1")], "id int, v string, w string")
    target = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, None, 1), (4, 1, 1)], "id long, v int, w int")
    assert counts(diff.summary(source, target, ["id"])) == (0, 2, 0)
    assert rows(diff.changed_cells(source, target, ["id"])) == [(1, "v", None, "n/a"), (2, "w", None, "x")]
    assert sorted(r.id for r in diff.updated(source, target, ["id"]).collect()) == [1, 2]
    assert not verify.full(source, target, ["id"]).first().passed
    assert diff.multiset_diff(source, target).count() == 4
    odd = spark.createDataFrame([("x", "1", "1"), ("4", "1", "1")], "id string, v string, w string")
    assert counts(diff.summary(odd, target, ["id"])) == (1, 0, 3)


def test_any_column_names(spark):
    source = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "`k.1` int, `_in` string, `a.b` string")
    target = spark.createDataFrame([(1, "a", "z"), (3, "c", "w")], "`k.1` int, `_in` string, `a.b` string")
    keys = ["k.1"]
    assert rows(apply.merged(source, target, keys)) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "w")]
    assert diff.diff_page(source, target, keys, "update").first()[:] == (1, "update", "a", "x", "a", "z")
    assert rows(diff.changed_cells(source, target, keys)) == [(1, "a.b", "z", "x")]
    assert sorted(r.pk_key for r in diff.diff_keys(source, target, keys).collect()) == ["1\x1f", "2\x1f", "3\x1f"]
    assert diff.samples(source, target, keys, 5).count() == 2
    assert project.filtered(source, [Filter("K.1", "=", 1), Filter("A.B", "like", "x")]).count() == 1


@pytest.mark.parametrize("cap", [1, 7, 1000])
def test_first_keys_by_ranges(spark, cap):
    source = spark.range(300).selectExpr("id", "id % 5 AS v")
    target = source.where("id % 3 > 0").selectExpr("id", "if(id % 7 = 0, -1, v) AS v").unionByName(spark.range(1000, 1050).selectExpr("id", "0L AS v"))
    found = {}
    for r in diff.diff_keys(source, target, ["id"], cap).collect():
        found.setdefault(r.change_type, []).append((r.position, int(r.pk_key[:-1]), r.truncated))
    want = {"insert": [k for k in range(300) if k % 3 == 0], "update": [k for k in range(300) if k % 3 and k % 7 == 0], "delete": list(range(1000, 1050))}
    assert {c: sorted(x) for c, x in found.items()} == {c: [(n, k, len(ks) > cap) for n, k in enumerate(ks[:cap], 1)] for c, ks in want.items()}


def test_partition_values_keep_their_text(spark, tmp_path):
    shape = "id int, name string, p string"
    spark.createDataFrame([(1, "a", "01"), (2, "b", "1"), (3, "c", "x=1")], shape).write.partitionBy("p").parquet(str(tmp_path / "t"))
    source = spark.createDataFrame([(1, "A", "01"), (2, "b", "1"), (3, "c", "x=1")], shape)
    assert rows(apply.merge_into_path(source, str(tmp_path / "t"), ["id"], ["p"])) == [("01", 0, 1, 0)]
    assert sorted(p.name for p in (tmp_path / "t").glob("p=*")) == ["p=01", "p=1", "p=x%3D1"]
    with pytest.raises(apply.KeyConflict):
        apply.merge_into_path(source.unionByName(source), str(tmp_path / "t"), ["id"], ["p"])


def test_a_failed_check_leaves_the_path(spark, users, tmp_path):
    path = str(tmp_path / "u")
    users.where("id = 1").selectExpr("id + 90 AS id", "name", "age").write.parquet(path)
    selections = {n: TableSelection(["id"]) for n in "uvw"}
    sources, targets = {"u": users, "v": users, "w": users.unionByName(users)}, {"u": spark.read.parquet(path), "v": users.limit(0), "w": users}
    done, rep = report.sync_tables(spark, sources, targets, selections, {"u": path}, parallel=4)
    told = {r.table: r for r in rep.collect()}
    assert spark.read.parquet(path).count() == 1 and list(done) == ["v"] and "same key" in told["w"].error
    assert told["u"].verified is False and "check failed" in told["u"].error and told["v"].verified and told["v"].error is None
    _, serial = report.sync_tables(spark, {"v": users}, {"v": users.limit(0)}, {"v": TableSelection(["id"])}, parallel=1)
    assert rows(serial) == [tuple(told["v"])]


def test_a_failed_rename_keeps_the_old_table(spark, users, tmp_path):
    path = str(tmp_path / "t")
    users.write.parquet(path)
    with pytest.raises(OSError):
        staging.publish(spark, str(tmp_path / "nowhere"), path)
    assert spark.read.parquet(path).count() == 3


def test_lengths_and_whole_tables_in_changes(spark):
    shape = "`table` string, `column` string, position int, native_type string, length int, nullable boolean"
    before = spark.createDataFrame([("t", "a", 0, "varchar", 10, True), ("t", "b", 1, "a|", None, True), ("old", "x", 0, "int", None, True)], shape)
    after = spark.createDataFrame([("t", "a", 0, "varchar", 20, True), ("t", "b", 1, "a|", None, True), ("new", "x", 0, "int", None, True)], shape)
    assert rows(schema.diff_columns(before, after)) == [("new", "x", "added"), ("old", "x", "dropped"), ("t", "a", "altered")]
    assert rows(schema.changes(before, after, tables=True)) == [("new", "new", "create_table", False), ("old", "old", "drop_table", True), ("t", "a", "alter_column", True)]
    assert rows(schema.change_counts(before, after, tables=True)) == [("new", 1), ("old", 1), ("t", 1)]
