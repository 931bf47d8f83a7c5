"""CSV with line breaks and JSON arrays, cut by many tasks, equal what whole-file readers give."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from tidemark.queries import QUERIES
from tidemark.sources import pieces, readers, writers


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("90", "1", "60")):
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def table(seed, n=120):
    r = random.Random(seed)
    parts = ["a", '"', ",", "\n", "é", " ", "{", "}", "[", "]", "\\", "\\n", ":", "x y"]
    return [[str(k), *("".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(2))] for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv(tiny_splits, tmp_path, end):
    spark, data = tiny_splits, {}
    for name in ("a", "b"):
        data[name] = table(ord(name))
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([["k", "head\nline", ""], *data[name], ["900", "z" * 300 + "\n" + "y" * 300, ""]])
        (tmp_path / f"{name}.csv").write_text(out.getvalue() + end, newline="")
    found = readers.import_csv(spark, str(tmp_path))
    assert found.columns == ["k", "head\nline", "col3"]
    want = [*data["a"], *data["b"], *[["900", "z" * 300 + "\n" + "y" * 300, ""]] * 2]
    assert sorted([x or "" for x in r] for r in found.collect()) == sorted(want)
    assert pieces.pieces(spark, str(tmp_path), pieces.CSV).rdd.getNumPartitions() > 20
    if end == "\r\n":
        return  # the whole-file reader takes an empty line of these for a row
    whole = spark.read.options(multiLine=True, header=True, quote='"', escape='"', emptyValue="", nullValue="\x00").csv(str(tmp_path))
    assert sorted(map(tuple, found.fillna("-").collect())) == sorted(map(tuple, whole.fillna("-").collect()))


def test_csv_quotes_inside_a_field_are_signs(tiny_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,x\n6" pipe,"two\nlines"\n7,"say ""hi"",\n"""\n' * 1 + "".join(f'{k}",q"\n' for k in range(60)))
    found = readers.import_csv(tiny_splits, str(tmp_path / "a.csv")).collect()
    assert sorted(map(tuple, found)) == sorted([('5" pipe', "x"), ('6" pipe', "two\nlines"), ("7", 'say "hi",\n"'), *[(f'{k}"', 'q"') for k in range(60)]])


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(tiny_splits, tmp_path, indent):
    spark = tiny_splits
    data = [{"k": t[0], "t": t[1], **({"n": {"d": [{"e": "}{"}], "f": t[2]}} if int(t[0]) % 3 == 0 else {})} for t in table(7)]
    data[5]["late \" name"] = "x"
    (tmp_path / "a.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False))
    found = readers.import_json(spark, str(tmp_path / "a.json"))
    assert found.columns == ["k", "t", "n", 'late " name']
    want = sorted((d["k"], d["t"], json.dumps(d["n"]) if "n" in d else None) for d in data)
    got = sorted((r[0], r[1], json.dumps(json.loads(r[2])) if r[2] else None) for r in found.collect())
    assert got == want
    assert pieces.pieces(spark, str(tmp_path), pieces.JSON_ARRAY).rdd.getNumPartitions() > 20


def test_steps():
    for line, outside, inside in (("", 0, 1), ("a,b", 0, 1), ('"', 1, 0), ('a"b', 0, 0), ('"a""', 1, 0), ('x,"y', 1, 0), ('"a",b', 0, 0), ('"",""', 0, 1), ('""', 0, 1)):
        assert (pieces.csv_step(line, (0, 0))[0], pieces.csv_step(line, (1, 0))[0]) == (outside, inside), line
    assert pieces.json_step('[{"a": "x', (0, 0)) == (1, 2) and pieces.json_step('y\\"z", "b": 1', (1, 2)) == (0, 1)


BROKEN = [
    '{"a": 1, "b": {"c": 2}}', '[1, {"a": 1}]', '[{"a": 1}, null, {"a": 2}]', '[{"a": 1},{"a": 2', '[{"a": 1},{"a": 2}', '[{"a": 1},{"a": "x',
    '[{"a": 1},{"a":,},{"a": 3}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}],{"a": 2}]', '[{"a": 1}]]', '[{"a": 1},]', "nonsense", '[[{"a": 1}]]',
]


@pytest.mark.parametrize("text", BROKEN)
def test_json_that_is_no_array_of_objects(tiny_splits, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ValueError, match="b.json"):
        readers.import_json(tiny_splits, str(tmp_path / "b.json"))


def test_json_lines_and_marks(tiny_splits, tmp_path):
    spark = tiny_splits
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{}\n{"b": {"c": 2}}\n')
    got = readers.import_json(spark, str(tmp_path / "l.json"), lines=True)
    assert got.columns == ["a", "b"] and sorted(map(str, map(tuple, got.collect()))) == ["('1', None)", "(None, '{\"c\": 2}')", "(None, None)"]
    (tmp_path / "n.json").write_text('[{"n": {"c": 1.50}}, {"n": {"d": [true, null]}}, {"n": [1, "x"]}, {"n": 1e3}, {"n": "t"}]')
    assert sorted(r.n for r in readers.import_json(spark, str(tmp_path / "n.json")).collect()) == sorted(['{"c": 1.50}', '{"d": [true, null]}', '[1, "x"]', "1e3", "t"])
    (tmp_path / "m.json").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(ValueError, match="m.json"):
        readers.import_json(spark, str(tmp_path / "m.json"), lines=True)
    many = tmp_path / "many"
    many.mkdir()
    (many / "1.json").write_text('\ufeff[{"a": 1}, {},\n{"a": 2}]\n')
    (many / "2.json").write_text(" [ ] ")
    (many / "3.json").write_text('[{"a": "]}{["}]')
    assert sorted(str(r.a) for r in readers.import_json(spark, str(many)).collect()) == ["1", "2", "None", "]}{["]
    (many / "4.json").write_text('[{"a": 1}')
    with pytest.raises(ValueError, match="4.json"):
        readers.import_json(spark, str(many))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]\n")
    assert readers.import_json(spark, str(tmp_path / "a.json")).columns == []
    (tmp_path / "b.json").write_text('[\n {"a": 1}\n]')
    assert [tuple(r) for r in readers.import_json(spark, str(tmp_path / "b.json")).collect()] == [("1",)]


@pytest.mark.parametrize("n", [1, 500])
def test_each_exported_file_is_one_array(spark, tmp_path, n):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        rows = spark.range(0, n, 1, 5).selectExpr("cast(id as string) AS k", "concat('}],{\"', id) AS t", "if(id % 3 = 0, null, 'x') AS o")
        writers.export_json_arrays(rows, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    whole = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert len(whole) == 5 and sum(map(len, whole)) == n
    found = readers.import_json(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_import_json_array_of_many_tasks(spark, tmp_path):
    """Arrays that several tasks of a shuffle write must not share a file."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.range(0, 3000, 1, 8).selectExpr("id AS event_id", "concat('t', id) AS event_type", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
        assert QUERIES["import_json_array"](spark, str(tmp_path)).count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
