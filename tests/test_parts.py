"""Tabularizing, schemas, generation, find and replace, sources, sinks, streams."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.dynamic.evaluator import evaluate
from docloom.dynamic.table import table_to_csv, to_table
from docloom.engine import Engine
from docloom.errors import JsonError, QueryError
from docloom.operators import find, generate, schemas
from docloom.operators.tabularize import classify, tabularize
from docloom.sources import globs, readers, sinks

ROUTES = [{"line": "a", "depot": {"floor": 1, "street": "x"}, "trains": [{"kind": "p", "cars": [1, 2]}, {"kind": "q", "cars": [3]}]}, {"line": "b", "depot": {"floor": 2, "street": "y"}, "trains": []}]


@pytest.fixture(scope="module")
def routes(spark):
    return spark.createDataFrame([(t["line"], (t["depot"]["floor"], t["depot"]["street"]), [(p["kind"], p["cars"]) for p in t["trains"]]) for t in ROUTES], "line string, depot struct<floor: long, street: string>, trains array<struct<kind: string, cars: array<long>>>")


def test_tabularize_in_both_lanes(routes):
    rows = [r.asDict() for r in tabularize(routes, "d").collect()]
    assert sorted(rows, key=str) == sorted(to_table(ROUTES), key=str)
    assert len(rows) == 3 and rows[0]["depot.floor"] == 1


def test_tabularize_strategies(routes):
    wide = tabularize(routes.select("line", "depot"), "r")
    assert wide.columns == ["line", "depot.floor", "depot.street"]
    assert tabularize(routes, "s").first()["depot"] == '{"floor":1,"street":"x"}'
    with pytest.raises(QueryError):
        tabularize(routes, "n")
    assert to_table([{"a": [1, 2], "b": ["x"], "c": 5}]) == [{"a": 1, "b": "x", "c": 5}, {"a": 2, "b": "", "c": 5}]
    assert to_table([[1, 2], [3, 4]]) == [{"col1": 1, "col2": 2}, {"col1": 3, "col2": 4}]
    assert to_table([{"a": {"b": [1]}}], "r") == [{"a.b.col1": 1}]
    with pytest.raises(QueryError):
        to_table({"a": [{"x": 1}], "b": [{"y": 1}]})
    assert classify(routes.schema) == "BAD" and classify(routes.schema["depot"].dataType) == "ROW"
    assert table_to_csv([{"b": True, "a": 'x"y'}, {"a": None}], bools_as_ints=True) == 'a,b\n"x""y",1\n,'


def test_schema_inference(spark):
    docs = ['{"a": 1, "b": [1, 2.5]}', '{"a": null, "c": {"d": "x"}}', '{"a": 2}', "not json", None]
    df = spark.createDataFrame([(d,) for d in docs], "value string").repartition(3)
    got, unreadable = schemas.infer_counted(df)
    assert unreadable == 1 and schemas.infer(df) == got
    assert got["type"] == "object" and got["required"] == ["a"]
    assert got["properties"]["a"] == {"type": ["integer", "null"]} and got["properties"]["b"] == {"type": "array", "items": {"type": "number"}}
    assert schemas.as_schema(schemas.partial([1, [2], {"a": 3}]))["items"]["anyOf"][0] == {"type": "integer"}


SCHEMA = {
    "type": "object", "required": ["a"], "$defs": {"t": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}},
    "properties": {"a": {"type": "number", "minimum": 1, "exclusiveMaximum": 9}, "s": {"type": "string", "pattern": "^[a-c]+$", "minLength": 2, "maxLength": 4}, "e": {"enum": [1, "x"]},
                   "l": {"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 3, "contains": {"minimum": 5}}, "n": {"$ref": "#/$defs/t"}},
    "patternProperties": {"^z": {"type": "boolean"}},
}


@pytest.mark.parametrize(
    ("value", "kinds"),
    [({"a": 1, "s": "abc", "e": "x", "l": [5], "n": {"a": 2}, "z1": True}, []), ({}, ["required"]), ({"a": 9}, ["exclusiveMaximum"]), ({"a": 0.5}, ["minimum"]), ({"a": "x"}, ["type"]), ({"a": 1, "s": "d"}, ["pattern", "minLength"]),
     ({"a": 1, "s": "aaaaa"}, ["maxLength"]), ({"a": 1, "e": 2}, ["enum"]), ({"a": 1, "l": []}, ["minItems", "contains"]), ({"a": 1, "l": [1, 2.5, 6, 7]}, ["maxItems", "type"]), ({"a": 1, "n": {"b": 1}}, ["anyOf"]), ({"a": 1, "zz": 1}, ["type"]), ([], ["type"])],
)
def test_validation(value, kinds):
    assert [k for k, _, _ in schemas.problems(SCHEMA, value)] == kinds


def test_validation_of_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "x", None), (2, 2.5, None, True)], "a long, b double, c string, d boolean")
    schema = {"properties": {"a": {"type": "number", "maximum": 1}, "b": {"type": "integer"}, "c": {"type": "string"}, "d": {"type": ["boolean", "null"]}, "e": {}}, "required": ["c", "e"]}
    rows = [r["problems"] for r in schemas.validate_columns(df, schema).orderBy("a").collect()]
    assert rows == [["e:required"], ["a:maximum", "b:type", "c:type", "c:required", "e:required"]]


def test_validation_of_documents(spark):
    df = spark.createDataFrame([('{"a": 1}', "x/a.json"), ("{}", "x/a.json"), ("[", "b.txt")], "value string, path string")
    assert [len(r["problems"]) for r in schemas.validate(df, SCHEMA).collect()] == [0, 1, 1]
    assert [len(r["problems"]) for r in schemas.validate_files(df, {r"\.json$": SCHEMA}).collect()] == [0, 1, 0]


def test_generated_documents_are_valid(spark):
    r = random.Random(14)
    for _ in range(50):
        generate.generate(SCHEMA, r, patterns=True)
    simple = {k: v for k, v in SCHEMA.items() if k != "properties"} | {"properties": {k: SCHEMA["properties"][k] for k in ("a", "e", "n")}}
    for _ in range(50):
        assert not list(schemas.problems(simple, generate.generate(simple, r)))
    for p in (r"^[a-c]{2,4}\d+(x|yz)?$", r"(\w)\1-[^a-y ]", r"\s*0x[\da-f]+"):
        for _ in range(20):
            assert re.search(p, generate.matching(p, r))
    a, b = (sorted(x["value"] for x in generate.documents(spark, simple, 10, seed=3).collect()) for _ in range(2))
    assert a == b and len(a) == 10 and all(json.loads(x) is not None for x in a)


def test_find_and_replace():
    doc = {"abc": "x1", "d": ["abc", {"e": "ABC"}], "f": 5}
    assert evaluate(find.find_query("abc", "keys"), doc) == ["x1"]
    assert evaluate(find.find_query("abc", exact=True), doc) == ["abc"]
    assert evaluate(find.find_query("abc", ignore_case=True), doc) == ["abc", "ABC"]
    assert evaluate(find.find_query("> 4", math=True), {"a": 5, "b": 3}) == [5]
    assert evaluate(find.replace_query(find.find_query("abc", exact=True), "b", "-"), doc)["d"][0] == "a-c"


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("{'x': 1, // c\n}")
    (tmp_path / "in" / "b.json").write_text("@")
    (tmp_path / "in" / "c.txt").write_text("no")
    found = {r["path"].rsplit("/", 1)[-1]: r for r in readers.grep(spark, str(tmp_path / "in"), "*.json\n*.jsonc").collect()}
    assert set(found) == {"a.json", "b.json"} and found["a.json"]["json"] == '{"x": 1}' and found["b.json"]["level"] == "FATAL"
    (tmp_path / "t.csv").write_text('a;b\n1;"x;y"\n2;"q""r"\n')
    assert sorted(tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv")).collect()) == [("1", "x;y"), ("2", 'q"r')]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    for breaks in (True, False):
        rows = sorted((r["a"], r["b"], r["bad"]) for r in readers.csv(spark, str(tmp_path / "bad.csv"), malformed="bad", line_breaks=breaks).collect())
        assert [r[2] for r in rows] == [None, "3", "4,5,6"] and rows[0][:2] == ("1", "2")
    assert readers.csv(spark, str(tmp_path / "bad.csv")).collect() == [("1", "2")]
    assert readers.sniff("a\tb\n1\t2\n") == ("\t", "\n", 2) and readers.sniff("hello") == (None, None, -1)
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read(spark, str(tmp_path / "l.jsonl")).count() == 2
    text = "; c\n[s]\na = 1\nb: x\n  y\n[t]\nc=é\n"
    assert readers.ini(text) == {"s": {"a": "1", "b": "x\ny"}, "t": {"c": "é"}}
    for bad in ("a=1", "[s]\na=1\na=2", "[s]\n[s]", "[s]\nnothing"):
        with pytest.raises(JsonError):
            readers.ini(bad)
    (tmp_path / "c.ini").write_text(text)
    assert readers.ini_files(spark, str(tmp_path / "c.ini")).first()["sections"] == readers.ini(text)
    lines = spark.createDataFrame([("a 1\nb -2",), (None,)], "value string")
    assert [tuple(r) for r in readers.by_pattern(lines, "value", r"^(\w) (INT)$").collect()] == [("a", "1"), ("b", "-2")]
    assert readers.urls(spark.createDataFrame([("http://127.0.0.1:9/x",)], "url string")).first()["error"]


def test_globs():
    match = re.compile(globs.matcher("*.json\ndata/**/x?.txt")).search
    assert match("/a/B.JSON") and match("data/q/r/x1.txt") and not match("a.jsonl") and not match("x1.txt")
    test = globs.compiled("*.{json,txt} !a* | <b* [0-9]*>")
    assert test("c.json") and not test("a.json") and not test("b.csv") and test("x/c.txt")
    with pytest.raises(QueryError):
        globs.compiled("<a")


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([('{"b": {"x": "1"}, "a": {}}',), ("[",), (None,)], "value string")
    assert [r["text"] for r in sinks.formatted(docs, "c").collect()] == ['{"a": {}, "b": {"x": "1"}}', None, None]
    assert sinks.formatted(docs, "ini").first()["text"] == "[b]\nx=1\n[a]\n"
    sinks.write_csv(spark.createDataFrame([(True, "x,\"y")], "b boolean, a string").coalesce(1), str(tmp_path / "o"), bools_as_ints=True)
    assert next((tmp_path / "o").glob("part-*")).read_text() == 'a,b\n"x,""y",1\n'
    texts = spark.createDataFrame([("a\"b\n",)], "v string")
    assert sinks.from_json_strings(sinks.to_json_strings(texts, "v"), "v").first()["v"] == 'a"b\n'
    assert sinks.to_json_strings(texts, "v").first()["v"] == '"a\\"b\\n"'


def test_stream(spark, sf_dir, tmp_path):
    from docloom.errors import Untyped
    from docloom.streaming.stream import stream_query

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, text, mode in (("rows", "@[:][@.value > 50]{k: @.event_id}", "append"), ("groups", "group_by(@, event_type).*{n: len(@)}", "complete")):
        q = stream_query(spark, text, stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, Engine(spark).query(text, table).collect()))
    with pytest.raises(Untyped):
        stream_query(spark, "@", table)


def test_query_documents(spark):
    docs = spark.createDataFrame([('{"a": [1, 2]}',), ("{a: 'x'}",), ("]",), (None,)], "value string")
    rows = Engine(spark).query_documents("sum(@.a)", docs).collect()
    assert [r["result"] for r in rows] == ["3.0", None, None, None] and all(r["error"] for r in rows[1:])
    with pytest.raises(QueryError):
        Engine(spark).query_documents("sum(", docs)


def test_lints(spark):
    from docloom.dynamic.lane import lints

    r = lints(spark.createDataFrame([("{a: 1}",)], "value string")).select("json", "level", F.size("lints").alias("n")).first()
    assert tuple(r) == ('{"a": 1}', "JSON5", 1)


def test_sorting_inside_documents(spark):
    from docloom.operators import sorting

    docs = spark.createDataFrame([('{"a": ["b", "C", "a"], "n": {"x": [3, 1], "y": [2, 9, 4]}}',), ("{",), (None,)], "value string")
    first = lambda **how: sorting.sort_documents(docs, **how).first()["result"]
    assert first(path="@.a") == '{"a": ["a", "b", "C"], "n": {"x": [3, 1], "y": [2, 9, 4]}}'
    assert first(path="@.n", many=True, descending=True) == '{"a": ["b", "C", "a"], "n": {"x": [3, 1], "y": [9, 4, 2]}}'
    assert first(path="@.n.y", by="@ % 4") == '{"a": ["b", "C", "a"], "n": {"x": [3, 1], "y": [4, 9, 2]}}'
    assert first(path="@.n.y", as_text=True, descending=True).endswith('"y": [9, 4, 2]}}')
    shuffled = [first(path="@.n.y", seed=k) for k in (1, 1, 2, 3, 4)]
    assert shuffled[0] == shuffled[1] and len(set(shuffled)) > 1 and all(sorted(json.loads(x)["n"]["y"]) == [2, 4, 9] for x in shuffled)
    rows = sorting.sort_documents(docs, "@.a", ignore_case=True).collect()
    assert [r["error"] is None for r in rows] == [True, False, False]
    assert sorting.sort_documents(docs, "@.n").first()["error"] == "only an array can be sorted"


def test_sorting_and_shuffling_relations(spark):
    from docloom.operators import sorting

    df = spark.createDataFrame([("b", 1), ("A", 2), (None, 3), ("a", 4)], "s string, n long")
    assert [r["n"] for r in sorting.sort_relation(df, "s", "-n", ignore_case=True).collect()] == [3, 4, 2, 1]
    assert [r["n"] for r in sorting.sort_relation(df, "-s").collect()] == [1, 4, 2, 3]
    orders = [[r["n"] for r in sorting.shuffle(df, seed).collect()] for seed in (1, 1, 2, 3, 4, 5)]
    assert orders[0] == orders[1] and len({tuple(o) for o in orders}) > 1 and all(sorted(o) == [1, 2, 3, 4] for o in orders)


def test_dson():
    from docloom.dynamic.writer import dson

    assert dson({"a": 8, "b": [True, None, "x"], "c": {}, "d": [], "e": -9.5, "f": 1}) == 'such "a" is 10, "b" is so yes and empty also "x" many. "c" is such wow! "d" is so many? "e" is -11.5, "f" is 1 wow'
    assert dson([2.5e30, -(1 << 63), 3.0]) == "so 2.5VERY36 and 1000000000000000000000 also 3 many"
    with pytest.raises(ValueError):
        dson(float("nan"))


def test_node_paths(spark):
    from docloom.dynamic.lane import node_paths

    docs = spark.createDataFrame([(7, '{"a": [1, {"b c": null}]}'), (8, "]")], "id long, value string")
    assert [tuple(r) for r in node_paths(docs).collect()] == [(7, "@", "object", '{"a": [1, {"b c": null}]}'), (7, "@.a", "array", '[1, {"b c": null}]'), (7, "@.a[0]", "integer", "1"), (7, "@.a[1]", "object", '{"b c": null}'), (7, "@.a[1][`b c`]", "null", "null")]
    assert [r["path"] for r in node_paths(docs, style="python", scalars_only=True).collect()] == ["['a'][0]", "['a'][1]['b c']"]


def test_selections(spark):
    from docloom.dynamic.lane import selections

    texts = spark.createDataFrame([("x [1] y {a: 2}", [(2, 5), (8, 14)]), ("é[3]", [(1, 4)]), ("[", [(0, 1)]), (None, None)], "value string, spans array<struct<start: long, end: long>>")
    rows = selections(texts).collect()
    assert [r["document"] for r in rows] == ['{"2,5": [1], "8,14": {"a": 2}}', '{"1,4": [3]}', None, None] and rows[2]["error"].startswith("0,1: ")


def test_grep_as_one_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[2]")
    (tmp_path / "c.json").write_text("@")
    one = readers.grep_object(spark, str(tmp_path))
    (row,) = Engine(spark).query_documents("keys(@)[:]->s_find(@, g`[a-z]\\.json$`)[0]", one).collect()
    assert row["result"] == '["a.json", "b.json"]'
    with pytest.raises(QueryError):
        readers.grep_object(spark, str(tmp_path), most=3)
