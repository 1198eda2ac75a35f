import json
import random

import duckdb

from graphweave.operators.nested import KINDS, child_tables, flatten, is_json, nested_children


def holds(v):
    if isinstance(v, str) and v.strip()[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def brute(rows):
    out = set()

    def walk(v, rid, a):
        v = holds(v)
        if isinstance(v, dict):
            for k, x in v.items():
                x = holds(x)
                if k in KINDS:
                    for i, e in enumerate([x] if isinstance(x, dict) else x if isinstance(x, list) else []):
                        if isinstance(holds(e), dict):
                            out.add((rid, a, k, i))
                walk(x, rid, a)
        elif isinstance(v, list):
            for x in v:
                walk(x, rid, a)

    for rid, p in rows:
        if not parses(p):
            continue
        v = json.loads(p)
        found = holds(v.get("annotations")) if isinstance(v, dict) else None
        for i, a in enumerate([found] if isinstance(found, dict) else found if isinstance(found, list) else []):
            walk(a, rid, i)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    return {tuple(x)[:4] for x in nested_children(df, "record_id", "payload").collect()}


def test_generated_payloads(spark):
    r = random.Random(3)

    def value(depth):
        kind = r.random()
        if depth > 4 or kind < 0.25:
            return r.choice([None, 1, -2.5e3, True, "", "a\"b\\", "n/a", "{", "[1,", "ü\U0001f600", "{}", "[]", " {\"nodes\": [{}, 3, {\"id\": 1}]}"])
        if kind < 0.6:
            keys = r.sample(["nodes", "links", "segments_info", "x", "annotations", "scene_graph", "no\"des", "label"], r.randint(0, 5))
            return {k: value(depth + 1) for k in keys}
        if kind < 0.9:
            return [value(depth + 1) for _ in range(r.randint(0, 4))]
        return json.dumps(value(depth + 1))

    rows = []
    for i in range(400):
        v = {"annotations": value(1), "nodes": [{}]} if r.random() < 0.9 else value(0)
        text = json.dumps(v, indent=r.choice([None, None, 2]), ensure_ascii=r.random() < 0.5)
        rows.append((i, text[: r.randint(0, len(text))] if r.random() < 0.2 else text))
    assert found(spark, rows) == brute(rows)
    assert len(brute(rows)) > 100


def parses(text):
    def reject(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=reject)
    except ValueError:
        return False
    return True


def test_completeness_against_a_parser():
    r = random.Random(8)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"', "\\", "1", "-", "0", ".5", "e", "true", "null", "fals", "false", " ", "\n", '"x":', '"\\u00e9"', '"\\u0g"', "\t", "\u00e9"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert is_json(t) == parses(t), t
    whole = json.dumps({"a": [1, -2.5e3, True, None, {"b": "x\\\"", "c": []}], "d": {}})
    for _ in range(3000):
        k = r.randrange(len(whole))
        t = whole[:k] + r.choice(["", r.choice(parts)]) + whole[k + r.randint(0, 1) :]
        assert is_json(t) == parses(t), t


def test_objects_of_one_place_are_kept(spark):
    text = '{"annotations":[{"nodes":[{"id":1,"links":[{"s":1},{"s": 2}]}],"inner":{"nodes":[{"id":2},{"id":2}]}, "x": "{\\"nodes\\": {\\"id\\": 3}}"}]}'
    df = spark.createDataFrame([(1, text), (1, text), (1, text.replace('"id":1', '"id":7'))], "record_id int, payload string")
    rows = nested_children(df, "record_id", "payload")
    nodes = {(x["path"], x["id"]) for x in child_tables(rows)["nodes"].collect()}
    assert nodes == {("$.annotations[0].nodes[0]", 1), ("$.annotations[0].nodes[0]", 7), ("$.annotations[0].inner.nodes[0]", 2), ("$.annotations[0].inner.nodes[1]", 2), ("$.annotations[0].x.nodes", 3)}
    assert {x["path"] for x in rows.where("kind = 'links'").collect()} == {f"$.annotations[0].nodes[0].links[{k}]" for k in (0, 1)}
    assert nested_children(df, "record_id", "payload", body=False).count() == 4
    assert nested_children(df, "record_id", "payload", body=False, kinds=("links",)).count() == 2


def test_edge_cases(spark):
    deep = '{"annotations": [' + '{"x": [' * 60 + '{"nodes": [{"id": 1}]}' + "]}" * 60 + "]}"
    long = json.dumps({"annotations": [{"nodes": [{"id": i, "label": "x" * 50} for i in range(20000)]}]})
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "3"), (6, '{"annotations": null}'), (7, '{"annotations": {"links": {"s": 1}}}'), (8, deep), (8, deep), (9, long), (None, '{"annotations": [{"nodes": [{}]}]}'), (10, '{"annotations": [{"nodes": [NaN, {}]}]}')]
    got = found(spark, rows)
    assert (7, 0, "links", 0) in got and (8, 0, "nodes", 0) in got and (None, 0, "nodes", 0) in got
    assert len([x for x in got if x[0] == 9]) == 20000 and not [x for x in got if x[0] in (1, 2, 3, 4, 5, 6, 10)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    assert nested_children(df, "record_id", "payload").where("record_id = 8").count() == 1  # repeated record


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "record_id bigint, payload string")
    assert nested_children(df, "record_id", "payload").collect() == []
    df = spark.createDataFrame([(1, '{"annotations": [{"nodes": [{"id": "7", "label": "a"}, {"id": "x"}]}]}', 2, "z")], "rid int, body string, ann_no int, kind string")
    rows = child_tables(nested_children(df, "rid", "body"))["nodes"].orderBy("child_no").collect()
    assert [tuple(x)[:3] + tuple(x)[4:] for x in rows] == [(1, 0, 0, 7, "a"), (1, 0, 1, None, None)]


def test_flatten_takes_the_last_delivery(spark):
    df = spark.createDataFrame([(1, [(1, "a")], 1), (1, [(2, "b"), None, (3, None)], 2), (2, None, 1), (3, [], 1), (None, [(9, "n")], 1)], "id int, xs array<struct<i:int,l:string>>, at int")
    got = {tuple(x) for x in flatten(df, {"id": "id"}, "xs", "at", ["i", "l"]).collect()}
    assert got == {(1, 0, 2, "b"), (1, 2, 3, None), (None, 0, 9, "n")}


def test_whole_table_against_a_parser(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT record_id, payload FROM '{d}/raw_records.parquet'").fetchall()
    got = {tuple(x)[:4] for x in nested_children(spark.read.parquet(f"{d}/raw_records.parquet"), "record_id", "payload", body=False).collect()}
    assert got == brute([(i, p) for i, p in rows if p is not None])
