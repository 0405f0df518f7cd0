import json

from pyspark.sql import functions as F

from storyloom.operators import shred as S

SCHEMA = "row_id bigint, activity_id string, activity_name string, events string"
REF = {"document_id": "d", "line_start": 1, "line_end": 2}


def leaves(spark, *events):
    df = spark.createDataFrame([(k, "a", "n", e) for k, e in enumerate(events)], SCHEMA)
    return sorted(map(tuple, S.timeline_leaves(df).collect()))


def test_shapes_of_one_tree(spark):
    event = {"event": "x", "sources": [{"text": "s", "references": [REF, REF]}]}
    plain = json.dumps([event])
    for shape in (plain, json.dumps(event), json.dumps(plain), json.dumps([json.dumps(event)]), json.dumps(json.dumps(plain))):
        assert leaves(spark, shape) == [(0, 0, 0, 0), (0, 0, 0, 1)]
    held = {"event": "x", "sources": json.dumps({"text": "s", "references": json.dumps([REF])})}
    assert leaves(spark, json.dumps([held])) == [(0, 0, 0, 0)]


def test_missing_children_and_positions(spark):
    got = leaves(
        spark,
        None, "null", "[]", "5", '"none"', "not json", "", "[NaN]", "[1,",
        json.dumps([None, {"event": 1}, 7, {"sources": [None, {"references": "none"}, {"references": [None, REF]}]}]),
    )
    assert got == [(k, -1, -1, -1) for k in range(5)] + [(9, 1, -1, -1), (9, 3, 1, -1), (9, 3, 2, 1)]


def test_empty_table_and_repeated_rows(spark):
    assert leaves(spark) == []
    e = json.dumps([{"sources": []}])
    df = spark.createDataFrame([(1, "a", "n", e)] * 3, SCHEMA)
    assert [tuple(r) for r in S.timeline_leaves(df).collect()] == [(1, 0, -1, -1)] * 3


def test_tables_keep_links_and_types(spark):
    row = [{"event_id": "e1", "time": {"text": "t", "year_start": 990, "year_end": "991"}, "sources": {"text": "s", "references": [dict(REF, line_end="x")]}}, {"event": {"odd": 1}}]
    df = spark.createDataFrame([(1, None, "n", json.dumps(row), "mine"), (2, "b", None, "{", "mine"), (3, "c", None, None, "mine")], SCHEMA + ", status string")
    t = S.timeline_tables(df)
    assert {r.row_id: r.status for r in t["activities"].collect()} == {1: "ok", 2: "invalid", 3: "null"}
    assert [(r.row_id, r.event_pos, r.event_id, r.time_year_start, r.time_year_end, r.event) for r in t["events"].orderBy("event_pos").collect()] == [(1, 0, "e1", 990, 991, None), (1, 1, None, None, None, None)]
    assert [tuple(r) for r in t["references"].collect()] == [(1, None, 0, 0, 0, "d", 1, None)]
    assert t["sources"].count() == 1


def test_levels_of_a_column(spark):
    df = spark.createDataFrame([(1, "a", "n", json.dumps([{"sources": [{"text": "x"}, {}]}, {}]))], SCHEMA)
    r = S.shred(df, "events", S.TIMELINE, ["row_id"], ["events/sources/text"]).select(F.col("`events/sources/text`").alias("c")).first().c
    assert (r.r, r.d, r.v) == ([0, 2, 0 + 1], [3, 2, 1], ["x", None, None])


def test_deep_and_long_records(spark):
    deep = "[" * 50_000 + "]" * 50_000
    many = json.dumps([{"sources": [{"references": [REF] * 3}] * 3}] * 500)
    got = leaves(spark, deep, many)
    assert len([g for g in got if g[0] == 1]) == 4500 and len([g for g in got if g[0] == 0]) <= 1


def test_against_plain_recursion(spark, data):
    df = spark.read.parquet(f"{data}/activity_timelines.parquet").select("row_id", "events")

    def refuse(x):
        raise ValueError(x)

    def holds(v):
        while isinstance(v, str):
            try:
                v = json.loads(v, parse_constant=refuse)
            except ValueError:
                return v
        return v

    def children(v):
        v = holds(v)
        if isinstance(v, dict):
            return [(0, v)]
        return [(k, y) for k, x in enumerate(v) if isinstance(y := holds(x), dict)] if isinstance(v, list) else []

    expected = []
    for r in df.collect():
        if r.events is None:
            expected.append((r.row_id, -1, -1, -1))
            continue
        try:
            v = json.loads(r.events, parse_constant=refuse)
        except ValueError:
            continue
        for i, e in children(v) or [(-1, {})]:
            for j, s in children(e.get("sources")) or [(-1, {})]:
                for k, _ in children(s.get("references")) or [(-1, {})]:
                    expected.append((r.row_id, i, j, k))
    assert sorted(map(tuple, S.timeline_leaves(df).collect())) == sorted(expected)


def test_nesting_beyond_the_parser_and_halves_of_pairs(spark):
    deep = '[{"event":"e","odd":' + '{"a":[' * 100_000 + "]}" * 100_000 + ',"sources":[{"text":"\\ud83d and \\ud83d\\ude00"}]}]'
    wrong = "[" * 100_000 + "]" * 99_999
    df = spark.createDataFrame([(1, "a", "n", deep), (2, "a", "n", wrong), (3, "a", "n", json.dumps([{"sources": deep}]))], SCHEMA)
    tables = S.timeline_tables(df)
    assert {r.row_id: r.status for r in tables["activities"].collect()} == {1: "ok", 2: "invalid", 3: "ok"}
    assert [r.event for r in tables["events"].where("row_id = 1").collect()] == ["e"]
    assert [r.text for r in tables["sources"].where("row_id = 1").collect()] == ["� and \U0001f600"]
    assert [tuple(r) for r in S.timeline_leaves(df).orderBy("row_id").collect()] == [(1, 0, 0, -1), (3, 0, 0, -1)]


def test_both_parsers_agree():
    texts = ['{"a":[1,-2.5e3,{"b":"x\\n\\u00e9"},[],{}],"a":null}', " [true , false] ", "3", '"s"', "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "[01]", "[NaN]", "", '["\n"]', "{]", "[}", '{1:2}', "[1]x"]

    def said(f, text):
        try:
            return f(text)
        except ValueError:
            return "invalid"

    assert [said(S._decode_deep, t) for t in texts] == [said(S._decode, t) for t in texts]
    assert [said(S._decode, t) for t in texts].count("invalid") == 12
