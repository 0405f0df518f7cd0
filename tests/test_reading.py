import hashlib
import json

import pytest
from pyspark.sql import functions as F

from storyloom.operators import localisation, read, session, snapshot, timeline
from storyloom.sources import corpus

LINE = "document_id string, line_number int, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_delivery(spark):
    t = spark.createDataFrame([(3, "d", 1, "a"), (1, "d", 1, "b"), (2, "d", 2, None), (4, None, 1, "x"), (5, "d", None, "x")], "line_id int, document_id string, line_number int, text string")
    assert rows(corpus.one_delivery(t)) == [(1, "d", 1, "b"), (2, "d", 2, None)]


def test_budgets(spark):
    t = spark.createDataFrame([("d", 1, "aaa"), ("d", 2, "bb"), ("d", 3, "cccc"), ("d", 4, None), ("e", 1, "xxxxxxxx")], LINE)
    take = lambda n, s: [(r.document_id, r.line_number) for r in read.budget_prefix(t, n, s).orderBy("document_id", "line_number").collect()]
    assert take(9, 5) == [("d", 1), ("d", 2)] and take(9, 4) == [("d", 1)] and take(9, 2) == [] and take(2, 99) == [("d", 1), ("d", 2), ("e", 1)]


def test_stream_pages_cover_each_line_once(spark):
    d = spark.createDataFrame([("c", "a", 3), ("c", "b", 0), ("c", "x", None), ("c", "y", 4)], "col string, document_id string, line_count int")
    s = read.stream(d, "col", ["document_id"])
    assert [(r["first"], r["last"]) for r in s.orderBy("ordinal").collect()] == [(1, 3), (4, 3), (4, 3), (4, 7)]
    seen = []
    for at in range(1, 9, 2):
        for r in read.stream_page(s, "col", at, 2).orderBy("ordinal").collect():
            seen += [(r.document_id, k) for k in range(r.start, r.stop + 1)]
    assert seen == [("a", 1), ("a", 2), ("a", 3), ("y", 1), ("y", 2), ("y", 3), ("y", 4)]
    assert read.stream_page(s, "col", 8, 5).count() == 0


def test_neighbours_lookup_redirect_preference(spark):
    d = spark.createDataFrame(
        [("a", None, "b", "T", "synopsis", 1), ("b", "a", "gone", "T", "story", 5), ("c", "b", None, None, "story", 5), ("e", None, None, "U", "synopsis", 5)],
        "document_id string, previous_document_id string, next_document_id string, display_title string, kind string, n int",
    )
    got = {r.document_id: (r.previous_status, r.next_status, r.previous_title) for r in read.adjacent(d).collect()}
    assert got == {"a": ("none", "there", None), "b": ("there", "dangling", "T"), "c": ("there", "none", "T"), "e": ("none", "none", None)}
    assert rows(read.lookup(d, F.col("display_title"))) == [("T", 2, None), ("U", 1, "e")]
    assert rows(read.redirect(d, F.col("kind") == "synopsis", ["display_title"])) == [("a", "b"), ("b", "b"), ("c", "c"), ("e", "e")]
    assert {r.document_id for r in read.preferred(d, "display_title", "n", "document_id").where("kept = 1").collect()} == {"b", "c", "e"}


def test_integrity(spark):
    t = spark.createDataFrame([("d", 2, "y"), ("d", 1, "x"), ("d", 3, None)], LINE)
    good = hashlib.sha256(b"x\ny\n").hexdigest()
    assert rows(read.integrity(t)) == [("d", good)]
    stated = spark.createDataFrame([("d", good), ("lost", good)], "document_id string, sha256 string")
    assert [r.document_id for r in read.verify(t, stated).collect()] == ["lost"]


def test_around(spark):
    t = spark.createDataFrame([("d", k, str(k)) for k in range(1, 8)], LINE)
    at = spark.createDataFrame([("d", 1), ("d", 6), ("q", 1)], "document_id string, line_number int")
    assert [r.line_number for r in read.around(t, at, 2, 1).orderBy("line_number").collect()] == [1, 2, 4, 5, 6, 7]


def brute(requested, shown):
    want, have = {x for a, b in requested for x in range(a, b + 1)}, {x for a, b in shown for x in range(a, b + 1)}

    def runs(s):
        out = []
        for x in sorted(s):
            if out and out[-1][1] == x - 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return [tuple(r) for r in out]

    return runs(want & have), runs(want - have), runs(want)


@pytest.mark.parametrize("requested,shown", [([(1, 5)], []), ([(1, 5)], [(1, 5)]), ([(1, 9), (3, 12)], [(2, 3), (4, 4), (8, 20)]), ([(5, 6), (8, 9)], [(1, 7)]), ([(1, 3)], [(4, 9)]), ([], [(1, 2)])])
def test_coverage(spark, requested, shown):
    schema = "user int, start int, stop int"
    r = spark.createDataFrame([(1, a, b) for a, b in requested], schema)
    s = spark.createDataFrame([(1, a, b) for a, b in shown], schema)
    reused, new, whole = brute(requested, shown)
    got = session.split(r, s, ["user"])
    pick = lambda k: sorted((x.start, x.stop) for x in got.where(F.col("kind") == k).collect())
    assert pick("reused") == reused and pick("new") == new
    assert sorted((x.start, x.stop) for x in session.merged(r, ["user"]).collect()) == whole


def test_visibility_threshold(spark):
    stored = spark.createDataFrame([(1, 1, 8), (1, 101, 110), (1, 201, 210), (2, 1, 1)], "user int, start int, stop int")
    seen = [(1, x) for x in [*range(1, 8), *range(101, 110), *range(201, 209)]]
    got = session.visible(stored, spark.createDataFrame(seen, "user int, line int"), ["user"])
    assert rows(got) == [(1, 101, 110)]


def test_sessions_end_after_the_gap(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 06:00:00"), (1, "2024-01-01 12:00:01"), (2, "2024-01-01 00:00:00")], "user int, t string").withColumn("ts", F.to_timestamp("t"))
    assert [(r.user, r.session) for r in session.sessions(t, "user", "ts").orderBy("user", "ts").collect()] == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_stream_agrees_with_batch(spark, data):
    from storyloom.plans.catalogue import QUERIES

    batch = {(r.user_id, r["first"], r.entries) for r in QUERIES["session_reset"](spark, data).collect()}
    stream = {(r.user_id, str(r["first"]), r.entries) for r in QUERIES["stream_sessions"](spark, data).collect()}
    assert {(u, n) for u, _, n in batch} == {(u, n) for u, _, n in stream} and len(batch) == len(stream)


def test_snapshot(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, x string")
    v1 = snapshot.write({"t": df}, root, "one")
    assert snapshot.current(root) == {"snapshot_id": "one", "data_version": v1}
    assert rows(snapshot.load(spark, root)["t"]) == rows(df)
    v2 = snapshot.write({"t": df.limit(1)}, root, "two")
    assert v1 != v2 and [s["snapshot_id"] for s in snapshot.snapshots(root)] == ["two", "one"]
    snapshot.activate(root, "one")
    df.limit(1).write.mode("overwrite").parquet(f"{root}/one/t.parquet")
    snapshot.write({"t": df}, root, "three")
    snapshot.activate(root, "one")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.delete(root, "one")
    snapshot.delete(root, "three")
    assert {x["snapshot_id"] for x in snapshot.snapshots(root)} == {"one", "two"}
    for bad in ("three", "../one"):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.activate(root, bad)
    with pytest.raises(snapshot.SnapshotError, match="altered"):
        snapshot.load(spark, root)
    for bad in ("../x", "/x", "a/../b", "", "a//b", "a\\b"):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.safe_path(root, bad)
    with open(f"{root}/current.json", "w") as f:
        json.dump({"snapshot_id": "one", "data_version": "short"}, f)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.current(root)


def test_digest_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    d = lambda x: snapshot.row_digest(x).first().digest
    assert d(df) == d(df.orderBy(F.desc("id"))) == d(df.select("x", "id")) and d(df) != d(df.unionByName(df)) and d(df.limit(0)) != d(df)


def test_problems(spark):
    d = spark.createDataFrame([("a", 1, None, "b"), ("b", 2, "a", "gone"), ("b", 2, "a", None)], "document_id string, line_count int, previous_document_id string, next_document_id string")
    t = spark.createDataFrame([("a", 1, "x"), ("o", 1, "x")], LINE)
    assert {(r.problem, r.id) for r in snapshot.problems(d, t).collect()} == {("repeated id", "b"), ("line count", "b"), ("orphan lines", "o"), ("dangling link", "gone")}


def test_newest_common(spark):
    a = spark.createDataFrame([("x", "2024"), ("y", "2025"), ("z", "2026")], "name string, date string")
    assert rows(snapshot.newest_common([a, a.where("name != 'z'")])) == [("y", "2025")]


def test_timeline(spark):
    e = lambda i, t, y, text: {"event_id": i, "time": {"text": t, "year_start": y}, "event": text}
    rows_ = [(1, "main_3", "X", json.dumps([e("tle_" + "a" * 24, "1000年", None, "first"), e(None, "11世纪", None, "same")])), (2, "act", "Y", json.dumps([e("tle_" + "a" * 24, "1000年", None, "first"), e("", "11世纪", None, "same")])), (3, None, None, None)]
    t = spark.createDataFrame(rows_, "row_id bigint, activity_id string, activity_name string, events string")
    ev = timeline.events(t)
    merged = {r.event: (r.activities, r.deliveries, r.year_start, r.year_end) for r in timeline.merge(ev).collect()}
    assert merged == {"first": (["X", "Y"], 2, 1000, 1000), "same": (["X", "Y"], 2, 1001, 1100)}
    assert timeline.search(ev, activity="第三章").count() == 2 and timeline.search(ev, low=1050).count() == 2
    assert timeline.search(ev, words="FIRST", names=["z", "fir"]).count() == 2
    assert timeline.names_activity(t, "主线3章") and not timeline.names_activity(t, "主线")
    assert timeline.by_marker(ev, "年表出处:tle_" + "a" * 24).count() == 2


def test_localisation(spark):
    i = spark.createDataFrame([(2, "t", "zh", 0, "b"), (1, "t", "CN", 0, "a"), (3, "t", "cn", 2, "c"), (4, "t", "EN", 0, "long text"), (5, "u", "EN", 0, None), (6, None, "EN", 0, "x")], "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    d = localisation.dictionary(i)
    assert {(r.text_id, r.lang, r.text_offset, r.row_id) for r in d.collect()} == {("t", "CN", 0, 1), ("t", "CN", 2, 3), ("t", "EN", 0, 4)}
    texts = localisation.documents(d)
    a = localisation.aligned(texts, ["CN", "EN", "DE"], 4, 3).first()
    assert (a.cn_status, a.en_status, a.en_text, a.de_status) == ("unavailable", "available", " te", "missing")
    c = spark.createDataFrame([("t", ["CN", "DE"], [("d", 1, 3, "text")]), ("v", None, None)], "text_id string, languages array<string>, refs array<struct<document_id:string,line_start:int,line_end:int,field:string>>")
    assert rows(localisation.missing_ids(c, d)) == [("t", "DE")]
    assert localisation.by_line(c, "d", 2).count() == 1 and localisation.by_line(c, "d", 4).count() == 0
    records = spark.createDataFrame([("d", 2)], "document_id string, line_count int")
    assert localisation.broken_references(c, records).count() == 1


def test_i18n_page_against_a_loop(spark):
    sizes = [50, 900, 120, 2000, 10, 400]
    texts = spark.createDataFrame([(f"t{k}", "x" * n) for k, n in enumerate(sizes)], "text_id string, text string")
    for budget in (100, 99, 700, 3000, 20_000):
        left, expected = budget, []
        for k, n in enumerate(sizes):
            if left < 100:
                break
            width = left // 2
            expected.append((f"t{k}", min(width, n)))
            left -= min(width, n)
            if n > width:
                break
        got = [(r.text_id, r.shown) for r in localisation.page(texts, budget, 20).orderBy("ord").collect()]
        assert got == expected, budget


def test_required_and_missing(spark):
    df = lambda *x: spark.createDataFrame([(k,) for k in x], "k int")
    assert rows(snapshot.missing(df(1, 2, 2, 3), df(2, 9), "k")) == [(1,), (3,)] and snapshot.missing(df(1), df(1), "k").count() == 0


def test_streams_come_out_as_tables(spark, tmp_path):
    from storyloom.streaming import sessions as streaming

    log = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:05"), (1, "b", "2024-01-01 00:00:06"), (2, "a", "2024-01-01 09:00:00")], "u int, q string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    log.write.parquet(f"{tmp_path}/log.parquet")
    read_ = lambda: streaming.read_log(spark, f"file://{tmp_path}", "log.parquet", log)
    out = streaming.run_once(streaming.session_sizes(read_(), "u", "ts"), "s1", f"file://{tmp_path}/one", "complete")
    assert sorted((r.u, r.entries) for r in out.collect()) == [(1, 3), (2, 1)]
    out = streaming.run_once(streaming.first_queries(read_(), "u", "q", "ts"), "s2", f"file://{tmp_path}/two")
    assert sorted((r.u, r.q) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    log.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    none = streaming.read_log(spark, f"file://{tmp_path}", "none.parquet", log)
    assert streaming.run_once(streaming.first_queries(none, "u", "q", "ts"), "s3", f"file://{tmp_path}/three").count() == 0
