"""The four tools on a small made-up corpus: requests, pages, limits, errors, texts."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from storyloom.operators import entities, index, sections, session
from storyloom.sources import packed
from storyloom.tools import facade, localised, read, render, requests, search
from storyloom.tools.corpus import Corpus

VERSION = "a" * 64
RECORD = "record_id bigint, document_id string, display_title string, game string, document_type string, document_kind string, document_category string, activity_id string, activity_name string, story_code string, part_type string, sequence_index int, line_count int, previous_document_id string, next_document_id string, character_name string, path string, wiki_role string, story_name string, text_sha256 string, source_story_id string"
LINE = "line_id bigint, document_id string, activity_id string, line_number int, line_type string, speaker_raw string, text string, source_line_id string, entity_occurrences array<struct<entity_id:string,raw_name:string,evidence_kind:string,confidence:double>>"


def record(k, id_, title, **more):
    base = dict(record_id=k, document_id=id_, display_title=title, game="game_a", document_type="story", document_kind="story", document_category="activity", sequence_index=k)
    names = [x.split()[0] for x in RECORD.split(", ")]
    return tuple((base | more).get(n) for n in names)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {f"s{k:02d}": [f"line {n} of {k}" + (" with the reactor" if n % 4 == 1 else "") + (" and a storm" if n == 6 else "") for n in range(1, 13)] for k in range(30)}
    wiki = ["名称：Vi", "<简要介绍>", "Vi keeps the reactor.", "", "She sings.", "</简要介绍>", "<活动名称>Tide</活动名称>", "about the tide reactor", "</相关内容>", "<活动名称>Ebb</活动名称>", "about the ebb reactor"]
    texts |= {"wiki1": wiki, "wiki2": ["nothing"], "short": ["a synopsis"], "full": ["the whole story", "second"], "mat1": ["same"], "mat2": ["same"]}
    rows = []
    for k, (d, own) in enumerate(texts.items()):
        game = "game_b" if d[1:].isdigit() and int(d[1:]) % 3 == 0 else "game_a"
        more = dict(line_count=len(own), game=game, activity_id="act1", activity_name="Tide", text_sha256=hashlib.sha256("\n".join(own).encode()).hexdigest())
        if d in ("s01", "s02"):
            more |= dict(sequence_index=None)
        if d.startswith("wiki"):
            more |= dict(document_type="knowledge", document_kind="wiki", document_category=None, wiki_role="character_activity", path=f"char_v3/prompt_{d}", activity_name=None, activity_id=None)
        if d == "short":
            more |= dict(document_kind="synopsis", source_story_id="[uc]info/obt/full", activity_id="act2", activity_name="Two")
        if d == "full":
            more |= dict(source_story_id="obt/full", activity_id="act2", activity_name="Two", story_code="GT-3", part_type="before")
        if d.startswith("mat"):
            more |= dict(document_type="character", document_kind="profile", document_category="干员档案", character_name="Vi")
        rows.append(record(k, d, "Same title" if d in ("s01", "s02") else f"Title {d}", **more))
    lines = []
    for d, own in texts.items():
        for n, t in enumerate(own, 1):
            speaker = "Vi" if d == "s05" and n == 3 else None
            lines.append((len(lines), d, "act1", n, "dialogue" if speaker else "narration", speaker, t, None, [("e1", "Vi", "speaker", 1.0)] if speaker else []))
    lines += [(9000 + k, *x[1:]) for k, x in enumerate(lines[:20])]  # delivered again
    e = spark.createDataFrame([("e1", "Vi", ["Violet", None], "game_a", "A keeper. " * 100, "History. " * 300)], "entity_id string, canonical_name string, aliases array<string>, game string, description string, history_summary string")
    i18n = [(1, "1", "CN", 0, "引擎<b>启动</b>"), (2, "1", "EN", 0, "The engine starts " * 30), (3, "2", "CN", 0, "引擎启动"), (4, "2", "DE", 0, "Der Motor"), (5, "3", "CN", 0, "别的")]
    catalog = [("1", ["CN", "EN"], [("T", "r", "text")], [("s01", 1, 3, "text", "line")]), ("2", ["CN", "DE"], [("T", "r", "name")], [("s01", 3, 3, "name", "line")]), ("3", ["CN"], [], None)]
    events = [{"event_id": "tle_" + "b" * 24, "time": {"text": "1097年春"}, "event": "The tower fell", "sources": [{"text": "told by Violet", "story_name": "S"}]}, {"event_id": "x", "time": {"year_start": 1000}, "event": "Old", "sources": []}]
    return Corpus(
        spark.createDataFrame(rows, RECORD), spark.createDataFrame(lines, LINE), VERSION, entities=e,
        relations=spark.createDataFrame([("r1", "Reactor", "Furnace")], "id string, a string, b string"),
        timelines=spark.createDataFrame([(1, "main_3", "Tide", json.dumps(events)), (2, "act", "Ebb", json.dumps(events[:1]))], "row_id bigint, activity_id string, activity_name string, events string"),
        i18n=spark.createDataFrame(i18n, "row_id bigint, text_id string, lang string, text_offset bigint, text string"),
        i18n_catalog=spark.createDataFrame(catalog, "text_id string, languages array<string>, sources array<struct<table_name:string,row_id:string,field:string>>, refs array<struct<document_id:string,line_start:int,line_end:int,field:string,alignment:string>>"),
    )


# --- requests ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "make,raw",
    [
        (requests.search_request, x) for x in ([], {}, {"query": "x" * 513}, {"query": "a*", "match_mode": "regex"}, {"match_mode": "regex", "games": ["game_a"]}, {"query": "x", "games": ["other"]}, {"context_terms": ["x"], "games": ["game_a"]}, {"wiki_sections": ["a", "b"]}, {"query": "x", "speakers": []}, {"query": "x", "speakers": ["", "y"]}, {"query": "x", "speakers": ["y"] * 3 + [str(k) for k in range(16)]}, {"query": "x", "cursor": "c"}, {"query": "x", "after": {"position": 1}}, {"query": "x", "context_terms": [str(k) for k in range(9)]})
    ] + [
        (requests.read_request, x) for x in ({}, {"document_id": "a", "display_title": "b"}, {"document_id": "a", "mode": "around"}, {"document_id": "a", "mode": "range", "start_line": 3, "end_line": 2}, {"document_id": "a", "mode": "activity"}, {"activity_id": "a", "mode": "document"}, {"document_id": "a", "max_lines": 501}, {"document_id": "a", "max_chars": 99}, {"document_id": "a", "line": True}, {"document_id": "a", "line": 1.5}, {"source_ref": "a:L0"}, {"document_uid": "doc_x"}, {"document_id": "a", "mode": "section", "section": "no"}, {"document_id": "a", "format": "xml"})
    ] + [
        (requests.timeline_request, x) for x in ({}, {"query": "x" * 201}, {"activity_names": "x"}, {"source_marker": "tle_1"}, {"year_start": "x"}, {"year_start": True}, {"query": "x", "max_results": 101}, {"entity_names": [str(k) for k in range(21)]})
    ] + [
        (requests.localisation_request, x) for x in ({"languages": ["EN"]}, {"query": "x"}, {"query": "x", "title": "y", "languages": ["EN"]}, {"query": "x", "languages": ["XX"]}, {"query": "x", "languages": ["EN"] * 5}, {"text_ids": [1], "languages": ["EN"]}, {"query": "x", "line": 1, "languages": ["EN"]}, {"query": "x", "languages": ["EN"], "odd": 1}, {"query": "x", "languages": ["EN"], "after": {"data_version": VERSION, "position": 0, "request_hash": VERSION, "text_offset": 0}})
    ],
)
def test_requests_out_of_order_are_refused(make, raw):
    with pytest.raises(requests.RequestError):
        make(raw)


def test_requests_are_brought_to_one_form():
    r = requests.search_request({"query": " Ａ  b ", "speakers": ["x", "ｘ"], "games": ["Game_A"]}, ("game_a",))
    assert (r.query, r.filters["speakers"], r.filters["games"], r.kind, r.line_scope) == ("A b", ("x",), ("game_a",), "text_matches", True)
    assert requests.search_request({"activity_names": ["x"]}).kind == "documents"
    with pytest.raises(requests.RequestError, match="enabled"):
        requests.search_request({"query": "x", "games": ["game_b"]}, ("game_a",))
    assert requests.read_request({"source_ref": "a:b:L7"}).center == 7 and requests.read_request({"document_id": "a", "line": "3"}).start == 3
    assert requests.localisation_request({"query": "x", "languages": ["en-us", "EN", "de"]}).languages == ("EN", "DE")


# --- search --------------------------------------------------------------------------------------------------------
def test_pages_show_every_document_once(corpus):
    seen, after, pages = [], None, 0
    while True:
        a = search.run(corpus, {"query": "reactor"} | ({"after": after} if after else {}))
        assert a["status"] == "ok" and len(a["documents"]) <= 12
        seen += [d["document_uid"] for d in a["documents"]]
        after, pages = a["page"]["next_after"], pages + 1
        if not after:
            break
    assert len(seen) == len(set(seen)) == 31 and pages == 3
    first = search.run(corpus, {"query": "reactor"})["documents"]
    assert [d["game"] for d in first[:4]] == ["game_a", "game_b"] * 2  # in turns
    m = next(d for d in first if "Tide" in d["title"])["matches"]
    assert len(m) == 3 and m[0]["excerpt"][0]["role"] in ("match", "context") and m[0]["citation"].startswith("《")
    assert search.run(corpus, {"query": "reactor"})["relations"][0]["id"] == "r1"


def test_anchors_of_other_pages_are_refused(corpus):
    after = {"data_version": VERSION, "resource_type": "story", "title": "no such title", "position": 1}
    code = lambda **x: search.run(corpus, {"query": "reactor", "after": after | x})["error"]["code"]
    assert code() == "PAGE_ANCHOR_MISMATCH" and code(position=999) == "PAGE_ANCHOR_NOT_FOUND" and code(data_version="b" * 64) == "PAGE_ANCHOR_VERSION_MISMATCH"


def test_context_sections_ranges_entities_and_titles(corpus):
    a = search.run(corpus, {"query": "reactor", "context_terms": ["storm"], "games": ["game_b"]})
    assert len(a["documents"]) == 10 and all(d["matches"][0]["line_start"] == 5 for d in a["documents"])
    assert "constraint" in {x["role"] for x in a["documents"][0]["matches"][0]["excerpt"]}
    a = search.run(corpus, {"wiki_sections": ["简要介绍"]})
    assert a["result_kind"] == "complete_sections" and a["documents"][0]["section_content"]["blocks"] == ["Vi keeps the reactor.", "She sings."]
    a = search.run(corpus, {"query": "reactor", "activity_names": ["Ebb"]})
    assert [(m["line_start"], m["line_end"]) for d in a["documents"] for m in d["matches"]] == [(11, 11)]
    a = search.run(corpus, {"entity_names": ["Violet"]})
    assert a["result_kind"] == "structured_matches" and {m["match_kind"] for d in a["documents"] for m in d["matches"]} == {"entity_speaker", "entity_mention"}
    assert [d["title"] for d in search.run(corpus, {"character_names": ["Vi"], "resource_types": ["reviewed_wiki"]})["documents"]] == ["A · Title wiki1 / 角色活动 Wiki · 第 30 篇"]
    a = search.run(corpus, {"query": "Same title"})
    assert len(a["documents"]) == 2 and all(d["matches"][0]["match_kind"] == "title" for d in a["documents"])
    assert search.run(corpus, {"speakers": ["Vi"]})["documents"][0]["matches"][0]["line_start"] == 3
    assert search.run(corpus, {"query": "line [0-9]{2} of", "match_mode": "regex"})["status"] == "ok"
    assert search.run(corpus, {"query": "of nothing at all"})["page"]["total_documents"] == 0


def test_stored_index_gives_the_same_candidates(corpus, tmp_path):
    index.build(index.texts_of(corpus.documents, corpus.lines), f"file://{tmp_path}/index", files=4)
    stored = index.load(corpus.documents.sparkSession, f"file://{tmp_path}/index")
    with_index = Corpus(**(corpus.__dict__ | {"index": stored}))
    r = requests.search_request({"query": "reactor"})
    key = lambda df: sorted((x.document_id, x.ordinal) for x in df.collect())
    assert key(search.candidates(with_index, r)) == key(search.candidates(corpus, r))
    spans = sorted((x["first"], x["last"]) for x in index.key_ranges(stored).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    p = index.postings(stored).where("gram = 'rea'").collect()
    assert sum(x.n for x in p) == stored.where("gram = 'rea'").count() and all(index.decode(x.packed) == x.numbers for x in p)
    index.build(index.texts_of(corpus.documents, corpus.lines), f"file://{tmp_path}/three", sizes=(3,))
    with pytest.raises(index.SizeUnsupported):
        index.documents_with(index.load(corpus.documents.sparkSession, f"file://{tmp_path}/three"), ["re"])


def test_posting_lists():
    assert index.varint(300) == b"\xac\x02" and index.read_varint(b"\xac\x02") == (300, 2)
    for numbers in ([], [0], [5, 1, 1, 900_000], list(range(300))):
        assert index.decode(index.encode(numbers)) == sorted(set(numbers))
    for bad in (b"", b"\x02\x01", b"\x01\x01\x01", b"\xff"):
        with pytest.raises(ValueError):
            index.decode(bad)


# --- read ----------------------------------------------------------------------------------------------------------
def test_reading_modes_and_limits(corpus):
    a = read.run(corpus, {"document_id": "s03", "max_lines": 5})
    assert [x["line_number"] for x in a["content"]["lines"]] == [1, 2, 3, 4, 5] and a["selection"]["truncation_reason"] == "max_lines"
    at, seen = a, [1, 2, 3, 4, 5]
    while at["page"]["continuation"]:
        at = read.run(corpus, at["page"]["continuation"] | {"max_lines": 5})
        seen += [x["line_number"] for x in at["content"]["lines"]]
    assert seen == list(range(1, 13))
    assert read.run(corpus, {"document_id": "s03", "mode": "around", "line": 2})["selection"]["line_end"] == 5
    assert read.run(corpus, {"source_ref": "s03:L12"})["selection"]["line_start"] == 9
    assert read.run(corpus, {"document_id": "s03", "mode": "range", "start_line": 2, "end_line": 99, "format": "plain_text"})["content"]["text"].count("\n") == 10
    assert read.run(corpus, {"document_id": "s03", "max_chars": 100})["selection"]["truncation_reason"] == "max_chars"
    assert read.run(corpus, {"document_id": "wiki1", "mode": "section", "section": "简要介绍"})["selection"]["line_count"] == 3
    assert read.run(corpus, {"document_id": "short"})["document"]["document_id"] == "full"
    code = lambda raw: read.run(corpus, raw)["error"]["code"]
    assert code({"document_id": "none"}) == "DOCUMENT_NOT_FOUND" and code({"display_title": "Same title"}) == "DOCUMENT_AMBIGUOUS"
    assert code({"document_id": "s03", "line": 99}) == "LINE_RANGE_INVALID" and code({"document_id": "s03", "mode": "section", "section": "简要介绍"}) == "INVALID_REQUEST"
    assert code({"document_id": "s03", "data_version": "b" * 64}) == "PACKAGE_VERSION_MISMATCH"
    stated = corpus.documents.select("document_id", F.col("text_sha256").alias("sha256"))
    assert read.run(corpus, {"document_id": "s03"}, stated)["status"] == "ok"
    assert read.run(corpus, {"document_id": "s03"}, stated.withColumn("sha256", F.lit("0")))["error"]["code"] == "INDEX_CORRUPT"


def test_lookups(corpus):
    assert read.by_stage(corpus, "gt－3", "before").document_id == "full" and read.by_material(corpus, "Vi", "profile").document_id == "mat1"
    with pytest.raises(requests.RequestError):
        read.by_record(corpus, "Vi", "none")
    d = corpus.described()
    assert {r.document_id for r in read.needs_uid(d).collect()} >= {"s01", "s02"}
    packs = d.select("document_id", F.when(F.col("document_id") != "s07", F.col("game")).alias("pack_id"))
    ids = lambda *x: d.where(F.col("document_id").isin(*x))
    assert read.packs_of(packs, ids("s00", "s01")) == ["game_a", "game_b"] and read.packs_of(packs, ids("s07")) is None


def test_collections_are_read_through_once(corpus):
    at, seen = {"activity_id": "act1", "max_lines": 100}, []
    while at:
        a = read.run(corpus, at | {"max_lines": 100})
        seen += [x["stream_position"] for x in a["content"]["lines"]]
        at = a["page"]["continuation"]
    assert seen == list(range(1, 361))
    assert read.run(corpus, {"activity_name": "Tide"})["stream"]["documents"] == 30
    assert read.run(corpus, {"activity_name": "Tide", "position": 361})["error"]["code"] == "LINE_RANGE_INVALID"


# --- chronology and localisation -----------------------------------------------------------------------------------
def test_timeline_answers(corpus):
    run = lambda **x: facade.call(corpus, "timeline", x)
    a, text = run(entity_names=["Vi"])
    assert [e["activity_names"] for e in a["events"]] == [["Ebb", "Tide"]] and "1097年春：The tower fell" in text and a["stats"]["matched_occurrences"] == 2
    assert run(query="第三章")[0]["filters"]["inferred_activity"] and run(query="第三章")[0]["page"]["total"] == 2
    assert run(year_end=1000)[0]["events"][0]["time"] == "1000 年" and run(query="violet")[0]["page"]["total"] == 1
    a, text = run(source_marker="年表出处:tle_" + "b" * 24)
    assert a["provenance"]["sources"] == [{"text": "told by Violet", "story_name": "S"}] and "told by Violet | S" in text
    assert run(source_marker="tle_" + "c" * 24)[0]["error"]["code"] == "TIMELINE_SOURCE_NOT_FOUND" and run(query="x", max_results=1)[0]["page"]["returned"] == 0


def test_localised_answers(corpus):
    run = lambda **x: localised.run(corpus, x)
    a = run(query="引擎启动", languages=["EN", "DE"])
    assert a["total_matches"] == 2 and {m["translations"]["DE"]["status"] for m in a["matches"]} == {"missing_localization", "available"}
    assert run(query="引擎", languages=["EN"])["status"] == "not_found" and run(query="引擎", languages=["EN"], match_mode="literal")["total_matches"] == 2
    a = run(text_ids=["9", "1"], languages=["EN"], include_ids=True, max_chars=1000)
    assert a["missing_text_ids"] == ["9"] and a["matches"][0]["source_fields"] == [{"table_name": "T", "row_id": "r", "field": "text"}] and a["page"]["has_more"]
    text = a["matches"][0]["translations"]["EN"]["text"]
    b = run(**a["page"]["continuation"])
    assert text + b["matches"][0]["translations"]["EN"]["text"] == "The engine starts " * 30 and not b["page"]["has_more"]
    assert run(title="A · Tide", languages=["FR"])["error"]["code"] == "DOCUMENT_AMBIGUOUS"
    uid = corpus.described().where("document_id = 's01'").first().uid
    a = run(document_uid=uid, line=3, languages=["DE"])
    assert a["total_matches"] == 2 and a["matches"][1]["references"][0]["citation"].endswith("中文定位第 3 行")
    assert run(document_uid=uid, line=1, languages=["DE"])["total_matches"] == 1 and run(document_uid=uid, line=99, languages=["DE"])["error"]["code"] == "LINE_RANGE_INVALID"
    texts = localised.dictionaries(corpus)
    assert localised.broken(texts, corpus.i18n_catalog).count() == 0 and localised.broken(texts, corpus.i18n_catalog.where("text_id = '1'")).count() == 3


# --- texts, sessions, sections, packed assets ----------------------------------------------------------------------
def test_texts_of_answers(corpus):
    a, text = facade.call(corpus, "search", {"query": "reactor", "odd": 1, "speakers": []})
    assert "【reactor】" in text and "after: " in text and facade.call(corpus, "search", {"query": "("[:0]})[1].startswith("[search:error]")
    a, text = facade.call(corpus, "read", {"activity_name": "Tide", "max_lines": 20})
    assert text.count("《") == 2 and "continuation: " in text
    assert facade.call(corpus, "read", {"document_id": "s05"})[1].count("L3 dialogue Vi: line 3") == 1
    off = facade.Settings.of({"enabled": ["read"], "output_signs": 5})
    assert facade.call(corpus, "search", {"query": "x"}, off)[0]["error"]["code"] == "TOOL_DISABLED" and off.output_signs == 1000
    assert render.capped("a\n" * 50, 40) == "a\n" * 14 + "a\n" + render.CUT or len(render.capped("a\n" * 50, 40)) <= 40
    assert search.fit([{"role": "match", "text": "x" * 200}, {"role": "context", "text": "y"}], 100)[0]["text"].endswith("…")
    whole = search.entity_summary(corpus.entities.first())
    assert len(whole["description"]) == 800 and len(whole["history_summary"]) == 1600 and whole["truncated"]


def test_activity_ranges(corpus):
    own = corpus.lines.where("document_id = 'wiki1'").select("document_id", "line_number", "text")
    assert [tuple(r)[1:] for r in sections.activity_ranges(own).orderBy("start").collect()] == [("Tide", 7, 9), ("Ebb", 10, 11)]
    assert sections.activity_ranges(own.limit(0)).count() == 0


def test_sessions_of_versions_and_markers(spark):
    log = spark.createDataFrame([("u", k, v) for k, v in ((0, "a"), (10, None), (20, "a"), (30, "b"), (90_000, "b"))] + [("w", 89_000, "a")], "u string, s long, v string").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.session for r in session.versioned_sessions(log, "u", "ts", "v").where("u = 'u'").orderBy("ts").collect()]
    assert got == [1, 1, 1, 2, 3]
    now = log.agg(F.max("ts")).first()[0]
    assert [r.u for r in session.live(log, "u", "ts", now).collect()] == ["u", "w"] and session.live(log, "u", "ts", now, most=1).count() == 1 and session.live(log, "u", "ts", now, idle=500).count() == 1
    assert session.latest(log, "u", [F.desc("ts")], 2).where("u = 'u'").count() == 2
    shown = spark.createDataFrame([(1, "L3 dialogue x\n> L12 y L9 z\nL12 again"), (2, None)], "k int, t string")
    assert sorted(tuple(r) for r in session.shown_markers(shown, "k", "t").collect()) == [(1, 3), (1, 12)]


def test_names_of_listed_lines_and_context(spark):
    g = spark.createDataFrame([("Vi", ["Vi", "Violet"], ["game_a"])], "canonical string, aliases array<string>, games array<string>")
    listed = spark.createDataFrame([("Violet; V. ; Vivi",), ("New;Neu",), (" ; ",), (None,), ("New;Other;Vi",)], "text string")
    got = {r.canonical: r.aliases for r in entities.attached(g, listed, others=spark.createDataFrame([("Other",)], "name string")).collect()}
    assert got == {"Vi": ["V.", "Vi", "Violet", "Vivi"], "New": ["Neu", "New", "Vi"]}
    assert entities.expand(g, ["Violet", "Nobody"]) == {"Vi": ["Vi", "Violet"], "Nobody": ["Nobody"]}
    texts = spark.createDataFrame([(1, "Violet met <Vi>"), (2, "none")], "k int, t string")
    rel = spark.createDataFrame([("1", "Violet", "O<")], "id string, a string, b string")
    assert {r.k: r.context for r in entities.retrieval_context(texts, "k", "t", g, rel).collect()} == {1: "- Vi：Violet\n- Violet / O&lt;"}
    assert entities.gated_relations(rel, ["game_a"]).count() == 0


def test_packed_assets(spark, tmp_path):
    def asset(name, plain, **wrong):
        data = gzip.compress(plain)
        (tmp_path / name).write_bytes(data)
        return {"path": name, "compressed_size": len(data), "uncompressed_size": len(plain), "sha256": hashlib.sha256(data).hexdigest()} | wrong

    good = [asset("a.jsonl.gz", b'{"x": 1}\n\n{"x": 2, "y": "z"}\n'), asset("b.jsonl.gz", '{"x": 3, "y": "é"}'.encode())]
    root = f"file://{tmp_path}"
    got = packed.records(spark, root, good, "x int, y string").orderBy("x").collect()
    assert [tuple(r) for r in got] == [("a.jsonl.gz", 0, 1, None), ("a.jsonl.gz", 2, 2, "z"), ("b.jsonl.gz", 0, 3, "é")]
    pairs = asset("cn.jsonl.gz", '["1","一"]\n["2",null]\n'.encode())
    assert [tuple(r) for r in packed.dictionary_rows(spark, root, "CN", pairs).orderBy("text_id").collect()] == [("CN", "1", "一"), ("CN", "2", None)]
    raw = (tmp_path / "a.jsonl.gz").read_bytes()
    first = good[0]
    for wrong in (dict(sha256="0" * 64), dict(uncompressed_size=5), dict(uncompressed_size=500), dict(compressed_size=3), dict(sha256="x")):
        a = first | wrong
        with pytest.raises(packed.AssetError):
            packed.unpack("a", raw, a["compressed_size"], a["uncompressed_size"], a["sha256"])
    bomb = gzip.compress(b"0" * 10_000_000)
    with pytest.raises(packed.AssetError):
        packed.unpack("bomb", bomb, len(bomb), 1000, hashlib.sha256(bomb).hexdigest())
    with pytest.raises(packed.AssetError):
        packed.lines_of(spark, root, [first | {"path": "../a.gz"}])
    rows = spark.createDataFrame([(1, '{"events": [{"event": "x"}]}'), (2, "broken"), (3, '{"a": 1}'), (4, None)], "line int, text string")
    assert [r.line for r in packed.text_rows(rows, "events array<struct<event:string>>").collect()] == [1]


def test_cache_keeps_the_latest_within_its_room():
    c = packed.Cache(entries=2, room=10)
    made = []
    make = lambda x: lambda: made.append(x) or x
    for x in ("aaaa", "bbbb", "aaaa", "cccc", "bbbb", "x" * 11):
        assert c.get(x, make(x)) == x
    assert made == ["aaaa", "bbbb", "cccc", "bbbb", "x" * 11] and c.stats() == {"entries": 2, "bytes": 8, "hits": 1, "misses": 5}
