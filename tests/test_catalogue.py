import glob
import os
import unicodedata

import pytest

duckdb = pytest.importorskip("duckdb")

from storyloom.plans.catalogue import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, data, other, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = other.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall())


def test_the_others_are_named():
    assert set(QUERIES) - set(ORACLE) == {"normalise_compatible", "search_normal_form", "timeline_merge"}


def squeezed(text):
    return " ".join(unicodedata.normalize("NFKC", text).split())


def test_compatible_forms(spark, data):
    got = {r.doc_id: r.form for r in QUERIES["normalise_compatible"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs) and all(got[d.doc_id] == (None if d.text is None else squeezed(d.text)) for d in docs)


def test_matches_in_normal_form(spark, data):
    lines = spark.read.parquet(f"{data}/search_lines.parquet").where("text IS NOT NULL AND document_id IS NOT NULL AND line_number IS NOT NULL").collect()
    expected = {(r.document_id, r.line_number, squeezed(r.text).lower().find("quaxor")) for r in lines if "quaxor" in squeezed(r.text).lower()}
    got = [(r.document_id, r.line_number, r.start) for r in QUERIES["search_normal_form"](spark, data).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_merged_events(spark, data):
    names = {r.row_id: r.activity_name for r in spark.read.parquet(f"{data}/activity_timelines.parquet").collect()}
    expected = {}
    for e in QUERIES["p1_events"](spark, data).collect():
        key = e.event_id or "\0".join(squeezed(x or "").lower() for x in (e.time_text, e.event))
        held = expected.setdefault(key, [set(), 0])
        held[0] |= {names[e.row_id]} - {None, ""}
        held[1] += 1
    got = {r.key: ("|".join(sorted(x for x in r.activities.split("|") if x)), r.deliveries) for r in QUERIES["timeline_merge"](spark, data).collect()}
    assert got == {k: ("|".join(sorted(n)), c) for k, (n, c) in expected.items()} and len(got) > 3
