import re

from pyspark.sql import functions as F

import pytest

from storyloom.operators import entities, search, sections

LINE = "document_id string, line_number int, line_type string, text string"


def lines(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, k + 1, "dialogue", t) for k, t in enumerate(texts)], LINE)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hits(spark, numbers, score=1000, doc="d"):
    return spark.createDataFrame([(doc, n, s) for n, s in zip(numbers, score if isinstance(score, list) else [score] * len(numbers))], "document_id string, line_number int, score int")


def test_passages_join_at_two_lines_and_keep_three(spark):
    p = search.passages(hits(spark, [1, 3, 6, 8, 20, 30, 40], [1, 1, 1, 1, 9, 1, 1]))
    got = {(r["first"], r["last"], r.hits, r["rank"], r.cut) for r in p.collect()}
    assert got == {(20, 20, 1, 1, 1), (1, 3, 2, 2, 1), (6, 8, 2, 3, 1)}


def test_passages_reach_with_context_lines(spark):
    h = hits(spark, [1, 5, 9]).withColumns({"low": F.col("line_number"), "high": F.when(F.col("line_number") == 1, 4).otherwise(F.col("line_number"))})
    assert [(r["first"], r["last"]) for r in search.passages(h).orderBy("first").collect()] == [(1, 5), (9, 9)]
    assert search.passages(hits(spark, []).limit(0)).count() == 0


def test_score_bounds(spark):
    df = spark.createDataFrame([(0,), (10,), (100,), (None,)], "s int")
    assert [r[0] for r in df.select(search.score(F.col("s"))).collect()] == [1000, 950, 800, 1000]
    assert [r[0] for r in df.select(search.score(F.col("s"), 700, 500)).collect()] == [1000, 1000, 1000, 1000]


def test_literal_and_regex_places(spark):
    df = spark.createDataFrame([("xx ab ab",), (None,), ("",), ("😀ab",)], "text string")
    assert [r[0] for r in df.select(search.literal_start(F.col("text"), "ab")).collect()] == [3, None, None, 1]
    a, b = search.regex_match(F.col("text"), "a.{1}")
    assert [tuple(r) for r in df.select(a, b).collect()] == [(3, 2), (None, None), (None, None), (1, 2)]


def test_first_matches(spark):
    assert search.first_matches(hits(spark, range(1, 40)), 24).agg(F.max("line_number")).first()[0] == 24


def test_context_terms_against_brute_force(spark):
    texts = ["a", "x", "b", "c", "a b", "x", "c", "", None, "x a", "b", "q", "q", "q", "x"]
    t = lines(spark, *texts).withColumn("form", F.col("text"))
    h = t.where(F.contains("text", F.lit("x"))).select("document_id", "line_number")
    got = {(r.line_number, tuple(r.term_lines)) for r in search.context_terms(t, h, ["a", "b"]).collect()}
    expected = set()
    for k, s in enumerate(texts):
        if s and "x" in s:
            near = range(max(0, k - 3), min(len(texts), k + 4))
            first = [next((j + 1 for j in near if texts[j] and w in texts[j]), None) for w in "ab"]
            if None not in first:
                expected.add((k + 1, tuple(sorted(set(first)))))
    assert got == expected and got


def test_near_hit(spark):
    df = spark.createDataFrame([("ab" + "." * 300 + "hit", "ab"), ("ab hit", "ab"), ("hit", "ab"), (None, "ab"), ("x", "")], "t string, a string")
    got = [r[0] for r in df.select(search.near_hit(F.col("t"), F.col("a"), F.lit(3), F.lit(6))).collect()]
    assert got == [1, 1, None, None, None]


def test_interleave_and_page(spark):
    df = spark.createDataFrame([(f"{g}{k}", g, 100) for g, n in (("a", 3), ("b", 5), ("c", 2)) for k in range(n)] + [("z", None, 100)], "document_id string, game string, chars int")
    o = search.interleave(df, "game", ["document_id"], ["b", "a"])
    assert [r.document_id for r in o.orderBy("ordinal").collect()] == ["b0", "a0", "b1", "a1", "b2", "a2", "b3", "b4", "c0", "c1", "z"]
    page = lambda **k: [r.ordinal for r in search.page(o, **k).orderBy("ordinal").collect()]
    assert page(signs=250) == [0, 1] and page(signs=10) == [0] and page(after=8, documents=9) == [9, 10] and page(after=99) == []
    seen, at = [], -1
    while got := page(after=at, documents=4):
        seen, at = seen + got, got[-1]
    assert seen == list(range(11))


def test_grams_divide(spark):
    t = lines(spark, "abcd", "xbcde").unionByName(lines(spark, "abcde", doc="e")).unionByName(lines(spark, None, "", "ab", doc="f"))
    assert rows(search.candidates(t, F.col("text"), "abcde")) == [("d",), ("e",)]
    assert rows(search.candidates(t, F.col("text"), "ab")) == [("d",), ("e",), ("f",)]
    title = spark.createDataFrame([("g",)], "document_id string")
    assert rows(search.candidates(t, F.col("text"), "abcde", title, spark.createDataFrame([("g",), ("e",)], "document_id string"))) == [("e",), ("g",)]


def test_anchor_lines(spark):
    t = spark.createDataFrame([("d", 1, "narration", "x"), ("d", 2, "dialogue", " "), ("d", 3, "dialogue", "y"), ("e", 1, None, None), ("e", 2, "narration", "z"), ("f", 1, None, "")], LINE)
    assert rows(search.anchor_lines(t)) == [("d", 3), ("e", 2)]


def test_sections(spark):
    t = lines(spark, "<a>", "1", "<b>", "<a>", "2", "</x>", "3", "<all>", "4", "<a>", "5", "</a>", "6", "</all>", "<b>", "7", None)
    got = [(r.name, r.start, r.stop) for r in sections.sections(t, ["a", "b", "all"], container="all").orderBy("start", "stop").collect()]
    assert got == [("a", 2, 2), ("a", 5, 5), ("all", 9, 13), ("a", 11, 11), ("b", 16, 17)]
    inside = {r.line_number: r.name for r in sections.lines_in(t, sections.sections(t, ["a", "b", "all"], container="all")).collect()}
    assert inside[11] == "a" and inside[9] == "all" and 7 not in inside
    both = sections.intersect(sections.sections(t, ["all"], container="all"), sections.sections(t, ["a"]))
    assert [(r.start, r.stop) for r in both.collect()] == [(11, 11)]


def test_automaton_finds_what_find_finds():
    patterns = ["he", "she", "his", "hers", "s", "ers"]
    text = "ushershishe"
    found = {(patterns[p], s, e) for p, s, e in entities.Automaton(patterns).find(text)}
    assert found == {(p, m.start(), m.start() + len(p)) for p in patterns for m in re.finditer(f"(?={p})", text)}


def test_span_selection():
    s = entities.select_spans
    assert s([(0, 2, "a"), (0, 4, "b"), (2, 4, "c")], 9) == [(0, 4, "b")]
    assert s([(0, 3, "a"), (2, 5, "b")], 9) == [(0, 3, "a"), (2, 5, "b")]
    assert s([(0, 3, "a"), (0, 3, "b"), (0, 3, "a")], 9) == [(0, 3, "a"), (0, 3, "b")]
    assert s([(0, 1, "a")], 1) == [(0, 1, "a")] and s([(0, 1, "a")], 2) == []
    assert s([(0, 6, "x"), (1, 3, "y"), (4, 6, "z"), (5, 8, "w")], 9) == [(0, 6, "x"), (5, 8, "w")]


def test_alias_groups(spark):
    e = spark.createDataFrame([("A", ["a1", None, " a1 ", "B", ""], "g1"), ("B", None, "g2"), ("A", ["a2"], "g1"), (None, ["x"], "g1"), ("", ["y"], "g1")], "canonical_name string, aliases array<string>, game string")
    got = {r.canonical: (r.aliases, r.games) for r in entities.alias_groups(e).collect()}
    assert got == {"A": (["A", "a1", "a2"], ["g1"]), "B": (["B"], ["g2"])}


def test_mentions_and_the_way_for_many_patterns(spark):
    t = spark.createDataFrame([(1, "abcdabc"), (2, None), (3, ""), (1, "abcdabc")], "k int, text string")
    names = spark.createDataFrame([("abc", "X"), ("abc", "Y"), ("bcda", "Z"), ("", "E"), (None, "N")], "alias string, canonical string")
    a = rows(entities.mentions(t, "k", "text", names, select=False).distinct())
    b = rows(entities._mentions_by_trigram(t, "k", "text", names).distinct())
    assert a == b and len(a) == 5
    assert entities.mentions(t.limit(0), "k", "text", names).count() == 0 and entities.mentions(t, "k", "text", names.limit(0)).count() == 0


def test_relations_prefer_installed(spark):
    a = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "o", "o"), (2, "p", "q")], "id int, a string, b string")
    merged = entities.relations(a, b)
    assert rows(merged) == [(1, "x", "y"), (2, "p", "q")]
    t = spark.createDataFrame([(7, "there is x and q"), (8, None)], "k int, text string")
    assert rows(entities.relation_hints(t, "k", "text", merged)) == [(7, "p", "q"), (7, "x", "y")]


@pytest.mark.parametrize("select", [True, False])
def test_many_patterns_keep_short_names_and_selection(spark, monkeypatch, select):
    names = spark.createDataFrame([("凯", "K"), ("凯尔", "KE"), ("凯尔希", "KEX"), ("凯尔希医生", "DR"), ("尔希", "EX"), ("希", "X"), ("ab", "AB"), ("ab", "AB2"), ("b", "B"), ("", "none")], "alias string, canonical string")
    texts = spark.createDataFrame([(1, "凯尔希医生和凯尔"), (2, "凯"), (3, "xabab"), (4, "b"), (5, ""), (6, None), (7, "😀ab凯尔希"), (7, "凯尔希ab")], "k int, text string")
    few = rows(entities.mentions(texts, "k", "text", names, select))
    monkeypatch.setattr(entities, "MOST_PATTERNS", 2)
    assert rows(entities.mentions(texts, "k", "text", names, select)) == few and len(few) > 8
