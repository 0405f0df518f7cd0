import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from storyloom.functions import classify, fuzzytime
from storyloom.functions import text as tx
from storyloom.functions.saferegex import RegexRejected, safe_pattern


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_normal_forms(spark):
    assert one(spark, tx.normalize, "ＧＴ－３　  x ") == "GT-3 x"
    assert one(spark, tx.search_form, "ＡＢ") == "ab"
    assert one(spark, tx.normalize, None) is None and one(spark, tx.normalize, "") == ""


@pytest.mark.parametrize("code,strict,relaxed", [("gt－3", "GT-3", "GT-3"), ("g t-3", "", "GT-3"), ("a--b", "", ""), ("", "", ""), (None, "", ""), ("x" * 33, "", ""), ("ａ−１", "A-1", "A-1")])
def test_stage_code(spark, code, strict, relaxed):
    assert one(spark, tx.stage_code, code) == strict
    assert one(spark, lambda c: tx.stage_code(c, relaxed=True), code) == relaxed


def test_markup_and_cleaning(spark):
    assert one(spark, tx.strip_markup, '<color=#f00>a</color><br>b<@ba.kw>c</><image name="x">y</image><i>d</i>') == "a\nbcd"
    assert one(spark, tx.metadata_text, "a​\n b\x00") == "a b" and one(spark, tx.metadata_text, None) == ""
    assert one(spark, tx.escape, '<a "b">&\x01') == "&lt;a &quot;b&quot;&gt;&amp;"
    assert one(spark, lambda c: tx.clip(c, 3), "😀bcd") == "😀b…" and one(spark, lambda c: tx.clip(c, 3), "abc") == "abc"


def test_natural_order(spark):
    names = ["a10", "a2", "A1", "b", "a2b", "", None, "12", "3"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r.x for r in df.where("x IS NOT NULL").orderBy(tx.natural_key(F.col("x"))).collect()]
    assert got == ["", "3", "12", "A1", "a2", "a2b", "a10", "b"]


def test_document_uid_is_stable(spark):
    import base64
    import hashlib

    digest = base64.urlsafe_b64encode(hashlib.sha256(b"document\0abc").digest()).decode()[:16]
    assert one(spark, tx.document_uid, "abc") == f"doc_{digest}" and one(spark, tx.document_uid, "") == ""


def test_ngrams(spark):
    assert sorted(one(spark, lambda c: tx.ngrams(c, (1, 2, 3)), "aba")) == ["a", "ab", "aba", "b", "ba"]
    assert one(spark, lambda c: tx.ngrams(c, (3,)), "ab") == [] and one(spark, tx.ngrams, None) == []
    assert tx.query_ngrams("ABCA") == ["abc", "bca"] and tx.query_ngrams("é") == ["é"] and tx.query_ngrams(" ") == []


def test_line_content(spark):
    df = spark.createDataFrame([("dialogue", "A", "A: hi"), ("narration", "A", "A: hi"), ("dialogue", "", ": hi"), ("dialogue", None, None)], "t string, s string, x string")
    assert [r[0] for r in df.select(tx.line_content(F.col("t"), F.col("s"), F.col("x"))).collect()] == ["hi", "A: hi", ": hi", None]


@pytest.mark.parametrize("good", ["凯.{2}", "[a-z]{3}", "^x$", r"\d{4}", r"a\b", "", r"[(|*]"])
def test_safe_patterns(good):
    assert safe_pattern(good).endswith(good)


@pytest.mark.parametrize("bad", ["a(b|c)", "a*", "a+", "a?", r"\1", "x{100}", r"\p{L}", "(?P=ref)", "x{2,3}", "{2}", "^{2}", "}", "[a", "a" * 257, r"\k<a>", "x{65}", r"\b{2}"])
def test_unsafe_patterns(bad):
    with pytest.raises(RegexRejected):
        safe_pattern(bad)


@pytest.mark.parametrize(
    "label,years,order",
    [
        ("11世纪", (1001, 1100), (1001, 0, 0, 0)),
        ("11世纪 90年代", (1090, 1099), (1090, 0, 0, 0)),
        ("1100 年 5 月", (1100, 1100), (1100, 5, 0, 0)),
        ("1100年秋 深夜", (1100, 1100), (1100, 9, 0, 1380)),
        ("1100年3月2日 7:05", (1100, 1100), (1100, 3, 2, 425)),
        ("年代不详", (None, None), (fuzzytime.LAST, 13, 32, 1440)),
        (None, (None, None), (fuzzytime.LAST, 13, 32, 1440)),
    ],
)
def test_fuzzy_time(spark, label, years, order):
    df = spark.createDataFrame([(label,)], "x string").withColumn("b", fuzzytime.bounds(F.col("x")))
    r = df.select("b.*", fuzzytime.order_key(F.col("x"), F.col("b.start")).alias("o")).first()
    assert (r.start, r.end) == years and tuple(r.o) == order


def test_overlap_needs_known_years(spark):
    df = spark.createDataFrame([(1, 5), (None, None), (6, 9)], "s int, e int")
    assert df.where(fuzzytime.overlaps(F.col("s"), F.col("e"), 5, 5)).count() == 1
    assert df.where(fuzzytime.overlaps(F.col("s"), F.col("e"), None, None)).count() == 3


def test_chinese_numbers_and_chapters(spark):
    df = spark.range(101).select("id", classify.chinese_number(F.col("id").cast("int")).alias("c"))
    got = {r.id: r.c for r in df.collect()}
    assert [got[k] for k in (0, 9, 10, 11, 20, 35, 99, 100)] == ["零", "九", "十", "十一", "二十", "三十五", "九十九", "100"]
    r = spark.createDataFrame([("main_12", "名"), ("event:main:3", None), ("act1", "名"), (None, None)], "i string, n string")
    a = [x[0] for x in r.select(classify.activity_aliases(F.col("i"), F.col("n"))).collect()]
    assert "第十二章" in a[0] and "名" in a[0] and len(a[0]) == 6 and "主线第3章" in a[1] and a[2] == ["名"] and a[3] == []


def test_semver_order(spark):
    v = ["1.0.0", "1.0.0-rc.1", "0.9.10", "0.9.9", "bad", "01.0.0", None]
    df = spark.createDataFrame([(x,) for x in v], "x string").withColumn("k", classify.semver_key(F.col("x"))).where("k IS NOT NULL")
    assert [r.x for r in df.orderBy("k").collect()] == ["0.9.9", "0.9.10", "1.0.0-rc.1", "1.0.0"]


def test_titles(spark):
    cols = "game string, act string, code string, name string, part string, cat string, seq int, disp string"
    rows = [("A", "Act", "GT-1", "Act", "before", "activity", 3, "d"), ("A", "Act", None, None, None, "activity", 3, "d"), ("A", None, None, None, None, None, None, "d"), ("A", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    c = [F.col(x) for x in ("game", "act", "code", "name", "part", "cat", "seq", "disp")]
    assert [r[0] for r in df.select(classify.story_title(*c)).collect()] == ["A · Act · GT-1 · before", "A · Act · 第 3 篇", "A · d", ""]


def test_normalize_matches_python(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").limit(200).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r.y for r in df.select(tx.normalize(F.col("x")).alias("y")).collect()]
    assert got == [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for t in texts]


def test_language_names(spark):
    got = {c: spark.createDataFrame([(c,)], "x string").select(tx.language(F.col("x"))).first()[0] for c in ("en-US", "ja-JP", "fr-FR", "es-MX", "pt-BR", "zh", " ZH_cn", "ko", "xx")}
    assert got == {"en-US": "EN", "ja-JP": "JP", "fr-FR": "FR", "es-MX": "MX", "pt-BR": "BR", "zh": "CN", " ZH_cn": "CN", "ko": "KR", "xx": "XX"}
    assert set(tx.LANGUAGES.values()) <= set(tx.LANGUAGE_CODES) and len(tx.LANGUAGES) == 26


def test_versions_in_order(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0", "1.0.9", "1.0.10", "99999999999999999999.0.0", "100000000000000000000.0.0"]
    bad = ["1.0", "01.0.0", "1.0.0-01", "1.0.0-", "1.0.0+", "v1.0.0", None, "1.0.0-a..b"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(order + bad)], "k int, v string").withColumn("o", classify.semver_key(F.col("v")))
    assert [r.k for r in df.where("o IS NOT NULL").orderBy("o").collect()] == list(range(len(order)))
    assert df.where("o IS NULL").count() == len(bad)


def test_wiki_roles(spark):
    rows = [("wiki", "", "stories/a"), ("wiki", "", "char_v3/prompt_1"), ("wiki", "", "char_v3/x"), ("wiki", "", "else"), ("wiki", "odd", None), ("wiki", " story ", ""), ("story", "story", "")]
    df = spark.createDataFrame(rows, "k string, r string, p string")
    assert [r[0] for r in df.select(classify.wiki_role(F.col("k"), F.col("r"), F.col("p"))).collect()] == ["story", "character_activity", "character", "other", "other", "story", ""]


def test_labels_of_times(spark):
    rows = [("", "1097年春", None, None), (None, "123世纪", None, None), ("８：05 1098 年", "冬", None, None), ("清晨", "1097年", 1096, 1099), ("某日", None, 1096, None), (None, None, 1096, 1097), (None, None, None, None), ("第二纪元", None, 5, 6)]
    df = spark.createDataFrame(rows, "t string, s string, a int, b int")
    label = fuzzytime.label_of(F.col("t"), F.col("s"))
    out = df.select(fuzzytime.bounds(label, F.col("a"), F.col("b")).alias("b"), label.alias("l"), fuzzytime.display(F.col("t"), F.col("s"), F.col("a"), F.col("b")).alias("d"))
    got = [((r.b.start, r.b.end), tuple(r.o), r.d) for r in out.withColumn("o", fuzzytime.order_key(F.col("l"), F.col("b.start"))).collect()]
    assert got == [
        ((1097, 1097), (1097, 3, 0, 0), "1097年春"),
        ((12201, 12300), (12201, 0, 0, 0), "123世纪"),
        ((1098, 1098), (1098, 0, 0, 485), "８：05 1098 年"),
        ((1096, 1099), (1096, 0, 0, 300), "1096-1099 年 清晨"),
        ((1096, 1096), (1096, 0, 0, 0), "1096 年 某日"),
        ((1096, 1097), (1096, 0, 0, 0), "1096-1097 年"),
        ((None, None), (fuzzytime.LAST, 13, 32, 1440), "时间不详"),
        ((5, 6), (5, 0, 0, 0), "第二纪元"),
    ]


def test_lines_without_their_speaker_and_clipping(spark):
    df = spark.createDataFrame([("Vi", "Vi：  hello"), ("Vi", "Vi : x"), ("Vi", "Vivid: x"), (None, "Vi: x"), ("Vi", None)], "s string, t string")
    assert [r[0] for r in df.select(tx.public_text(F.col("s"), F.col("t"))).collect()] == ["hello", "x", "Vivid: x", "Vi: x", None]
    c = df.select(tx.clipped(F.lit(" a  bcd "), 4).alias("a"), tx.clipped(F.lit(None).cast("string"), 4).alias("b"), tx.clipped(F.lit("ab"), 0).alias("c"), tx.clipped(F.lit("abcd"), 4).alias("d")).first()
    assert [tuple(x) for x in c] == [("a b…", True), ("", False), ("", True), ("abcd", False)]


def test_query_variants():
    assert tx.variants("é") == {"é", "e\u0301"} and "a" in tx.variants("a") and len(tx.variants("\u1ec7" * 20)) == 32
    assert tx.changing_signs("aＡb") == {"Ａ": "a"}


def test_grams_of_signs_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([("😀ab😀",), ("ab",), (None,), ("aaaa",)], "x string")
    assert [sorted(r[0]) for r in df.select(tx.ngrams(F.col("x"), (3,))).collect()] == [["ab😀", "😀ab"], [], [], ["aaa"]]
    assert sorted(df.select(tx.ngrams(F.col("x"))).first()[0]) == sorted(["😀", "a", "b", "😀a", "ab", "b😀", "😀ab", "ab😀"])


def test_citations_and_keys(spark):
    df = spark.createDataFrame([(3, 3, None), (3, 5, None), (3, 5, "概述"), (None, None, None)], "a int, b int, s string")
    assert [r[0] for r in df.select(classify.citation(F.lit("T"), F.col("a"), F.col("b"), F.col("s"))).collect()] == ["《T》第 3 行", "《T》第 3-5 行", "《T》Wiki·概述", "《T》"]
    k = df.select(classify.stage_key(F.lit("gt－3"), F.lit(" Before")), classify.record_key(F.lit("Ａ b"), F.lit("r"), F.lit(2)), classify.collection_name(F.lit(""), F.lit(None).cast("string"), F.lit("Ｘ"))).first()
    assert tuple(k) == ("GT-3\0before", "A b\0r\x002", "X")
