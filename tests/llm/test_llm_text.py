"""One form, tokens, sentences."""

import pytest

from storyloom.llm import oneform, sentences, tokens

form = oneform.transducer()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- one form ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "a,b",
    [
        ("Ｔｈｏ　ＫＸ－４", "Tho KX-4"), ("\u0411\u03bf\u200b\u0431o\u0434\u043e\u043b", "\u0411\u043e\u0431\u043e\u0434\u043e\u043b"), ("ﾊｸﾐﾝ", "ハクミン"), ("八クミン", "ハクミン"), ("ｸﾞﾗ", "グラ"), ("カ‍ﾞ", "ガ"),
        ("Olfén", "Olfén"), ("Olfе́n", "Olfén"), ("Ngуệt", "Ngyệt"), ("웬⁠웅", "웬웅"), ("시‎ᆯ", "실"),
        ("KX‐4", "KX−4"), ("a b", "a b"), ("﻿ a 　", "a"), ("⽇蚀", "日蚀"), ("里", "里"), ("Tide Ⅳ", "Tide IV"), ("so­ft", "soft"), ("ａ︎", "a"),
    ],
)
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", [("Brybrytek", "bRybrytek"), ("Olfen", "Olfén"), ("Olfèn", "Olfén"), ("KX-²", "KX-2"), ("KX-②", "KX-2"), ("バ", "パ"), ("ク", "グ"), ("日", "目"), ("a!", "a"), ("⑴", "(1)"), ("Nguêt", "Nguệt"), ("ab", "a b")])
def test_other_look(a, b):
    assert form(a) != form(b)


def test_form_is_stable_and_defined_at_the_edges():
    assert form(None) is None and form("") == "" and form(" ​　") == ""
    for s in ["Ｔｈｏ　ＫＸ－４", "八クﾐﾝ", "ẹ́", "ﬁn Ⅳ ㌔", "́", "a" * 100_000 + "Ａ", "ᄀ​ᅡ"]:
        assert form(form(s)) == form(s)


def test_rules_have_no_conflict_and_outputs_are_final():
    rules = oneform.build_rules()
    assert all(not any(c in rules for c in t) for t in rules.values())


def test_sequences_match_longest_and_conflicts_between_overlaps_are_refused():
    rules = oneform.build_rules()
    sequences = oneform.build_sequences(rules)
    assert sequences["\u03b1\u0301"] == "\xe1" and sequences["\uff76\uff9e"] == "ガ" and sequences["e\u0302\u0301"] == "ế"
    oneform.check_sequences(rules, sequences)
    only = oneform.Transducer((rules | {"xy": "z", "xyw": "v"}, "xyw", "w"))
    assert only._emit("xyw") == "v" and only._emit("xyx") == "zx"
    for bad in ({"e\u0301": "e"}, {"ab": "\u0430b"}, {"a\u0301": "á", "a\u0301\u0323": "á"}):
        with pytest.raises(oneform.Conflict):
            oneform.check_sequences(rules, bad)


def test_printed_formats_and_joiners_that_show_stay():
    persian, family = "می\u200cخواهم", "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    for s in ("\u0600\u0661", "\u06dd12", "\U000110bd", persian, family, "क्\u200dष"):
        assert form(s) == s or form(s) == form(form(s)) and any(c in form(s) for c in oneform.JOINERS)
    assert form("a\u200db") == "ab" and form("\u200cカ\u200dﾞ\u200d") == "ガ" and form("ا\u200d\u200cب") == "اب"


def test_form_of_form_at_random():
    import random

    rng = random.Random(3)
    signs = "aеéЁ\u0301\u0323\u0308ｶカﾞﾟﾊハ八\u200b\u200d\u200cم्क🛰\ufe0f ​　-‐각가ⅣﬁＡ\u0600\xa0\n"
    for _ in range(20_000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(1, 9)))
        assert form(form(s)) == form(s), ascii(s)


def test_conflicting_tables_are_refused(monkeypatch):
    monkeypatch.setattr(oneform, "KANA_ALIKE", {"ハ": "八", "ホ": "八"})
    with pytest.raises(oneform.Conflict):
        oneform.build_rules()


def tables(spark, lines, timelines, names):
    return (
        spark.createDataFrame(lines, "line_id bigint, speaker_raw string, text string, form string"),
        spark.createDataFrame(timelines, "row_id bigint, activity_name string"),
        spark.createDataFrame(names, "name_id bigint, field string, name string"),
    )


def test_found(spark):
    t = tables(
        spark,
        [(1, "Ｔho", "Tho", "x"), (1, "Tho", None, "x"), (2, None, "Ｔho", "x"), (3, "", " ", "x"), (4, "tho", "Th0", "x"), (5, "Ｔho", None, "x")],
        [(7, "Tho​"), (8, None)],
        [(100, "speaker_raw", "Tho"), (101, "activity_name", "Tho"), (102, "text", " "), (103, "speaker_raw", "Тhо")],
    )
    assert rows(oneform.found(*t)) == [("activity_name", 7, 101), ("speaker_raw", 1, 100), ("speaker_raw", 1, 103), ("speaker_raw", 1, 103), ("speaker_raw", 5, 100), ("speaker_raw", 5, 103)]
    u = {(r.field, r.row_id, r.value, r.name_id) for r in oneform.unified(*t).collect()}
    assert ("text", 2, "Tho", None) in u and ("speaker_raw", 5, "Tho", 100) in u and ("speaker_raw", 3, "", None) in u
    assert oneform.found(t[0].limit(0), t[1].limit(0), t[2]).count() == 0 and oneform.found(t[0], t[1], t[2].limit(0)).count() == 0


# --- tokens --------------------------------------------------------------------------------------------------------
def test_tokens_agree_with_another_library_and_decode(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()]
    texts += ["", " ", "\n\n  x", "<|endoftext|>", "I'll we've 'S", "🛰️é​", "a" * 3000, " " * 500, "\x00\x7f", "١٢٣ ௧ Ⅷ", "ᲉꟋ"[:0]]
    e = tokens.encoder()
    assert e.encode_many(texts) == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]
    assert [e.decode(i) for i in e.encode_many(texts)] == texts


def test_ids_query(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, None, 1), (3, "", 1), (1, "hello world", 1)], "doc_id bigint, text string, ids int")
    got = rows(df.select("doc_id", tokens.with_ids(df, "text"), tokens.token_counts(df, "text")))
    assert got == [(1, [31373, 995], 2), (1, [31373, 995], 2), (2, [], 0), (3, [], 0)]
    assert df.limit(0).select(tokens.with_ids(df, "text")).count() == 0


def test_small_memory_gives_the_same(monkeypatch):
    e = tokens.encoder()
    texts = [f"word{k} and more{k % 7}" for k in range(500)]
    whole = e.encode_many(texts)
    monkeypatch.setattr(tokens, "REMEMBER", 10)
    assert [x for turn in e.in_turns(texts, 50) for x in turn] == whole


# --- sentences -----------------------------------------------------------------------------------------------------
CASES = {
    "en": [
        "Dr. R. T. Olm met Mr. Xo at 6.40 a.m. sharp.|They left (see p. 12. and p. 14.)!|No. 7 stayed in the N.E.R.|“A. B went. Gone?” said Vi.|He saw e.g. two... and left...|Not yet...|End",
        '"Go. Now!" she said. |"Stay." |Then ropes, lamps, etc. |Pax said: "One. Two." |By 9 p.m. |She slept at Olm & Co. |Who?!',
    ],
    "de": ["Hr. Pi kam am 3. Mai um ca. 3,5 m.|Er trug z. B. Seile usw. |„Halt. Wer da?“ fragte Lu.|»Nein. Nie…« |Und dann… und weiter.|Siehe Kap. 4.2.|Ende"],
    "fr": ["M. Lu a dit : «\xa0Non. Jamais\xa0!\xa0» |J.-K. Pa est venu, p. ex. ici.|Env. 3,5 m, etc. |Qui va là ?|Fin"],
    "es": ["¡Resistid! |¿Quién va? |Sr. Pi llegó a las 6.40 a. m. en punto.|Vio n.º 7, etc. |«Sí. No.» dijo Lu.|Fin"],
    "ru": ["Проф. К. Ли жил в 1097 г. у реки.|Взял лампы и т. д. |«Да. Нет!» — сказал Им. Пи.|Ждал… и ушёл…|Конец"],
    "zh": ["他说：「走。快！」|K.加多尔在图3.2里。|「不。」卢温低声问。|他走了……却无人应答？！|（无人。也无记录。）。|《旧账·卷二》。|完"],
    "xx": ["Maj. Lu and Sen. Pi met in Sept. at Ft. Olm, Figs. 3 and 4. |Then they left.", "Das war die Aufl. von Bd. 3, insb. Tab. 4. |Fertig.", "Mgr. Lu et Ste. Anne, éd. Pi. |Fini.", "Vio a la Profa. Lu y al Gral. Pi en la Avda. Sol. |Fin.", "Доц. Ли живёт на ул. Садовой. |Конец."],
    "zh2": ["「住手！」帕洛怒吼道。|「好。」他叹了。|「走。」她嘀咕着。|「来。」|他们守住了。"],
    "ja": ["『行け。今！』とパが言った。|彼は「いや。」と答えた。|誰だ？|返事は……だが来ない。|終わり"],
    "ko": ["“가. 지금!”라고 K. 올이 말했다. |No. 7 구역에서. |누구냐?"],
}


def cut(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [(r.start_pos, r.end_pos, r.sentence) for r in sentences.sentences(df, "doc_id", "text").orderBy("start_pos").collect()]


@pytest.mark.parametrize("lang,k", [(x, k) for x in CASES for k in range(len(CASES[x]))])
def test_sentences(spark, lang, k):
    parts = CASES[lang][k].split("|")
    joint = "" if lang in ("zh", "zh2", "ja") else " "
    text = joint.join(p.strip() for p in parts)
    got = cut(spark, text)
    assert [s for _, _, s in got] == [p.strip() for p in parts]
    assert all(text[a:b] == s for a, b, s in got)


def test_lines_lists_titles_and_scripts_without_marks(spark):
    text = "KX-ST-4\n1. One. \r\n(2) Two\n- Three!\n<notes>\n\n旧账\n"
    assert [s for _, _, s in cut(spark, text)] == ["KX-ST-4", "1. One.", "(2) Two", "- Three!", "<notes>", "旧账"]
    assert [s for _, _, s in cut(spark, "雨后修好了 7 块钢板　没有人知道 误差3.5%")] == ["雨后修好了 7 块钢板", "没有人知道", "误差3.5%"]
    assert [s for _, _, s in cut(spark, "雨后修好了。没有人 知道。")] == ["雨后修好了。", "没有人 知道。"]
    assert [s for _, _, s in cut(spark, "ปาซูแลก 7602 ชุด โบปาซู\n1. ทาหาย")] == ["ปาซูแลก 7602 ชุด", "โบปาซู", "1. ทาหาย"]


def test_sentence_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, " \n　", 9), (4, "A. B", 9), (4, "A. B", 9)], "doc_id bigint, text string, start_pos int")
    assert [tuple(r) for r in sentences.found(df.where("doc_id < 4")).collect()] == []
    assert sentences.found(df).count() == 2 and sentences.found(df.limit(0)).count() == 0
    own = "x" + sentences.DOT + ". Y" + sentences.SEPARATOR + "z."
    assert [s for _, _, s in cut(spark, "　 " + own)][0].startswith("x" + sentences.DOT)


def test_long_text(spark):
    text = "Lu went home. " * 20_000
    got = cut(spark, text)
    assert len(got) == 20_000 and got[-1] == (14 * 19_999, 14 * 19_999 + 13, "Lu went home.")


def test_many_short_sentences_of_one_text(spark):
    text = "Go on. " * 300_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    r = sentences.found(df).agg(F.count("*").alias("n"), F.max("start_pos").alias("last"), F.sum(F.col("start_pos") % 7).alias("off")).first()
    assert tuple(r) == (300_000, 7 * 299_999, 0)


def test_own_private_use_signs_end_nothing(spark):
    texts = ["One  two. Three  four! Five.", "Alpha beta. Gamma delta.", "好的。行了。"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(sentences.sentences(df, "doc_id", "text").collect())
    assert [r.sentence for r in got] == ["One  two.", "Three  four!", "Five.", "Alpha beta.", "Gamma delta.", "好的。", "行了。"]
    assert all(texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence for r in got)


def test_own_fences_and_open_quotes(spark):
    texts = ["One \uf8fe two. “Three\uf8fe. Four.” Five.", "(open. Not closed.\nNew (one. two) three.", "“a. b” «c. d» [e. f]. Next."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(sentences.sentences(df, "doc_id", "text").collect())
    assert [r.sentence for r in got] == [
        "One \uf8fe two.", "“Three\uf8fe. Four.”", "Five.", "(open.", "Not closed.", "New (one. two) three.", "“a. b” «c. d» [e. f].", "Next.",
    ]
    assert all(texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence for r in got)


def test_list_marks_and_ellipses_of_any_width(spark):
    texts = [" " * 12 + "1. Foo bar.\n" + " " * 30 + "12345678. Baz.", "他说" + "…" * 14 + " She left."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.sentence for r in sorted(sentences.sentences(df, "doc_id", "text").collect())]
    assert got == ["1. Foo bar.", "12345678. Baz.", texts[1]]
