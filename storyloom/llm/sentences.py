"""Sentences of texts in many languages and scripts, in SQL expressions only.

Marks that end no sentence (dots of decimals, codes, links, initials and abbreviations, list marks, ellipses a sentence
runs on from, everything in quotes and brackets) are masked, each by one private-use sign, so that lengths and
positions stay. What terminators are left, by script, get a separator behind them; the text is split there and the
masked signs are restored. No Python runs on the rows, and no row is shuffled.

Defined results: null, empty and white texts have no sentence; a line break always ends one; positions are code points;
a text that holds the private-use signs itself has them as one neutral sign while it is split, and is cut whole; repeated rows count each for themselves;
texts of any length are cut whole, with the work growing in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------------------------
#: Signs that may end a sentence, and white space that may; each has its private-use sign at the same place.
MARKS = ".!?…。！？｡ \t\u00a0\u3000\u202f\u2009"
MASKS = "".join(chr(0xF8E0 + k) for k in range(len(MARKS)))
DOT, BANG, QUERY, DOTS, STOP, WIDE_BANG, WIDE_QUERY, HALF_STOP = MASKS[:8]
SEPARATOR = "\uf8ff"
#: Set on both sides of quoted stretches.
FENCE = "\uf8fe"
#: Stands for a text's own masks, separators and fences.
NEUTRAL = "\uf8df"

#: Quotes and brackets: opening sign and closing signs that may answer it.
QUOTES = (
    ("「", "」"), ("『", "』"), ("《", "》"), ("〈", "〉"), ("【", "】"), ("（", "）"), ("［", "］"), ("(", ")"), ("[", "]"),
    ("„", "“”"), ("‚", "‘’"), ("“", "”"), ("‘", "’"), ("«", "»"), ("»", "«"), ("‹", "›"), ('"', '"'), ("＂", "＂"),
)
CLOSERS = "」』》〉】）］)\\]”’“‘»«›\"＂"

#: Abbreviations that stand before what they belong to, so their dot never ends a sentence.
LEADING = {
    "en": "Mr Mrs Ms Messrs Dr Drs Prof Rev Hon Pres Gov Sen Rep Amb Gen Col Maj Capt Cpt Lt Cmdr Adm Sgt Cpl Pvt Insp St Mt Ft vs cf viz "
    "e.g i.e approx ca est fig figs Fig Figs p pp vol vols Vol ch chs Ch sec Sec eq Eq ref refs ed eds trans nos Nos op Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Ing Mag Priv Hptm Lt Gen St Nr Nrn Abb Abs Anm Art Aufl Bd Bde Bsp Kap Ausg Hrsg S Z Tab vgl bzw bspw ca evtl ggf ggfs inkl exkl "
    "insb insbes max min zzgl abzgl sog z z.B d.h d.i i.A i.d.R u.U geb gest verh Mio Mrd Tel Jh",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Drs Pr Prs Me Mgr St Ste Cie env cf fig figs chap vol t p pp art éd av apr bd hab réf tél ex.g c.-à-d",
    "es": "Sr Sres Sra Sras Srta Srtas D Dña Dra Dr Dres Cap Cdte Cnel Gral Tte Sgto Prof Profa Lic Ing Arq Mons Excmo Excma Sto Sta Ud Uds Vd Vds aprox pág págs fig figs cap caps art núm núms vol vols ed eds tel av avda Avda p.ej",
    "ru": "проф Проф доц Доц акад Акад им Им св Св тов Тов гр Гр ок см См ср Ср рис Рис табл гл Гл стр разд т.е т.н напр ул пл просп пер наб г-н г-жа тел тыс",
}
#: Month names after which a number with a dot is no end (ordinal dates).
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Chinese verbs of saying: a quote goes on if a name, one of these, perhaps with 道, 着 or 了, and an end mark follow.
SAYING = (
    "说问答喊叫笑道讲嚷吼念骂叹劝唱写",
    "回答 回应 应答 低语 耳语 私语 宣布 宣告 解释 说明 补充 嘟囔 嘟哝 嘀咕 咕哝 呢喃 喃喃 反驳 反问 追问 质问 询问 发问 强调 提醒 承认 否认 命令 吩咐 嘱咐 叮嘱 建议 提议 警告 抱怨 感叹 感慨 "
    "惊呼 惊叫 高呼 欢呼 咆哮 怒吼 重复 表示 插话 插嘴 打断 附和 汇报 报告 介绍 评论 总结 祈祷 安慰 催促 恳求 央求 哀求 请求 答应 赞叹 称赞 嘲讽 调侃 打趣 开口",
)
#: Particles that carry a Japanese sentence on after a quote.
PARTICLES = "と|って|を|の"

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々"
BREAK = r"\n\r\x0B\f\x{85}\x{2028}\x{2029}"
#: White space within a line, and all of it as plain signs to strip.
SPACE = r"[ \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
WHITE = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85      　" + "".join(map(chr, range(0x2000, 0x200B)))
THAI = r"\x{0E01}-\x{0E3A}\x{0E40}-\x{0E4E}"
OPENERS = "".join(a for a, _ in QUOTES)


def _mask_quoted(text: Column) -> Column:
    """Mask every mark between a quote or bracket and the one that closes it in the same line.

    Each such stretch is fenced, so that a split at the fences gives what is outside and inside in turns. (Matches are not
    extracted, as each of those copies the whole text.)
    """
    spans = "|".join(f"\\Q{a}\\E[^{BREAK}\\Q{b}\\E]*+[\\Q{b}\\E]" for a, b in QUOTES)
    parts = F.split(F.regexp_replace(text, F.lit(spans), F.lit(f"{FENCE}$0{FENCE}")), FENCE)
    return F.array_join(F.transform(parts, lambda x, k: F.when(k % 2 == 1, F.translate(x, MARKS, MASKS)).otherwise(x)), "")


def _dots() -> str:
    """A dot that ends no sentence. The dot comes first in the pattern, so that other signs are passed over fast."""
    words = sorted({w for line in LEADING.values() for w in line.split()}, key=lambda w: (-len(w), w))
    leading = "|".join(w.replace(".", rf"[.]{SPACE}?") for w in words)
    alone = r"(?<![\p{L}\p{N}.])"
    return r"\.(?:" + "|".join([
        # something other than an end stands right behind: decimals, codes, links, list marks, parts of abbreviations
        rf"(?=[^{BREAK}.!?…{CLOSERS} \t\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}])",
        # what runs on: a small letter or a number behind, in the same line
        rf"(?=[.…]*+{SPACE}++[\p{{Ll}}\p{{N}}])",
        rf"(?={SPACE})(?<={alone}(?:{leading})[.])",
        rf"(?={SPACE})(?<={alone}\p{{Lu}}[.])",
        rf"(?={SPACE}(?:{MONTHS})\b)(?<=\d[.])",
    ]) + ")"


def _ellipses() -> str:
    """An ellipsis that ends no sentence: it runs on, or it stands in a line of Chinese or Japanese."""
    return rf"…(?:(?=…*+{SPACE}++[\p{{Ll}}\p{{N}}])|(?=…*+{SPACE}?[{CJK}])|(?<=[{CJK}）」』]…))|\G(?<=…)…"


#: A list mark at the start of a line, up to its dot, and up to the blank behind it.
LIST_DOT = rf"^({SPACE}*+\d++)\."
LIST_BLANK = rf"^({SPACE}*+(?:\d++[.{DOT})）]|[(（]\d++[)）]|[-*•·–—])){SPACE}"
#: Signs that close what an unmasked mark stands in can only be these; the others open the next sentence.
SURE_CLOSERS = "」』》〉】）］)\\]”’›"
_NO_SMALL = rf"(?!{SPACE}*+(?:[—–-]++{SPACE}*+)?\p{{Ll}})(?!{SPACE}*+[,;:.!?…])"
_EDGE = r"(?=[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}「『“‘„«]|$)"
_CLOSE = rf"(?:[{CLOSERS}]|[\x{{A0}}\x{{202F}} {MASKS[8:]}]»)[{SURE_CLOSERS}]*+"

#: Ends in scripts with spaces, and lines.
SPACED_END = (
    rf"(?=[.!?…{BREAK}{DOT}{BANG}{QUERY}{DOTS}])(?:"
    rf"[.!?…]++(?![{SURE_CLOSERS}]){_EDGE}{_NO_SMALL}"
    rf"|[.!?…{DOT}{BANG}{QUERY}{DOTS}]++{_CLOSE}{_EDGE}{_NO_SMALL}"
    rf"|[{BREAK}]++)"
)
#: East Asian ends: bare, or inside a quote that closes while nothing carries the sentence on.
WIDE_END = (
    rf"(?=[。！？｡{STOP}{WIDE_BANG}{WIDE_QUERY}{HALF_STOP}{DOTS}])(?:"
    rf"[。！？｡][。！？｡!?]*+[{SURE_CLOSERS}]*+(?![，、；：,;:])"
    rf"|[{STOP}{WIDE_BANG}{WIDE_QUERY}{HALF_STOP}{DOTS}]++[{CLOSERS}][{SURE_CLOSERS}]*+(?![。！？｡!?，、；：,;:.…{MASKS[:8]}{SURE_CLOSERS}])"
    rf"(?![^。！？…：，、\s「『“‘（]{{1,24}}?(?:[{SAYING[0]}]|{SAYING[1].replace(' ', '|')})[道着了]?[。！？!?…]|{PARTICLES}|的))"
)
#: Thai: white space, unless beside a digit.
THAI_END = rf"{SPACE}(?:(?<=[{THAI}].)(?!{SPACE}*+[\p{{N}}{BREAK}])|(?<=[^\p{{N}}\s:：].)(?={SPACE}*+[{THAI}]))"
#: The same in texts of Han or kana without end marks.
BLANK_END = THAI_END.replace(THAI, CJK)
#: Pieces in one step of the running sums, and such steps in one of the steps above; beyond some 10 million pieces of one
#: text the sums over the latter, which grow as (pieces / STEP ** 2) ** 2, begin to show.
STEP = 32


def _put(c: Column, pattern: str, on: Column) -> Column:
    """Set the separator behind every match, where ``on`` says that the text can have one."""
    return F.when(on, F.regexp_replace(c, F.lit(pattern), F.lit("$0" + SEPARATOR))).otherwise(c)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos, sentence): each sentence of the column ``text`` with its place in it."""
    t = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length(F.btrim("__text", F.lit(WHITE))) > 0)
    m = F.col("__m")
    own = MASKS + SEPARATOR + FENCE
    clash = F.col("__text").rlike("[" + own + "]")
    # one projection for each step: what is used twice is computed once
    t = t.withColumn("__m", F.when(clash, F.translate("__text", own, NEUTRAL * len(own))).otherwise(F.col("__text")))
    t = t.withColumn("__m", F.when(m.rlike("[" + "".join(f"\\Q{a}\\E" for a in OPENERS) + "]"), _mask_quoted(m)).otherwise(m))
    t = t.withColumn("__m", F.when(m.contains("."), F.regexp_replace(F.regexp_replace(m, F.lit("(?m)" + _dots()), F.lit(DOT)), F.lit("(?m)" + LIST_DOT), F.lit("$1" + DOT))).otherwise(m))
    t = t.withColumn("__m", F.when(m.contains("…"), F.regexp_replace(m, F.lit(_ellipses()), F.lit(DOTS))).otherwise(m))
    t = t.withColumn("__cjk", m.rlike(f"[{CJK}]")).withColumn("__thai", m.rlike(f"[{THAI}]"))
    t = t.withColumn("__bare", F.col("__cjk") & ~m.rlike("[。！？｡]"))
    t = t.withColumn("__m", F.when(F.col("__thai") | F.col("__bare"), F.regexp_replace(m, F.lit("(?m)" + LIST_BLANK), F.lit("$1" + MASKS[8]))).otherwise(m))
    t = t.withColumn("__m", _put(m, THAI_END, F.col("__thai")))
    t = t.withColumn("__m", _put(m, BLANK_END, F.col("__bare")))
    t = t.withColumn("__m", _put(m, WIDE_END, F.col("__cjk")))
    t = t.withColumn("__m", F.regexp_replace(m, F.lit(SPACED_END), F.lit("$0" + SEPARATOR)))
    t = t.withColumn("__pieces", F.split(m, SEPARATOR))
    t = t.withColumn("__sizes", F.transform("__pieces", lambda x: F.length(x)))
    # where each piece starts: running sums in three levels, so that long texts cost in proportion
    add = lambda a, x: a + x
    step = lambda k: F.floor(k / STEP).cast("int")
    steps = F.sequence(F.lit(0), step(F.size("__sizes") - 1))
    t = t.withColumn("__sums", F.transform(steps, lambda c: F.aggregate(F.slice("__sizes", c * STEP + 1, F.lit(STEP)), F.lit(0), add)))
    tops = F.sequence(F.lit(0), step(F.size("__sums") - 1))
    t = t.withColumn("__tops", F.transform(tops, lambda c: F.aggregate(F.slice("__sums", c * STEP + 1, F.lit(STEP)), F.lit(0), add)))
    t = t.withColumn("__under", F.transform("__tops", lambda x, k: F.aggregate(F.slice("__tops", F.lit(1), k), F.lit(0), add)))
    # the sums are named twice, or the optimiser would move their making into the lambda, once for every piece
    at = lambda sums, k: F.when(F.size(sums) > step(k), F.element_at(sums, step(k) + 1))
    t = t.withColumn("__bases", F.transform("__sums", lambda x, k: at("__under", k) + F.aggregate(F.slice("__sums", step(k) * STEP + 1, k % STEP), F.lit(0), add)))
    within = lambda k: F.aggregate(F.slice("__sizes", step(k) * STEP + 1, k % STEP), F.lit(0), add)
    start = lambda k: at("__bases", k) + within(k)
    restored = lambda x: F.translate(x, MASKS, MARKS)
    plain = F.transform("__pieces", lambda x, k: F.struct(restored(x).alias("piece"), start(k).alias("at")))
    # texts that hold the private-use signs themselves are cut from the original
    exact = F.transform("__pieces", lambda x, k: F.struct(F.substr(F.col("__text"), start(k) + 1, F.length(x)).alias("piece"), start(k).alias("at")))
    # the outer form, as for the inner one the optimiser infers a filter and copies all of the above into it
    t = t.select("__key", F.explode_outer(F.when(clash, exact).otherwise(plain)).alias("p"))
    t = t.select("__key", "p.at", F.ltrim("p.piece", F.lit(WHITE)).alias("tail"), F.length("p.piece").alias("n"))
    t = t.select("__key", F.rtrim("tail", F.lit(WHITE)).alias("sentence"), (F.col("at") + F.col("n") - F.length("tail")).cast("bigint").alias("start_pos"))
    t = t.where(F.length("sentence") > 0)
    return t.select(F.col("__key").alias(key), "start_pos", (F.col("start_pos") + F.length("sentence")).alias("end_pos"), "sentence")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of ``documents``."""
    return sentences(documents, "doc_id", "text").select("doc_id", "start_pos", "end_pos")
