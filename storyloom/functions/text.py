"""Column functions on texts: normal forms, cleaning, keys, clipping, rendering.

Everything but the Unicode normal forms is a built-in expression. Null gives null unless said otherwise; lengths are
code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash signs read as a hyphen in stage codes.
STAGE_DASHES = "‐‑‒–—―−"
#: Language codes, and the 26 names each is known by.
LANGUAGE_CODES = ("CN", "EN", "JP", "KR", "TC", "MX", "BR", "FR", "DE", "RU", "IT", "ID", "TH", "VN")
LANGUAGES = {
    "zh-cn": "CN", "zh-hans": "CN", "en": "EN", "ja": "JP", "ko": "KR", "zh-tw": "TC", "zh-hant": "TC", "es-mx": "MX", "pt-br": "BR",
    "fr": "FR", "de": "DE", "ru": "RU", "it": "IT", "id": "ID", "th": "TH", "vi": "VN", "en-us": "EN", "ja-jp": "JP", "ko-kr": "KR",
    "fr-fr": "FR", "de-de": "DE", "ru-ru": "RU", "it-it": "IT", "id-id": "ID", "th-th": "TH", "vi-vn": "VN",
}
#: Spellings met in delivered tables besides: the bare language of the first code, three-letter codes.
SPELLINGS = {"zh": "CN", "chs": "CN", "cht": "TC", "jpn": "JP", "kor": "KR", "eng": "EN", "ger": "DE", "deu": "DE", "fra": "FR", "fre": "FR", "rus": "RU", "ita": "IT", "tha": "TH", "vie": "VN"}


def _normal(form: str, text: Column) -> Column:
    @F.arrow_udf("string")
    def normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # Arrow's own kernel leaves composed forms decomposed in some builds
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return normal(text)


def nfkc(text: Column) -> Column:
    """Compatibility composed form; one of the few things Spark has no expression for."""
    return _normal("NFKC", text)


def nfc(text: Column) -> Column:
    return _normal("NFC", text)


def squeeze(text: Column) -> Column:
    """Runs of any white space become one space; none stay at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFKC and squeezed; case stays."""
    return squeeze(nfkc(text))


def search_form(text: Column) -> Column:
    """The form literal queries are compared in."""
    return F.lower(normalize(text))


def plain_form(text: Column) -> Column:
    """As ``search_form`` for texts stored in normal form: no Python on the rows."""
    return F.lower(squeeze(text))


#: Style tags of the game's texts.
STYLE_TAGS = "color|b|i|size"


def strip_markup(text: Column) -> Column:
    """Game markup removed: images with their content, references, style and closing tags; a line break is a line feed."""
    text = F.regexp_replace(text, r"(?is)<image(?:\s*=[^>]*>|[^>]*>.*?</image>)", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(text, rf"(?i)<(?:@[^>]*|/|/?(?:{STYLE_TAGS})(?:=[^>]*)?)>", "")


def localised_form(text: Column) -> Column:
    """The form localised texts are looked up by: without markup, in search form."""
    return search_form(strip_markup(text))


def metadata_text(text: Column, most: int = 256, compose: bool = True) -> Column:
    """Control and format signs become spaces, squeezed, clipped; null gives the empty text."""
    text = F.coalesce(text, F.lit(""))
    text = nfc(text) if compose else text
    return F.substring(squeeze(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " ")), 1, most)


def stage_code(text: Column, relaxed: bool = False, compatible: bool = True) -> Column:
    """A public stage code in upper case with plain hyphens, or the empty text if it is none.

    Strict input may hold no white space or control signs.
    """
    raw = F.coalesce(text, F.lit(""))
    raw = nfkc(raw) if compatible else raw
    code = F.upper(F.regexp_replace(F.translate(raw, STAGE_DASHES, "-" * len(STAGE_DASHES)), r"(?U)\s+", ""))
    good = code.rlike("^[A-Z0-9]+(-[A-Z0-9]+)*$") & (F.length(code) <= 32)
    if not relaxed:
        good = good & ~raw.rlike(r"(?U)[\s\p{Cc}\p{Cf}]")
    return F.when(good, code).otherwise("")


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` code points, the last one a mark where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def escape(text: Column, most: int = 160) -> Column:
    """Control signs and white space to single spaces, clipped, and the signs of markup escaped."""
    text = F.substring(squeeze(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " ")), 1, most)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def natural_key(text: Column) -> Column:
    """A string that sorts runs of digits by value and other signs without case; runs beyond 20 digits sort by text."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    pad = lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(x, F.greatest(F.length(x), F.lit(20)), "0"))).otherwise(F.concat(F.lit("1"), x))
    return F.array_join(F.transform(parts, pad), "\x01")


def document_uid(document_id: Column, space: str = "document") -> Column:
    """A short stable id: 16 signs of the URL-safe base64 of a hash; empty for an empty or null id."""
    digest = F.base64(F.unhex(F.sha2(F.concat(F.lit(space + "\0"), document_id), 256)))
    uid = F.concat(F.lit("doc_"), F.substring(F.translate(F.replace(digest, F.lit("="), F.lit("")), "+/", "-_"), 1, 16))
    return F.when(F.length(document_id) > 0, uid).otherwise("")


def tokens_estimate(text: Column) -> Column:
    """A rough number of tokens: two and a half signs each."""
    return F.ceil(F.length(text) / 2.5).cast("bigint")


def line_content(line_type: Column, speaker: Column, text: Column) -> Column:
    """The text of a dialogue line without the speaker it repeats in front."""
    prefix = F.concat(F.coalesce(speaker, F.lit("")), F.lit(":"))
    repeated = (line_type == "dialogue") & (prefix != ":") & F.startswith(text, prefix)
    return F.when(repeated, F.ltrim(F.substr(text, F.length(prefix) + 1))).otherwise(text)


def rendered_line(number: Column, speaker: Column, text: Column) -> Column:
    """A line as shown to readers: ``L<number> <speaker>: <text>``."""
    named = F.length(F.trim(F.coalesce(speaker, F.lit("")))) > 0
    return F.concat(F.lit("L"), number.cast("string"), F.lit(" "), F.when(named, F.concat(F.trim(speaker), F.lit(": "))).otherwise(""), F.coalesce(text, F.lit("")))


def public_text(speaker: Column, text: Column) -> Column:
    """The text of a line without the speaker repeated in front, whichever colon and blanks follow the name."""
    name = F.trim(F.coalesce(speaker, F.lit("")))
    rest = F.ltrim(F.substr(text, F.length(name) + 1))
    named = (name != "") & F.startswith(text, name) & F.substring(rest, 1, 1).isin(":", "：")
    return F.when(named, F.ltrim(F.substring(rest, 2, 1 << 30))).otherwise(text)


def byte_less(a: Column, b: Column) -> Column:
    """Order by UTF-8 bytes, which is Spark's own order of strings, as that of the grams in an index."""
    return a < b


def clipped(text: Column, most: Column | int) -> Column:
    """(text, cut): the squeezed text within ``most`` signs, the last one a mark where something was cut; none for 0."""
    most = F.lit(most) if isinstance(most, int) else most
    plain = squeeze(F.coalesce(text, F.lit("")))
    n = F.length(plain)
    short = F.concat(F.substr(plain, F.lit(1), F.greatest(F.lit(0), most - 1)), F.lit("…"))
    out = F.when((n == 0) | (most <= 0), "").when(n <= most, plain).otherwise(short)
    return F.struct(out.alias("text"), (n > F.greatest(most, F.lit(0))).alias("cut"))


def variants(query: str, most: int = 32) -> set[str]:
    """The spellings of a query that are equal in normal form: decomposed, and with each pair composed in turn."""
    apart = unicodedata.normalize("NFD", query)
    known, open_ = {query, apart}, [apart]
    while open_ and len(known) < most:
        now = open_.pop()
        for k in range(len(now) - 1):
            joint = unicodedata.normalize("NFC", now[k : k + 2])
            new = now[:k] + joint + now[k + 2 :]
            if len(joint) == 1 and new not in known and len(known) < most:
                known.add(new), open_.append(new)
    return known


def changing_signs(text: str) -> dict[str, str]:
    """The signs of a text that the search form changes, and into what: a raw scan has to look for these as well."""
    return {c: form for c in dict.fromkeys(text) if (form := unicodedata.normalize("NFKC", c).lower()) != c}


def highlight_pattern(text: Column, pattern: str) -> Column:
    """Every match of a safe pattern in 【】; matches of nothing are left alone."""
    from storyloom.functions.saferegex import safe_pattern

    return F.regexp_replace(text, f"(?=[\\s\\S])({safe_pattern(pattern)})(?<=[\\s\\S])", "【$1】")


def highlight(text: Column, literal: str, ignore_case: bool = True) -> Column:
    """Every occurrence of a literal in 【】."""
    return F.regexp_replace(text, ("(?i)" if ignore_case else "") + re.escape(literal), "【$0】")


def language(code: Column) -> Column:
    """The canonical language code; unknown codes come back in upper case."""
    low = F.translate(F.lower(F.trim(code)), "_", "-")
    names = F.create_map(*[F.lit(x) for kv in (LANGUAGES | SPELLINGS).items() for x in kv])
    return F.coalesce(names[low], F.upper(low))


def chunk(text: Column, offset: int, width: int) -> Column:
    """A window on a text with its status: ``available``, ``missing`` for null, ``unavailable`` for beyond the end."""
    status = F.when(text.isNull(), "missing").when(F.length(text) <= offset, "unavailable").otherwise("available")
    return F.struct(status.alias("status"), F.substring(text, offset + 1, width).alias("text"))


def ngrams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct character n-grams of a text; empty for null. One pass over the text for each size.

    The pattern matches nothing at every sign and looks ahead; second halves of a pair are no place to start.
    """
    every = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{k - 1}}}))"), F.lit(1)) for k in sizes]
    return F.array_distinct(F.concat(*every) if len(every) > 1 else every[0])


def query_ngrams(query: str) -> list[str]:
    """The grams a literal query needs: of size three, or the whole query if it is shorter; order kept."""
    signs = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query)).strip().lower()
    size = min(3, len(signs))
    return list(dict.fromkeys(signs[k : k + size] for k in range(len(signs) - size + 1))) if size else []
