"""One consistent form for texts that look the same but differ in their characters.

A transducer is compiled once from a precomputed mapping that is checked for conflicts: a trie over code points whose
final states hold an output. Its sources are single signs (widths, spaces, dashes, look-alike letters) and sequences:
letters of any look with their accents, half-width kana with their voice marks. It runs over the text in one pass,
grapheme cluster by grapheme cluster, takes the longest match at each place, and drops signs that cannot be seen on the
way, so that accents typed as separate marks, and marks that an unseen sign had cut off their letter, come out as one
sign. Hangul, whose composition is a formula, and clusters that have no sign of their own are composed by the normal form.

What counts as the same look: full- and half-width forms, kinds of spaces, kinds of dashes, signs that cannot be seen,
spaces at either end, compatibility copies of letters (radicals, ligatures, Roman numerals), letters drawn alike in
other scripts. Case, accents, raised, lowered, encircled and bracketed signs stay apart. Format characters that print
(Arabic number signs and the like) stay, and so do joiners where they show: within emoji and between letters of scripts
that join. Variation selectors count as unseen.

The form is for comparison: look-alikes go to one representative whatever script the text is in (so a CJK sign drawn
like a kana goes to the kana). ``agreed`` gives the agreed spelling where a value meets one.

Defined results: null gives null; empty text and text of unseen signs or spaces only give the empty text; texts of any
length are read whole; the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: letters drawn alike, representative first -------------------------------------------------------
#: Latin, then the Greek, Cyrillic, Armenian and other letters drawn like it.
LATIN_ALIKE = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ",
    "K": "ΚКᏦK", "L": "Ꮮ", "M": "ΜМϺᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ",
    "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "k": "ķ"[:0], "l": "ӏ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛգ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "z": "ᴢ",
}
#: Kana, then the CJK signs drawn like it.
KANA_ALIKE = {
    "ハ": "八", "カ": "力", "ロ": "口囗", "エ": "工", "ニ": "二", "タ": "夕", "ト": "卜", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "ー": "一",
    "ノ": "丿", "メ": "乄",
}
#: Kinds of dashes; the representative is the hyphen-minus.
DASHES = "‐‑‒–—―−⁃˗֊᠆﹘﹣－⸺⸻"
#: Blank letters and signs without ink besides the format characters and variation selectors.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ⠀"
#: Kinds of compatibility forms that look like what they stand for, and blocks of them that don't.
LIKE_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")
UNLIKE_BLOCKS = ((0x2100, 0x214F), (0x2474, 0x24B5), (0x3200, 0x33FF), (0x1F100, 0x1F2FF), (0x017F, 0x017F), (0xFB13, 0xFDFF), (0xFE70, 0xFEFE))


#: Format characters that print: signs before numbers, the end of a verse, abbreviation and number marks.
PRINTED_FORMATS = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0xFFF9, 0xFFFB), (0x13430, 0x1343F), (0x1D173, 0x1D17A))
#: Joiners, and what they show between: letters of scripts that join or form conjuncts, emoji.
JOINERS = "\u200c\u200d"
JOINING = ((0x0620, 0x06FF), (0x0710, 0x074F), (0x0750, 0x077F), (0x07C0, 0x07FF), (0x0840, 0x08FF), (0x0900, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x17D3), (0x1820, 0x18AA), (0xA840, 0xA877), (0x10AC0, 0x10AFF), (0x1E900, 0x1E943))
PICTURES = ((0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF), (0x2300, 0x23FF))


class Conflict(ValueError):
    """Two rules disagree, or an output would be changed again."""


def _is_unseen(c: str) -> bool:
    k = ord(c)
    format_ = unicodedata.category(c) == "Cf" and not any(a <= k <= b for a, b in PRINTED_FORMATS)
    return format_ or c in UNSEEN or 0xFE00 <= k <= 0xFE0F or 0xE0100 <= k <= 0xE01EF


def build_rules() -> dict[str, str]:
    """Source -> output of every single sign that changes, from the tables above and Unicode's own data."""
    rules: dict[str, str] = {}

    def add(source: str, target: str, weak: bool = False) -> None:
        if source == target:
            return
        if rules.get(source, target) != target:
            if weak:
                return
            raise Conflict(f"{source!r}: {rules[source]!r} or {target!r}")
        rules[source] = target

    for table in (LATIN_ALIKE, KANA_ALIKE):
        for target, sources in table.items():
            for s in sources:
                add(s, target)
    for s in DASHES:
        add(s, "-")
    for k in range(0x110000):
        if 0xD800 <= k <= 0xDFFF:
            continue
        c = chr(k)
        if _is_unseen(c):
            add(c, "")
        elif unicodedata.category(c) == "Zs" or c in "\t\n\v\f\r\x85  ":
            add(c, " ")
        else:
            kind, _, code = unicodedata.decomposition(c).partition(" ")
            if kind in LIKE_FORMS and not any(a <= k <= b for a, b in UNLIKE_BLOCKS):
                # further rules apply to what it stands for: a full-width dash is a dash, a kana radical a kana
                form = "".join(chr(int(x, 16)) for x in code.split())
                if not form.startswith(" ") and form != "-":
                    add(c, form, weak=True)
            elif kind and not kind.startswith("<") and " " not in code and not code:
                add(c, unicodedata.normalize("NFC", c), weak=True)  # canonical copies: compatibility ideographs
    # close the rules: an output must not change again
    for _ in range(8):
        again = {s: "".join(rules.get(x, x) for x in t) for s, t in rules.items()}
        if again == rules:
            break
        rules = again
    else:
        raise Conflict("the rules run in a circle")
    for s, t in rules.items():
        if any(x in rules for x in t):
            raise Conflict(f"{s!r} gives {t!r}, which changes again")
    return rules


def build_sequences(rules: dict[str, str]) -> dict[str, str]:
    """Source -> output of every sequence of signs that has one sign of its own: a letter of any look with its accents.

    For each sign that Unicode composes of others, its parts in canonical order are a source, with every look-alike of
    the first part in its place; so are the kana whose voice marks have a half-width form.
    """
    alike: dict[str, list[str]] = {}
    for source, target in rules.items():
        if len(target) == 1:
            alike.setdefault(target, []).append(source)
    out: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if out.get(source, target) != target:
            raise Conflict(f"{source!r}: {out[source]!r} or {target!r}")
        out[source] = target

    for k in range(0x110000):
        if 0xD800 <= k <= 0xDFFF or not (parts := unicodedata.decomposition(chr(k))) or parts.startswith("<"):
            continue
        parts = unicodedata.normalize("NFD", chr(k))
        if len(parts) < 2:
            continue
        base = rules.get(parts[0], parts[0])
        target = unicodedata.normalize("NFC", base + parts[1:])
        for first in {parts[0], base, *alike.get(base, ())}:
            add(first + parts[1:], target)
        if half := {"\u3099": "\uff9e", "\u309a": "\uff9f"}.get(parts[1:]):
            for first in {base, *alike.get(base, ())}:
                add(first + half, target)
    return out


def check_sequences(rules: dict[str, str], sequences: dict[str, str]) -> None:
    """Where rules overlap, every way to read a text must come to the same; else the longest match would hide a conflict.

    A sequence read sign by sign and composed, and read as a shorter sequence and a rest, must give its output; an
    output must not be part of any source, alone or with what may follow it.
    """
    say = lambda text: "".join(rules.get(c, c) for c in text)
    for source, target in sequences.items():
        for cut in range(1, len(source) + 1):
            head = source[:cut]
            read = (sequences.get(head) or say(head)) + say(source[cut:])
            if unicodedata.normalize("NFC", read) != target:
                raise Conflict(f"{source!r} gives {target!r}, but {head!r} and the rest give {read!r}")
        if target in rules or any(c in rules for c in target):
            raise Conflict(f"{source!r} gives {target!r}, which changes again")


def compile_rules() -> tuple[dict[str, str], str, str]:
    """The checked rules, and as ranges of code points the signs they may start at and those that join the sign before."""
    rules = build_rules()
    sequences = build_sequences(rules)
    check_sequences(rules, sequences)
    points = [k for k in range(0x110000) if not 0xD800 <= k <= 0xDFFF]
    marks = {k for k in points if unicodedata.category(chr(k)) in ("Mn", "Mc", "Me")}
    # accents of look-alike letters: decomposed first, so that the letter below the accent is seen
    composed = {k for k in points if unicodedata.decomposition(chr(k)) and unicodedata.normalize("NFD", chr(k))[:1] in rules}
    jamo = {*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD800)}
    joiners = {ord(c) for c in JOINERS}
    follow = (marks | jamo | {ord(s) for s, t in rules.items() if t == ""} | {0xFF9E, 0xFF9F}) - joiners
    return rules | sequences, _ranges(({ord(s) for s in rules} | composed | follow) - joiners), _ranges(follow)


class Transducer:
    """The compiled rules: a trie over code points, read with longest match, and its one-pass runner."""

    def __init__(self, compiled: tuple[dict[str, str], str, str]):
        rules, active, follow = compiled
        self.trie: dict = {}
        for source, target in rules.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        # a stretch to work on: a grapheme cluster with marks or unseen signs, or a sign that changes; joiners are unseen
        # unless they stand between two signs that they join
        letter, picture = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for ranges in (JOINING, PICTURES))
        shown = f"(?<=[{letter}])[{JOINERS}](?=[{letter}])|(?:(?<=[{picture}])|(?<=[{picture}]\ufe0f))\u200d(?=[{picture}])"
        tail = f"(?:[{follow}]|(?!{shown})[{JOINERS}])+"
        self.stretch = re.compile(f"[^{follow}{JOINERS}]?{tail}|[{active}]")
        self.active = re.compile(f"[{active}{JOINERS}]")
        self.known: dict[str, str] = {}

    def _emit(self, stretch: str) -> str:
        out, k, n = [], 0, len(text := unicodedata.normalize("NFD", stretch))
        while k < n:
            node, best, end, j = self.trie, None, k, k
            while j < n and text[j] in node:
                node = node[text[j]]
                j += 1
                if "" in node:
                    best, end = node[""], j
            if best is None:
                out.append(text[k])
                k += 1
            else:
                out.append(best)
                k = end
        return unicodedata.normalize("NFC", "".join(out))

    def _stretch(self, m: re.Match) -> str:
        s = m.group()
        if (t := self.known.get(s)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            t = self.known[s] = self._emit(s)
        return t

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text.strip(" ") if text.isprintable() else self.stretch.sub(self._stretch, text).strip(" ")
        if self.active.search(text):
            text = self.stretch.sub(self._stretch, text)
            # marks put in order may have changed what stands beside a joiner that was kept
            while ("\u200d" in text or "\u200c" in text) and (again := self.stretch.sub(self._stretch, text)) != text:
                text = again
        return text.strip(" ")


def _ranges(points: set[int]) -> str:
    out, start, last = [], None, None
    for k in [*sorted(points), None]:
        if last is not None and k == last + 1:
            last = k
            continue
        if start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
        start = last = k
    return "".join(out)


_transducers: dict[int, Transducer] = {}
_compiled: list[tuple[dict[str, str], str, str]] = []


def compiled_rules() -> tuple[dict[str, str], str, str]:
    """The rules of this process, compiled on first use."""
    if not _compiled:
        _compiled.append(compile_rules())
    return _compiled[0]


def transducer(compiled: tuple[dict[str, str], str, str] | None = None) -> Transducer:
    """The transducer of this process; workers get the compiled rules and need not derive them."""
    compiled = compiled or compiled_rules()
    key = hash((len(compiled[0]), compiled[1], compiled[2]))
    if key not in _transducers:
        _transducers[key] = Transducer(compiled)
    return _transducers[key]


def one_form(text: str | Column) -> Column:
    """The consistent form of a text column, formed once for each value.

    Marked as if it were not deterministic, as the optimiser would else copy it into the filters it infers for joins.
    """
    compiled = compiled_rules()  # some 100 kB, whatever the data

    @F.arrow_udf("string")
    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = transducer(compiled)
        for texts in batches:
            coded = texts.dictionary_encode()  # speakers and names repeat a lot
            yield pa.array([run(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return form.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def fields_long(lines: DataFrame, timelines: DataFrame) -> DataFrame:
    """(field, row_id, value) of the three fields to unify, each table read once; null values have no row."""
    pairs = F.array(F.struct(F.lit("speaker_raw").alias("field"), F.col("speaker_raw").alias("value")), F.struct(F.lit("text").alias("field"), F.col("text").alias("value")))
    two = lines.select(F.col("line_id").alias("row_id"), F.explode(pairs).alias("p")).select("p.field", "row_id", "p.value")
    one = timelines.select(F.lit("activity_name").alias("field"), "row_id", F.col("activity_name").alias("value"))
    return two.unionByName(one).where(F.col("value").isNotNull())


#: ``canonical_names`` is a fixed list; beyond this many rows it is joined by shuffle instead of broadcast.
NAMES_BROADCAST = 100_000


def agreed(values: DataFrame, names: DataFrame) -> DataFrame:
    """``values`` (field, row_id, value) that look like an agreed name of their field, with ``form``, name_id and name.

    A value that looks like several names of one field gives a row for each; names equal in form are kept apart.
    """
    keyed = names.select("field", "name_id", "name", one_form("name").alias("form")).where(F.col("form") != "")
    if names.limit(NAMES_BROADCAST + 1).count() <= NAMES_BROADCAST:
        keyed = F.broadcast(keyed)
    return values.withColumn("form", one_form("value")).join(keyed, ["field", "form"])


def found(lines: DataFrame, timelines: DataFrame, names: DataFrame) -> DataFrame:
    """(field, row_id, name_id): values that look the same as an agreed name but are not equal to it."""
    hits = agreed(fields_long(lines, timelines), names).where(F.col("value") != F.col("name"))
    return hits.select("field", "row_id", "name_id")


def unified(lines: DataFrame, timelines: DataFrame, names: DataFrame) -> DataFrame:
    """Every non-null value with its consistent form: the agreed spelling where it meets one, else the form itself.

    Of several names equal in form the one with the smallest name_id is taken.
    """
    keyed = names.select("field", "name_id", "name", one_form("name").alias("form")).where(F.col("form") != "")
    keyed = keyed.groupBy("field", "form").agg(F.min_by("name", "name_id").alias("name"), F.min("name_id").alias("name_id"))
    values = fields_long(lines, timelines).withColumn("form", one_form("value"))
    return values.join(keyed, ["field", "form"], "left").select("field", "row_id", F.coalesce("name", "form").alias("value"), "name_id")
