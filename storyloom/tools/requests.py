"""Requests to the four tools: what they may hold, checked and brought to one form before any table is read.

A request is a plain mapping; what comes out is a frozen dataclass. Anything out of order raises ``RequestError`` with a
code that callers can tell apart. Limits are fixed values of the tools' contract.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

from storyloom.functions.classify import CONTENT_ORDER, SECTIONS
from storyloom.functions.saferegex import RegexRejected, safe_pattern
from storyloom.functions.text import LANGUAGE_CODES, LANGUAGES

GAMES = ("game_a", "game_b")
VERSION = re.compile(r"[0-9a-f]{64}")
UID = re.compile(r"doc_[A-Za-z0-9_-]{16}")
MARKER = re.compile(r"(?:年表出处:)?(tle_[0-9a-f]{24})")
FILTERS = ("resource_types", "character_names", "story_names", "activity_names", "entity_names", "speakers", "wiki_sections", "games", "content_types", "collection_names")


class RequestError(ValueError):
    """A request that can't be met: a code, what is wrong, and whether the same request may succeed later."""

    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.message, self.retryable = code, message, retryable

    def public(self) -> dict:
        return {"status": "error", "error": {"code": self.code, "message": self.message, "retryable": self.retryable}}


def plain(value: object) -> str:
    """A value as text in compatibility form, squeezed; empty for none."""
    return "" if value is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", str(value))).strip()


def _need(ok: bool, message: str, code: str = "INVALID_REQUEST") -> None:
    if not ok:
        raise RequestError(code, message)


def names(value: object, what: str, most: int, longest: int = 512, empty: bool = False) -> tuple[str, ...]:
    """A list of names in compatibility form, each once in order; none given is no name."""
    if value is None:
        return ()
    _need(isinstance(value, (list, tuple)) and (empty or bool(value)), f"{what} must be a list that is not empty")
    out = tuple(dict.fromkeys(plain(x) for x in value))
    if empty:
        out = tuple(x for x in out if x)
    _need(all(out) and len(out) <= most and all(len(x) <= longest for x in out), f"{what}: up to {most} names of up to {longest} signs, none empty")
    return out


def whole(value: object, low: int, high: int, what: str, default: int | None = None, lenient: bool = False) -> int:
    """An integer within bounds; ``lenient`` takes whole floats and digits as well. Booleans are none."""
    if value is None and default is not None:
        return default
    if lenient and isinstance(value, float) and value.is_integer():
        value = int(value)
    if lenient and isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value.strip()):
        value = int(value)
    _need(isinstance(value, int) and not isinstance(value, bool), f"{what} must be an integer")
    _need(low <= value <= high, f"{what} must be within {low} and {high}")
    return value


def allowed_games(wanted: Iterable[str], enabled: Iterable[str]) -> tuple[str, ...]:
    """The requested games that are enabled, all of those if none is asked for; it is an error if none is left."""
    enabled = tuple(enabled)
    out = tuple(g for g in (tuple(wanted) or enabled) if g in enabled)
    _need(bool(out), "none of the requested games is enabled")
    return out


# --- search --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class After:
    """Where a page ended: bound to the data version, and checked against the document that stands there."""

    data_version: str
    resource_type: str
    title: str
    position: int


@dataclass(frozen=True)
class SearchRequest:
    query: str
    mode: str
    filters: dict[str, tuple[str, ...]]
    context_terms: tuple[str, ...] = ()
    after: After | None = None

    @property
    def kind(self) -> str:
        """What the result is made of."""
        if self.query:
            return "text_matches"
        if self.filters["speakers"] or self.filters["entity_names"]:
            return "structured_matches"
        return "complete_sections" if self.filters["wiki_sections"] else "documents"

    @property
    def line_scope(self) -> bool:
        """Some condition is on lines, so titles are not looked at."""
        return bool(self.filters["speakers"] or self.filters["entity_names"] or self.filters["wiki_sections"] or self.context_terms)


def search_request(raw: dict, enabled: Iterable[str] = GAMES) -> SearchRequest:
    """Checked and normalised; games are cut to the enabled ones."""
    _need(isinstance(raw, dict), "the request must be an object")
    _need(raw.get("cursor") is None, "cursors are not supported, pages go on by after")
    after = raw.get("after")
    if after is not None:
        _need(isinstance(after, dict) and set(after) == {"data_version", "resource_type", "title", "position"}, "after needs data_version, resource_type, title and position")
        _need(isinstance(after["data_version"], str) and bool(VERSION.fullmatch(after["data_version"])), "after.data_version must be a sha256")
        position = whole(after["position"], 0, 10_000_000, "after.position")
        after = After(after["data_version"], plain(after["resource_type"]), plain(after["title"]), position)
        _need(bool(after.resource_type and after.title), "after.resource_type and after.title can't be empty")
    query = plain(raw.get("query"))
    _need(len(query) <= 512, "a query has at most 512 signs")
    filters = {f: names(raw.get(f), f, 16) for f in FILTERS}
    filters["games"] = tuple(g.lower() for g in filters["games"])
    _need(all(g in GAMES for g in filters["games"]), f"games are {GAMES}")
    _need(bool(query) or any(filters.values()), "a query or a filter is needed")
    mode = raw.get("match_mode", "literal")
    _need(mode in ("literal", "regex"), "match_mode is literal or regex")
    if mode == "regex":
        _need(bool(query), "regex needs a query")
        try:
            safe_pattern(query)
        except RegexRejected as e:
            raise RequestError("REGEX_REJECTED", str(e)) from e
    terms = names(raw.get("context_terms"), "context_terms", 8, empty=False) if raw.get("context_terms") else ()
    _need(not terms or bool(query or filters["speakers"] or filters["entity_names"]), "context_terms need a query, speakers or entity_names")
    _need(bool(query) or len(filters["wiki_sections"]) <= 1, "without a query one wiki section at a time")
    filters["games"] = allowed_games(filters["games"], enabled)
    return SearchRequest(query, mode, filters, terms, after)


# --- read ----------------------------------------------------------------------------------------------------------
LOCATORS = ("source_ref", "document_id", "document_uid", "display_title", "activity_id", "activity_name", "collection_name")
STREAMS = ("activity_id", "activity_name", "collection_name")
SOURCE_REF = re.compile(r"(\S.*):L([1-9][0-9]*)", re.S)


@dataclass(frozen=True)
class ReadRequest:
    locator: tuple[str, str]
    mode: str
    start: int = 1
    end: int | None = None
    center: int | None = None
    before: int = 3
    after: int = 3
    section: str = ""
    position: int = 1
    content_types: tuple[str, ...] = ()
    format: str = "lines"
    adjacent: bool = True
    max_lines: int = 100
    max_chars: int = 12_000
    data_version: str | None = None


def read_request(raw: dict) -> ReadRequest:
    """Exactly one locator, a mode that fits it, and limits."""
    _need(isinstance(raw, dict), "the request must be an object")
    version = raw.get("data_version")
    _need(version is None or bool(VERSION.fullmatch(str(version))), "data_version must be a sha256")
    given = {k: raw[k] for k in LOCATORS if raw.get(k) is not None}
    _need(len(given) == 1, f"exactly one of {', '.join(LOCATORS)} is needed")
    (kind, value), = given.items()
    _need(isinstance(value, str) and bool(value.strip()) and len(value) <= 1024, f"{kind} must be a text of at most 1024 signs")
    center = None
    if kind == "source_ref":
        m = SOURCE_REF.fullmatch(value)
        _need(bool(m), "source_ref ends in :L and a line number", "SOURCE_REF_INVALID")
        value, center = m.group(1), int(m.group(2))
    elif kind == "document_uid":
        _need(bool(UID.fullmatch(value.strip())), "document_uid is doc_ and 16 signs")
    if kind in ("activity_name", "collection_name", "display_title"):
        value = plain(value)
    mode = raw.get("mode") or ("around" if kind == "source_ref" else "activity" if kind in ("activity_id", "activity_name") else "collection" if kind == "collection_name" else "document")
    _need(mode in ("around", "range", "document", "section", "activity", "collection"), f"unknown mode {mode}")
    _need((kind in STREAMS) == (mode in ("activity", "collection")) or kind == "document_uid", f"mode {mode} does not go with {kind}")
    int_ = lambda name, low, high, default: whole(raw.get(name), low, high, name, default, lenient=True)
    start, end = 1, None
    if mode == "around":
        _need(center is None or raw.get("line") is None, "around a source_ref takes no line")
        center = center or whole(raw.get("line"), 1, 10**9, "line", lenient=True)
    elif mode == "range":
        start, end = int_("start_line", 1, 10**9, None), int_("end_line", 1, 10**9, None)
        _need(end >= start, "end_line is before start_line", "LINE_RANGE_INVALID")
    elif mode == "document":
        start = int_("line", 1, 10**9, 1)
    section = str(raw.get("section") or "").strip()
    _need(mode != "section" or section in SECTIONS, "section must be a known wiki section")
    types = names(raw.get("content_types"), "content_types", len(CONTENT_ORDER)) if raw.get("content_types") else ()
    _need(not types or mode == "collection" and all(t in CONTENT_ORDER for t in types), "content_types go with collections and must be known")
    shape = raw.get("format", "lines")
    _need(shape in ("lines", "plain_text"), "format is lines or plain_text")
    adjacent = raw.get("include_adjacent_documents", True)
    _need(isinstance(adjacent, bool), "include_adjacent_documents is true or false")
    return ReadRequest(
        (kind, value.strip()), mode, start, end, center, int_("before_lines", 0, 100, 3), int_("after_lines", 0, 100, 3), section, int_("position", 1, 10**9, 1), types, shape, adjacent,
        int_("max_lines", 1, 500, 100), int_("max_chars", 100, 100_000, 12_000), version,
    )


# --- chronology and localisation -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class TimelineRequest:
    query: str = ""
    activities: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    marker: str = ""
    year_start: int | None = None
    year_end: int | None = None
    limit: int = 20


def timeline_request(raw: dict) -> TimelineRequest:
    _need(isinstance(raw, dict), "the request must be an object")
    query = plain(raw.get("query"))
    _need(len(query) <= 200, "a query has at most 200 signs")
    activities, entities = (names(raw.get(k), k, 20, empty=True) for k in ("activity_names", "entity_names"))
    marker = str(raw.get("source_marker") or "").strip()
    found = MARKER.fullmatch(marker)
    _need(not marker or bool(found), "source_marker is tle_ and 24 hex digits")
    year = lambda k: None if raw.get(k) is None else whole(raw[k], -(10**9), 10**9, k, lenient=not isinstance(raw[k], str))
    low, high = year("year_start"), year("year_end")
    _need(bool(query or activities or entities or marker) or low is not None or high is not None, "something to look for is needed")
    return TimelineRequest(query, activities, entities, found.group(1) if found else "", low, high, whole(raw.get("max_results"), 1, 100, "max_results", 20, lenient=not isinstance(raw.get("max_results"), str)))


def language_code(value: object) -> str:
    _need(isinstance(value, str), "a language code is a text")
    code = LANGUAGES.get(value.lower(), value.upper())
    _need(code in LANGUAGE_CODES, f"unknown language {value}")
    return code


@dataclass(frozen=True)
class LocalisationRequest:
    locator: tuple[str, object]
    languages: tuple[str, ...]
    source: str = "CN"
    match: str = "exact"
    line: int | None = None
    ids: bool = False
    max_matches: int = 5
    max_chars: int = 16_000
    position: int = 0
    offset: int = 0
    data_version: str | None = None
    identity: str = field(default="", compare=False)

    @property
    def hash(self) -> str:
        """What binds a continuation to its request: everything but where it stands."""
        return hashlib.sha256(self.identity.encode()).hexdigest()


def localisation_request(raw: dict) -> LocalisationRequest:
    _need(isinstance(raw, dict), "the request must be an object")
    known = {"query", "title", "document_uid", "text_ids", "line", "languages", "source_language", "match_mode", "include_ids", "max_matches", "max_chars", "data_version", "after", "game"}
    _need(set(raw) <= known, "unknown parameters")
    given = [k for k in ("query", "title", "document_uid", "text_ids") if raw.get(k) is not None]
    _need(len(given) == 1, "exactly one of query, title, document_uid and text_ids is needed")
    kind = given[0]
    if kind == "text_ids":
        ids = raw[kind]
        _need(isinstance(ids, list) and 0 < len(ids) <= 20 and all(isinstance(x, str) and re.fullmatch(r"-?[0-9]{1,20}", x) for x in ids), "text_ids are 1 to 20 decimal texts")
        value: object = tuple(dict.fromkeys(ids))
    else:
        _need(isinstance(raw[kind], str) and bool(raw[kind].strip()) and len(raw[kind]) <= 12_000, f"{kind} must be a text of at most 12000 signs")
        value = raw[kind].strip()
        _need(kind != "document_uid" or bool(UID.fullmatch(value)), "document_uid is doc_ and 16 signs")
    line = raw.get("line")
    if line is not None:
        _need(kind in ("title", "document_uid"), "a line goes with a document")
        line = whole(line, 1, 100_000_000, "line")
    targets = raw.get("languages")
    _need(isinstance(targets, list) and 1 <= len(targets) <= 4, "1 to 4 languages are needed")
    source, codes = language_code(raw.get("source_language", "CN")), tuple(dict.fromkeys(language_code(x) for x in targets))
    match = raw.get("match_mode", "exact")
    _need(match in ("exact", "literal"), "match_mode is exact or literal")
    ids_too = raw.get("include_ids", False) or False
    _need(isinstance(ids_too, bool), "include_ids is true or false")
    version = raw.get("data_version")
    _need(version is None or isinstance(version, str) and bool(VERSION.fullmatch(version)), "data_version must be a sha256")
    most, signs = whole(raw.get("max_matches"), 1, 20, "max_matches", 5), whole(raw.get("max_chars"), 1000, 48_000, "max_chars", 16_000)
    identity = json.dumps([kind, value, line, source, codes, match, ids_too, most, signs], ensure_ascii=False)
    out = LocalisationRequest((kind, value), codes, source, match, line, ids_too, most, signs, 0, 0, version, identity)
    after = raw.get("after")
    if after is not None:
        _need(isinstance(after, dict) and set(after) == {"data_version", "position", "request_hash", "text_offset"}, "after must be handed on as it came")
        _need(after["request_hash"] == out.hash, "after belongs to another request")
        _need(isinstance(after["data_version"], str) and bool(VERSION.fullmatch(after["data_version"])), "after.data_version must be a sha256")
        position, offset = whole(after["position"], 0, 1_000_000, "after.position"), whole(after["text_offset"], 0, 10_000_000, "after.text_offset")
        out = LocalisationRequest((kind, value), codes, source, match, line, ids_too, most, signs, position, offset, after["data_version"], identity)
    return out
