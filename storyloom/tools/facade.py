"""The four tools by name, with what each takes; disabled ones and unknown parameters are refused or left out."""

from __future__ import annotations

from dataclasses import dataclass

from storyloom.tools import chronology, localised, read, render, search
from storyloom.tools.corpus import Corpus
from storyloom.tools.requests import FILTERS, RequestError, plain

_LIST = {"type": "array", "items": {"type": "string"}}
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: What each tool takes.
PARAMETERS: dict[str, dict[str, dict]] = {
    "search": {"query": _TEXT, "match_mode": {"enum": ["literal", "regex"]}, "context_terms": _LIST, "after": {"type": "object"}} | {f: _LIST for f in FILTERS},
    "read": {k: _TEXT for k in ("source_ref", "document_id", "document_uid", "display_title", "activity_id", "activity_name", "collection_name", "mode", "section", "format", "data_version")}
    | {k: _NUMBER for k in ("line", "start_line", "end_line", "before_lines", "after_lines", "position", "max_lines", "max_chars")} | {"content_types": _LIST, "include_adjacent_documents": {"type": "boolean"}},
    "timeline": {"query": _TEXT, "activity_names": _LIST, "entity_names": _LIST, "source_marker": _TEXT, "year_start": _NUMBER, "year_end": _NUMBER, "max_results": _NUMBER, "data_version": _TEXT},
    "i18n": {"query": _TEXT, "title": _TEXT, "document_uid": _TEXT, "text_ids": _LIST, "line": _NUMBER, "languages": _LIST, "source_language": _TEXT, "match_mode": {"enum": ["exact", "literal"]}, "include_ids": {"type": "boolean"}, "max_matches": _NUMBER, "max_chars": _NUMBER, "data_version": _TEXT, "after": {"type": "object"}},
}
RUN = {"search": search.run, "read": read.run, "timeline": chronology.run, "i18n": localised.run}


@dataclass(frozen=True)
class Settings:
    """Which tools are on and how much they hand out; values out of bounds are brought within them."""

    enabled: frozenset[str] = frozenset(PARAMETERS)
    output_signs: int = render.MOST_SIGNS

    @classmethod
    def of(cls, raw: dict | None) -> Settings:
        raw = raw or {}
        on = raw.get("enabled", list(PARAMETERS))
        signs = raw.get("output_signs", render.MOST_SIGNS)
        signs = signs if isinstance(signs, int) and not isinstance(signs, bool) else render.MOST_SIGNS
        return cls(frozenset(x for x in on if x in PARAMETERS), max(1000, min(render.MOST_SIGNS, signs)))


def cleaned(tool: str, raw: dict) -> dict:
    """The arguments a tool knows, without nulls, empty texts and empty lists."""
    return {k: v for k, v in raw.items() if k in PARAMETERS[tool] and v not in (None, "", [], {})}


def call(corpus: Corpus, tool: str, raw: dict, settings: Settings = Settings()) -> tuple[dict, str]:
    """The answer of a tool, and the same as text."""
    if tool not in PARAMETERS or tool not in settings.enabled:
        answer = RequestError("TOOL_DISABLED", f"{tool} is not enabled").public()
        return answer, render.error(tool, answer) or ""
    args = cleaned(tool, raw)
    answer = RUN[tool](corpus, args)
    if tool == "search":
        text = render.search(answer, plain(args.get("query")), args.get("match_mode", "literal"))
    else:
        text = {"read": render.read, "timeline": render.timeline, "i18n": render.localised}[tool](answer)
    return answer, render.capped(text, settings.output_signs)
