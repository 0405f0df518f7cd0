"""Answers about the chronology: events by activity, entity, years and words, or the sources of one event."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions.fuzzytime import display
from storyloom.operators import entities, timeline
from storyloom.tools.corpus import Corpus
from storyloom.tools.requests import RequestError, TimelineRequest, plain, timeline_request
from storyloom.tools.search import alias_groups


def useful(groups: dict[str, list[str]]) -> list[str]:
    """The aliases to look for: of each group those of more than one sign, or all if there is none."""
    out: dict[str, None] = {}
    for aliases in groups.values():
        own = [a for x in aliases if (a := plain(x).lower())]
        out |= dict.fromkeys([a for a in own if len(a) > 1] or own)
    return list(out)


def run(corpus: Corpus, raw: dict) -> dict:
    try:
        version = raw.get("data_version") if isinstance(raw, dict) else None
        if version and version != corpus.version:
            raise RequestError("PACKAGE_VERSION_MISMATCH", "the version has changed", retryable=True)
        request = timeline_request(raw)
        if corpus.timelines is None:
            raise RequestError("TIMELINE_NOT_INSTALLED", "there is no chronology", retryable=True)
        return _source(corpus, request) if request.marker else _search(corpus, request)
    except RequestError as e:
        return e.public()


def _shown(r) -> dict:
    return {"event_id": r.event_id, "time": r.shown, "event": r.event, "year_start": r.year_start, "year_end": r.year_end, "source_marker": f"年表出处:{r.event_id}" if r.event_id else ""}


def _time():
    whole = lambda c: F.col(c).try_cast("int")
    return display(F.col("time_text"), F.col("time_section"), whole("time_year_start"), whole("time_year_end"))


def _source(corpus: Corpus, request: TimelineRequest) -> dict:
    found = timeline.by_marker(timeline.events(corpus.timelines), request.marker)
    row = found.withColumn("shown", _time()).orderBy("row_id", "event_pos").first()
    if row is None:
        raise RequestError("TIMELINE_SOURCE_NOT_FOUND", "no event has this marker")
    from storyloom.operators.shred import timeline_tables

    own = timeline_tables(corpus.timelines.where(F.col("row_id") == row.row_id))["sources"]
    sources = own.where(F.col("event_pos") == row.event_pos).orderBy("source_pos").collect()
    listed = [{k: s[k] for k in ("text", "story_name", "activity_name") if s[k]} for s in sources]
    return {"status": "ok", "mode": "source", "data_version": corpus.version, "event": _shown(row) | {"activity_name": row.activity_name}, "provenance": {"sources": listed}}


def _search(corpus: Corpus, request: TimelineRequest) -> dict:
    t = corpus.timelines
    groups = entities.expand(alias_groups(corpus), list(request.entities)) if request.entities and corpus.entities is not None else {n: [n] for n in request.entities}
    inferred = bool(request.query and not request.activities and timeline.names_activity(t, request.query))
    activities = [request.query] if inferred else list(request.activities)
    words = "" if inferred else request.query
    found = timeline.events(t)
    if words or groups:
        found = timeline.with_sources(found, t)
    found = timeline.search(found, activities or None, words or None, useful(groups) or None, request.year_start, request.year_end, exact=inferred)
    merged = timeline.merge(found)
    totals = merged.agg(F.count(F.lit(1)).alias("events"), F.sum("deliveries").alias("occurrences")).first()
    rows = merged.withColumn("shown", _time()).orderBy("order", "key").limit(request.limit).collect()
    return {
        "status": "ok", "mode": "search", "data_version": corpus.version,
        "filters": {"query": words, "activity_names": activities, "entity_alias_groups": groups, "year_start": request.year_start, "year_end": request.year_end, "inferred_activity": inferred},
        "events": [_shown(r) | {"activity_names": list(r.activities)} for r in rows],
        "page": {"returned": len(rows), "total": totals.events, "has_more": totals.events > len(rows)},
        "stats": {"matched_events": totals.events, "matched_occurrences": totals.occurrences or 0},
    }
