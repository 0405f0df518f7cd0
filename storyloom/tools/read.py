"""From a read request to its answer: locate one document or one collection, check it, cut it to its limits, show it.

Locating is a filter on the documents that leaves at most two rows to tell one from several; lines are read for the
documents found only, and no more of them than the limits allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from storyloom.functions import classify
from storyloom.functions import text as tx
from storyloom.operators import read, sections
from storyloom.tools.corpus import Corpus, complete, tags  # noqa: F401
from storyloom.tools.requests import ReadRequest, RequestError, plain, read_request
from storyloom.tools.search import complete_lines

ADJACENT = ("document_id", "title", "uid", "game", "resource_type")


def one(found: DataFrame, what: str) -> Row:
    """The one document of a filter; several entities of one name give the richest."""
    rows = found.orderBy("document_id").limit(2).collect()
    if not rows:
        raise RequestError("DOCUMENT_NOT_FOUND", f"there is no document for {what}")
    if len(rows) > 1:
        if found.where(F.coalesce(F.col("document_type") != "entity", F.lit(True))).isEmpty():
            return found.orderBy(F.desc_nulls_last("line_count"), "document_id").first()
        listed = choices(found, F.coalesce("activity_name", "title"))
        raise RequestError("DOCUMENT_AMBIGUOUS", f"{what} may be: {listed}")
    return rows[0]


def choices(found: DataFrame, name: Column, most: int = 8) -> str:
    """The names several documents go by, with how many there are of each, the first in order of their ids."""
    rows = found.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first")).orderBy("first").limit(most).collect()
    return "; ".join(f"{r.name} ({r.n})" for r in rows)


def locate(corpus: Corpus, locator: tuple[str, str], documents: DataFrame | None = None) -> Row:
    """The document an id, public id, reference prefix, source id, path or title names."""
    kind, value = locator
    d = corpus.described() if documents is None else documents
    if kind == "document_uid":
        return one(d.where(F.col("uid") == value), value)
    if kind == "source_ref":
        return one(d.where((F.col("source_ref_prefix") == value) | (F.col("document_id") == value)), value)
    if kind == "display_title":
        by_title = d.where(tx.normalize(F.col("title")) == value)
        return one(by_title if not by_title.isEmpty() else d.where(tx.normalize(F.col("display_title")) == value), value)
    return one(d.where(F.col(kind) == value), value)


def by_stage(corpus: Corpus, code: str, part: str | None = None) -> Row:
    """The story of a stage code, and of its part where there are several."""
    d = corpus.described()
    d = d.where(tx.stage_code(F.col("story_code")) == tx.stage_code(F.lit(code), relaxed=True))
    return one(d.where(classify.part(F.col("part_type")) == part) if part else d, f"stage {code}")


def by_record(corpus: Corpus, character: str, record: str, segment: int | None = None) -> Row:
    """A character's record by its name, and its segment where there are several."""
    d = corpus.described()
    d = d.where((F.col("document_category") == "memory") & (tx.normalize(F.col("character_name")) == plain(character)) & (tx.normalize(F.col("story_name")) == plain(record)))
    own = classify.record_segment(F.col("document_category"), F.coalesce("source_story_id", "document_id"), F.col("game"))
    return one(d.where(own == str(segment)) if segment is not None else d, f"record {record}")


def by_material(corpus: Corpus, character: str, material: str, game: str | None = None) -> Row:
    """A character's material; of documents with the same text the smallest id."""
    d = corpus.described().where((classify.material(F.col("document_type"), F.col("document_category")) == material) & (tx.normalize(F.col("character_name")) == plain(character)))
    d = d.where(F.col("game") == game) if game else d
    texts = d.agg(F.countDistinct("text_sha256").alias("n"), F.count("text_sha256").alias("m"), F.count(F.lit(1)).alias("all"), F.min("document_id").alias("first")).first()
    if texts.all and texts.n == 1 and texts.m == texts.all:
        return d.where(F.col("document_id") == texts.first).first()
    return one(d, f"{material} of {character}")


def needs_uid(documents: DataFrame) -> DataFrame:
    """(document_id) of the documents whose title others bear too, so only their public id tells them apart."""
    several = documents.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title")
    return documents.join(several, "title", "left_semi").select("document_id")


def packs_of(documents: DataFrame, wanted: DataFrame, pack: str = "pack_id") -> list[str] | None:
    """The packs that hold the wanted documents; None if one of them is in no pack."""
    own = wanted.select("document_id").distinct().join(documents.select("document_id", pack), "document_id", "left")
    row = own.agg(F.array_sort(F.collect_set(pack)).alias("packs"), F.count_if(F.col(pack).isNull()).alias("unknown")).first()  # as many as there are packs
    return None if row.unknown else list(row.packs)


def summary(row: Row) -> dict:
    """The fixed fields of a document, the empty text for what is missing."""
    held = row.asDict()
    return {"document_uid": held.get("uid") or ""} | {k: "" if held.get(k) is None else held[k] for k in classify.SUMMARY}


def public_lines(lines: DataFrame) -> DataFrame:
    """Lines as they are shown: the speaker is not repeated in the text."""
    own = complete_lines(lines)
    return own.withColumn("text", tx.public_text(F.col("speaker_raw"), F.coalesce("text", F.lit(""))))


def run(corpus: Corpus, raw: dict, stated: DataFrame | None = None) -> dict:
    """The answer to a request. ``stated`` (document_id, sha256) has the hashes documents must have; others are not checked."""
    try:
        request = read_request(raw)
        if request.data_version and request.data_version != corpus.version:
            raise RequestError("PACKAGE_VERSION_MISMATCH", "the version has changed", retryable=True)
        return _stream(corpus, request) if request.mode in ("activity", "collection") else _document(corpus, request, stated)
    except RequestError as e:
        return e.public()


def _document(corpus: Corpus, request: ReadRequest, stated: DataFrame | None) -> dict:
    d = corpus.described()
    document = locate(corpus, request.locator, d)
    if request.mode == "document" and document.document_kind == "synopsis":
        document = _full_story(d, document)
    own = corpus.lines.where(F.col("document_id") == document.document_id)
    lines = corpus.once(complete_lines(own))
    count = document.line_count if document.line_count is not None else lines.agg(F.max("line_number")).first()[0] or 0
    count = int(count)
    if stated is not None and not (bad := read.verify(lines, stated.where(F.col("document_id") == document.document_id))).isEmpty():
        raise RequestError("INDEX_CORRUPT", f"{document.document_id}: expected {bad.first().sha256}")
    start, end = request.start, count
    if request.mode == "around":
        if request.center > count:
            raise RequestError("LINE_RANGE_INVALID", f"line {request.center} is beyond {count}")
        start, end = max(1, request.center - request.before), min(count, request.center + request.after)
    elif request.mode == "range":
        end = min(count, request.end)
    elif request.mode == "section":
        if document.role == "":
            raise RequestError("INVALID_REQUEST", "only wiki documents have sections")
        found = sections.sections(lines.select("document_id", "line_number", "text"), (request.section,)).limit(2).collect()
        if len(found) != 1:
            raise RequestError("DOCUMENT_AMBIGUOUS" if found else "DOCUMENT_NOT_FOUND", f"{len(found)} sections {request.section}")
        start, end = int(found[0].start), int(found[0].stop)
    if start > count:
        raise RequestError("LINE_RANGE_INVALID", f"line {start} is beyond {count}")
    # at most the lines a request may ask for come to the driver
    rows = lines.where(F.col("line_number").between(start, min(end, start + request.max_lines - 1))).orderBy("line_number").collect()
    kept, chars, reason = [], 0, "max_lines" if end - start + 1 > request.max_lines else None
    for r in rows:
        n = len(r.text or "")
        if chars + n > request.max_chars:
            reason = reason or "max_chars"
            break
        chars += n
        kept.append(r)
    if rows and not kept:
        raise RequestError("BUDGET_EXCEEDED", f"the first line alone is over {request.max_chars} signs")
    last = kept[-1].line_number if kept else start - 1
    more = reason is not None
    answer = {
        "status": "ok", "data_version": corpus.version, "document": summary(document), "title": document.title,
        "selection": {"mode": request.mode, "line_start": kept[0].line_number if kept else start, "line_end": last, "line_count": len(kept), "character_count": chars, "truncated": more},
        "content": _content(request, kept, document),
        "page": {"returned": len(kept), "has_more": more, "total": count if request.mode == "document" else end - start + 1, "continuation": _go_on(corpus, d, document, last + 1) if more else None},
        "citation": f"《{document.title}》Wiki·{request.section}" if request.section else f"《{document.title}》第 {start if start == last else f'{start}-{last}'} 行",
        "stats": {"estimated_input_tokens": -(-chars * 2 // 5)},
    }
    if reason:
        answer["selection"]["truncation_reason"] = reason
    if request.adjacent:
        links = {"previous": document.previous_document_id, "next": document.next_document_id}
        known = {r.document_id: summary(r) for r in d.where(F.col("document_id").isin(*[x for x in links.values() if x])).collect()} if any(links.values()) else {}
        answer["adjacent_documents"] = {k: known.get(x) for k, x in links.items()}
    return answer


def _full_story(d: DataFrame, short: Row) -> Row:
    """The story a synopsis is of: by its source id without the prefix of synopses, where it has one."""
    source = short.source_story_id or ""
    if "info/" not in source:
        return short
    full = d.where((F.col("source_story_id") == source.split("info/", 1)[1]) & (F.col("document_kind") == "story")).orderBy("document_id").first()
    return full or short


def _content(request: ReadRequest, rows: list[Row], document: Row) -> dict:
    if request.format == "plain_text":
        return {"format": "plain_text", "text": "\n".join(r.text or "" for r in rows)}
    lines = []
    for r in rows:
        held = r.asDict()
        item = {"line_number": r.line_number, "line_type": r.line_type or "", "speaker_raw": r.speaker_raw or "", "text": r.text or "", "source_ref": f"{document.source_ref_prefix or document.document_id}:L{r.line_number}"}
        lines.append(item | {k: held[k] for k in ("source_line_id", "speaker_id", "audio", "hint", "document_title", "stream_position") if held.get(k)})
    return {"format": "lines", "lines": lines}


def _go_on(corpus: Corpus, d: DataFrame, document: Row, line: int) -> dict:
    """How to read on: by title where that names one document, else by public id."""
    same = d.where(tx.normalize(F.col("title")) == plain(document.title)).limit(2).count()
    where = {"display_title": document.title} if same == 1 else {"document_uid": document.uid}
    return {**where, "mode": "document", "line": line, "data_version": corpus.version}


def collection(corpus: Corpus, request: ReadRequest) -> tuple[DataFrame, list]:
    """The documents of a collection and their order; the empty result and several collections of one name are errors."""
    kind, value = request.locator
    d = corpus.described().where((F.col("document_type") == "story") & ~F.coalesce(F.col("document_kind") == "synopsis", F.lit(False)) & ~classify.is_training(F.coalesce("path", "document_id")))
    if kind == "document_uid":
        anchor = locate(corpus, request.locator)
        kind, value = ("activity_id", anchor.activity_id) if request.mode == "activity" else ("collection_name", anchor.collection_name)
    if kind == "activity_name":
        found = d.where(classify.activity_match(classify.activity_aliases(F.col("activity_id"), tx.normalize(F.col("activity_name")), F.col("collection_id")), value, exact=True))
    else:
        found = d.where((tx.normalize(F.col(kind)) if kind == "collection_name" else F.col(kind)) == value)
    if request.content_types:
        found = found.where(F.col("content_type").isin(*request.content_types))
    key = "activity_id" if request.mode == "activity" else "collection_id"
    several = found.groupBy(F.coalesce(key, "activity_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first")).orderBy("first").limit(9).collect()
    if not several:
        raise RequestError("DOCUMENT_NOT_FOUND", f"there is no collection {value}")
    if len(several) > 1 and kind != "activity_id":
        raise RequestError("DOCUMENT_AMBIGUOUS", f"{value} may be: " + "; ".join(f"{r.key} ({r.n})" for r in several))
    if request.mode == "activity":
        order = [tx.natural_key(F.coalesce("collection_id", F.lit(""))), F.asc_nulls_last("sequence_index"), tx.natural_key(F.col("document_id")), "document_id"]
    else:
        order = [classify.rank(F.col("content_type"), classify.CONTENT_ORDER), tx.natural_key(F.coalesce("source_story_id", "title", F.lit(""))), "document_id"]
    return found.withColumn("__collection", F.lit(value)), order


def _stream(corpus: Corpus, request: ReadRequest) -> dict:
    found, order = collection(corpus, request)
    streamed = read.stream(found, "__collection", order)  # one collection; its documents' metadata only
    total = streamed.agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("documents")).first()
    if request.position > (total.last or 0):
        raise RequestError("LINE_RANGE_INVALID", f"position {request.position} is beyond {total.last or 0}")
    parts = read.stream_page(streamed, "__collection", request.position, request.max_lines).select("document_id", "title", "uid", "source_ref_prefix", "ordinal", "first", "start", "stop")
    lines = corpus.once(complete_lines(corpus.lines.join(F.broadcast(parts.select("document_id")), "document_id", "left_semi")))
    shown = lines.join(F.broadcast(parts), "document_id").where(F.col("line_number").between(F.col("start"), F.col("stop")))
    shown = shown.withColumns({"stream_position": F.col("first") + F.col("line_number") - 1, "document_title": F.col("title")})
    rows = shown.orderBy("stream_position").limit(request.max_lines).collect()
    kept, chars, cut = [], 0, False
    for r in rows:
        n = len(r.text or "")
        if chars + n > request.max_chars:
            cut = True
            break
        chars += n
        kept.append(r)
    if rows and not kept:
        raise RequestError("BUDGET_EXCEEDED", f"the first line alone is over {request.max_chars} signs")
    last = int(kept[-1].stream_position) if kept else request.position - 1
    more = last < (total.last or 0)
    kind, value = request.locator
    go_on = {kind: value, "mode": request.mode, "position": last + 1, "data_version": corpus.version}
    if request.content_types:
        go_on["content_types"] = list(request.content_types)
    content = _content(request, kept, rows[0]) if kept else {"format": request.format, "lines": []}
    return {
        "status": "ok", "data_version": corpus.version, "stream": {"mode": request.mode, "name": value, "documents": total.documents, "lines": int(total.last or 0), "position_start": request.position, "position_end": last},
        "selection": {"mode": request.mode, "line_start": request.position, "line_end": last, "line_count": len(kept), "character_count": chars, "truncated": cut},
        "content": content, "page": {"returned": len(kept), "has_more": more, "total": int(total.last or 0), "continuation": go_on if more else None},
    }
