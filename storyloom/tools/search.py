"""From a search request to its result: scope, candidates, matches, passages, and the page that is shown.

Everything up to the page is DataFrames. Lines are only matched for the documents a page may look at, at most ``SCAN``
after the place it starts from; their answer, at most ``PAGE`` documents, is put together in the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from storyloom.functions import classify
from storyloom.functions import text as tx
from storyloom.operators import entities, search, sections
from storyloom.tools.corpus import Corpus
from storyloom.tools.requests import RequestError, SearchRequest, search_request

#: Signs of a line, of an entity's description, and of its history and both.
LINE_SIGNS, DESCRIPTION, HISTORY, SUMMARY = 2000, 800, 1600, 2400
LEAST_SHOWN = 80
NONE = "struct<evidence:string,alias:string,canonical:string,bonus:int>"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scope(corpus: Corpus, request: SearchRequest) -> DataFrame:
    """Documents that meet every filter on what is known of them; any value of a filter will do."""
    f, d = request.filters, corpus.described()
    d = d.where(F.col("game").isin(*f["games"]))
    if f["resource_types"]:
        d = d.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in f["resource_types"]])))
    for name, column in (("content_types", F.col("content_type")), ("collection_names", F.col("collection_name")), ("story_names", tx.normalize(F.col("story_name")))):
        if f[name]:
            d = d.where(column.isin(*f[name]))
    shared = F.col("role") == "character_activity"  # their names may stand in the text only
    if f["character_names"]:
        stated = F.length(F.trim(F.coalesce("character_name", F.lit("")))) > 0
        named = corpus.lines.select("document_id", "line_number", classify.named_in_line(F.col("text")).alias("__name")).where("__name IS NOT NULL")
        named = named.groupBy("document_id").agg(F.min_by("__name", "line_number").alias("__name"))
        d = d.join(named, "document_id", "left").where(tx.normalize(F.when(shared & ~stated, F.col("__name")).otherwise(F.col("character_name"))).isin(*f["character_names"])).drop("__name")
    if f["activity_names"]:
        no_name = F.length(F.trim(F.coalesce("activity_name", F.lit("")))) == 0
        name = F.when(no_name & F.col("role").isin("story", "character_activity"), F.col("display_title")).otherwise(F.col("activity_name"))
        aliases = classify.activity_aliases(F.col("activity_id"), name, F.col("collection_id"))
        exact = F.col("role").isin("story", "character_activity")
        fits = any_of([F.when(exact, classify.activity_match(aliases, w, True)).otherwise(classify.activity_match(aliases, w)) for w in f["activity_names"]])
        held = ranges(corpus, request).select("document_id").distinct().withColumn("__held", F.lit(1))
        d = d.join(held, "document_id", "left").where(F.when(shared & no_name, F.col("__held") == 1).otherwise(fits)).drop("__held")
    if f["wiki_sections"]:
        d = d.where(F.col("role") != "")
    if f["speakers"]:
        said = corpus.lines.where(F.col("speaker_raw").isin(*f["speakers"])).select("document_id").distinct()
        d = d.join(said, "document_id", "left_semi")
    return d


def ranges(corpus: Corpus, request: SearchRequest) -> DataFrame:
    """The wanted activities' parts of documents that hold several."""
    found = sections.activity_ranges(corpus.lines.select("document_id", "line_number", "text").distinct())
    return found.where(tx.normalize(F.col("name")).isin(*request.filters["activity_names"]))


def title_hits(documents: DataFrame, request: SearchRequest) -> DataFrame:
    """(document_id, exact) of the documents whose titles match; none where a condition is on lines."""
    if not request.query or request.line_scope:
        return documents.select("document_id", F.lit(0).alias("exact")).limit(0)
    if request.mode == "regex":
        hit = tx.normalize(F.concat_ws("\n", "display_title", "story_name", "activity_name", "character_name", "story_code", "part_label")).rlike(search.safe_pattern(request.query))
    else:
        hit = F.contains("titles", F.lit(request.query.lower()))
    exact = any_of([F.coalesce(tx.normalize(F.col(c)) == request.query, F.lit(False)) for c in ("story_name", "display_title")])
    return documents.where(hit).select("document_id", exact.cast("int").alias("exact"))


def candidates(corpus: Corpus, request: SearchRequest) -> DataFrame:
    """The documents to look at, in order: described, with ``ordinal`` from 0.

    A literal of three signs or more leaves those that hold all its grams, by the index if there is one; archive documents
    that bear the query as their title come first, the games take turns after them.
    """
    d = scope(corpus, request)
    if request.query and request.mode == "literal":
        literal = request.query.lower()
        if corpus.index is not None:
            from storyloom.operators import index

            held = index.documents_with(corpus.index, tx.query_ngrams(literal))
        else:
            held = search.candidates(corpus.lines, tx.search_form(F.col("text")), literal)
        held = held.unionByName(title_hits(d, request).select("document_id")).distinct()
        d = d.join(held, "document_id", "left_semi")
    first = F.lit(False)
    if request.query:
        first = (F.col("resource_type") == "archive") & any_of([F.coalesce(tx.search_form(F.col(c)) == request.query.lower(), F.lit(False)) for c in ("display_title", "story_name")])
    d = d.withColumn("__lead", F.when(first, "first").otherwise(F.col("game")))
    ordered = search.interleave(d, "__lead", ["document_id"], list(request.filters["games"]))
    ahead = search.ranked(ordered.where("__lead = 'first'").select("document_id", "__lead"), "__lead", ["document_id"], "__ahead").select("document_id", "__ahead")
    n = ahead.count()  # one row or a few: documents titled exactly so
    if not n:
        return ordered.drop("__lead")
    out = ordered.join(F.broadcast(ahead), "document_id", "left")
    return out.withColumn("ordinal", F.coalesce("__ahead", F.col("ordinal") + n)).drop("__ahead", "__lead")


def occurrence(groups: dict[str, list[str]], query: bool, start: Column, stop: Column, content: Column) -> Column:
    """How a line names one of the wanted entities: (evidence, alias, canonical, bonus), null if it does not.

    Stored occurrences come first, then the speaker, then an alias in the text; where there is a query, an alias in the
    text must stand within reach of its match.
    """
    owner = {a: c for c, aliases in reversed(groups.items()) for a in [*aliases, c]}
    canon = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    near = lambda a: search.near_hit(content, a, start, stop).isNotNull() if query else F.contains(content, a)
    of = lambda kind, alias, canonical, bonus: F.struct(F.lit(kind).alias("evidence"), alias.alias("alias"), canonical.alias("canonical"), F.lit(bonus).alias("bonus"))
    fit = F.filter("entity_occurrences", lambda o: canon[o["raw_name"]].isNotNull() & ((o["evidence_kind"] == "speaker") | near(o["raw_name"]) if query else F.lit(True)))
    o = F.get(fit, F.lit(0))
    bonus = F.when(o["evidence_kind"] == "speaker", 300).when(o["evidence_kind"].isin("mention", "text_mention", "alias"), 50).otherwise(200)
    stored = F.when(o.isNotNull(), F.struct(o["evidence_kind"].alias("evidence"), o["raw_name"].alias("alias"), canon[o["raw_name"]].alias("canonical"), bonus.alias("bonus")))
    found = [stored]
    for canonical, aliases in groups.items():
        found.append(F.when(F.col("speaker_raw").isin(*aliases), of("speaker", F.col("speaker_raw"), F.lit(canonical), 300)))
        useful = [a for a in aliases if len(a) > 1] or aliases
        found += [F.when(near(F.lit(a)), of("text_mention", F.lit(a), F.lit(canonical), 50)) for a in useful]
    return F.coalesce(*found)


def matches(corpus: Corpus, request: SearchRequest, documents: DataFrame) -> DataFrame:
    """Matching lines of the documents: (document_id, line_number, start, score, evidence, term_lines, low, high, and where
    asked for section and range), each line once."""
    f = request.filters
    lines = complete_lines(corpus.lines).join(documents.select("document_id"), "document_id", "left_semi")
    if f["speakers"]:
        lines = lines.where(F.col("speaker_raw").isin(*f["speakers"]))
    content = tx.normalize(tx.line_content(F.col("line_type"), F.col("speaker_raw"), F.col("text")))
    lines = lines.withColumn("__content", content)
    if request.query and request.mode == "regex":
        start, size = search.regex_match(F.col("__content"), request.query)
        base = 700
    elif request.query:
        start, size = search.literal_start(F.lower("__content"), request.query.lower()), F.lit(len(request.query))
        base = 1000
    else:
        start, size, base = F.lit(None).cast("int"), F.lit(0), 500
    hits = lines.withColumn("start", start)
    if request.query:
        hits = hits.where("start IS NOT NULL")
    hits = hits.withColumn("stop", F.col("start") + size)
    if f["entity_names"]:
        groups = entities.expand(alias_groups(corpus), list(f["entity_names"]))
        hits = hits.withColumn("__o", occurrence(groups, bool(request.query), F.col("start"), F.col("stop"), F.col("__content"))).where("__o IS NOT NULL")
    else:
        hits = hits.withColumn("__o", F.lit(None).cast(NONE))
    hits = hits.withColumn("score", search.score(F.col("start"), base, F.coalesce("__o.bonus", F.lit(0))))
    own = ["document_id", "line_number", "start", "score", F.col("__o.evidence").alias("evidence")]
    hits = corpus.once(hits.select(*own, *(["line_id"] if "line_id" in hits.columns else []))).drop("line_id")
    whole = corpus.lines.join(documents.select("document_id"), "document_id", "left_semi")
    if f["wiki_sections"]:
        spans = sections.sections(whole.select("document_id", "line_number", "text").distinct(), f["wiki_sections"])
        hits = within(hits, spans, "section")
    if f["activity_names"]:
        shared = documents.where((F.col("role") == "character_activity") & (F.length(F.trim(F.coalesce("activity_name", F.lit("")))) == 0)).select("document_id", F.lit(1).alias("__shared"))
        spans = ranges(corpus, request)
        hits = within(hits.join(shared, "document_id", "left"), spans, "range", outer=True).where("__shared IS NULL OR range IS NOT NULL").drop("__shared")
    if not request.line_scope and request.mode == "literal" and request.query:
        hits = search.first_matches(hits)
    terms = [t.lower() for t in request.context_terms]
    return search.context_terms(whole.withColumn("form", tx.search_form(F.col("text"))), hits, terms)


def complete_lines(lines: DataFrame) -> DataFrame:
    texts = [c for c in ("line_type", "speaker_raw", "text") if c not in lines.columns]
    lines = lines.withColumns({c: F.lit(None).cast("string") for c in texts})
    if "entity_occurrences" not in lines.columns:
        lines = lines.withColumn("entity_occurrences", F.array().cast("array<struct<entity_id:string,raw_name:string,evidence_kind:string,confidence:double>>"))
    return lines


def within(hits: DataFrame, spans: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Hits with the smallest interval they lie in, as a struct (name, start, stop)."""
    rolled = spans.select("document_id", F.explode(F.sequence("start", "stop")).alias("line_number"), F.struct((F.col("stop") - F.col("start")).alias("size"), "start", "name", "stop").alias("s"))
    least = rolled.groupBy("document_id", "line_number").agg(F.min("s").alias("s"))
    least = least.select("document_id", "line_number", F.struct("s.name", "s.start", "s.stop").alias(name))
    return hits.join(least, ["document_id", "line_number"], "left" if outer else "inner")


def alias_groups(corpus: Corpus) -> DataFrame:
    groups = entities.alias_groups(corpus.entities)
    return groups if corpus.alias_lines is None else entities.attached(groups, corpus.alias_lines)


def result_kinds(request: SearchRequest) -> Column:
    """match_kind of a passage by the evidence of its best hit."""
    e = F.col("evidence")
    plain = "regex" if request.mode == "regex" else "literal" if request.query else "speaker"
    return F.when(e == "speaker", "entity_speaker").when(e == "text_mention", "entity_mention").when(e.isNotNull(), "entity_projection").otherwise(plain)


def anchors(corpus: Corpus, documents: DataFrame, speakers: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, line_number) a document is opened at."""
    lines = complete_lines(corpus.lines).join(documents.select("document_id"), "document_id", "left_semi")
    return search.anchor_lines(lines.where(F.col("speaker_raw").isin(*speakers)) if speakers else lines)


def items(corpus: Corpus, request: SearchRequest, documents: DataFrame) -> DataFrame:
    """What is found in each document: (document_id, field, section, first, last, hits, score, cut, rank); title hits last."""
    wide = lambda df: df.select("document_id", "field", "section", *[F.col(c).cast("int").alias(c) for c in ("first", "last", "hits", "score", "cut")], "kind")
    if request.kind == "complete_sections":
        whole = corpus.lines.join(documents.select("document_id"), "document_id", "left_semi").select("document_id", "line_number", "text").distinct()
        spans = sections.sections(whole, request.filters["wiki_sections"])
        filled = whole.where(F.length(F.trim("text")) > 0).select("document_id", "line_number")
        some = sections.lines_in(filled, spans).select("document_id", "name").distinct()
        found = wide(spans.join(some, ["document_id", "name"], "left_semi").select("document_id", F.lit("wiki_section").alias("field"), F.col("name").alias("section"), F.col("start").alias("first"), F.col("stop").alias("last"), F.lit(1).alias("hits"), F.lit(1000).alias("score"), F.lit(0).alias("cut"), F.lit("section").alias("kind")))
    elif request.kind == "documents":
        at = anchors(corpus, documents)
        found = wide(at.select("document_id", F.lit("catalog").alias("field"), F.lit(None).cast("string").alias("section"), F.col("line_number").alias("first"), F.col("line_number").alias("last"), F.lit(1).alias("hits"), F.lit(1000).alias("score"), F.lit(0).alias("cut"), F.lit("catalog").alias("kind")))
    else:
        hits = matches(corpus, request, documents)
        found = search.passages(hits)
        best = hits.groupBy("document_id", "line_number").agg(F.first("evidence").alias("evidence"), F.first("score").alias("score"))
        lead = found.select("document_id", "rank", F.explode(F.sequence("first", "last")).alias("line_number")).join(best, ["document_id", "line_number"])
        lead = lead.groupBy("document_id", "rank").agg(F.max_by("evidence", F.struct("score", -F.col("line_number"))).alias("evidence"))
        found = found.join(lead, ["document_id", "rank"], "left")
        kind = F.when(F.col("section").isNotNull(), "section").otherwise(result_kinds(request)) if "section" in found.columns else result_kinds(request)
        section = F.col("section.name") if "section" in found.columns else F.lit(None).cast("string")
        field_ = "content" if request.query else "entity" if request.filters["entity_names"] else "speaker_raw"
        found = wide(found.withColumn("kind", kind).withColumn("section", section).withColumn("field", F.lit(field_)))
        titles = title_hits(documents, request).join(anchors(corpus, documents, request.filters["speakers"]), "document_id")
        titles = titles.select("document_id", F.lit("title").alias("field"), F.lit(None).cast("string").alias("section"), F.col("line_number").alias("first"), F.col("line_number").alias("last"), F.lit(1).alias("hits"), F.when(F.col("exact") == 1, 1000).otherwise(960).alias("score"), F.lit(0).alias("cut"), F.lit("title").alias("kind"))
        found = found.unionByName(wide(titles))
    order = search.W.partitionBy("document_id").orderBy((F.col("field") == "title").cast("int"), F.desc("score"), "first")
    return found.withColumn("rank", F.row_number().over(order))


def shown_lines(corpus: Corpus, request: SearchRequest, documents: DataFrame, found: DataFrame) -> DataFrame:
    """The lines the first passages of each document show: (document_id, rank, line_number, role, line_type, speaker, text, cut)."""
    own = complete_lines(corpus.lines).join(documents.select("document_id"), "document_id", "left_semi")
    text = tx.normalize(tx.line_content(F.col("line_type"), F.col("speaker_raw"), F.col("text")))
    own = own.withColumn("text", text)
    best = found.where(f"field != 'title' AND rank <= {search.PASSAGES}")
    if request.kind == "complete_sections":
        rolled = best.select("document_id", F.lit(1).alias("rank"), F.explode(F.sequence("first", "last")).alias("line_number")).distinct()
        shown = own.where(F.length("text") > 0).join(rolled, ["document_id", "line_number"])
        return corpus.once(shown.withColumn("role", F.lit("match")).select("document_id", "line_number", "rank", "role", "line_type", F.col("speaker_raw").alias("speaker"), "text", F.lit(False).alias("cut")))
    hits = matches(corpus, request, documents)
    lines = search.excerpts(own, best, hits)
    more = own.groupBy("document_id", "line_number").agg(F.min_by(F.struct("line_type", "speaker_raw"), "line_id" if "line_id" in own.columns else "text").alias("m"))
    out = lines.join(more, ["document_id", "line_number"])
    cut = F.length("text") > LINE_SIGNS
    return out.select("document_id", "rank", "line_number", "role", "m.line_type", F.col("m.speaker_raw").alias("speaker"), F.when(cut, F.concat(F.substring("text", 1, LINE_SIGNS), F.lit("…"))).otherwise(F.col("text")).alias("text"), cut.alias("cut"))


def fit(lines: list[dict], budget: int) -> list[dict]:
    """Lines within a budget of signs: the last context lines go first, then the first match is clipped."""
    out = [dict(x) for x in lines]
    cost = lambda: sum(len(x["text"] or "") for x in out)
    while cost() > budget and any(x["role"] == "context" for x in out):
        out.pop(max(k for k, x in enumerate(out) if x["role"] == "context"))
    if out and cost() > budget:
        target = next((x for x in out if x["role"] == "match"), out[0])
        room = max(LEAST_SHOWN, budget - cost() + len(target["text"]))
        if len(target["text"]) > room:
            target["text"], target["cut"] = target["text"][: max(1, room - 1)] + "…", True
    return out


def entity_summary(entity: Row | None, most: int = SUMMARY) -> dict:
    """Description and history of an entity within their limits and the whole one."""

    def clip(value: str | None, limit: int) -> tuple[str, bool]:
        from storyloom.tools.requests import plain

        text = plain(value)
        if not text or limit <= 0:
            return "", bool(text)
        return (text, False) if len(text) <= limit else (text[: limit - 1] + "…", True)

    if entity is None:
        return {"canonical_name": "", "truncated": False}
    description, cut = clip(entity.description, min(DESCRIPTION, most))
    history, cut_too = clip(entity.history_summary, min(HISTORY, max(0, most - len(description))))
    out = {"canonical_name": entity.canonical_name or "", "truncated": cut or cut_too}
    if description:
        out["description"] = description
    if history and history != description:
        out["history_summary"] = history
    return out


def run(corpus: Corpus, raw: dict) -> dict:
    """The answer to a request: documents of one page with what was found, and where the next one goes on."""
    try:
        request = search_request(raw, corpus.games)
        after = request.after
        if after and after.data_version != corpus.version:
            raise RequestError("PAGE_ANCHOR_VERSION_MISMATCH", "the page belongs to another version")
        ordered = candidates(corpus, request)
        begin = after.position + 1 if after else 0
        if after:
            at = ordered.where(F.col("ordinal") == after.position).select("resource_type", "title").first()
            if at is None:
                raise RequestError("PAGE_ANCHOR_NOT_FOUND", "there is no such place")
            if (at.resource_type, at.title) != (after.resource_type, after.title):
                raise RequestError("PAGE_ANCHOR_MISMATCH", "another document stands there")
        return _page(corpus, request, ordered, begin)
    except RequestError as e:
        return e.public()


def _page(corpus: Corpus, request: SearchRequest, ordered: DataFrame, begin: int) -> dict:
    columns = ["document_id", "ordinal", "title", "uid", "game", "resource_type", "content_type", "collection_name", "activity_name", "character_name", "story_name", "display_title", "role", "titles", "story_code", "part_label"]
    # the documents of one page, at most SCAN and one that tells whether there are more
    window = ordered.where(F.col("ordinal").between(begin, begin + search.SCAN)).select(*columns).orderBy("ordinal").collect()
    more, window = len(window) > search.SCAN, window[: search.SCAN]
    total = ordered.agg(F.max("ordinal")).first()[0] if not more else None
    documents = corpus.documents.sparkSession.createDataFrame(window, ordered.select(*columns).schema)
    found = items(corpus, request, documents)
    first: dict[str, list[Row]] = {}
    for r in found.where(F.col("rank") <= search.PASSAGES + 1).orderBy("document_id", "rank").collect():
        first.setdefault(r.document_id, []).append(r)
    # what may be shown: no more documents than a page has
    likely = [r for r in window if r.document_id in first][: search.PAGE]
    shown: dict[tuple, list[dict]] = {}
    if likely and request.kind != "documents":
        few = documents.where(F.col("document_id").isin(*[r.document_id for r in likely]))
        best = found.join(few.select("document_id"), "document_id", "left_semi")
        for x in shown_lines(corpus, request, few, best).orderBy("document_id", "rank", "line_number").collect():
            shown.setdefault((x.document_id, x["rank"]), []).append({"line": x.line_number, "role": x.role, "line_type": x.line_type or "", "speaker": x.speaker or "", "text": x.text or "", "cut": bool(x.cut)})
    summaries = _summaries(corpus, [r for r in likely if r.resource_type == "entity_profile"])
    out: list[dict] = []
    reasons: set[str] = set()
    used, stopped, position = 0, False, begin
    for r in window:
        if len(out) >= search.PAGE:
            stopped = True
            break
        if r.document_id in first:
            left = search.PAGE_SIGNS - used
            own = _document(r, first[r.document_id], shown, summaries, request, search.PAGE_SIGNS if not out else left)
            if out and own["__cost"] > left:
                reasons.add("output_chars")
                stopped = True
                break
            used += own.pop("__chars")
            own.pop("__cost")
            reasons |= own.pop("__reasons")
            out.append(own)
        position = r.ordinal + 1
    exhausted = not stopped and not more
    if not exhausted:
        reasons.add("scan_incomplete")
    page: dict = {"returned_documents": len(out), "total_relation": "eq" if exhausted and begin == 0 else "unknown", "has_more": not exhausted, "exhausted": exhausted, "next_after": None}
    if exhausted and begin == 0:
        page["total_documents"] = len(out)
    if not exhausted:
        last = next(r for r in window if r.ordinal == position - 1)
        page["next_after"] = {"data_version": corpus.version, "resource_type": last.resource_type, "title": last.title, "position": position - 1}
    page["candidates"] = None if total is None else total + 1
    answer = {"status": "ok", "result_kind": request.kind, "documents": out, "page": page, "truncated": bool(reasons), "truncation_reasons": sorted(reasons)}
    if corpus.relations is not None and len(corpus.games) > 1:
        said = json.dumps([request.query, request.filters, out], ensure_ascii=False)
        text = corpus.documents.sparkSession.createDataFrame([(0, said.lower())], "k int, text string")
        lowered = corpus.relations.select("id", F.lower("a").alias("a"), F.lower("b").alias("b"))
        ids = [r.id for r in entities.relation_hints(text, "k", "text", lowered.select("id", "a", "b")).join(lowered, ["a", "b"]).select("id").distinct().collect()]
        answer["relations"] = [r.asDict() for r in corpus.relations.where(F.col("id").isin(*ids)).orderBy("id").collect()] if ids else []
    return answer


def _summaries(corpus: Corpus, profiles: list[Row]) -> dict[str, Row]:
    if not profiles or corpus.entities is None:
        return {}
    names = [r.display_title for r in profiles if r.display_title]
    return {e.canonical_name: e for e in corpus.entities.where(F.col("canonical_name").isin(*names)).select("canonical_name", "description", "history_summary").collect()}


def _document(r: Row, found: list[Row], shown: dict, summaries: dict, request: SearchRequest, budget: int) -> dict:
    """One document of the answer, with what it costs in signs and what was cut."""
    out: dict = {"game": r.game, "title": r.title, "document_uid": r.uid, "resource_type": r.resource_type, "content_type": r.content_type, "matches": [], "matches_truncated": any(i.cut for i in found)}
    out |= {k: r[k] for k in ("collection_name", "activity_name", "character_name") if r[k]}
    reasons = {"document_passages"} if out["matches_truncated"] else set()
    chars = cost = 0
    if request.kind != "documents" and r.resource_type == "entity_profile":
        whole = entity_summary(summaries.get(r.display_title))
        cost = len(whole.get("description", "")) + len(whole.get("history_summary", ""))
        out["entity_summary"], out["matches_truncated"] = entity_summary(summaries.get(r.display_title), min(SUMMARY, budget)), False
        chars = len(out["entity_summary"].get("description", "")) + len(out["entity_summary"].get("history_summary", ""))
        reasons = {"entity_summary"} if out["entity_summary"]["truncated"] else set()
    elif request.kind == "complete_sections":
        lines = shown.get((r.document_id, 1), [])
        cost = sum(len(x["text"]) for x in lines)
        blocks: list[str] = []
        for x in lines:
            if chars + len(x["text"]) > budget:
                if not blocks:
                    blocks.append(x["text"][: max(1, budget - 1)] + "…")
                    chars = budget
                reasons.add("section_content")
                break
            blocks.append(x["text"])
            chars += len(x["text"])
        name = found[0].section
        out["section_content"] = {"section": name, "completeness": "partial" if "section_content" in reasons else "complete", "blocks": blocks, "citation": f"《{r.title}》Wiki·{name}"}
    elif request.kind != "documents":
        for i in found[: search.PASSAGES]:
            lines = [] if i.field == "title" else shown.get((r.document_id, i["rank"]), [])
            own = sum(len(x["text"]) for x in lines)
            cost += own
            if out["matches"] and chars + own > budget:
                out["matches_truncated"] = True
                reasons |= {"output_chars", "document_passages"}
                break
            kept = fit(lines, budget - chars) if own > budget - chars else lines
            if any(x["cut"] for x in kept) or sum(len(x["text"]) for x in kept) < own:
                reasons.add("line_chars")
            where = f"《{r.title}》" + ("" if i.field == "title" else f"Wiki·{i.section}" if i.section else f"第 {i.first} 行" if i.first == i.last else f"第 {i.first}-{i.last} 行")
            match = {"match_kind": i.kind, "evidence_kind": _evidence(r.resource_type, i), "score": i.score / 1000, "excerpt": kept, "citation": where}
            if i.field != "title" and not i.section:
                match |= {"line_start": i.first, "line_end": i.last}
            out["matches"].append(match)
            chars += sum(len(x["text"]) for x in kept)
    return out | {"__chars": chars, "__cost": cost, "__reasons": reasons}


def _evidence(resource: str, item: Row) -> str:
    """As ``classify.evidence_kind``, for a row that is at hand."""
    if item.field in ("catalog", "title"):
        return "catalog"
    if item.kind == "entity_projection":
        return "entity_projection"
    if resource in ("story", "original_story", "operator_record"):
        return "official_canonical"
    structured = resource == "archive" or resource.startswith("character_") and not resource.endswith("_wiki")
    return "official_structured" if structured else "wiki_curated"
