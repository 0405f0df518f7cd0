"""Answers as text for readers, and the cap on how much of it is handed out."""

from __future__ import annotations

import json
import re

MOST_SIGNS = 60_000
#: How text stands for what is shown.
MARKS = {"match": ">", "constraint": "+", "context": " "}
CUT = "…[输出已截断]"


def capped(text: str, most: int = MOST_SIGNS) -> str:
    """At most so many signs, cut after the last whole line, with a remark."""
    if len(text) <= most:
        return text
    room = most - len(CUT) - 1
    at = text.rfind("\n", 0, room + 1)
    return text[: at if at > 0 else room] + "\n" + CUT


def error(tool: str, answer: dict) -> str | None:
    if answer.get("status") != "error":
        return None
    e = answer["error"]
    return f"[{tool}:error] {e['code']}: {e['message']}"


def highlighted(text: str, query: str, mode: str = "literal") -> str:
    """Every match of the query in 【】; matches of nothing are left alone."""
    if not query:
        return text
    pattern = re.compile(query if mode == "regex" else re.escape(query), 0 if mode == "regex" else re.I)
    return pattern.sub(lambda m: f"【{m.group()}】" if m.group() else "", text)


def search(answer: dict, query: str = "", mode: str = "literal") -> str:
    """A heading, relations, each document with its passages, and how to go on."""
    if failed := error("search", answer):
        return failed
    documents, page = answer["documents"], answer["page"]
    shown = sum(1 if "entity_summary" in d else len(d["matches"]) for d in documents)
    parts = [{"documents": f"# 找到 {len(documents)} 篇资料入口", "complete_sections": f"# 返回 {len(documents)} 篇资料的完整字段"}.get(answer["result_kind"], f"# 找到 {len(documents)} 篇资料，共展示 {shown} 处命中")]
    if answer.get("relations"):
        parts.append("\n".join(["## 关系", *(f"- {r['a']} / {r['b']}" for r in answer["relations"])]))
    for d in documents:
        lines = [f"## {d['title']} [{d['resource_type']}] document_uid={d['document_uid']}"]
        if "entity_summary" in d:
            lines += [d["entity_summary"][k] for k in ("description", "history_summary") if k in d["entity_summary"]]
        if "section_content" in d:
            lines += [*d["section_content"]["blocks"], d["section_content"]["citation"]]
        for m in d["matches"]:
            lines.append(f"{m['citation']} ({m['match_kind']})")
            for x in m["excerpt"]:
                text = highlighted(x["text"], query, mode) if x["role"] == "match" else x["text"]
                lines.append(f"{MARKS[x['role']]} L{x['line']} " + (f"{x['speaker']}: " if x["speaker"] else "") + text)
        parts.append("\n".join(lines))
    if page["next_after"]:
        parts.append("after: " + json.dumps(page["next_after"], ensure_ascii=False, separators=(",", ":")))
    elif not documents:
        parts.append("已检查完整检索范围，没有找到。")
    elif "total_documents" in page:
        parts.append(f"已检查完整检索范围，共匹配 {page['total_documents']} 篇资料。")
    return capped("\n\n".join(parts))


def line(item: dict) -> str:
    """One line as shown to readers, its speaker not repeated."""
    speaker, text = item["speaker_raw"].strip(), item["text"]
    if speaker:
        text = re.sub(rf"^{re.escape(speaker)}\s*[：:]\s*", "", text)
    return f"L{item['line_number']} {item['line_type']} {speaker + ': ' if speaker else ''}{text}".rstrip()


def read(answer: dict) -> str:
    """The lines; in collections the document is named where it changes, once for all its lines."""
    if failed := error("read", answer):
        return failed
    parts = [f"# {answer['title']}" if "title" in answer else f"# {answer['stream']['name']} {answer['stream']['position_start']}-{answer['stream']['position_end']}/{answer['stream']['lines']}"]
    if answer["content"]["format"] == "plain_text":
        parts.append(answer["content"]["text"])
    last = None
    for item in answer["content"].get("lines", []):
        if (title := item.get("document_title")) != last and title:
            parts.append(f"《{title}》")
            last = title
        parts.append(line(item))
    if "citation" in answer:
        parts.append(answer["citation"])
    if answer["page"]["continuation"]:
        parts.append("continuation: " + json.dumps(answer["page"]["continuation"], ensure_ascii=False, separators=(",", ":")))
    return capped("\n".join(parts))


def timeline(answer: dict) -> str:
    if failed := error("timeline", answer):
        return failed
    if answer["mode"] == "source":
        e = answer["event"]
        sources = [" | ".join(s.get(k) for k in ("text", "story_name", "activity_name") if s.get(k)) for s in answer["provenance"]["sources"]]
        return capped("\n".join([f"{e['time']}：{e['event']}", f"activity: {e['activity_name'] or ''}", *(f"  - {s}" for s in sources)]))
    page = answer["page"]
    rows = [f"{k + 1}. [{'、'.join(e['activity_names'])}] {e['time']}：{e['event']} [{e['source_marker']}]" for k, e in enumerate(answer["events"])]
    return capped("\n".join([*rows, f"page: returned={page['returned']} total={page['total']} has_more={str(page['has_more']).lower()}"]))


def localised(answer: dict) -> str:
    return capped(error("i18n", answer) or json.dumps(answer, ensure_ascii=False, separators=(",", ":")))
