"""JSON of requests and responses."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import uni_trim

#: What a book's memory holds at most.
NOTES, GLOSSARY, RECENT = 8, 32, 2
FENCE = "```(?:json)?\\s*([\\s\\S]*?)\\s*```"


def fenced_json(content: Column) -> Column:
    """The first fenced body, else the whole text, as a variant; null unless it is an object."""
    text = uni_trim(content)
    body = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    v = F.try_parse_json(body)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def message_content(response: Column) -> Column:
    """Text of choices[0].message.content: a string, or a list of strings and objects with text."""
    v = F.try_parse_json(response)
    path = "$.choices[0].message.content"
    parts = F.try_variant_get(v, path, "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))), "")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return uni_trim(F.when(kind == "STRING", F.try_variant_get(v, path, "string")).when(kind.startswith("ARRAY"), joined).otherwise(""))


def batch_payload(blocks: Column, context: Column | None = None) -> Column:
    """{context?, blocks: [{id, html}]} as JSON; an empty context is left out."""
    return F.to_json(F.struct(*([context.alias("context")] if context is not None else []), blocks.alias("blocks")))


def _texts(value: object, most: int) -> list[str]:
    return [t for x in (value if isinstance(value, list) else []) if isinstance(x, str) and (t := x.strip())][:most]


def _text(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


def _pairs(value: object, most: int = GLOSSARY) -> list[dict[str, str]]:
    pairs = [{"source": _text(e.get("source")), "target": _text(e.get("target"))} for e in (value if isinstance(value, list) else []) if isinstance(e, dict)]
    return [e for e in pairs if e["source"] and e["target"]][:most]


def read_chapter_memory(value: object) -> dict:
    """summary and glossary of a chapter; wrong types count as empty."""
    v = value if isinstance(value, dict) else {}
    return {"title": _text(v.get("title")), "summary": _text(v.get("summary")), "glossary": _pairs(v.get("glossary"))}


def read_memory(text: str | None) -> dict:
    """A book's memory: bookSummary, styleGuide, glossary and recentChapters; what isn't readable is left out."""
    try:
        v = json.loads(text or "")
    except ValueError:
        v = {}
    v = v if isinstance(v, dict) else {}
    chapters = [read_chapter_memory(c) for c in (v.get("recentChapters") if isinstance(v.get("recentChapters"), list) else []) if isinstance(c, dict)]
    return {"bookSummary": _text(v.get("bookSummary")), "styleGuide": _texts(v.get("styleGuide"), NOTES), "glossary": _pairs(v.get("glossary")), "recentChapters": [c for c in chapters if any(c.values())][:RECENT]}


def write_memory(memory: dict) -> str:
    """read_memory() takes it back; an empty summary is left out."""
    return json.dumps({k: v for k, v in memory.items() if k != "bookSummary" or v}, ensure_ascii=False)
