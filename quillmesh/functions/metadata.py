"""Normalising model answers: tags, category, concepts, whole metadata records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.coercion import (
    as_items,
    as_text,
    field,
    is_truthy,
    kind_of,
    parse_answer,
    to_number,
)
from quillmesh.functions.text import is_blank, let, trim_ws

# The categories, their default, and the extraction limits.
VALID_CATEGORIES = ["技术笔记", "生活日记", "读书笔记", "想法灵感", "工作记录"]
DEFAULT_CATEGORY = "技术笔记"
MAX_TAGS = 5
MAX_CONCEPTS = 5
DEFAULT_CONFIDENCE = 0.7
MAX_PROMPT_CHARS = 2000
REASON_PREFIX = "片段主题: "
REASON_DEFAULT = "来自片段内容"

# Keyword lists per category.
CATEGORY_KEYWORDS = {
    "tech": [
        "code", "function", "class", "api", "bug", "algorithm", "data", "programming", "software",
        "development", "typescript", "javascript", "python", "rust", "java", "database", "server",
        "client", "代码", "函数", "类", "算法", "数据", "编程", "软件", "开发",
    ],
    "diary": [
        "今天", "昨天", "明天", "心情", "感觉", "想到", "觉得", "today", "yesterday", "feel", "feeling", "mood",
    ],
    "book": [
        "读了", "书中", "作者", "认为", "观点", "章节", "book", "author", "chapter", "read", "reading",
    ],
    "idea": [
        "想法", "灵感", "或许", "可以", "尝试", "创意", "idea", "inspiration", "maybe", "perhaps", "creative",
    ],
}
KEYWORD_CATEGORY_NAMES = {"tech": "技术笔记", "diary": "生活日记", "book": "读书笔记", "idea": "想法灵感"}

CONCEPT = "struct<name:string,confidence:double>"
METADATA = f"struct<summary:string,tags:array<string>,category:string,concepts:array<{CONCEPT}>>"


def strip_code_fence(answer: Column) -> Column:
    """Remove the code fence some models put around their JSON."""
    return F.regexp_replace(answer, "```json\n?|\n?```", "")


def normalize_tags(tags: Column) -> Column:
    """Drop blank tags, keep the first of equal ones, at most five."""
    kept = F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & ~is_blank(t)))
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, MAX_TAGS)


def normalize_category(category: Column) -> Column:
    return F.when(category.isin(VALID_CATEGORIES), category).otherwise(F.lit(DEFAULT_CATEGORY))


def strongest_per_name(concepts: Column) -> Column:
    """One concept per case-insensitive name: strictly highest confidence wins,
    ties keep the first; output in order of first appearance."""

    def pick(items: Column) -> Column:
        keys = F.array_distinct(F.transform(items, lambda x: F.lower(x["name"])))

        def best(key: Column) -> Column:
            same = F.filter(items, lambda x: F.lower(x["name"]) == key)
            return F.aggregate(
                F.slice(same, F.lit(2), F.size(same)),
                F.get(same, F.lit(0)),
                lambda acc, x: F.when(x["confidence"] > acc["confidence"], x).otherwise(acc),
            )

        return F.transform(keys, best)

    return let(concepts, pick)


def normalize_concepts(items: Column) -> Column:
    """Array of VARIANT (strings or objects) -> at most five distinct concepts."""

    def one(item: Column) -> Column:
        kind = kind_of(item)
        name = F.when(kind == "STRING", as_text(item)).when(
            (kind == "OBJECT") & (kind_of(field(item, "name")) == "STRING"), as_text(field(item, "name"))
        )
        stated = F.when(kind == "OBJECT", to_number(field(item, "confidence")))
        return F.struct(
            trim_ws(name).alias("name"),
            F.coalesce(stated, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        )

    named = F.filter(F.transform(items, one), lambda c: F.coalesce(c["name"], F.lit("")) != "")
    return F.slice(strongest_per_name(named), 1, MAX_CONCEPTS)


def empty_metadata() -> Column:
    return F.struct(
        F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("").alias("category"),
        F.array().cast(f"array<{CONCEPT}>").alias("concepts"),
    ).cast(METADATA)


def normalize_metadata(answer: Column, content: Column) -> Column:
    """Model answer text -> metadata record.

    The record is empty when the content is blank, the answer does not parse or
    is null, or a tag is a non-empty value other than a string.
    """

    def build(v: Column) -> Column:
        tags = as_items(field(v, "tags"))
        bad_tag = F.exists(tags, lambda t: is_truthy(t) & (kind_of(t) != "STRING"))
        summary = F.when(is_truthy(field(v, "summary")), as_text(field(v, "summary")))
        category = F.when(kind_of(field(v, "category")) == "STRING", as_text(field(v, "category")))
        record = F.struct(
            F.coalesce(summary, F.lit("")).alias("summary"),
            normalize_tags(F.transform(F.filter(tags, is_truthy), as_text)).alias("tags"),
            normalize_category(F.coalesce(category, F.lit(""))).alias("category"),
            normalize_concepts(as_items(field(v, "concepts"))).alias("concepts"),
        ).cast(METADATA)
        unusable = v.isNull() | (kind_of(v) == "VOID") | bad_tag
        return F.when(F.coalesce(unusable, F.lit(True)), empty_metadata()).otherwise(record)

    return F.when(is_blank(content), empty_metadata()).otherwise(
        let(parse_answer(strip_code_fence(answer)), build)
    )


def concept_reason(summary: Column, header_path: Column) -> Column:
    return (
        F.when(~is_blank(summary), trim_ws(summary))
        .when(F.coalesce(header_path, F.lit("")) != "", F.concat(F.lit(REASON_PREFIX), header_path))
        .otherwise(F.lit(REASON_DEFAULT))
    )


def concept_details(concepts: Column, summary: Column, header_path: Column) -> Column:
    """Concepts of a chunk with the reason they were proposed."""
    named = F.filter(concepts, lambda c: F.coalesce(c["name"], F.lit("")) != "")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.transform(
        named,
        lambda c: F.struct(
            c["name"].alias("name"),
            F.when(finite(c["confidence"]), c["confidence"]).otherwise(F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
            concept_reason(summary, header_path).alias("reason"),
        ),
    )


def truncate_for_prompt(content: Column, max_chars: int = MAX_PROMPT_CHARS) -> Column:
    return F.when(
        F.length(content) > max_chars, F.concat(F.substring(content, 1, max_chars), F.lit("..."))
    ).otherwise(content)


def metadata_prompt(content: Column, template: str) -> Column:
    """Fill ``{content}`` of a caller-supplied prompt with the truncated text."""
    before, after = template.split("{content}")
    return F.concat(F.lit(before), truncate_for_prompt(content), F.lit(after))


def span_prompt(content: Column, title: Column, template: str) -> Column:
    """Fill ``{title}`` and ``{numbered}`` of a caller-supplied prompt."""
    from quillmesh.functions.markdown import add_line_numbers

    before, rest = template.split("{title}")
    middle, after = rest.split("{numbered}")
    return F.concat(F.lit(before), title, F.lit(middle), add_line_numbers(content), F.lit(after))


def keyword_hits(content: Column, category: str) -> Column:
    """How many keywords of the category occur in the lower-cased text."""
    return let(
        F.lower(content),
        lambda text: F.size(
            F.filter(F.array(*[F.lit(k) for k in CATEGORY_KEYWORDS[category]]), lambda k: F.contains(text, k))
        ),
    )


def keyword_category(content: Column) -> Column:
    """Category with most keyword hits; ties go to the earlier list, none to the default."""
    ranked = F.array(
        *[
            F.struct(
                keyword_hits(content, name).alias("hits"),
                F.lit(-i).alias("priority"),
                F.lit(KEYWORD_CATEGORY_NAMES[name]).alias("category"),
            )
            for i, name in enumerate(CATEGORY_KEYWORDS)
        ]
    )
    return let(
        F.array_max(ranked),
        lambda best: F.when(best["hits"] > 0, best["category"]).otherwise(F.lit(DEFAULT_CATEGORY)),
    )
