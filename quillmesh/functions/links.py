"""Wikilinks and the concept list kept in a note's frontmatter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import trim_ws

# Link patterns and the default page prefix.
WIKILINK = r"\[\[([^\]]+)\]\]"
STORED_LINK = r"\[\[.+/(.+)\]\]\z"
LISTED_LINK = r"\[\[.*/(.+)\]\]"
DEFAULT_PREFIX = "_me"


def wikilink_concepts(content: Column) -> Column:
    """Distinct link targets in reading order, without alias, heading and folders."""

    def target(raw: Column) -> Column:
        no_alias = trim_ws(F.substring_index(trim_ws(raw), "|", 1))
        page = trim_ws(F.substring_index(no_alias, "#", 1))
        parts = F.filter(F.split(page, "/"), lambda p: p != "")
        return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(page)

    found = F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1)), target)
    return F.array_distinct(F.filter(found, lambda name: name != ""))


def wrap(name: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return F.concat(F.lit(f"[[{prefix}/"), name, F.lit("]]"))


def stored_name(link: Column) -> Column:
    """Concept name of a stored link; a link without a folder stays verbatim."""
    return F.when(link.rlike(STORED_LINK), F.regexp_extract(link, STORED_LINK, 1)).otherwise(link)


def merge_links(existing: Column, new_names: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """Union of stored links and new names, in order, all wrapped again."""
    none = F.array().cast("array<string>")
    names = F.concat(
        F.transform(F.coalesce(existing, none), stored_name), F.coalesce(new_names, none)
    )
    return F.transform(F.array_distinct(names), lambda n: wrap(n, prefix))
