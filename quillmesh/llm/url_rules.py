"""URL allow and block rules by a sort-merge range join.

A host becomes the key of its labels in reverse order, each closed by a dot:
``www.example.com`` is ``com.example.www.``.  The key of a rule's host is a prefix
of the keys of all its subdomains, so the rule covers one interval of the sorted
keys.  Both sides are cut into the same key ranges, each range is sorted, and a
sweep keeps a stack of the rules whose interval holds the current key.

A host with many urls spreads over several ranges, because the range bounds are
pairs of key and row hash; a rule goes to every range that its interval meets.
Ranges are swept as a stream.  In memory are the rules of one chain of nested hosts
(not of all hosts) and the bounds, of which there are at most ``ranges``.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fold

#: Rows sampled for each range bound.
BOUND_SAMPLE = 64
_LAST = "\U0010ffff"

MATCHED = "id bigint, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _bounds(keyed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ``ranges - 1`` bounds from a hash sample of some ``BOUND_SAMPLE`` rows a range."""
    rows = keyed.count()
    step = max(1, rows // (BOUND_SAMPLE * ranges))
    sample = keyed.where(F.pmod("salt", F.lit(step)) == 0).select("key", "salt").limit(4 * BOUND_SAMPLE * ranges).collect()
    found = sorted((r.key, r.salt) for r in sample)
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _assign(bounds: list[tuple[str, int]]):
    def urls(batches):
        for b in batches:
            at = [bisect_right(bounds, x) for x in zip(b["key"].to_pylist(), b["salt"].to_pylist(), strict=True)]
            yield b.append_column("piece", pa.array(at, pa.int32()))

    def rules(batches):
        low, high = -(1 << 63), 1 << 63
        for b in batches:
            rows, pieces = [], []
            for i, key in enumerate(b["key"].to_pylist()):
                for p in range(bisect_right(bounds, (key, low)), bisect_right(bounds, (key + _LAST, high)) + 1):
                    rows.append(i)
                    pieces.append(p)
            yield b.take(pa.array(rows, pa.int32())).append_column("piece", pa.array(pieces, pa.int32()))

    return urls, rules


def _sweep(default: str):
    def longest(stack, path: str):
        """The fitting rule of greatest length; of equal ones that of the deeper host."""
        best, size = None, -1
        for _, host, lengths, paths in stack:
            for n in lengths:
                if len(host) + n >= size and n <= len(path) and (hit := paths.get(path[:n])):
                    best, size = hit, len(host) + n
        return best

    def run(batches):
        stack: list[tuple[str, str, set, dict]] = []
        piece = None
        for b in batches:
            columns = [b[n].to_pylist() for n in ("piece", "key", "is_url", "id", "host", "path", "verdict")]
            out = []
            for at, key, is_url, ident, host, path, verdict in zip(*columns, strict=True):
                if at != piece:
                    piece, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_url:
                    rule, said = longest(stack, path) or (None, default)
                    out.append((ident, host, path, rule, said))
                else:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, set(), {}))
                    _, _, lengths, paths = stack[-1]
                    lengths.add(len(path))
                    # rows are sorted by verdict, and a rule given twice keeps the first: allow before block
                    paths.setdefault(path, (host + path, verdict))
            names = ("id", "host", "path", "rule", "verdict")
            types = (pa.int64(), *[pa.string()] * 4)
            values = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    return run


def match_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """One row per url row: (id, host, path, rule, verdict).

    ``rules`` has (host, path, verdict).  A rule fits its host and all subdomains of
    it where the url's path starts with the rule's path; the longest rule text wins, and
    of equally long ones that of the deeper host.  A rule given with both verdicts
    allows.  Without a fitting rule: rule NULL, verdict ``default``.  NULL urls and urls
    without ``://`` have empty host and path and fit nothing.  NULL host or path in a rule
    counts as empty.  Repeated rows and NULL ids are kept; other columns are not read.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col(url_col))
    parsed = urls.select(F.col(id_col).cast("bigint").alias("id"), host.alias("host"), path.alias("path"))
    keyed = parsed.select("*", host_key(F.col("host")).alias("key"), F.xxhash64("id", "path").alias("salt"))
    on_urls, on_rules = _assign(_bounds(keyed, ranges))
    sides = "id bigint, host string, path string, key string, salt bigint, verdict string, is_url boolean"
    left = keyed.select("id", "host", "path", "key", "salt", F.lit("").alias("verdict"), F.lit(True).alias("is_url"))
    rule_host = fold(F.coalesce("host", F.lit("")))
    right = rules.select(
        F.lit(None).cast("bigint").alias("id"),
        rule_host.alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        host_key(rule_host).alias("key"),
        F.lit(0).cast("bigint").alias("salt"),
        F.col("verdict"),
        F.lit(False).alias("is_url"),
    )
    both = left.mapInArrow(on_urls, f"{sides}, piece int").unionByName(right.mapInArrow(on_rules, f"{sides}, piece int"))
    swept = both.drop("salt").repartition(ranges, "piece").sortWithinPartitions("piece", "key", "is_url", "verdict")
    return swept.mapInArrow(_sweep(default), MATCHED)
