"""Token counts with a digest cache.

Every text is named by the digest of its normalised content, every tokenizer by a digest of its
file and its library's version.  Stored counts are joined by both digests; only distinct texts
without a count are encoded, and their counts are appended to the cache.

* Nothing but digests moves for texts that the cache knows.  A text without a count moves once for
  each task that reads it (copies are merged before the exchange), so a text that a third of all
  rows repeat is encoded once and fills no partition.
* Counts go back to the rows by an exchange of digests.  Digests of very many rows, of which there
  can be ``HOT_DIGESTS`` at most, are broadcast instead.
* The cache is a folder of Parquet files below the tokenizer's digest.  Each append writes a folder
  of its own; readers take one count per digest, so jobs that append the same texts do no harm.

NULL texts count as empty ones.  Empty tables give empty results.  Repeated rows each keep their
row.  Only the id and the text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.session import discard, materialize, path_exists

OVER_LIMIT = 4096
#: Missing digests up to this many (32 bytes each) are broadcast; more are joined by an exchange.
BROADCAST_MISSES = 200_000
#: No more digests than this can have a share of the rows above 1 / HOT_DIGESTS.
HOT_DIGESTS = 10_000
HOT_ROWS = 20_000
#: Counts of words that a task remembers.
WORD_MEMO = 500_000
STORED = "digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer: the name and version of its library, and its file's bytes."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    h = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


# A blank between a character other than a blank and anything else.
_WORD_CUT = re.compile(r"(?<=[^ ▁]) (?=[\s\S])")


def _pieces_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a sentencepiece model.

    A model that prefixes a blank to every text, keeps all others, and has no token with a blank
    after another character never joins a word to the one before it.  Its count of a text is then
    the sum over the text's words, each with its blank, and a task counts a word once.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    by_words = model.normalize(" a  b ") == "▁▁a▁▁b▁" and not any("▁" in p.lstrip("▁") for p in pieces)
    if not by_words:
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            plain = "  " not in text and "▁" not in text and text[:1] != " " and text[-1:] != " "
            words = text.split(" ") if plain else _WORD_CUT.split(text)
            new = list({w for w in words if w not in memo})
            if len(memo) + len(new) > WORD_MEMO:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
            out.append(sum(map(memo.__getitem__, words)))
        return out

    return count


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts as the tokenizer's own library gives them.

    ``.model``: sentencepiece; ``.json``: tokenizers.  No begin, end or added special tokens, no
    truncation or padding; special strings inside texts are treated as the library does by default.
    """
    if path.endswith(".model"):
        return _pieces_counter(path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def content(text: Column) -> Column:
    """The normalised content that a digest stands for: NULL is the empty text.

    Nothing more may be folded: case, blanks and forms of characters all change counts.
    """
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens), one row per digest that the cache holds for a tokenizer; None if it holds nothing."""
    at = f"{cache}/{version}"
    if not path_exists(spark, at):
        return None
    stored = spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(at)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_counts(texts: DataFrame, cache: str, version: str, path: str) -> DataFrame:
    """Encode rows of (digest, text), append the counts to the cache, and return what was appended."""
    to = f"{cache}/{version}/{uuid.uuid4().hex}"

    def encode(digests, contents, count):
        return digests, count(contents)

    map_slices(texts.select("digest", "text"), encode, STORED, lambda: load_counter(path)).write.parquet(to)
    return texts.sparkSession.read.schema(STORED).parquet(to)


def count_tokens(docs: DataFrame, path: str, cache: str, over: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, ``over_limit`` where there are more than ``over`` tokens.

    ``cache`` is a folder that all executors share; counts it lacks are added.  ``path`` is the
    tokenizer's file, which executors find at the same place.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    source = docs.select(F.col(id_col).alias("id"), content(F.col(text_col)).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = materialize(source.select("id", digest, F.octet_length("text").cast("bigint").alias("n_bytes")), "text-digests")
    wanted = rows.groupBy("digest").agg(F.count("*").alias("rows"))
    known = read_cache(spark, cache, version)
    wanted = wanted.join(known, "digest", "left") if known is not None else wanted.withColumn("n_tokens", F.lit(None).cast("bigint"))
    wanted = materialize(wanted, "wanted-digests")
    missing = wanted.where("n_tokens is null").select("digest")
    total = wanted.agg(F.sum("rows").alias("rows"), F.count_if(F.col("n_tokens").isNull()).alias("missing")).first()

    counts = wanted.where("n_tokens is not null").select("digest", "n_tokens")
    if total.missing:
        texts = source.select(digest, "text")
        few = known is not None and total.missing <= BROADCAST_MISSES
        if few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        # equal digests have equal texts; the largest of equal texts is any of them
        texts = texts.groupBy("digest").agg(F.max("text").alias("text"))
        if known is not None and not few:
            texts = texts.join(missing, "digest", "left_semi")
        counts = counts.unionByName(append_counts(texts, cache, version, path))

    hot_rows = max(HOT_ROWS, (total.rows or 0) // HOT_DIGESTS)
    hot = F.broadcast(wanted.where(F.col("rows") > hot_rows).select("digest").join(counts, "digest"))
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(counts, "digest"))
    found = materialize(found.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")), "token-counts")
    discard(rows, wanted)
    return found
