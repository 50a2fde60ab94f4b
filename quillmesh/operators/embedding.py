"""Embedding adapters: any text -> vector callable, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]

# Text column -> vector column of a chunk.
CHUNK_TEXTS = {"content_text": "content_vec", "summary_text": "summary_vec", "title_text": "title_vec"}


def embed_columns(
    df: DataFrame,
    embedder: Embedder,
    columns: Mapping[str, str],
    *,
    continue_on_error: bool = False,
    max_texts: int = 256,
) -> DataFrame:
    """Add one vector column per text column, and ``error`` (NULL when all worked).

    ``embedder`` maps a list of at most ``max_texts`` texts to their vectors.
    Rows stay where they are: no shuffle.  Texts that repeat within an Arrow
    batch are embedded once, which catches the titles that the chunks of one
    file share.  With ``continue_on_error`` a failing call is retried text by
    text and each failure is reported in its row; otherwise the job fails.
    """
    texts_in, vectors_out = list(columns), list(columns.values())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            per_column = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in texts_in]
            distinct = list(dict.fromkeys(t for texts in per_column for t in texts if t is not None))
            vectors, errors = {}, {}
            for start in range(0, len(distinct), max_texts):
                part = distinct[start : start + max_texts]
                try:
                    vectors.update(zip(part, embedder(part), strict=True))
                except Exception:
                    if not continue_on_error:
                        raise
                    for text in part:
                        try:
                            vectors[text] = embedder([text])[0]
                        except Exception as e:  # noqa: BLE001 - reported per row
                            errors[text] = str(e) or type(e).__name__
            added = [
                pa.array([vectors.get(t) if t is not None else None for t in texts], pa.list_(pa.float32()))
                for texts in per_column
            ]
            failed = [next((errors[t] for t in row if t in errors), None) for row in zip(*per_column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added, pa.array(failed, pa.string())],
                names=[*batch.schema.names, *vectors_out, "error"],
            )

    schema = T.StructType(
        [
            *df.schema.fields,
            *[T.StructField(v, T.ArrayType(T.FloatType())) for v in vectors_out],
            T.StructField("error", T.StringType()),
        ]
    )
    return df.mapInArrow(run, schema)


def embed_texts(df: DataFrame, embedder: Embedder, *, text_col: str = "text", **options) -> DataFrame:
    """Add ``vec`` and ``error`` for one text column."""
    return embed_columns(df, embedder, {text_col: "vec"}, **options)


def split_results(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all vectors, and rows with an error."""
    return (
        embedded.filter(F.col("error").isNull()).drop("error"),
        embedded.filter(F.col("error").isNotNull()),
    )


def check_dimension(vectors: DataFrame, vec_col: str, expected: int) -> DataFrame:
    """Rows whose vector has another size than the model's."""
    return vectors.filter(F.size(vec_col) != expected)
