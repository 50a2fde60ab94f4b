"""Language identification with a convolutional network over bytes.

Texts are lower-cased, encoded and cut into windows of ``WINDOW`` bytes.  Filters of several
widths slide over the embedded bytes of a window, the maximum of each filter is
kept, and a softmax layer turns the maxima into language probabilities; a text gets the mean over
all its windows.  The network is trained with numpy on a bounded sample of labelled texts, in
one task.  To apply it, embedding and filters are multiplied out into one table per byte
offset, so a filter response is a sum of table rows.  Nothing is shuffled but the sample.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.session import materialize

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Labelled texts per language that the network is fitted on at most, and in all, if that leaves one per language.
SAMPLE_ROWS = 600
TOTAL_ROWS = 60_000
EPOCHS = 5
#: Windows that are worked on at a time.
CHUNK = 256
UNKNOWN = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers such as the half sign, superscripts or Roman numerals are none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def windows_of(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes; the last window is filled up with spaces."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


class Network:
    """Byte embedding, filters of several widths, max over positions, softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(x))
        e = self.embedding[x]
        pooled, at = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            span = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            response = span @ f
            best = response.argmax(axis=1)
            at.append(best)
            pooled.append(np.take_along_axis(response, best[:, None, :], 1)[:, 0] + b)
        h = np.concatenate(pooled, axis=1)
        active = np.maximum(h, 0)
        p = softmax(active @ self.out + self.out_bias)
        p[rows, y] -= 1
        d = p * weight[:, None] / len(x)
        g_out, g_out_bias = active.T @ d, d.sum(0)
        d_h = (d @ self.out.T) * (h > 0)
        g_embedding = np.zeros_like(self.embedding)
        g_filters, g_bias = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = d_h[:, k * FILTERS : (k + 1) * FILTERS]
            position = at[k][:, :, None] + np.arange(w)
            taken = x[rows[:, None, None], position]
            spans = self.embedding[taken].reshape(len(x), FILTERS, w * EMBEDDING)
            g_filters.append(np.einsum("bf,bfk->kf", part, spans))
            g_bias.append(part.sum(0))
            back = (part[:, :, None] * f.T[None]).reshape(-1, EMBEDDING)
            np.add.at(g_embedding, taken.reshape(-1), back)
        return [g_embedding, *g_filters, *g_bias, g_out, g_out_bias]

    def tables(self) -> np.ndarray:
        """(offset, byte, filter of any width): what a byte at an offset adds to each response."""
        out = np.zeros((max(WIDTHS), 256, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            for j in range(w):
                out[j, :, k * FILTERS : (k + 1) * FILTERS] = self.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING]
        return out

    def probabilities(self, x: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(windows, languages).  A filter sees the positions that all its bytes fit into."""
        parts = []
        width = max(WIDTHS)
        for start in range(0, len(x), CHUNK):
            b = x[start : start + CHUNK]
            n = WINDOW - width + 1
            total = tables[0][b[:, :n]]
            for j in range(1, width):
                total += tables[j][b[:, j : n + j]]
            best = total.max(axis=1)
            for k, w in enumerate(WIDTHS):  # the last places, where only the narrower filters fit
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for p in range(n, WINDOW - w + 1):
                    best[:, own] = np.maximum(best[:, own], sum(tables[j][b[:, p + j], own] for j in range(w)))
            h = np.maximum(best + np.concatenate(self.bias), 0)
            parts.append(softmax(h @ self.out + self.out_bias))
        return np.concatenate(parts)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on random windows, two of each text in an epoch; every language has the same weight."""
    languages = sorted(set(labels))
    net = Network(languages)
    rng = np.random.default_rng(11)
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    cut = [windows_of(t) for t in texts]
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(len(cut)) for _ in range(2)])
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x = np.stack([cut[i][rng.integers(len(cut[i]))] for i in rows])
            step += 1
            for k, (p, g) in enumerate(zip(net.parameters(), net.gradients(x, y[rows], weight[rows]), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from at most ``sample_rows`` texts per language; None if no row has both text and language.

    Every language is learned.  Distinct texts are chosen, those of the smallest hashes in each language, so that a
    repeated text counts once.  A first cut by hash, at a rate that the number of distinct texts sets, keeps all others
    from moving.
    """
    import pickle

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h")
    )
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    per = max(1, min(sample_rows, TOTAL_ROWS // max(1, counts.count())))
    # twice the rate that would do, as counts are rough and hashes uneven
    million = 1_000_000
    rates = counts.select("lang", F.ceil(F.lit(2.0 * million * per) / F.col("n") + 20).alias("rate"))
    some = rows.join(rates, "lang").where(F.pmod("h", F.lit(million)) < F.col("rate"))
    distinct = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = distinct.withColumn("nth", nth).where(F.col("nth") <= per).select("text", "lang")

    def run(batches):
        import pyarrow as pa

        found = sorted((r["text"], r["lang"]) for b in batches for r in b.to_pylist())
        if found:
            net = fit([t for t, _ in found], [v for _, v in found])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    fitted = chosen.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(bytes(fitted[0]["net"])) if fitted else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, lang_pred, score).

    The score is the mean probability of the predicted language over all windows.  A text that is
    NULL or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
    Repeated rows are judged one by one; other columns are not read.
    """

    def work(idents, texts, tables):
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
        waiting, rows = [], 0
        for n, i in enumerate(asked):
            waiting.append((i, windows_of(texts[i])))
            rows += len(waiting[-1][1])
            if rows < CHUNK and n + 1 < len(asked):
                continue
            p = net.probabilities(np.concatenate([w for _, w in waiting]), tables)
            at = 0
            for k, w in waiting:
                mean = p[at : at + len(w)].mean(axis=0)
                at += len(w)
                best = int(mean.argmax())
                langs[k], scores[k] = net.languages[best], float(min(1.0, mean[best]))
            waiting, rows = [], 0
        return idents, langs, scores

    setup = net.tables if net else dict
    return map_slices(docs.select(F.col(id_col).cast("bigint"), text_col), work, "id bigint, lang_pred string, score double", setup)
