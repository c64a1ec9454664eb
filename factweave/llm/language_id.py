"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter is max-pooled over a
window and a softmax layer rates the languages. A filter over one-hot bytes is a table of 256 numbers per
place, so a convolution is a sum of table rows. The network is trained in numpy on labelled text and
applied to all windows of every whole text (training looks at ``TRAIN_DOCS`` texts a language, of each at its first 6,144
characters and there at ``TRAIN_WINDOWS`` windows at most: that is the bound of the labelled sample); a text's probabilities are the means over its windows,
weighted by their letters-bearing bytes.

Defined cases: null text and text without letters are ``und`` with score 0; without labelled text every
document is ``und``; a short text is one window padded with zero bytes; ties go to the first language in
alphabetical order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import pick, table

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: documents per language, windows per document, passes.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, SEED = 500, 6, 6, 7
#: Steps in which a share of the texts is measured.
SHARES = 1 << 40
UNKNOWN = "und"


@dataclass
class Model:
    """tables[w][place] is (256, filters); dense is (widths * filters, languages)."""

    langs: list[str]
    tables: list[list[np.ndarray]]
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes -> (windows, widths * filters) after max pooling and ReLU."""
        out = []
        for places in self.tables:
            width = len(places)
            n = x.shape[1] - width + 1
            conv = places[0][x[:, :n]]
            for k in range(1, width):
                conv += places[k][x[:, k : k + n]]
            out.append(conv.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.dense + self.last
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW, the last padded with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam on windows of the texts, some of them cut short so that short texts are known too."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in zip(texts, labels):
        rows = windows_of(text.encode())
        rows = rows[rng.permutation(len(rows))[:TRAIN_WINDOWS]].copy()
        for row in rows:
            if rng.random() < 0.4:
                row[int(rng.integers(12, WINDOW)) :] = 0
        xs.append(rows)
        ys += [langs.index(label)] * len(rows)
    x, y = np.concatenate(xs), np.array(ys)
    model = Model(
        langs, [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [t for places in model.tables for t in places] + [model.bias, model.dense, model.last]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            own = order[at : at + 64]
            grads = _gradients(model, x[own], y[own])
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return model


def _gradients(model: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(x)
    best, tops = [], []
    for places in model.tables:
        length = x.shape[1] - len(places) + 1
        conv = places[0][x[:, :length]]
        for k in range(1, len(places)):
            conv += places[k][x[:, k : k + length]]
        top = conv.argmax(axis=1)
        tops.append(top)
        best.append(np.take_along_axis(conv, top[:, None, :], 1)[:, 0])
    raw = np.concatenate(best, axis=1) + model.bias
    hidden = np.maximum(raw, 0)
    z = hidden @ model.dense + model.last
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ model.dense.T) * (raw > 0)
    out: list[np.ndarray] = []
    column = np.tile(np.arange(FILTERS), n)
    for w, places in enumerate(model.tables):
        g = back[:, w * FILTERS : (w + 1) * FILTERS].ravel()
        for k in range(len(places)):
            at = np.take_along_axis(x, tops[w] + k, 1).ravel()
            grad = np.zeros((256, FILTERS), np.float32)
            np.add.at(grad, (at, column), g)
            out.append(grad)
    return [*out, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_candidates(docs: DataFrame, per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, h, text: distinct usable texts, thinned to about three times ``per_lang`` a language by that language's own number of distinct texts.

    The texts are cut to what training looks at. A language of up to that many texts keeps them all, one of any size leaves as few rows.
    """
    usable = pick(docs, id_col, text_col, lang_col).where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    hashed = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(text_col, 1, 4 * WINDOW * TRAIN_WINDOWS).alias("text"))
    share = F.least(F.lit(SHARES), (F.lit(float(SHARES)) * 3 * per_lang / F.greatest(F.col("n"), F.lit(1))).cast("long"))
    shares = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select("lang", share.alias("share"))
    small = hashed.join(F.broadcast(shares), "lang").where(F.pmod(F.col("h"), F.lit(SHARES)) < F.col("share"))  # a row per language
    return small.groupBy("lang", "h").agg(F.min("text").alias("text"))


def training_sample(docs: DataFrame, per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``per_lang`` different labelled texts a language, the first of the candidates in the order of a hash of their text.

    Each task hands on its own first ones only.
    """
    first = Window.partitionBy("lang").orderBy("h")
    kept = training_candidates(docs, per_lang, id_col, text_col, lang_col).withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_lang)
    rows = kept.orderBy("lang", "at").collect()  # bounded by per_lang texts a language
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each document."""
    rows = pick(docs, id_col, text_col).select(id_col, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary")).alias("data"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double"
    if model is None:
        return rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = _Fast(model)
        for batch in batches:
            column = batch.column("data")
            langs, scores = [], []
            for at in range(0, len(batch), 64):
                for p in fast.documents(column.slice(at, 64).to_pylist()):
                    best = -1 if p is None else int(p.argmax())
                    langs.append(UNKNOWN if p is None else model.langs[best])
                    scores.append(0.0 if p is None else min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


class _Fast:
    """The same network with neighbouring places looked up together: one table of 65,536 rows for two bytes."""

    STEP = 256

    def __init__(self, model: Model):
        self.model = model
        self.tables = [[(p[k][:, None, :] + p[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(p) - 1, 2)] for p in model.tables]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.int64) << 8) | x[:, 1:]
        out = []
        for places, doubles in zip(self.model.tables, self.tables):
            n = x.shape[1] - len(places) + 1
            conv = np.take(doubles[0], pairs[:, :n], axis=0)
            for k in range(1, len(doubles)):
                conv += np.take(doubles[k], pairs[:, 2 * k : 2 * k + n], axis=0)
            if len(places) % 2:
                conv += np.take(places[-1], x[:, len(places) - 1 : len(places) - 1 + n], axis=0)
            out.append(conv.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.model.bias, 0)

    def documents(self, data: list[bytes | None]) -> list[np.ndarray | None]:
        blocks = [windows_of(d) for d in data if d]
        if not blocks:
            return [None] * len(data)
        x = np.concatenate(blocks)
        p = np.empty((len(x), len(self.model.langs)))
        for at in range(0, len(x), self.STEP):
            z = self.pooled(x[at : at + self.STEP]) @ self.model.dense + self.model.last
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p[at : at + self.STEP] = z / z.sum(axis=1, keepdims=True)
        weight = np.maximum((x >= 65).sum(axis=1), 1e-9)
        ends = np.cumsum([len(b) for b in blocks])
        sums = np.add.reduceat(p * weight[:, None], ends - [len(b) for b in blocks], axis=0)
        means = iter(sums / sums.sum(axis=1, keepdims=True))
        return [next(means) if d else None for d in data]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score: train on the labelled part, predict everything."""
    texts, labels = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = train(texts, labels) if texts else None
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` whose language is known with a score of ``least`` or more; the texts pass through the network's tasks once."""
    texts, labels = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not texts:
        return docs.limit(0)
    model = train(texts, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = _Fast(model)
        for batch in batches:
            column = batch.column("_fw_data")
            good = [p is not None and p.max() >= least for at in range(0, len(batch), 64) for p in fast.documents(column.slice(at, 64).to_pylist())]
            yield batch.drop_columns(["_fw_data"]).filter(pa.array(good, pa.bool_()))

    with_data = docs.withColumn("_fw_data", F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary")))
    return with_data.mapInArrow(run, docs.schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_language_id": _query}
ORACLE: dict[str, str] = {}
