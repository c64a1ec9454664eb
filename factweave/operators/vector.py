"""Cosine search and ranking over tables of vectors (array<double> columns)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions import columns as C


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 if one is empty or has no length."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def with_norm(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumn("norm", norm(F.col(vector)))


#: Queries per block: what a broadcast of queries can hold, whatever the number of queries.
QUERY_BLOCK = 20_000


def query_blocks(queries: DataFrame) -> int:
    """Parts in which a query set is sent out, so that no broadcast holds more than QUERY_BLOCK queries; counts them."""
    return max(1, -(-queries.count() // QUERY_BLOCK))


#: (query, row) cells of one matrix product: what a task holds at a time, whatever the sizes of both sides.
CELLS = 250_000
#: Pairs of which the products are summed at a time, and rows of a batch that a task hands on.
SUMMED, HANDED = 16_384, 20_000


class Vectors:
    """Vectors of an Arrow list column, read by their lengths. One that is null, empty, without length or not finite is ``flat``: its cosine with any other is 0."""

    def __init__(self, column: pa.Array):
        self.size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        self.start = column.offsets.to_numpy()[:-1].astype("int64")
        self.values = column.values.to_numpy(zero_copy_only=False).astype("float64")
        self.norm = np.zeros(len(column))
        for n in np.unique(self.size[self.size > 0]):
            rows = np.flatnonzero(self.size == n)
            m = self.of(rows)
            self.norm[rows] = np.sqrt(np.einsum("ij,ij->i", m, m))
        self.flat = ~(np.isfinite(self.norm) & (self.norm > 0))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Rows of one length as a matrix."""
        return self.values[self.start[rows][:, None] + np.arange(self.size[rows[0]] if len(rows) else 0)]


def _near(rows: Vectors, asked: Vectors, part: np.ndarray, threshold: float, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, cosine) of the pairs at or above the threshold, with ``among`` of these queries only. A matrix product finds them with a margin; the
    cosine of each found pair is then summed by itself, so that equal vectors have equal cosines wherever they stand."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    among = np.arange(len(asked.size)) if among is None else among
    if threshold <= 0:
        i, j = np.nonzero(rows.flat[part][:, None] | asked.flat[among][None, :])
        found.append((part[i], among[j], np.zeros(len(i))))
    for n in np.unique(rows.size[part][~rows.flat[part]]):
        own = part[(rows.size[part] == n) & ~rows.flat[part]]
        other = among[(asked.size[among] == n) & ~asked.flat[among]]
        if len(other):
            a, b = rows.of(own), asked.of(other)
            i, j = np.nonzero((a / rows.norm[own][:, None]) @ (b / asked.norm[other][:, None]).T >= threshold - 1e-9)
            sim = np.empty(len(i))
            for s in range(0, len(i), SUMMED):
                e = slice(s, s + SUMMED)
                sim[e] = np.einsum("ij,ij->i", a[i[e]], b[j[e]]) / (rows.norm[own[i[e]]] * asked.norm[other[j[e]]])
            keep = sim >= threshold
            found.append((own[i[keep]], other[j[keep]], sim[keep]))
    if not found:
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def rounding(width: int) -> float:
    """What a product of two unit vectors of single precision may differ by from their cosine, and more."""
    return (width + 8) * 1e-7


def near_any(rows: Vectors, asked: Vectors, part: np.ndarray, threshold: float, among: np.ndarray | None = None) -> np.ndarray:
    """For each of ``part`` whether its cosine with any query (any of ``among``) is at or above the threshold.

    Products of single precision settle it but for the rows of which the largest lies next to the threshold; their pairs are summed as ``_near`` sums them.
    """
    among = np.arange(len(asked.size)) if among is None else among
    hit = np.zeros(len(part), bool)
    if threshold <= 0 and len(among):
        hit = rows.flat[part] | asked.flat[among].any()
    for n in np.unique(rows.size[part][~rows.flat[part]]):
        at = np.flatnonzero((rows.size[part] == n) & ~rows.flat[part] & ~hit)
        other = among[(asked.size[among] == n) & ~asked.flat[among]]
        if not len(at) or not len(other):
            continue
        off, step = rounding(n), max(1, CELLS // len(other))
        b = (asked.of(other) / asked.norm[other][:, None]).astype("float32").T
        for s in range(0, len(at), step):
            e = at[s:s + step]
            own = part[e]
            most = ((rows.of(own) / rows.norm[own][:, None]).astype("float32") @ b).max(axis=1)
            hit[e] = most >= threshold + off
            close = own[(most >= threshold - off) & ~hit[e]]
            for x in range(0, len(close), step):
                hit[e] |= np.isin(own, _near(rows, asked, close[x:x + step], threshold, other)[0])
    return hit


class _Best:
    """Of the pairs that a task finds those that can be among the best ``k`` of their query by round(weight * sim + rest, digits), ties by the smaller key.

    The score itself is made later, as a column. Here a pair has the lowest and the highest value that it may be rounded to, which differ only next to a half; a pair
    goes if k others of its query come before it in any case. Without ``digits`` the score is sim.
    """

    def __init__(self, k: int, weight: float, digits: int | None, queries: int):
        self.k, self.weight, self.digits = k, weight, digits
        self.least = np.full(queries, -np.inf)  # of the k-th pair of each query so far
        self.held: list[pa.Table] = []

    def bounds(self, sim: np.ndarray, rest: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        if self.digits is None:
            return sim, sim
        score = self.weight * sim + rest.to_numpy(zero_copy_only=False).astype("float64")
        score[np.isnan(score)] = np.inf  # comes first
        score[rest.is_null().to_numpy(zero_copy_only=False)] = -np.inf  # comes last
        x = score * 10.0**self.digits + 0.5
        off = np.where(np.isfinite(x), np.maximum(1e-6, np.abs(x) * 1e-12), 0.0)
        return np.floor(x - off), np.floor(x + off)

    def add(self, rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray, sim: np.ndarray, rest: pa.Array | None) -> None:
        low, high = self.bounds(sim, None if rest is None else rest.take(pa.array(i)))
        good = np.flatnonzero(high >= self.least[j])
        if len(good):
            at = pa.array(i[good])
            self.held.append(pa.table([*[c.take(at) for c in rows.columns], pa.array(sim[good]), pa.array(j[good]), pa.array(low[good]), pa.array(high[good])], names=[*rows.schema.names, "sim", "_q", "_low", "_high"]))
            if sum(t.num_rows for t in self.held) > 2 * self.k * len(self.least) + CELLS:
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        found = pa.concat_tables(self.held)
        found = found.take(pc.sort_indices(found, [("_q", "ascending"), ("_low", "descending"), ("key", "ascending")], null_placement="at_start"))
        q, low, high = (found.column(c).to_numpy() for c in ("_q", "_low", "_high"))
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[first, len(q)])
        place = np.arange(len(q)) - np.repeat(first, size)
        full = size >= self.k
        self.least[q[first[full]]] = low[first[full] + self.k - 1]
        self.held = [found.filter(pa.array((place < self.k) | ((low < high) & (high >= self.least[q])))).combine_chunks()]
        return self.held[0]


def similar_pairs(queries: DataFrame, corpus: DataFrame, threshold: float, blocks: int | None = None, k: int | None = None, weight: float = 1.0, rest: Column | None = None, digits: int = 4, apart: bool = False) -> DataFrame:
    """Every (query, corpus row) with cosine >= threshold, as the corpus columns without the vector, query_id and sim.

    queries: query_id, vector; corpus: key, vector and more. A stated query set is held against the whole corpus: the queries
    are sent to all tasks in ``blocks`` parts (as many as ``query_blocks`` says, if not given), the corpus is never shuffled; a task multiplies
    slices of its rows with them. Vectors of different lengths aren't compared; one that is null, empty, without length or
    not finite has cosine 0 with all others. With ``k`` a task hands on only those that can be among the best k rows of a query by sim, or, with ``rest``
    (of the corpus row), by round(weight * sim + rest, digits), ties by key. With ``apart`` a row isn't paired with the query of its key.
    """
    spark, blocks = corpus.sparkSession, blocks or query_blocks(queries)
    corpus = corpus.withColumn("vector", F.col("vector").cast("array<double>"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([f for f in corpus.schema if f.name != "vector"] + [asked.schema["query_id"], T.StructField("sim", T.DoubleType())])
    if rest is not None:
        corpus = corpus.withColumn("_rest", rest.cast("double"))
    ranked = (weight, None if rest is None else digits)
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(own.toArrow().combine_chunks())

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            if not table.num_rows:
                return
            ids, theirs = table.column("query_id").chunk(0), Vectors(table.column("vector").chunk(0))
            step = max(1, CELLS // table.num_rows)
            best = _Best(k, *ranked, table.num_rows) if k else None
            for batch in batches:
                rows = Vectors(batch.column(batch.schema.get_field_index("vector")))
                kept = batch.drop_columns([n for n in ("vector", "_rest") if n in batch.schema.names])
                own = batch.column("_rest") if "_rest" in batch.schema.names else None
                for s in range(0, batch.num_rows, step):
                    i, j, sim = _near(rows, theirs, np.arange(s, min(s + step, batch.num_rows)), threshold)
                    if apart and len(i):
                        other = pc.fill_null(pc.not_equal(kept.column("key").take(pa.array(i)), ids.take(pa.array(j))), False).to_numpy(zero_copy_only=False)
                        i, j, sim = i[other], j[other], sim[other]
                    if best is not None:
                        best.add(kept, i, j, sim, own)
                        continue
                    for e in (slice(x, x + HANDED) for x in range(0, len(i), HANDED)):
                        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(i[e])) for c in kept.columns], ids.take(pa.array(j[e])), pa.array(sim[e])], names=[*kept.schema.names, "query_id", "sim"])
            if best is not None and (found := best.cut()) is not None:
                for part in found.to_batches(max_chunksize=HANDED):
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in schema.names[:-2]], ids.take(part.column("_q")), part.column("sim")], names=schema.names)

        part = corpus.mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return out


def top_k(df: DataFrame, k: int, score: str, by: str = "query_id", tie: str = "key") -> DataFrame:
    """Best k rows per query with ``rank``; ties by key, so the order is total."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, now: Column, threshold: float = 0.35, k: int = 10, blocks: int | None = None) -> DataFrame:
    """Similar rows ranked by a composite of similarity, importance, use, lifecycle and confidence, rounded before ranking."""
    days = C.age_days(F.col("last_accessed"), now)
    rest = (0.15 * F.col("importance") / 5 + 0.10 * C.reinforcement(F.col("access_count"))
            + 0.10 * C.item_lifecycle_score(F.col("importance"), days, F.col("access_count")) + 0.10 * F.col("confidence"))
    found = similar_pairs(queries, corpus, threshold, blocks, k, 0.55, rest)
    score = (0.55 * F.col("sim") + 0.15 * F.col("importance") / 5 + 0.10 * C.reinforcement(F.col("access_count"))
             + 0.10 * C.item_lifecycle_score(F.col("importance"), days, F.col("access_count")) + 0.10 * F.col("confidence"))
    return top_k(found.withColumn("score", F.round(score, 4)), k, "score")


def recall(queries: DataFrame, corpus: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """What ``search`` finds from a similarity of .2 on, at most ten rows a query, as a reader wants it.

    k is brought into 1 to 10. corpus also has memory, type and valid_from. Gives query_id, memory, type, importance, similarity, valid_from, rank.
    """
    found = search(queries, corpus, now, 0.2, min(10, max(1, k)))
    return found.select("query_id", "key", F.round("sim", 4).alias("similarity"), "rank").join(corpus.select("key", "memory", "type", "importance", "valid_from"), "key").select("query_id", "memory", "type", "importance", "similarity", "valid_from", "rank")


def decision_candidates(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The three nearest facts with a cosine of .75 or more for each new one: what a decision on conflicts looks at."""
    return top_k(similar_pairs(queries, corpus, 0.75, k=3), 3, "sim")


def with_vectors(df: DataFrame, text: str, provider: Callable[[list[str]], np.ndarray], vector: str = "vector") -> DataFrame:
    """``vector`` of each text by a provider that takes a list of texts and gives one row of numbers for each; null texts have a null vector.

    The provider is sent to the tasks and called once for each Arrow batch.
    """
    def embed(texts: pd.Series) -> pd.Series:
        known, out = texts.dropna(), pd.Series([None] * len(texts), index=texts.index, dtype="object")
        if len(known):
            out.loc[known.index] = pd.Series(list(np.asarray(provider(known.tolist()), dtype="float64")), index=known.index)
        return out

    return df.withColumn(vector, F.pandas_udf(embed, "array<double>")(F.col(text)))


def rank_blend(queries: DataFrame, corpus: DataFrame, now: Column, threshold: float = 0.0, k: int = 10) -> DataFrame:
    """Blend of similarity, importance, confidence, lifecycle, use and exponential recency."""
    days = C.age_days(F.col("last_accessed"), now)
    band = C.item_lifecycle(F.col("importance"), days)
    life = F.when(band == "active", 1.0).when(band == "aging", 0.7).when(band == "decaying", 0.4).otherwise(0.2)
    score = (0.35 * F.col("sim") + 0.20 * F.col("importance") / 5 + 0.15 * F.col("confidence") + 0.10 * life
             + 0.10 * C.ratio_cap(F.col("access_count"), 20.0) + 0.10 * C.exp_recency(days))
    rest = (0.20 * F.col("importance") / 5 + 0.15 * F.col("confidence") + 0.10 * life
            + 0.10 * C.ratio_cap(F.col("access_count"), 20.0) + 0.10 * C.exp_recency(days))
    return top_k(similar_pairs(queries, corpus, threshold, k=k, weight=0.35, rest=rest).withColumn("score", F.round(score, 4)), k, "score")


def recover(queries: DataFrame, active: DataFrame, archive: DataFrame, now: Column) -> DataFrame:
    """Archived row to restore for each query whose best active similarity is under .70."""
    blocks = query_blocks(queries)
    best = similar_pairs(queries, active, -1.0, blocks, k=1).groupBy("query_id").agg(F.max("sim").alias("best"))
    poor = queries.join(best, "query_id", "left").where(F.coalesce("best", F.lit(0.0)) < 0.70).select("query_id", "vector")
    days = C.age_days(F.col("last_accessed"), now)
    score = 0.60 * F.col("sim") + 0.25 * F.col("importance") / 5 + 0.15 * C.reinforcement(F.col("access_count")) - F.least(F.lit(0.2), days / 3650)
    rest = 0.25 * F.col("importance") / 5 + 0.15 * C.reinforcement(F.col("access_count")) - F.least(F.lit(0.2), days / 3650)
    return top_k(similar_pairs(poor, archive, 0.55, blocks, 1, 0.60, rest).withColumn("score", F.round(score, 4)).where(F.col("score") >= 0.62), 1, "score")


def lexical_relevance(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = C.word_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, C.word_set(text))) / F.size(q)).otherwise(0.0)


def budget_rank(query: Column, text: Column, importance: Column) -> Column:
    return F.round(0.7 * lexical_relevance(query, text) + 0.3 * importance / 5, 4)
