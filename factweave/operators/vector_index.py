"""Inverted-file index for cosine search: rows lie in lists around centroids, a query reads the lists nearest to it.

The centroids are fitted on a bounded sample, every row is put into the list of its nearest one. A search compares a query with all rows of the lists it
reads, so what it finds has its exact cosine; what it may miss are rows of other lists. ``exact`` reads those too which could, by the angle of
the query to their centroid and their radius, hold a row better than the k-th found. Queries and rows are packed by list into blocks of
bounded size, and a block of queries meets the blocks of rows that hold one of its lists: vectors are shuffled once however many lists a query reads,
and neither a list with a third of all rows nor one that all queries read meets in one task. A task hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.joins import large
from factweave.operators.vector import CELLS, HANDED, SUMMED, Vectors, _Best, rounding, top_k
from factweave.sources import shared

#: Rows the centroids are fitted on, at most: those with the smallest hashes of their keys.
SAMPLE = 50_000
#: Rows of a block and queries of one, at most; numbers in the vectors of a block, at most; blocks of rows that a task holds.
ROWS, QUERIES, NUMBERS, HELD = 10_000, 5_000, 640_000, 10
SLACK = 1e-6
#: A table as bytes, and the lists that its rows are in or that its queries read.
BLOCK = T.StructType([T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("block", T.BinaryType())])


@dataclass
class VectorIndex:
    """rows: the corpus with ``list`` and ``angle`` (to the centroid); centroids: unit vectors, one for each list."""

    rows: DataFrame
    centroids: np.ndarray

    def append(self, corpus: DataFrame) -> VectorIndex:
        """The index with more rows, put into the lists there are."""
        return VectorIndex(self.rows.unionByName(assign(corpus, self.centroids)), self.centroids)

    def save(self, path: str) -> None:
        """Rows stand together by list, so that a read of some lists skips the row groups of others."""
        self.rows.repartition("list").sortWithinPartitions("list").write.mode("error").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> VectorIndex:
    kept = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array(kept["centroid"].tolist(), float))


def _unit(rows: Vectors, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that have a direction and the given width (or the most common one)."""
    good = ~rows.flat
    if width is None:
        width = int(np.bincount(rows.size[good]).argmax()) if good.any() else 0
    place = np.flatnonzero(good & (rows.size == width))
    return place, (rows.of(place) / rows.norm[place][:, None]) if len(place) else np.zeros((0, width))


def fit(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on at most ``sample`` rows; ``lists`` is the root of their number if not given."""
    taken = corpus.select("key", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("key"), "key").limit(sample).toArrow().combine_chunks()
    column = taken.column("vector")
    unit = _unit(Vectors(column.chunk(0)))[1] if column.num_chunks else np.zeros((0, 0))
    unit = np.unique(unit, axis=0)
    if not len(unit):
        return np.zeros((0, 0))
    lists = min(len(unit), lists or max(1, int(len(unit) ** 0.5)))
    rng = np.random.default_rng(1)
    centres = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(unit[s:s + 4096] @ centres.T).argmax(1) for s in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def assign(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``corpus`` with ``list`` and ``angle``; list is -1 for rows without a direction or of another width, which no search finds."""
    sent = corpus.sparkSession.sparkContext.broadcast(centroids)
    corpus = corpus.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = T.StructType([*corpus.schema, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            place, unit = _unit(Vectors(batch.column(batch.schema.get_field_index("vector"))), centres.shape[1])
            lists, angles = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            step = max(1, CELLS // max(1, len(centres)))
            for s in range(0, len(place) if len(centres) else 0, step):
                dots = unit[s:s + step] @ centres.T
                lists[place[s:s + step]] = dots.argmax(1)
                angles[place[s:s + step]] = np.arccos(np.clip(dots.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(angles)], names=[*batch.schema.names, "list", "angle"])

    return corpus.mapInArrow(put, schema)


def build(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """corpus: key, vector and more columns."""
    centroids = fit(corpus, lists, sample)
    return VectorIndex(assign(corpus, centroids), centroids)


def _reads(unit: np.ndarray, centres: np.ndarray, probes: int, reach: np.ndarray | None, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each query and list whether it is read, and the place that the list has for the query: the nearest ``probes``, or with ``reach`` the others that could hold a better row than ``least``."""
    angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
    rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
    read = rank < probes
    if reach is not None:
        read = ~read & (np.cos(np.maximum(0, angle - reach[None, :])) >= least[:, None] - SLACK)
    return read, rank


def _probe(queries: DataFrame, index: VectorIndex, probes: int, radius: np.ndarray | None) -> DataFrame:
    """(query_id, vector, list, place): the lists that each query reads, with a copy of the query for each; for few queries."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, radius))
    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach = sent.value
        for batch in batches if len(centres) else ():
            vectors = batch.column(batch.schema.get_field_index("vector"))
            place, unit = _unit(Vectors(vectors), centres.shape[1])
            step = max(1, CELLS // len(centres))
            for s in range(0, len(place), step):
                rows = place[s:s + step]
                least = None if reach is None else batch.column(batch.schema.get_field_index("least")).to_numpy()[rows]
                read, rank = _reads(unit[s:s + step], centres, probes, reach, least)
                i, j = np.nonzero(read)
                for e in (slice(x, x + HANDED) for x in range(0, len(i), HANDED)):  # a query that reads all lists is copied as often
                    at = pa.array(rows[i[e]])
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("query_id")).take(at), vectors.take(at), pa.array(j[e].astype(np.int32)), pa.array(rank[i[e], j[e]].astype(np.int32))], names=["query_id", "vector", "list", "place"])

    return queries.mapInArrow(pick, schema)


def _block(table: pa.Table, lists: np.ndarray) -> pa.RecordBatch:
    """A block of a table; its vectors take half the bytes if single precision holds them exactly."""
    table, out = table.combine_chunks(), pa.BufferOutputStream()
    values = table.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False)
    if (values.astype("float32") == values).all():
        at = table.schema.get_field_index("vector")
        table = table.set_column(at, "vector", table.column(at).cast(pa.list_(pa.float32())))
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([lists.tolist()], pa.list_(pa.int32())), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=BLOCK.names)


def _table(block: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _parted(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` in about ``parts`` parts of neighbouring lists; a list of very many rows lies in several."""
    return df.orderBy("list", F.xxhash64(key)).coalesce(parts)


def _held(rows: DataFrame, k: int, width: int, parts: int) -> DataFrame:
    """Blocks of rows (key, vector, list). Of equal vectors of a list the k smallest keys of a block are enough: the others come after them for any query."""
    size = max(1, min(ROWS, NUMBERS // max(1, width)))

    def thinned(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("key", "ascending")]).combine_chunks()
        vectors = Vectors(table.column("vector").chunk(0))
        same = np.ascontiguousarray(np.c_[vectors.of(np.arange(table.num_rows)), table.column("list").to_numpy()])
        same = np.unique(same.view(f"V{same.shape[1] * 8}").ravel(), return_inverse=True)[1]
        return table.filter(pa.array(pd.Series(same).groupby(same).cumcount().to_numpy() < k))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            left = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if left.num_rows >= size:
                left = thinned(left)
                while left.num_rows >= size:
                    yield _block(left.slice(0, size), np.unique(left.column("list").slice(0, size).to_numpy()))
                    left = left.slice(size)
        if left is not None and left.num_rows:
            left = thinned(left)
            yield _block(left, np.unique(left.column("list").to_numpy()))

    return _parted(rows.select("key", "vector", "list"), "key", parts).mapInArrow(pack, BLOCK).repartition(parts)


def _asked(queries: DataFrame, index: VectorIndex, probes: int, radius: np.ndarray | None, parts: int) -> DataFrame:
    """Blocks of queries (query_id, vector and the nearest list; with ``radius`` least), each with the lists that it reads."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, radius))
    size = max(1, min(QUERIES, NUMBERS // max(1, index.centroids.shape[1])))
    names = ["query_id", "vector"] + ["least"] * (radius is not None)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach = sent.value
        left, step, width = None, max(1, CELLS // max(1, len(centres))), -(-len(centres) // 8)

        def block(table: pa.Table) -> pa.RecordBatch:
            any_of = np.bitwise_or.reduce(table.column("reads").combine_chunks().flatten().to_numpy().reshape(-1, width), axis=0)
            return _block(table, np.flatnonzero(np.unpackbits(any_of)))

        for batch in batches:
            unit = _unit(Vectors(batch.column(batch.schema.get_field_index("vector"))), centres.shape[1])[1]
            least = None if reach is None else batch.column(batch.schema.get_field_index("least")).to_numpy()
            read = np.concatenate([_reads(unit[s:s + step], centres, probes, reach, None if least is None else least[s:s + step])[0] for s in range(0, len(unit), step)] or [np.zeros((0, len(centres)), bool)])
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(read, axis=1).ravel()), width)
            some = pa.table([*[batch.column(batch.schema.get_field_index(n)) for n in names], bits], names=[*names, "reads"]).filter(pa.array(read.any(axis=1)))
            left = some if left is None else pa.concat_tables([left, some])
            while left.num_rows >= size:
                yield block(left.slice(0, size))
                left = left.slice(size)
        if left is not None and left.num_rows:
            yield block(left)

    return _parted(queries, "query_id", parts).mapInArrow(pack, BLOCK).repartition(parts)


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true cells, read by eight."""
    mask = mask.ravel()
    whole = len(mask) // 8 * 8
    some = np.flatnonzero(mask[:whole].view("u8"))
    i, j = np.nonzero(mask[:whole].reshape(-1, 8)[some])
    return np.r_[some[i] * 8 + j, whole + np.flatnonzero(mask[whole:])]


class _Search:
    """A block of queries and the best k of the rows that it has met."""

    def __init__(self, block: pa.Buffer, k: int, threshold: float):
        table = _table(block)
        self.block, self.ids, n = block, table.column("query_id"), table.num_rows
        vectors = Vectors(table.column("vector"))
        self.all, self.norm = vectors.of(np.arange(n)), vectors.norm
        self.unit, self.off = (self.all / self.norm[:, None]).astype("float32"), rounding(self.all.shape[1])
        self.reads = np.unpackbits(table.column("reads").flatten().to_numpy().reshape(n, -1), axis=1).astype(bool)
        self.least = np.maximum(table.column("least").to_numpy(), threshold) if "least" in table.schema.names else np.full(n, threshold)
        self.best, self.met, self.next = _Best(k, 1.0, None, n), 0, 512

    def meet(self, block: pa.Buffer) -> None:
        """Products of single precision find what can be among the best; those pairs are summed by themselves."""
        table = _table(block)
        kept, vectors, lists = table.select(["key"]), Vectors(table.column("vector")), table.column("list").to_numpy()
        rows = vectors.of(np.arange(table.num_rows))
        unit = (rows / vectors.norm[:, None]).astype("float32")
        ends = np.flatnonzero(np.r_[lists[1:] != lists[:-1], True]) + 1
        held, n = [], 0
        for start, end in zip(np.r_[0, ends[:-1]], ends):
            who = np.flatnonzero(self.reads[:, lists[start]])
            asked, step = self.unit if len(who) == len(self.unit) else self.unit[who], max(1, CELLS // max(1, len(who)))
            bar = self.bar()[who]
            for s in range(start, end if len(who) else start, step):
                part = unit[s:min(s + step, end)]
                hit = _true(asked @ part.T >= bar[:, None])
                j, i = who[hit // len(part)], s + hit % len(part)
                sim = np.empty(len(hit))
                for e in (slice(x, x + SUMMED) for x in range(0, len(hit), SUMMED)):
                    sim[e] = np.einsum("ij,ij->i", rows[i[e]], self.all[j[e]]) / (vectors.norm[i[e]] * self.norm[j[e]])
                good = sim >= self.least[j]
                held.append((i[good], j[good], sim[good]))
                n, self.met = n + len(sim), self.met + len(part)
                if n > HANDED or self.met >= self.next:
                    self.best.add(kept, *map(np.concatenate, zip(*held)), None)
                    held, n = [], 0
                    if self.met >= self.next:
                        self.best.cut()
                        self.next = 2 * self.met
                    bar = self.bar()[who]
        if held:
            self.best.add(kept, *map(np.concatenate, zip(*held)), None)

    def bar(self) -> np.ndarray:
        """What a product has to reach for each query, so far."""
        return (np.maximum(self.least, self.best.least) - self.off).astype("float32")

    def found(self) -> Iterator[pa.RecordBatch]:
        if (found := self.best.cut()) is not None:
            for part in found.to_batches(max_chunksize=HANDED):
                yield pa.RecordBatch.from_arrays([self.ids.take(part.column("_q")), part.column("key"), part.column("sim")], names=["query_id", "key", "sim"])


def _read(asked: DataFrame, held: DataFrame, schema: T.StructType, k: int, threshold: float) -> DataFrame:
    """The best k rows of each query among the blocks of rows that a task holds, as query_id, key and sim."""
    pairs = asked.select(F.col("lists").alias("wanted"), F.col("block").alias("asked")).join(held.withColumnRenamed("block", "held").hint("shuffle_replicate_nl"), F.arrays_overlap("wanted", "lists")).select("asked", "held")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1)):
                if search is None or not search.block.equals(asked.as_buffer()):
                    if search is not None:
                        yield from search.found()
                    search = _Search(asked.as_buffer(), k, threshold)
                search.meet(held.as_buffer())
        if search is not None:
            yield from search.found()

    return pairs.mapInArrow(match, schema)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, threshold: float, recall: float = 0.95, sample: int = 500) -> int:
    """Lists to read for a recall: of at most ``sample`` queries (smallest hashes of their ids) the true neighbours are found, and the place that their list has for the query."""
    some = shared.kept(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "index-sample")
    true = search(index, some, k, threshold, exact=True).select("query_id", "key").join(index.rows.select("key", "list"), "key")
    place = true.join(_probe(some, index, len(index.centroids), None).select("query_id", "list", "place"), ["query_id", "list"])
    worst = place.agg(F.expr(f"percentile_disc({recall}) within group (order by place)")).first()[0]
    return 1 if worst is None else int(worst) + 1


def search(index: VectorIndex, queries: DataFrame, k: int = 10, threshold: float = 1e-9, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, key, sim and rank of the best k rows with a cosine of ``threshold`` (above 0) or more; ties by key.

    queries: query_id, vector, any number of them. ``exact`` gives what a comparison with all rows gives, and reads as much of the index as that takes. ``probes``: lists
    that a query reads (8 if not given); with ``exact`` those that it reads first, for a bound on the others, whatever their number (the nearest one if not given).
    """
    probes = probes or (1 if exact else 8)
    if threshold <= 0:
        raise ValueError("rows without similarity are in no list; compare with all rows for a threshold of 0")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked, rows = assign(asked, index.centroids).where("list >= 0").select("query_id", "vector", "list"), index.rows.where("list >= 0")
    schema = T.StructType([asked.schema["query_id"], rows.schema["key"], T.StructField("sim", T.DoubleType())])
    radius, n, width = np.full(len(index.centroids), -10.0), 0, index.centroids.shape[1]  # of an empty list: never read
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # two numbers for each list
        radius[r["list"]], n = r["radius"], n + r["n"]
    parts = lambda n, most: max(1, -(-n // max(1, min(most, NUMBERS // max(1, width)))))
    held, blocks = _held(rows, k, width, -(-parts(n, ROWS) // HELD)), parts(asked.count(), QUERIES)
    found = top_k(_read(_asked(asked, index, probes, None, blocks), held, schema, k, threshold), k, "sim")
    if not exact or not len(index.centroids):
        return found.select("query_id", "key", "sim", "rank")
    found = shared.kept(found, "index-found")
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(threshold)).alias("least"))
    again = asked.join(large(least), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(threshold)))
    more = _read(_asked(again, index, probes, radius, blocks), held, schema, k, threshold)
    return top_k(found.select("query_id", "key", "sim").unionByName(more), k, "sim").select("query_id", "key", "sim", "rank")
