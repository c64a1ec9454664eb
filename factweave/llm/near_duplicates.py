"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents are sets of five-word shingles. Band and row counts follow from the similarity and the
target recall. Exact copies are collapsed first; band hashes are shuffled as small rows. Inside a bucket
members are linked if their signatures agree in half of the places or more (a pair of .8 fails that less than once in
10^12), by a spanning tree and without pairs, so that chance hits of a band don't chain unlike documents into one
component. A bucket is dealt out in parts of ``PART`` members, of which every two meet in one cell: the same rule holds at
every size, and a task holds one cell at a time.
The documents of a component meet once, in blocks of bounded size: pairs sharing a band are verified
on their whole shingle sets inside a task, which returns per document the number of verified links
and one edge to its block's root. Pairs are never written or shuffled; a component of any size is dealt
out as pairs of blocks, so no task holds more than two.

Defined cases: words are split at the six white-space characters after lower-casing; a text of one to
four words is one shingle; a text without words (null too) links to nothing. Links count documents, so
copies and repeated rows count; class_id is the smallest doc_id of a group (null if all are null).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import KEY, WORD_GAP, materialise, pick, row_key, table

SHINGLE, SIMILARITY, RECALL, HASHES, SEED = 5, 0.8, 0.9995, 128, 20240229
#: Members of one part of a bucket, and the share of equal signature bytes that links two members.
PART, AGREE = 2_000, 0.5
#: Shingles held by one block; a document weighs LIGHT at least, which bounds a block's documents too.
BLOCK, LIGHT = 1_000_000, 200


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Most rows a band (fewest false candidates) with which ``hashes`` hashes reach ``recall`` at ``similarity``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        hit = similarity**rows
        need = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if need * rows <= hashes:
            best = (need, rows)
    return best


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the n-word windows of one text, given its word hashes; a shorter text is one shingle."""
    w = words.astype(np.uint64)
    if len(w) == 0:
        return w
    width = min(n, len(w))
    out = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def signer(bands: int, rows: int, seed: int = SEED) -> Callable[[np.ndarray], tuple[np.ndarray, bytes]]:
    """From shingles to the codes of the bands and a byte of each hash."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(1, 2**32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]

    def sign(s: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(bands * rows, 2**32 - 1, dtype=np.uint32)
        x = ((s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 4096):
            np.minimum(low, (a * x[i : i + 4096] + b).min(axis=1), out=low)
        code = np.arange(1, bands + 1, dtype=np.uint64)
        for column in low.reshape(bands, rows).T.astype(np.uint64):
            code = (code ^ column) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
        return code.view(np.int64), (low >> np.uint32(24)).astype(np.uint8).tobytes()

    return sign


def _words(text_col: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_GAP), lambda w: w != "")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 0, rows: int = 0) -> DataFrame:
    """_fw_key, id, copy (digest of the word sequence, null without words), n (shingles), bands and sketch."""
    words = pick(docs, id_col, text_col).select(row_key(id_col, text_col).alias(KEY), F.col(id_col).alias("id"), _words(text_col).alias("w"))
    hashed = words.select(KEY, "id", F.when(F.size("w") > 0, F.md5(F.array_join("w", " "))).alias("copy"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(bands, rows)
        for batch in batches:
            column = batch.column("h")
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sizes, signed = [], []
            for i in range(len(batch)):
                s = shingles(flat[at[i] : at[i + 1]])
                sizes.append(len(s))
                signed.append(sign(s) if len(s) else (None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column("id"), batch.column("copy"), pa.array(sizes, pa.int64()), pa.array([x for x, _ in signed], pa.list_(pa.int64())), pa.array([y for _, y in signed], pa.binary())],
                names=[KEY, "id", "copy", "n", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(run, f"{KEY} binary, id {kind}, copy string, n long, bands array<long>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v longs) that isn't its component's smallest.

    Alternating stars: first neighbours above a node, then those below it, move to the smallest
    neighbour, until nothing changes. Only aggregates and joins on small rows.
    """
    now, before = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            return now.withColumnRenamed("v", "root")
        before = after


def spanning_links(rep: np.ndarray, sketches: np.ndarray, agree: float = AGREE) -> list[tuple[int, int]]:
    """Edges (larger, smaller) of a spanning forest of the members whose sketches agree.

    A member is compared with those that aren't in its tree yet, so a cell of alike members takes one pass.
    """
    root = np.arange(len(rep))
    out = []
    for i in range(len(rep) - 1):
        other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if not len(other):
            continue
        hit = other[(sketches[other] == sketches[i]).mean(axis=1) >= agree]
        trees, first = np.unique(root[hit], return_index=True)
        out += [(max(rep[i], rep[j]), min(rep[i], rep[j])) for j in hit[first]]
        root[np.isin(root, trees)] = root[i]
    return out


def bucket_cells(members: DataFrame, part: int) -> DataFrame:
    """``members`` (band, code, rep, members) with the cell (x, y) of each two parts of a bucket; a bucket of one part is one cell."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / part)).cast("int")
    dealt = members.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: (o != F.col("_own")) | (F.col("_parts") == 1))
    cells = F.transform(others, lambda o: F.struct(F.least(o, F.col("_own")).alias("x"), F.greatest(o, F.col("_own")).alias("y")))
    return dealt.withColumn("_c", F.explode(cells)).withColumns({"x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_parts", "_own", "_c")


def bucket_links(members: DataFrame, agree: float = AGREE) -> DataFrame:
    """(u, v) of the spanning forests of all cells; members: band, code, x, y, rep, sketch. A task reads its cells one after the other."""
    cell = ["band", "code", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            *keys, rep, sketch = rows
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [e for own in np.split(np.arange(len(rep)), cuts) for e in spanning_links(rep[own], sketch[own], agree)]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(batch), -1)
            rows = (*[batch.column(c).to_numpy(zero_copy_only=False) for c in (*cell, "rep")], sketch)
            if held is not None:
                rows = tuple(np.concatenate(pair) for pair in zip(held, rows))
            last = np.all([k == k[-1] for k in rows[: len(cell)]], axis=0)  # the cell that may go on in the next batch
            held = tuple(x[last] for x in rows)
            if not last.all():
                yield links(tuple(x[~last] for x in rows))
        if held is not None:
            yield links(held)

    return members.repartition(*cell).sortWithinPartitions(*cell, "rep").select(*cell, "rep", "sketch").mapInArrow(run, "u long, v long")


def verify_block(ids: np.ndarray, weight: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links per document (weighted by copies) and the root of each; ``side`` 0 and 1 are two blocks, else all pairs count.

    Shingles get dense numbers once; a document's are flagged and counted in those of each candidate.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(dense.max()) + 1 if len(dense) else 1, dtype=np.int32)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    two = len(np.unique(side)) > 1
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if two:
            rest = rest[side[i + 1 :] != side[i]]
        rest = rest[(bands[rest] == bands[i]).any(axis=1)]
        small, big = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[small >= similarity * big - 1e-9]
        if not len(rest):
            continue
        own = dense[start[i] : start[i + 1]]
        flag[own] = 1
        for part in np.array_split(rest, -(-int(sizes[rest].sum()) // 4_000_000)):
            if not len(part):
                continue
            run = sizes[part]
            first = np.cumsum(run) - run
            places = np.repeat(start[part] - first, run) + np.arange(int(run.sum()))
            common = np.add.reduceat(flag[dense[places]], first)
            good = part[common >= similarity * (sizes[part] + sizes[i] - common) - 1e-9]
            links[i] += weight[good].sum()
            links[good] += weight[i]
            for j in good:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
        flag[own] = 0
    return links, np.array([find(i) for i in range(n)], dtype=np.int64)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, part: int = PART) -> DataFrame:
    """_fw_key, id, class_id, n_links for every row of ``docs``; ``part`` sets how finely buckets are dealt out, not what is found."""
    spark = docs.sparkSession
    bands, rows = bands_and_rows(similarity, recall)
    signed = materialise(signatures(docs, id_col, text_col, bands, rows), "signed")
    first = F.min(F.struct("id", KEY, "n", "bands", "sketch"))
    reps = signed.where("copy is not null").groupBy("copy").agg(first.alias("r"), F.count("*").alias("weight"))
    # numbers of rows are unlike, as hashes needn't be; they are written and so stay what they are
    reps = materialise(reps.select("copy", F.monotonically_increasing_id().alias("rep"), F.col(f"r.{KEY}").alias(KEY), "r.n", "r.bands", "r.sketch", "weight"), "reps")
    inside = reps.select("rep", F.posexplode("bands").alias("band", "code"))
    shared = inside.groupBy("band", "code").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialise(inside.join(shared, ["band", "code"]), "buckets")
    roots = components(bucket_links(bucket_cells(shared, part).join(reps.select("rep", "sketch"), "rep")))
    comp = roots.select(F.col("u").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    members = reps.join(comp, "rep").withColumn("load", F.greatest("n", F.lit(LIGHT)))
    loads = members.groupBy("root").agg(F.sum("load").alias("all")).withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
    loads = materialise(loads, "loads")
    bins = max(1, -(-int(loads.where("blocks = 1").agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]) // (BLOCK // 2)))
    dealt = members.join(loads.select("root", "blocks"), "root").select(
        "rep", KEY, "root", "weight", "bands", "blocks",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("g"),
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"))
    dealt = materialise(dealt, "dealt")
    text = pick(docs, id_col, text_col).select(row_key(id_col, text_col).alias(KEY), F.col(text_col).alias("t"))
    # repeated rows share a key and are equal, so any of them gives the words
    held = dealt.join(text, KEY).dropDuplicates(["rep"]).withColumn("h", F.transform(_words("t"), lambda x: F.xxhash64(x))).drop("t", KEY)
    mine = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("x"), F.greatest(o, F.col("b")).alias("y")))
    cells = held.withColumn("c", F.explode(mine)).select("rep", "root", "weight", "bands", "b", "g", "h", "blocks", F.col("c.x").alias("x"), F.col("c.y").alias("y"))

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in frame.groupby("root", sort=False):
            ids = one["rep"].to_numpy()
            sets = [np.unique(shingles(np.asarray(h))) for h in one["h"]]
            links, root = verify_block(ids, one["weight"].to_numpy(), np.array(one["bands"].tolist()), sets, one["b"].to_numpy(), similarity)
            hit = links > 0
            out.append(pd.DataFrame({"rep": ids[hit], "links": links[hit], "to": ids[root[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "to": []})

    linked = materialise(cells.groupBy("g", "blocks", "x", "y").applyInPandas(check, "rep long, links long, to long"), "linked")
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    known = reps.select("copy", "rep", "weight").join(counted, "rep", "left").join(groups.withColumnRenamed("u", "rep"), "rep", "left")
    known = known.select("copy", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    rows_out = signed.select(KEY, "id", "copy").join(known, "copy", "left")
    # a row without words is a class by itself, named by its key
    rows_out = rows_out.select(KEY, "id", F.coalesce(F.col("root").cast("string"), F.hex(KEY)).alias("root"), "n_links")
    rows_out = materialise(rows_out, "classes")
    smallest = rows_out.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct("id", KEY)).alias("first"))
    return rows_out.join(smallest, "root").select(
        KEY, "id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("first")[KEY] == F.col(KEY)).alias("is_first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the smallest id of each group only; rows equal in id and text become one, that of the smallest JSON of the row.

    Only keys that occur repeatedly are gathered again; without any, the texts pass once.
    """
    linked = link_documents(docs, id_col, text_col, **options)
    gone = linked.where("not is_first").select(F.col(KEY).alias("_fw_gone"))
    left = docs.withColumn(KEY, row_key(id_col, text_col)).join(gone.distinct(), F.col(KEY) == F.col("_fw_gone"), "left_anti")
    again = materialise(linked.where("is_first").groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(F.col(KEY).alias("_fw_again")), "again")
    if again.isEmpty():
        return left.drop(KEY)
    same = F.col(KEY) == F.col("_fw_again")
    row, others = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    one = left.join(again, same, "left_semi").groupBy(KEY).agg(F.min_by(row, F.to_json(F.struct(*others)) if others else F.lit("")).alias("x"))
    return left.join(again, same, "left_anti").drop(KEY).unionByName(one.select("x.*"))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_ngram_jaccard_join": _query}
ORACLE: dict[str, str] = {}
