"""Periodic runs of words, found with a grammar made by recompression.

The words of a batch of documents stand in one sequence, each document between separators of its own. Recompression makes a grammar of it:
each round replaces blocks of one symbol by the symbol and the block's length (the run-length rule), then, with the symbols split into two
sides by a hash, each neighbouring pair of a left and a right one by a new symbol. Names are exact: two nodes of a level that bear one name
stand for the same words. Equal stretches are cut in the same way but for their ends, so the longest common extension of two
positions is found by climbing while parents agree, stepping over equal symbols (over whole blocks at once), and descending where they differ.
Extension to the left is the same walk on the mirrored levels.

Candidates are the multiples i of each q at which the words i, i+q, i+2q and i+3q agree: a stretch of four periods of q words holds such a
place wherever it starts, and all grids of a document together have n (1 + 1/2 + 1/3 ...) places. Each candidate is extended by the grammar to
the whole stretch in which words q apart agree; of equal stretches that with the smallest q is the run.

Defined cases: null and empty texts, or texts of white space, have no words and no run; rows are independent, so repeated rows give equal
results; a document of any length is one piece of work (about 170 bytes a word), and batches are closed after BATCH_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import WORD_GAP, pick, table

#: A run has this many periods at least, and this many words.
LEAST_POWER, LEAST_WORDS = 4, 6
#: Documents of a batch are put together until they have so many words.
BATCH_WORDS = 200_000


class Grammar:
    """Levels of a recompression of ``words`` (whole numbers from 0; the first and the last one occur once), flat one after another.

    ``symbol``, ``start`` (first word), ``block`` (end of the block of equal symbols), ``parent``, ``child`` (first symbol of the level below)
    and ``first`` (is it the first symbol of its parent) of every node of every level.
    """

    def __init__(self, words: np.ndarray):
        symbols, starts = words.astype(np.int64), np.arange(len(words), dtype=np.int32)
        levels, below = [], None
        while True:
            n = len(symbols)
            opens = np.empty(n, bool)
            opens[0] = True
            np.not_equal(symbols[1:], symbols[:-1], out=opens[1:])
            heads = np.flatnonzero(opens)
            ends = np.append(heads[1:], n)
            level = {"symbol": symbols, "start": starts, "block": np.repeat(ends, ends - heads), "child": below}
            levels.append(level)
            # blocks: the name of a symbol that stands alone is kept apart from that of a longer block
            names = _names(symbols[heads], ends - heads)
            left = _side(names, len(levels))
            pair = left[:-1] & ~left[1:]
            if len(heads) < 3 or not (pair.any() or len(heads) < n):
                break
            joins = np.append(False, pair)  # this block is the second of a pair
            tops = np.flatnonzero(~joins)
            second = np.append(tops[1:], len(heads)) - tops == 2
            partner = np.where(second, names[np.minimum(tops + 1, len(heads) - 1)] + 1, 0)
            nodes = heads[tops]
            level["first"] = np.zeros(n, bool)
            level["first"][nodes] = True
            level["parent"] = np.cumsum(level["first"]) - 1
            symbols, starts, below = _names(names[tops], partner), starts[nodes], nodes
        levels[-1] |= {"first": np.zeros(n, bool), "parent": np.zeros(n, np.int64)}
        self.sizes = [len(x["symbol"]) for x in levels]
        at = np.cumsum([0, *self.sizes])
        flat = lambda key, shift: np.concatenate([(x[key] if x[key] is not None else np.zeros(len(x["symbol"]), np.int64)) + shift(k) for k, x in enumerate(levels)]).astype(np.int32)
        self.words = len(words)
        self.symbol, self.start = flat("symbol", lambda k: 0), flat("start", lambda k: 0)
        self.block, self.parent = flat("block", lambda k: at[k]), flat("parent", lambda k: at[k + 1])
        self.child = flat("child", lambda k: at[k - 1] if k else 0)
        self.first = np.concatenate([x["first"] for x in levels])

    def mirrored(self) -> Grammar:
        """The same nodes read from right to left."""
        out, at = object.__new__(Grammar), np.cumsum([0, *self.sizes])
        ends = np.empty(at[-1], np.int32)
        lasts = np.empty(at[-1], np.int32)
        turned = np.empty(at[-1], np.int32)
        last_child = np.zeros(at[-1], np.int32)
        final = np.zeros(at[-1], bool)
        for k in range(len(self.sizes)):
            low, high = at[k], at[k + 1]
            ends[low:high] = np.append(self.start[low + 1:high], self.words)
            turned[low:high] = np.arange(high - 1, low - 1, -1)
            block = self.block[low:high]
            heads = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
            lasts[low:high] = np.repeat(heads, np.diff(np.append(heads, high - low)))  # first of the block, from the level's start
            if k + 1 < len(self.sizes):
                final[low:high] = np.append(self.first[low + 1:high], True)
            if k:
                last_child[low:high] = np.append(self.child[low + 1:high], at[k]) - 1
        level = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out.sizes, out.words = self.sizes, self.words
        out.symbol, out.start, out.first = self.symbol[turned], (self.words - ends)[turned], final[turned]
        out.block = (at[level] + at[level + 1] - (at[level] + lasts))[turned].astype(np.int32)  # one after the first of the block
        flip = lambda node, shift: (at[np.clip(level + shift, 0, len(self.sizes) - 1)] + at[np.clip(level + shift, 0, len(self.sizes) - 1) + 1] - 1 - node)[turned].astype(np.int32)
        out.parent, out.child = flip(self.parent, 1), flip(last_child, -1)
        return out

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words that agree from places ``one`` and ``other`` (different ones) on."""
        a, b = one.astype(np.int32), other.astype(np.int32)
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            up = self.first[a] & self.first[b]
            pa, pb = np.where(up, self.parent[a], a), np.where(up, self.parent[b], b)
            up &= self.symbol[pa] == self.symbol[pb]
            same = ~up & (self.symbol[a] == self.symbol[b])
            step = np.where(same, np.minimum(self.block[a] - a, self.block[b] - b), 0)
            ends = ~up & ~same & (a < self.words)
            out[left[ends]] = self.start[a[ends]] - one[left[ends]]
            down = ~(up | same | ends)
            a, b = np.where(up, pa, np.where(down, self.child[a], a + step)), np.where(up, pb, np.where(down, self.child[b], b + step))
            a, b, left = a[~ends], b[~ends], left[~ends]
        return out


def _names(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A whole number from 0 for each different pair."""
    return np.unique(one * (int(other.max()) + 1) + other, return_inverse=True)[1]


def _side(names: np.ndarray, level: int) -> np.ndarray:
    """One of two sides for each name, by a multiplicative hash that differs from level to level."""
    mixed = (names.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)


def candidates(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and steps of the harmonic grid. Documents stand by falling size, so that those long enough for a step are a prefix."""
    places, steps, size = [], [], len(sizes)
    for q in range(1, int(sizes[0]) // LEAST_POWER + 1 if len(sizes) else 1):
        while sizes[size - 1] < max(LEAST_POWER * q, LEAST_WORDS):
            size -= 1
            if not size:
                break
        if not size:
            break
        grid = words[:ends[size - 1]:q]
        agree = grid[1:] == grid[:-1]
        hits = np.flatnonzero(agree[:-2] & agree[1:-1] & agree[2:])
        if len(hits):
            places.append(hits * q)
            steps.append(np.full(len(hits), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(steps)


def runs_of(docs: list[list[bytes]]) -> list[np.ndarray]:
    """For each document its runs, rows of (start, length, period) by start and period."""
    sizes = np.array([len(x) for x in docs], np.int64)
    order = [k for k in np.argsort(-sizes, kind="stable") if sizes[k] >= LEAST_WORDS]
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    if not order:
        return out
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in docs[k]], np.int64) for k in order]
    words, at, firsts = np.empty(sum(map(len, parts)) + len(parts) + 1, np.int64), 1, []
    words[0] = len(known)
    for k, part in enumerate(parts):
        words[at:at + len(part)], words[at + len(part)] = part, len(known) + 1 + k
        firsts.append(at)
        at += len(part) + 1
    firsts = np.array(firsts)
    place, step = candidates(words, firsts + sizes[order], sizes[order])
    if not len(place):
        return out
    grammar = Grammar(words)
    ahead = grammar.common(place, place + step)
    behind = grammar.mirrored().common(len(words) - place, len(words) - place - step)
    start, length = place - behind, behind + ahead + step
    found = (length >= LEAST_POWER * step) & (length >= LEAST_WORDS)
    rows = np.unique(np.stack([start, length, step], 1)[found], axis=0)
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows  # of equal stretches the smallest period
    doc = np.searchsorted(firsts, rows[:, 0], "right") - 1
    cuts = np.searchsorted(doc, np.arange(len(order) + 1))
    for k, document in enumerate(order):
        own = rows[cuts[k]:cuts[k + 1]] - [firsts[k], 0, 0]
        out[document] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, inside in zip(words, np.cumsum(depth[:-1]) > 0, strict=True) if not inside)


def _table(ids: pa.Array, docs: list[list[bytes]]) -> pa.RecordBatch:
    """The result rows of some documents."""
    runs = runs_of(docs)
    rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    struct = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), struct)
    texts = pa.array([collapsed(w, r) for w, r in zip(docs, runs, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in docs], pa.int64()), listed, texts], ["id", "n_words", "runs", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        docs, since, held = [], 0, 0
        for k, text in enumerate(texts):
            docs.append((text.as_py() or "").encode().split())  # of bytes, split() knows the six white spaces of the word rule and no others
            held += len(docs[-1])
            if held >= BATCH_WORDS:
                yield _table(ids.slice(since, len(docs)), docs)
                docs, since, held = [], k + 1, 0
        if docs:
            yield _table(ids.slice(since, len(docs)), docs)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length and period, by start and period) and collapsed (the text without repeated periods) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_find, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from a place on repeat a first stretch."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def described(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and the digests of a result of ``find_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: Runs are a search over all places and periods of a text; tests/llm holds them against one.
ORACLE: dict[str, str] = {}
