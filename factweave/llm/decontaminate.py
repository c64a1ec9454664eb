"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. Each fixed mask looks at some of the tokens of a
span and ignores the others, so that a seed survives substitutions at the ignored places. Seeds of
the benchmark are joined to those of the training texts; every hit fixes an alignment of one item
with one document, and the tokens around it are compared place by place. An item has leaked into
a document if some window of ``window`` item tokens (the whole item if shorter) agrees in at least
``similarity`` of its places.

Benchmark items are sent to all tasks in blocks of about ``block_tokens`` tokens: once as seeds (a few numbers
each) and once as segments of their tokens, so that a block grows with its tokens and not with the length
of an item or the number of items that share a seed; every block reads the documents once. A hit is compared in
the task that holds the document, on the 25 tokens around it, so texts are not shuffled.

Defined cases: null and empty texts and items have no tokens and match nothing; items of fewer than 13 tokens are found by masks
of their own length, which leave one whole under every substitution that ``similarity`` allows (none under 5 tokens: those match as a whole), so that
nothing allowed is missed at any length. ``flag_documents`` gives a row per distinct id, ``decontaminate`` judges each row by itself; rows that
share an item_id are searched for with each of their texts and count once. Ids of documents and items may be null.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import KEY, materialise, pick, row_key, table

#: 1: the token is compared, 0: it is ignored. Fixed values.
MASKS = ("11011001", "1100011001")
WINDOW = 13
SIMILARITY = 0.8
BLOCK_TOKENS = 400_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


#: Tokens of a segment's own; it also holds WINDOW - 1 tokens before and after them.
SEGMENT = 64


def short_masks(n: int, similarity: float = SIMILARITY) -> list[str]:
    """Masks of an item of ``n`` tokens: it is cut into two stretches more than places may differ, so two at least stay whole; each pair of stretches is a mask."""
    differ = n - ceil(similarity * n - 1e-9)
    if not differ:
        return ["1" * n]
    parts = min(differ + 2, n)
    return ["".join("1" if k * parts // n in chosen else "0" for k in range(n)) for chosen in combinations(range(parts), parts - differ)]


def _seed_columns(n: str, masks: tuple[str, ...], short: list[int], similarity: float) -> Column:
    """The seeds that begin in the middle of ``seen``, the tokens around place ``pos``: one per mask that fits there, and those of each length of short items. Null where none fits."""
    pos, token, out = F.col("pos"), lambda k: F.get(F.col("seen"), F.lit(WINDOW - 1 + k)), []
    for m, mask in enumerate(masks):
        own = F.xxhash64(F.lit(m), *[token(k) for k, c in enumerate(mask) if c == "1"])
        out.append(F.when(pos + len(mask) <= F.col(n), own))
    for size in short:
        for m, mask in enumerate(short_masks(size, similarity)):
            out.append(F.when(pos + size <= F.col(n), F.xxhash64(F.lit(-size), F.lit(m), *[token(k) for k, c in enumerate(mask) if c == "1"])))
    return F.array(*out)


def _padded(h: Column) -> Column:
    """WINDOW - 1 nulls, the tokens, and as many nulls: what lies around a place is then a slice of fixed length."""
    none = F.array_repeat(F.lit(None).cast("long"), WINDOW - 1)
    return F.concat(none, h, none)


def _segments(items: DataFrame) -> DataFrame:
    """item_no, seg, toks: the tokens of places 64 seg - 12 to 64 seg + 75 of an item, null outside it."""
    ahead = items.select("item_no", "ih", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SEGMENT).cast("int"))).alias("seg"))
    return ahead.select("item_no", "seg", F.slice("ih", F.col("seg") * SEGMENT + 1, F.lit(SEGMENT + 2 * (WINDOW - 1))).alias("toks"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """id, item_id, n_match, n_window: the best window around a hit of each leaked item in each document that holds it."""
    window, span = WINDOW, 2 * WINDOW - 1
    items = pick(benchmark, item_col, item_text).select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("ih")).where(F.size("ih") > 0)
    items = materialise(items.distinct().select(F.monotonically_increasing_id().alias("item_no"), "item_id", _padded(F.col("ih")).alias("ih"), F.size("ih").alias("n")), "items")
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.collect_set(F.when(F.col("n") < window, F.col("n"))).alias("short")).first()
    blocks = max(1, -(-int(size["all"]) // block_tokens))
    short = sorted(size["short"])  # at most window - 1 lengths
    # outer, so that no filter on the number of tokens is inferred, for which the text would be cut into tokens twice
    places = lambda n: F.explode_outer(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))).alias("pos")
    text = pick(docs, id_col, text_col).select(F.col(id_col).alias("_fw_id"), _padded(tokens(F.col(text_col))).alias("h")).withColumn("n", F.size("h") - 2 * (window - 1))
    around = lambda h: F.slice(h, F.col("pos") + 1, F.lit(span)).alias("seen")  # noqa: E731  what is handed on is 25 tokens a place and not the text
    sown = text.select("_fw_id", "h", "n", places("n")).select("_fw_id", "n", "pos", around("h")).select("_fw_id", "seen", F.explode(_seed_columns("n", masks, short, similarity)).alias("s")).where("s is not null")
    own = items.select("item_no", "ih", "n", places("n")).select("item_no", "n", "pos", around("ih"))
    # a short item has the seeds of its own length; of places with equal surroundings one stands for all, since what is compared there is the same
    seeds_of = F.when(F.col("n") >= window, _seed_columns("n", masks, [], similarity))
    for k in short:
        seeds_of = seeds_of.when(F.col("n") == k, _seed_columns("n", (), [k], similarity))
    own = own.select("item_no", "n", "pos", "seen", F.explode(seeds_of).alias("s")).where("s is not null")
    own = own.groupBy("item_no", "n", "s", "seen").agg(F.min("pos").alias("ip")).drop("seen")
    segments, found = _segments(items), None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("item_no", "seg"), F.lit(blocks)) == b  # seeds and segment of one stretch of an item
        seeds = own.withColumn("seg", F.floor(F.col("ip") / SEGMENT).cast("int")).where(mine)
        hits = sown.join(F.broadcast(seeds), "s").select("_fw_id", "item_no", "seg", "n", (F.col("ip") - F.col("seg") * SEGMENT).alias("ip"), "seen")
        hits = hits.join(F.broadcast(segments.where(mine)), ["item_no", "seg"])
        same = F.zip_with("seen", F.slice("toks", F.col("ip") + 1, F.lit(span)), lambda x, y: F.when(x == y, 1).otherwise(0))
        width = F.least(F.lit(window), F.col("n"))
        need = F.ceil(F.lit(similarity) * width - 1e-9)
        rated = hits.select("_fw_id", "item_no", width.alias("n_window"), need.alias("need"), same.alias("same"))
        rated = rated.where(F.aggregate("same", F.lit(0), lambda acc, x: acc + x) >= F.col("need"))
        most = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.aggregate(F.slice("same", k, F.lit(window)), F.lit(0), lambda acc, x: acc + x)))
        best = rated.select("_fw_id", "item_no", most.alias("n_match"), "n_window", "need").where("n_match >= need").drop("need")
        best = best.groupBy("_fw_id", "item_no").agg(F.max("n_match").alias("n_match"), F.max("n_window").alias("n_window"))
        found = best if found is None else found.unionByName(best)
    most = F.max(F.struct("n_match", "n_window")).alias("x")
    named = found.join(items.select("item_no", "item_id"), "item_no").groupBy("_fw_id", "item_id").agg(most)
    return named.select(F.col("_fw_id").alias(id_col), "item_id", "x.n_match", "x.n_window")


def flag_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, contaminated, n_items, items (sorted): a row per distinct id. Items without id count as one and are not listed."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).select(id_col, "item_id", F.lit(True).alias("hit"))
    every = pick(docs, id_col).withColumns({"item_id": F.lit(None).cast(leaks.schema["item_id"].dataType), "hit": F.lit(False)})
    nameless = F.max(F.col("hit") & F.col("item_id").isNull()).cast("long").alias("nameless")
    return every.unionByName(leaks).groupBy(id_col).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("hit").alias("contaminated"), nameless).select(
        id_col, "contaminated", (F.size("items") + F.col("nameless")).alias("n_items"), F.array_join("items", ",").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; other rows of the same id stay."""
    keyed = docs.withColumn(KEY, row_key(id_col, text_col))
    bad = find_leaks(keyed, benchmark, KEY, text_col, **options).select(F.col(KEY).alias("_fw_bad")).distinct()
    return keyed.join(bad, F.col(KEY) == F.col("_fw_bad"), "left_anti").drop(KEY)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_decontamination": _query}


def _oracle() -> str:
    seeds = []
    for m, mask in enumerate(MASKS):
        parts = " || ' ' || ".join(f"t[p + {i}]" for i, c in enumerate(mask) if c == "1")
        seeds.append(f"select id, p, '{m}:' || {parts} as s from (select id, t, unnest(range(1, len(t) - {len(mask)} + 2)) as p from {{0}})")
    both = " union all ".join(seeds)
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id as id, {split} as t from documents),
b as (select item_id as id, {split} as t from benchmark),
ds as ({both.format('d')}), bs as ({both.format('b')}),
hits as (select distinct ds.id as doc, bs.id as item, ds.p - bs.p as diag from ds join bs on ds.s = bs.s),
m as (select doc, item, diag, len(b.t) as n, unnest(range(1, len(b.t) + 1)) as j, b.t as bt, d.t as dt
      from hits join b on b.id = item join d on d.id = doc),
e as (select doc, item, diag, n, j, case when j + diag >= 1 and bt[j] = dt[j + diag] then 1 else 0 end as same from m),
w as (select doc, item, n, j, sum(same) over (partition by doc, item, diag order by j rows between {WINDOW - 1} preceding and current row) as got from e),
f as (select distinct doc, item from w where got >= ceil({SIMILARITY} * least({WINDOW}, n) - 1e-9))
select doc_id, count(item) > 0 as contaminated, count(item) as n_items, coalesce(string_agg(item::varchar, ',' order by item), '') as items
from (select distinct doc_id from documents) left join f on doc = doc_id group by doc_id"""


ORACLE: dict[str, str] = {"op5_decontamination": _oracle()}
