"""Mixing sources to target weights by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked until their sums by source, by language
and by topic meet the target shares; a document is then kept with the probability of its cell, the
ratio of raked to present tokens, scaled so that the largest is 1 (the largest sample in which no
cell is short of tokens). Documents are pre-aggregated to cells before any shuffle; raking works on
the cells only, each step a partial aggregate and a join, and goes on until every sum is within the
tolerance of its target. Targets that no weights of the cells can meet (a source with one language, asked for more than
that language's share) are noticed when the error no longer falls: the last weights are kept, or ``strict`` makes it an error;
``achieved_margins`` says how far each sum is from its target. A column of topics can take the place of the marker rule.

Defined cases: null source or language is the category ``(none)``; null text has no tokens; a target
for a value without tokens is dropped and the other targets are scaled up; cells without tokens get
rate 0; repeated rows are kept or left together, as the draw depends on the id and the seed only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import materialise, table

DIMS = ("source", "lang", "topic")
#: Exponents of the default targets: a value's share is its share of tokens to this power, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOLERANCE, SEED = 1e-9, "mix-1"
#: Fall of the error in a cycle below which targets count as out of reach.
FALL = 0.999


def topic_of(text: Column) -> Column:
    """Topic by marker: table, legal, contact or prose, the first that fits."""
    return (F.when(text.contains(" | "), "table").when(text.rlike(r"(?i)licen[sc]e|copyright"), "legal")
            .when(text.contains("@"), "contact").otherwise("prose"))


def count_tokens(text: Column) -> Column:
    """Token weight of a text: its runs of characters other than the six white-space ones."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the id and the seed: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(docs: DataFrame, text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """``docs`` plus _fw_source, _fw_lang and _fw_topic, the cell of each document; topics are those of ``topic_col`` or else by marker."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.withColumns({"_fw_source": named("source"), "_fw_lang": named("lang"), "_fw_topic": named(topic_col) if topic_col else topic_of(F.col(text_col))})


def default_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """value, share: tempered token shares of one dimension. Values without tokens have none."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("x")).where(F.col("x") > 0).withColumn("x", F.pow(F.col("x"), F.lit(power)))
    every = own.agg(F.sum("x")).first()[0] or 1.0
    return own.select(dim, (F.col("x") / F.lit(every)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """``cells`` (dims and tokens > 0) plus ``w``, raked until no sum is further from its target than ``tolerance`` of it."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    total = now.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    for dim in targets:
        now = now.join(targets[dim].select(dim, F.col("share").alias(f"goal_{dim}")), dim)
    before = None
    while True:
        offs = []
        for dim in targets:
            margin = now.groupBy(dim).agg(F.sum("w").alias("m"))
            aim = F.col(f"goal_{dim}") * F.lit(total)
            now = now.join(margin, dim).withColumns({f"off_{dim}": F.abs(F.col("m") / aim - 1), "w": F.col("w") * aim / F.col("m")}).drop("m")
            offs.append(f"off_{dim}")
        now = materialise(now, "mix-step")  # a plan doubles with each join to its own sums, so each cycle is written
        worst = now.agg(F.greatest(*[F.coalesce(F.max(c), F.lit(0.0)) for c in offs], F.lit(0.0))).first()[0]
        now = now.drop(*offs)
        if worst <= tolerance:
            break
        if before is not None and worst > FALL * before:
            if strict:
                raise ValueError(f"targets can't be met: a sum stays {worst:.3g} of its target away")
            break
        before = worst
    return now.select(*cells.columns, "w")


def achieved_margins(raked: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """dim, value, share (the target) and achieved (the share of the weights) for every value of every dimension."""
    out = None
    for dim, goal in targets.items():
        own = raked.groupBy(dim).agg(F.sum("w").alias("x"))
        every = raked.agg(F.sum("w").alias("all"))
        one = goal.join(own, dim, "left").join(F.broadcast(every)).select(  # one row
            F.lit(dim).alias("dim"), F.col(dim).alias("value"), "share", (F.coalesce("x", F.lit(0.0)) / F.col("all")).alias("achieved"))
        out = one if out is None else out.unionByName(one)
    return out


def raked_cells(docs: DataFrame, text_col: str = "text", targets: Mapping[str, DataFrame] | None = None, topic_col: str | None = None, strict: bool = False) -> tuple[DataFrame, Mapping[str, DataFrame]]:
    """(cells with tokens and weight, the targets they were raked to)."""
    parts = with_cells(docs, text_col, topic_col).groupBy(*[f"_fw_{d}" for d in DIMS]).agg(F.sum(count_tokens(F.col(text_col))).alias("tokens"))
    cells = materialise(parts.toDF(*DIMS, "tokens").where(F.col("tokens") > 0), "mix-cells")
    goals = dict(targets) if targets else {d: default_targets(cells, d, TEMPER[d]) for d in DIMS}
    return rake(cells, goals, strict=strict), goals


def cell_rates(docs: DataFrame, text_col: str = "text", targets: Mapping[str, DataFrame] | None = None, topic_col: str | None = None, strict: bool = False) -> DataFrame:
    """_fw_source, _fw_lang, _fw_topic, tokens, rate for each cell that has tokens."""
    raked = raked_cells(docs, text_col, targets, topic_col, strict)[0].withColumn("ratio", F.col("w") / F.col("tokens"))
    top = raked.agg(F.max("ratio")).first()[0] or 1.0
    return materialise(raked.select(
        *[F.col(d).alias(f"_fw_{d}") for d in DIMS], "tokens", (F.col("ratio") / F.lit(top)).alias("rate")), "mix-rates")


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Mapping[str, DataFrame] | None = None, seed: str = SEED, topic_col: str | None = None, strict: bool = False) -> DataFrame:
    """All columns of ``docs`` plus _fw_source, _fw_lang, _fw_topic, rate and kept."""
    rates = cell_rates(docs, text_col, targets, topic_col, strict).drop("tokens")
    clean = docs.drop("rate", "kept")
    joined = with_cells(clean, text_col, topic_col).join(rates, [f"_fw_{d}" for d in DIMS], "left")
    return joined.withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("kept", draw(F.col(id_col), seed) < F.col("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Mapping[str, DataFrame] | None = None, seed: str = SEED, **options) -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    return rate_documents(docs, id_col, text_col, targets, seed, **options).where("kept").select(*docs.columns)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return rated.select(
        "doc_id", F.col("_fw_source").alias("source"), F.col("_fw_lang").alias("lang"), F.col("_fw_topic").alias("topic"),
        count_tokens(F.col("text")).alias("n_tokens"), F.round("rate", 5).alias("rate"), "kept")


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    raked, goals = raked_cells(table(spark, sf_dir, "documents"))
    return achieved_margins(raked, goals).select("dim", "value", F.round("share", 6).alias("share"), F.round("achieved", 6).alias("achieved"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_mixing": _query, "mixing_margins": _margins}
#: Cycles written out in the SQL; the operator's weights are then the same to more places than are compared.
CYCLES = 12


def _oracle() -> str:
    steps, last = [], "c0"
    for k in range(CYCLES):
        for dim in DIMS:
            name = f"s{k}_{dim}"
            steps.append(f"{name} as (select * exclude (w), w * g_{dim} * (select sum(tokens) from cells) / sum(w) over (partition by {dim}) as w from {last})")
            last = name
    goals = ", ".join(f"g{d} as (select {d}, pow(sum(tokens), {TEMPER[d]}) / sum(pow(sum(tokens), {TEMPER[d]})) over () as g_{d} from cells group by {d})" for d in DIMS)
    return f"""
with d as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
  case when contains(text, ' | ') then 'table' when regexp_matches(text, '(?i)licen[sc]e|copyright') then 'legal'
       when contains(text, '@') then 'contact' else 'prose' end as topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all having sum(n_tokens) > 0),
{goals},
c0 as (select cells.*, g_source, g_lang, g_topic, tokens as w from cells join gsource using (source) join glang using (lang) join gtopic using (topic)),
{', '.join(steps)},
r as (select source, lang, topic, w / tokens / max(w / tokens) over () as rate from {last})
select doc_id, source, lang, topic, n_tokens, round(coalesce(rate, 0), 5) as rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(1 << 52)!r} < coalesce(rate, 0) as kept
from d left join r using (source, lang, topic)"""


def _margins_oracle() -> str:
    """A raked sum is its target, so the shares achieved are the targets themselves."""
    sql = _oracle()
    parts = [f"select '{d}' as dim, {d} as value, round(g_{d}, 6)::double as share, round(g_{d}, 6)::double as achieved from g{d}" for d in DIMS]
    return sql[: sql.index("c0 as (")].rstrip().rstrip(",") + "\n" + "\nunion all ".join(parts)


ORACLE: dict[str, str] = {"op10_mixing": _oracle(), "mixing_margins": _margins_oracle()}
