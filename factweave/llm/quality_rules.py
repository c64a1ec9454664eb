"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per failed rule and the
measurements behind it. Policies are versioned sets of bits applied to a stored ledger, and
an ablation asks how many documents a policy would get back without one of its rules, all by
bitwise arithmetic and without reading a text again.

Null text counts as a text without words. Repeated rows give repeated ledger rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import WORD_GAP, materialise, pick, table

SYMBOLS = "#*$%&|<>"
#: Rule name -> condition over the measurements under which it fails. The order fixes the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "upper_case": "100 * n_upper > 60 * n_letters and n_letters > 0",
    "no_letters": "n_letters = 0",
}
#: Policy version -> rules whose failure rejects a document. `base` is part of each later one.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2024.1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines", "no_letters"),
    "2024.2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def policy_mask(version: str) -> int:
    """The bits that a policy looks at."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def _covered(sorted_windows: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more, from (hash, position) pairs sorted by hash.

    Neighbours with one hash are repeats. Positions of repeated windows, sorted again, each cover
    up to ``width`` words of which those of the next window are counted there.
    """
    after = F.slice(sorted_windows, F.lit(2), F.greatest(F.size(sorted_windows) - 1, F.lit(0)))
    return F.zip_with(sorted_windows, after, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of each document.

    Words are maximal runs without the six white-space characters. A 3-word window that occurs twice
    or more in the text counts the words it covers, first occurrence included. Lines are split at
    line feeds and count only if they hold a word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = pick(docs, id_col, text_col).select(
        id_col,
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    hashed = base.select(
        id_col, "n_symbols", "n_letters", "n_upper",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    size = F.size("h")
    pairs = F.zip_with("h", F.slice("h", F.lit(2), F.greatest(size - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keep = [id_col, "n_symbols", "n_letters", "n_upper", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    windows = hashed.select(*keep, pairs.alias("p"), "h").select(
        *keep,
        F.slice(
            F.zip_with("p", F.slice("h", F.lit(3), F.greatest(size - 2, F.lit(0))), lambda p, c: F.xxhash64(p["a"], p["b"], c)),
            F.lit(1), F.greatest(size - 2, F.lit(0)),
        ).alias("t"),
    ).select(*keep, F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("s"))
    marked = windows.select(*keep, "s", _covered(F.col("s"), 3).alias("same"))
    # a window is repeated if it equals its successor or its predecessor in sorted order
    before = F.concat(F.array(F.lit(False)), F.col("same"))
    spots = marked.select(
        *keep,
        F.sort_array(F.transform(
            F.filter(
                F.zip_with(F.zip_with("s", "same", lambda s, e: F.struct(s["i"].alias("i"), e.alias("e"))), F.slice(before, F.lit(1), F.size("same")), lambda x, b: F.struct(x["i"].alias("i"), (x["e"] | b).alias("r"))),
                lambda x: x["r"],
            ),
            lambda x: x["i"],
        )).alias("at"),
    )
    nxt = F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0)))
    return spots.select(
        *keep,
        F.aggregate(F.zip_with("at", nxt, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y).cast("long").alias("n_repeat_words"),
    ).select(id_col, *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``failed``: bit i is set if rule i of RULES fails."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def apply_policy(ledger_df: DataFrame, version: str) -> DataFrame:
    """The ledger plus ``rejected_by`` (failed bits of the policy) and ``kept``."""
    hit = F.col("failed").bitwiseAND(F.lit(policy_mask(version)))
    return ledger_df.withColumn("rejected_by", hit).withColumn("kept", hit == 0)


def ablation(ledger_df: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone (regained without it), and the policy's bit union.

    One pass: documents are pre-aggregated by failure mask, of which there are at most 2^rules.
    """
    mask = policy_mask(version)
    by_mask = ledger_df.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    aggs = []
    names = list(RULES)
    for rule in POLICIES[version]:
        bit = 1 << names.index(rule)
        aggs.append(F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias("n_regained"),
        ).alias(rule))
    total = by_mask.agg(*aggs, F.coalesce(F.bit_or("m"), F.lit(0)).alias("any_bits"))
    return total.select(F.explode(F.array(*[F.col(r) for r in POLICIES[version]])).alias("x"), "any_bits").select("x.*", "any_bits")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: measurements, the base verdict and the verdict of the current policy."""
    rated = apply_policy(ledger(table(spark, sf_dir, "documents")), "2024.2")
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0).alias("base_failed"),
        "kept", "failed", "n_lines", "n_letters", "n_upper",
    )


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's ablation over one stored ledger: the texts are read once, the policies see masks only."""
    stored = materialise(ledger(table(spark, sf_dir, "documents")), "ledger")
    out = None
    for version in POLICIES:
        one = ablation(stored, version).withColumn("policy", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_quality_rules": _query, "quality_ablation": _ablation}

ORACLE: dict[str, str] = {
    "op6_quality_rules": r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
t as (select rid, p, w[p] || chr(32) || w[p + 1] || chr(32) || w[p + 2] as g
      from (select rid, w, unnest(range(1, len(w) - 1)) as p from w)),
r as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as n from t) where n > 1),
c as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from r) group by rid),
m as (
select d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(w.l) - len(list_distinct(w.l)))::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, len(w.l)::bigint as n_lines,
  length(regexp_replace(d.text, '\P{L}+', '', 'g'))::bigint as n_letters,
  length(regexp_replace(d.text, '\P{Lu}+', '', 'g'))::bigint as n_upper
from d join w using (rid) left join c using (rid)),
f as (select *, (
  case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
  + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when word_chars < 3 * n_words then 8 else 0 end
  + case when word_chars > 12 * n_words then 16 else 0 end + case when 100 * n_dup_lines > 30 * n_lines then 32 else 0 end
  + case when 100 * n_upper > 60 * n_letters and n_letters > 0 then 64 else 0 end + case when n_letters = 0 then 128 else 0 end)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed,
  failed = 0 as kept, failed, n_lines, n_letters, n_upper from f""",
}


def _ablation_oracle() -> str:
    names, parts = list(RULES), []
    for version, rules in POLICIES.items():
        mask = policy_mask(version)
        for rule in rules:
            bit = 1 << names.index(rule)
            parts.append(f"select '{version}' as policy, '{rule}' as rule, count(*) filter (failed & {bit} <> 0) as n_failed, count(*) filter (failed & {mask} = {bit}) as n_regained, coalesce(bit_or(failed & {mask}), 0)::bigint as any_bits from q")
    return f"with q as ({ORACLE['op6_quality_rules']})\n" + "\nunion all ".join(parts)


ORACLE["quality_ablation"] = _ablation_oracle()
