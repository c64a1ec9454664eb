"""Curation of texts and raw model replies with native functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C

#: Patterns. Fixed values.
SECRET = r"(?i)(password|passwd|api[_ -]?key|secret|token)\s*(is|:|=)|sk-[A-Za-z0-9]{10,}"
REFUSAL = r"(?i)^\s*(sorry|i can't|i cannot|i'm sorry|as an ai)"


SEPARATOR_ROW = r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$"
FENCE = r"(?s)^```(?:markdown|md)?\s*\n(.*)\n```$"
FORMULA = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"
TAG = r"<(/?)([a-zA-Z][\w-]*)([^>]*)>"
ALLOWED_TAGS = ("details", "summary", "blockquote", "sub", "sup", "u")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_markup(text: Column) -> Column:
    """Without URLs, emphasis marks, code ticks and heading marks; blank lines squeezed."""
    for pattern, to in ((r"https?://\S+", ""), (r"\*\*|__|`", ""), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def accepted(text: Column, low: int = 60, high: int = 3500) -> Column:
    return F.length(text).between(low, high) & ~text.rlike(REFUSAL)


def has_secret(text: Column) -> Column:
    return text.rlike(SECRET)


def tables_ok(text: Column, most: int = 6) -> Column:
    """Every pipe table has a separator as its second row, one column count, and at most ``most`` columns."""
    lines = F.split(text, r"\r?\n")
    rows = F.transform(lines, lambda x: F.when(F.trim(x).startswith("|"), F.size(F.split(F.trim(F.trim(x), F.lit("|")), r"\|"))))
    marks = F.transform(lines, lambda x: F.trim(x).rlike(SEPARATOR_ROW))
    start = F.struct(F.lit(0).alias("row"), F.lit(0).alias("cols"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        inside, n = x["n"].isNotNull(), F.coalesce(x["n"], F.lit(0))
        row = F.when(inside, acc["row"] + 1).otherwise(0)
        good = F.when(~inside, acc["row"] != 1).when(row == 1, n <= most).when(row == 2, x["m"] & (n == acc["cols"])).otherwise(n == acc["cols"])
        return F.struct(row.alias("row"), F.when(row == 1, n).otherwise(acc["cols"]).alias("cols"), (acc["ok"] & good).alias("ok"))

    return F.aggregate(F.zip_with(rows, marks, lambda n, m: F.struct(n.alias("n"), m.alias("m"))), start, step, lambda acc: acc["ok"] & (acc["row"] != 1))


def rich_text(text: Column) -> Column:
    """The text of a rich post: an outer fence unwrapped, links and URLs dropped, blank lines squeezed. Null stays null."""
    text = strip(text)
    for pattern, to in ((FENCE, "$1"), (r"\[([^\]]*)\]\(https?://[^)]*\)", "$1"), (r"https?://\S+", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def rich_accepted(text: Column, low: int = 60, high: int = 6000) -> Column:
    """No refusal, every formula closed, allowed tags only and each as often closed as opened, sound tables. Null is not accepted."""
    count = lambda marks, mark: F.size(F.filter(marks, lambda m: m == mark))

    def balanced(marks: Column) -> Column:
        ok = F.forall(marks, lambda m: F.ltrim(m, F.lit("/")).isin(*ALLOWED_TAGS))
        for name in ALLOWED_TAGS:
            ok = ok & (count(marks, name) == count(marks, f"/{name}"))
        return ok

    def sound(flat: Column) -> Column:
        ends, names = (F.regexp_extract_all(flat, F.lit(TAG), F.lit(g)) for g in (1, 2))
        return ~F.contains(flat, F.lit("$")) & let(F.zip_with(ends, names, lambda a, b: F.lower(F.concat(a, b))), balanced)

    whole = lambda t: accepted(t, low, high) & let(F.regexp_replace(t, FORMULA, "M"), sound) & tables_ok(t)
    return F.coalesce(let(text, whole), F.lit(False))


def parse_reply(raw: Column) -> Column:
    """Elements of ``facts`` of a raw reply as JSON texts: what stands between the first and the last brace, parsed; null if it doesn't parse."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "facts array<string>")["facts"]


def fact_rows(df: DataFrame, raw: str, key: str, most: int = 3) -> DataFrame:
    """At most ``most`` facts per message, without empty, over-long and secret ones; defaults other and 3.

    An element is an object with a text, or a plain string. A reply that doesn't parse gives no rows.
    """
    rows = df.select(key, F.posexplode(parse_reply(F.col(raw))).alias("pos", "e"))
    field = lambda name: F.when(F.trim("e").startswith("{"), F.get_json_object("e", f"$.{name}"))
    rows = rows.select(key, "pos", strip(F.when(F.trim("e").startswith("{"), F.coalesce(field("text"), F.lit(""))).otherwise(F.col("e"))).alias("memory"),
                       F.coalesce(F.nullif(field("type"), F.lit("")), F.lit("other")).alias("type"), F.coalesce(F.nullif(field("importance").try_cast("int"), F.lit(0)), F.lit(3)).alias("importance"))
    good = rows.where((F.col("memory") != "") & (F.length("memory") <= 300) & ~has_secret(F.col("memory")))
    return good.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= most).drop("_n", "pos")


def entity_candidates(df: DataFrame, raw: str, key: str, least: float = 0.60) -> DataFrame:
    """(key, name, type, confidence, aliases, description) of the entities in replies: one per case-folded name, the most certain; at least ``least``."""
    element = "struct<name:string,type:string,confidence:string,aliases:array<string>,description:string>"
    rows = df.select(key, F.posexplode(F.from_json(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), f"entities array<{element}>")["entities"]).alias("pos", "e"))
    name = C.norm_name(F.col("e.name"))
    rows = rows.select(key, "pos", name.alias("name"), C.norm_entity_type(F.col("e.type")).alias("type"), C.clamp_confidence(F.col("e.confidence"), 0.0, 1.0, 0.0).alias("confidence"),
                       C.clean_aliases(F.col("e.aliases"), name, 10).alias("aliases"), F.substring(F.trim(F.coalesce("e.description", F.lit(""))), 1, 500).alias("description"))
    cols = ("name", "type", "confidence", "aliases", "description")
    best = rows.where((F.col("name") != "") & (F.col("confidence") >= least)).groupBy(key, C.canonical_name(F.col("name")).alias("_c")).agg(F.max_by(F.struct(*cols), F.struct("confidence", -F.col("pos"))).alias("x"))
    return best.select(key, *[f"x.{c}" for c in cols])


def relation_candidates(df: DataFrame, raw: str, key: str, known: DataFrame, least: float = 0.65) -> DataFrame:
    """(key, source, target, relation, confidence) of the relations in replies whose two ends are known names (known: entity_id, name)."""
    element = "struct<source:string,target:string,relation:string,confidence:string,evidence:string>"
    rows = df.select(key, F.explode(F.from_json(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), f"relations array<{element}>")["relations"]).alias("e"))
    rows = rows.select(key, C.canonical_name(F.col("e.source")).alias("s"), C.canonical_name(F.col("e.target")).alias("t"), C.canonical_relation(F.col("e.relation")).alias("relation"),
                       C.clamp_confidence(F.col("e.confidence"), 0.0, 1.0, 0.0).alias("confidence"), F.substring(F.trim(F.coalesce("e.evidence", F.lit(""))), 1, 500).alias("evidence"))
    good = rows.where((F.col("s") != F.col("t")) & F.col("relation").isin(*C.RELATIONS) & (F.col("confidence") >= least))
    names = known.groupBy(C.canonical_name(F.col("name")).alias("n")).agg(F.min("entity_id").alias("id"))
    good = good.join(names.select(F.col("n").alias("s"), F.col("id").alias("source")), "s").join(names.select(F.col("n").alias("t"), F.col("id").alias("target")), "t")
    return good.where("source <> target").select(key, "source", "target", "relation", "confidence", "evidence")


def evolution_candidates(df: DataFrame, raw: str, key: str, known: DataFrame) -> DataFrame:
    """(key, entity_id, action, new_name, new_type, aliases) of the CHANGE and END entries in replies for known entities."""
    element = "struct<entity_id:string,action:string,new_name:string,new_type:string,aliases:array<string>>"
    rows = df.select(key, F.explode(F.from_json(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), f"evolutions array<{element}>")["evolutions"]).alias("e"))
    rows = rows.select(key, F.trim("e.entity_id").alias("entity_id"), F.upper(F.trim("e.action")).alias("action"), C.norm_name(F.col("e.new_name")).alias("new_name"), "e.new_type", C.clean_ids(F.col("e.aliases"), 10).alias("aliases"))
    return rows.where(F.col("action").isin("CHANGE", "END")).join(known.select(F.col("entity_id").cast("string").alias("entity_id")).distinct(), "entity_id", "left_semi")
