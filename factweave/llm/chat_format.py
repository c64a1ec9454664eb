"""Chat formatting by schema fingerprints.

A record is a JSON text in one of several layouts (messages, from/value pairs, prompt and response,
instruction and output). The nested field paths of each record are hashed; the hash selects a
declarative mapping to canonical turns. Turns are written with marks around each turn, control strings
inside texts are escaped reversibly, and a loss mask lists the character spans of assistant texts.

Defined cases: null texts and roles are empty strings; a record whose fingerprint no mapping knows
keeps its row with null turns and layout; an empty list of messages gives no turns; turns with one
number are ordered by role, then text; repeated turns stay.
A conversation is one record and so has to fit one row; conversations are never joined to one another. Paths are read from
a skeleton, the record with its string values emptied, so records of every size go one way and the parser's limit on strings
(20 million characters) isn't met; texts are read with a reader whose limit is lifted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Other names of the roles. Fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"
#: A JSON string: quotes around plain characters and whole escapes. Anything else that starts with a quote is left for the parser to refuse.
BODY = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
READER = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: a list of (role, field), or an array field with role and text fields."""

    layout: str
    shape: str
    fields: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None
    rename: bool = False

    def schema(self) -> str:
        if self.array:
            name, role, text = self.array
            return f"{name} array<struct<`{role}`:string,`{text}`:string>>"
        return ", ".join(f"`{field}` string" for _, field in self.fields)

    def turns(self, record: Column) -> Column:
        parsed = F.from_json(record, self.schema(), READER)
        if self.array is None:
            return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(parsed[field], F.lit("")).alias("text")) for role, field in self.fields])
        name, role, text = self.array
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])

        def turn(x: Column) -> Column:
            said = F.coalesce(x[role], F.lit(""))
            said = F.coalesce(F.element_at(names, said), said) if self.rename else said
            return F.struct(said.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.coalesce(F.transform(parsed[name], turn), F.array().cast(TURNS))


MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", array=("messages", "role", "content")),
    Mapping("messages", "OBJECT<messages: ARRAY<_>>", array=("messages", "role", "content")),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", array=("conversations", "from", "value"), rename=True),
    Mapping("prompt_response", "OBJECT<prompt, response>", (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_response", "OBJECT<prompt, response, system>", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction_output", "OBJECT<instruction, output>", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_output", "OBJECT<input, instruction, output>", (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def _hash(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()[:16]


def skeleton(record: Column) -> Column:
    """A record with the same paths, its string values empty; names and faulty strings stay as they are, the latter taken up to their fault so that none is read from each of its quotes."""
    return F.regexp_replace(record, rf'("{BODY}"\s*+:\s*+)(?:("){BODY}("))?+|("){BODY}(")|("{BODY})', "$1$2$3$4$5$6")


def shape(record: Column) -> Column:
    """Nested field paths of a JSON record in canonical order, leaf types left out. Null if it is not JSON."""
    described = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    kind = r"(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\([0-9,]+\)|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|VARIANT)"
    return F.regexp_replace(F.regexp_replace(described, rf": {kind}(?=[,>])", ""), rf"(?<=<){kind}(?=>)", "_")


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(shape(record), 256), 1, 16)


def to_turns(records: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` plus fingerprint, layout and turns; the record column is read once per mapping that fits it."""
    marked = records.withColumn("fingerprint", fingerprint(F.col(record_col)))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in mappings:
        fits = F.col("fingerprint") == _hash(m.shape)
        turns = F.when(fits, m.turns(F.col(record_col))).otherwise(turns)
        layout = F.when(fits, m.layout).otherwise(layout)
    return marked.withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``df`` plus ``formatted`` and ``loss_mask``: array of [start, end) in code points, one per assistant turn."""
    safe = df.withColumn("_fw_safe", F.transform(turns_col, lambda t: F.struct(
        escape_role(t["role"]).alias("r"), escape(t["text"]).alias("t"), (t["role"] == "assistant").alias("a"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(t["r"]) + 1
        end = begin + F.length(t["t"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE) + 1).alias("at"), F.when(t["a"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return safe.withColumns({
        "formatted": F.array_join(F.transform("_fw_safe", lambda t: F.concat(F.lit(OPEN), t["r"], F.lit("\n"), t["t"], F.lit(CLOSE + "\n"))), ""),
        "loss_mask": F.aggregate("_fw_safe", start, step, lambda acc: acc["spans"]),
    }).drop("_fw_safe")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text, unescaped: the inverse of ``format_turns``."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        rest = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - (len(CLOSE) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id and one JSON record per conversation, in the layout that its roles allow."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).withColumn("r", F.transform("t", lambda x: x["role"]))
    text = lambda i: F.get("t", F.lit(i))["text"]
    number = F.coalesce(F.pmod(F.col("conv_id"), F.lit(6)), F.lit(0))
    pair = F.col("r") == F.array(F.lit("user"), F.lit("assistant"))
    known = F.forall("r", lambda x: x.isin("user", "assistant", "system"))
    other = lambda x: F.when(x == "user", "human").when(x == "assistant", "gpt").otherwise(x)
    return per.select("conv_id", (
        F.when(pair & (number % 2 == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(pair & (number % 3 == 0), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when((F.col("r") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (number % 2 == 0),
              F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(known & (number % 3 == 1), F.to_json(F.struct(F.transform("t", lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    ).alias("record"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    done = format_turns(to_turns(records_of(rows.unionByName(extra)), "record")).select("conv_id", "layout", "formatted", "loss_mask")
    back = done.withColumns({"back": read_back(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_mask"))})
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_chat_formatting": _query}

ORACLE: dict[str, str] = {
    "op4_chat_formatting": f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
e as (select *, 24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
        + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from e group by conv_id""",
}
