"""Chat formatting: records of many layouts become canonical turns, turns become one escaped text with a loss mask.

A record is a JSON object. Its nested field paths (types left out) are hashed; the hash selects a declared mapping
that reads the turns. Records whose hash has no mapping come back in ``unmapped_records``, none is lost.

Template: ``<s>`` then for each turn ``<|turn|>role<|text|>text<|end|>``, then ``</s>``. Inside roles and texts a
backslash is doubled and one is set behind the first character of every control string, so no control string is
left there and dropping a single (or halving a double) backslash gives the text back.

Defined cases: a NULL text or role is empty; a NULL turn number sorts first; equal turn numbers are ordered by role
and text; repeated rows stay; a conversation of a NULL id is one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.session import cut_lineage, load_table

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
# fixed values: the strings that mark turns here or in other common templates
CONTROL = r"(<|\[)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|)"


def _shape(example) -> str:
    """Canonical text of nested field paths: names sorted, every scalar written as ``_``."""
    if isinstance(example, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_shape(example[k])}" for k in sorted(example)) + ">"
    if isinstance(example, list):
        return f"ARRAY<{_shape(example[0])}>"
    return "_"


@dataclass(frozen=True)
class Layout:
    """A declared layout: its nested fields, and either roles with their field or one list of turns."""

    name: str
    fields: dict
    parts: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] = ()
    row: tuple[str, str, str] = ()

    def fingerprint(self) -> str:
        return hashlib.sha256(_shape(self.fields).encode()).hexdigest()

    def turns(self, record: Column) -> Column:
        if self.row:
            turn, role, text = (F.get_json_object(record, f"$.{p}") for p in self.row)
            return F.array(F.struct(turn.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))).cast(TURNS)
        if self.each:
            path, role, text = self.each
            items = F.from_json(record, f"struct<`{path}`: array<struct<`{role}`: string, `{text}`: string>>>")[path]
            named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
            return F.transform(items, lambda x, i: F.struct(
                i.cast("bigint").alias("turn"), F.coalesce(F.try_element_at(named, x[role]), x[role]).alias("role"), x[text].alias("text"))).cast(TURNS)
        made = [F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.get_json_object(record, f"$.{path}").alias("text"))
                for i, (role, path) in enumerate(self.parts)]
        return F.filter(F.array(*made), lambda x: F.coalesce(x["text"], F.lit("")) != "").cast(TURNS)


LAYOUTS = (
    Layout("turn row", {"turn": 0, "role": "", "text": ""}, row=("turn", "role", "text")),
    Layout("prompt and response", {"prompt": "", "response": ""}, parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", {"prompt": "", "completion": ""}, parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", {"instruction": "", "output": ""}, parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", {"instruction": "", "input": "", "output": ""},
           parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", {"messages": [{"role": "", "content": ""}]}, each=("messages", "role", "content")),
    Layout("conversations", {"conversations": [{"from": "", "value": ""}]}, each=("conversations", "from", "value")),
)
# fixed values: names of the speakers in other layouts
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text; NULL when it is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(shape, r"(?<=[:<] ?)(?!OBJECT<|ARRAY<)[A-Z]+(\(\d+, ?\d+\))?(?=[,>])", "_"), 256)


def with_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout (NULL: none is declared) and turns in one form."""
    keyed = records.withColumn("layout_hash", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        hit = F.col("layout_hash") == layout.fingerprint()
        name, turns = F.when(hit, layout.name).otherwise(name), F.when(hit, layout.turns(F.col(record))).otherwise(turns)
    clean = F.transform(turns, lambda t: F.struct(
        t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return keyed.withColumns({"layout": name, "turns": clean})


def unmapped_records(turned: DataFrame) -> DataFrame:
    """Records without a declared layout."""
    return turned.where(F.col("layout").isNull()).drop("turns")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turned: DataFrame, conv: str) -> DataFrame:
    """(conv, formatted, loss): one text per conversation and the code point spans of assistant texts in it."""
    turns = turned.where(F.col("layout").isNotNull()).groupBy(conv).agg(
        F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("own"), F.concat(F.lit("<|turn|>"), escape(t["role"]), F.lit("<|text|>")).alias("head"),
        escape(t["text"]).alias("body")))
    start = F.struct(F.lit("").alias("x"), F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("loss"))
    spans = F.aggregate("pieces", start, lambda acc, p: F.struct(
        F.lit("").alias("x"), (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + 7).alias("at"),
        F.when(p["own"], F.concat(acc["loss"], F.array(F.struct(
            (acc["at"] + F.length(p["head"])).cast("bigint").alias("start"),
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("bigint").alias("stop"))))).otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"])
    joined = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>"))), ""), F.lit("</s>"))
    return turns.select(conv, pieces.alias("pieces")).select(conv, joined.alias("formatted"), spans.alias("loss"))


def parse_formatted(formatted: DataFrame, conv: str) -> DataFrame:
    """(conv, turns, loss_text, formatted_chars) read back from formatted texts and their loss spans."""
    inner = F.regexp_replace("formatted", r"^<s>|(<\|end\|>)?</s>$", "")
    parts = F.filter(F.split(inner, r"<\|end\|>", -1), lambda p: F.startswith(p, F.lit("<|turn|>")))
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(9)), "<|text|>", 1)).alias("role"),
        unescape(F.substring_index(p, "<|text|>", -1)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return formatted.select(conv, turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, read back and digested."""
    columns = ["conv_id", "turn", "role", "text"]
    said = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = load_table(spark, sf_dir, "conversations").select(*columns).union(
        spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    out = cut_lineage(format_conversations(with_turns(rows.select("conv_id", record.alias("record"))), "conv_id"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_formatted(out, "conv_id").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


OP8_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), made as (
  select *, regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\1\\\2', 'g') as erole,
         regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\1\\\2', 'g') as etext from rows
), grouped as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length(erole) + length(etext) + 23) + 7 as chars
  from made group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
       sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from grouped
"""
