"""Chat formatting by prefix-target expansion (operator 2), in DataFrame functions alone.

A turn is written as ``<s>[INST] role [/INST]text</s>``.  Control strings inside
roles and texts get a backslash after their first character, and backslashes are
doubled before that, so texts come back exactly and no text can forge a turn.

Every assistant turn becomes an example of its own: all preceding turns as
context, then that turn, of whose text alone the loss mask is set.  Turns after
the last assistant turn, and conversations without one, give an example with an
empty mask, so that no turn is lost.

Rows with a null conv_id form one conversation of id null; null turns come
first; turns of equal number are ordered by role, then text; null roles and
texts are empty; repeated rows are turns of their own.  Extra columns play no
part.  An empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINABLE = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for control in CONTROL:
        out = F.replace(out, F.lit(f"{control[0]}\\{control[1:]}"), F.lit(control))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns, text, loss_start, loss_length: code points, from 0; a row for each example."""
    c = conversations
    text, role = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("text", "role"))
    turn = F.struct(c["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
    written = F.transform("turns", lambda t: F.struct((t["role"] == TRAINABLE).alias("target"), head(t).alias("head"), escaped(t["text"]).alias("body")))
    turns = turns.select("conv_id", written.alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    # running ends of the turns in the whole text
    sizes = F.transform("turns", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long"))
    start = F.lit(0).cast("long")
    ends = F.aggregate(sizes, F.array(start), lambda got, n: F.concat(got, F.array(F.element_at(got, -1) + n)))
    turns = turns.select("conv_id", "turns", whole.alias("whole"), ends.alias("ends"))
    last = F.size("turns") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["target"] | (i == last))
    turns = turns.select("conv_id", "turns", "whole", "ends", F.posexplode(wanted).alias("example", "at"))
    own = F.get("turns", F.col("at"))
    from_, to = F.get("ends", F.col("at")), F.get("ends", F.col("at") + 1)
    return turns.select(
        "conv_id",
        "example",
        (F.col("at") + 1).cast("long").alias("n_turns"),
        F.substring("whole", F.lit(1), to.cast("int")).alias("text"),
        (from_ + F.length(own["head"])).alias("loss_start"),
        F.when(own["target"], F.length(own["body"])).otherwise(0).cast("long").alias("loss_length"),
    )


def turns_of(text: Column) -> Column:
    """Roles and texts read back from formatted text."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    cut = lambda p: F.locate(MIDDLE, p)
    return F.transform(parts, lambda p: F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"), unescaped(F.substring(p, cut(p) + len(MIDDLE), F.length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns of its longest example, all text under the loss masks, and code points of its examples."""
    marked = unescaped(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    each = formatted.select("conv_id", "example", "n_turns", "text", marked.alias("loss"), F.length("text").cast("long").alias("chars"))
    found = each.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.count("*").alias("n_examples"),
        F.sum("chars").alias("formatted_chars"),
    )
    found = found.withColumn("turns", turns_of(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(examples(rows.unionByName(more)))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLE_OP2 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length('{OPEN}') + length({_ESCAPED.format("role")}) + length('{MIDDLE}') + length({_ESCAPED.format("text")}) + length('{CLOSE}') as chars,
    row_number() over w as k, count(*) over (partition by conv_id) as n
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
), run as (
  select *, sum(chars) over (partition by conv_id order by k) as so_far from sized
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(so_far) filter (where role = 'assistant' or k = n))::bigint as formatted_chars,
  (count(*) filter (where role = 'assistant' or k = n))::bigint as n_examples
from run group by conv_id
"""
