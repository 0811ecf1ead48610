"""Chat formatting as one relational plan: no Python runs on the rows.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged by array
functions; a template of control strings marks the merged messages:

    <s>[INST] role\\ntext[SEP]text [/INST]</s>

Control strings inside texts are escaped by a tilde after their first character (and so are escaped ones, by one
more), so parsed() gets every turn back exactly. loss_spans are the (start, length) of each assistant text within the
formatted text, in code points from 0.

Results in special cases: a null text counts as empty, a null role as the empty role; turns sort by (turn, role,
text), nulls first, so ties and repeated rows keep every row in a fixed order; rows with a null conversation form one
conversation; an empty table gives an empty one; other columns are ignored, whatever their names. A conversation
is one output row, so it must fit into a task as its formatted text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import text_or_empty

OPEN, SEP, CLOSE = "<s>[INST] ", "[SEP]", " [/INST]</s>"
#: A control string or an escaped one, after its first character.
TAIL = r"(/?(?:s>|INST\]|SEP\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(~*){TAIL}", "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])~(~*){TAIL}", "$1$2$3")


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: the runs of turns (role, text, opens) that begin where opens is true, each as one message; every turn is looked at once."""
    n = F.size(turns)
    opens = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(turns, i)["opens"])
    runs = F.arrays_zip(opens.alias("a"), F.concat(F.slice(opens, F.lit(2), F.size(opens)), F.array(n + 1)).alias("b"))
    return F.transform(runs, lambda r: F.struct(F.element_at(turns, r["a"])["role"].alias("role"), F.transform(F.slice(turns, r["a"], r["b"] - r["a"]), lambda t: t["text"]).alias("texts")))


def formatted(conversations: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id") -> DataFrame:
    """(conversation, formatted string, loss_spans array<struct<start long, length long>>) of each conversation.

    conversations has (conversation, turn, role, text), a row for each turn. Where a turn's text will stand is a running sum
    over the turns before it, taken in the same pass of the conversation that tells where messages begin.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("raw"))
    rows = rows.select("conv", "turn", "role", "raw", escaped(F.col("raw")).alias("text"))
    by = Window.partitionBy("conv").orderBy("turn", "role", "raw")
    told = rows.select("conv", "role", "text", F.row_number().over(by).alias("at"), (~F.lag("role").over(by).eqNullSafe(F.col("role"))).alias("opens"))
    head = F.length(F.url_encode("role")) + len(OPEN) + 1
    before = F.when(F.col("at") == 1, head).when(F.col("opens"), head + len(CLOSE)).otherwise(len(SEP))
    up_to = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("text").cast("long")
    placed = told.withColumn("start", F.sum(before + length).over(up_to) - length)
    every = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "opens", "start"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == F.lit(loss_role)), lambda t: F.struct(t["start"].alias("start"), F.length(t["text"]).cast("long").alias("length")))
    out = every.select("conv", merged(F.col("turns")).alias("messages"), spans.alias("loss_spans"))
    whole = F.array_join(F.transform("messages", lambda m: F.concat(F.lit(OPEN), F.url_encode(m["role"]), F.lit("\n"), F.array_join(m["texts"], SEP), F.lit(CLOSE))), "")
    return out.select(F.col("conv").alias(conv_col), whole.alias("formatted"), "loss_spans")


def parsed(text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, as they went in."""
    messages = F.slice(F.split(text, r"<s>\[INST\] "), 2, F.lit(1 << 30))

    def turns(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        body = F.substring(m, F.length(role) + 2, F.length(m) - F.length(role) - F.lit(1 + len(CLOSE)))
        return F.transform(F.split(body, r"\[SEP\]"), lambda t: F.struct(F.url_decode(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def under_mask(text: Column, spans: Column) -> Column:
    """array<string>: the unescaped text of each span."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int"))))
