"""Chat formatting with Spark expressions only.

A conversation becomes one string. A message is START role newline body END newline; adjacent
turns of one role share a message, their texts parted by SEP, so each turn can be read back.
Control strings within roles and texts are escaped: & as &amp;, <| as &lt;| and, in roles, a
newline as &nl;.

Defined cases: null texts and roles are empty; turns sort by turn (null first), then role, then
text, so ties and repeated rows have one order and all are kept; a null conv_id is a conversation
of its own; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def format_conversations(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) of rows (conv_id, turn, role, text).

    loss_mask is run-length coded over the code points of `formatted`: skip, then take; a run per text of
    loss_role, so that separators, heads and ends are skipped."""
    turns = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # 1-based places where a run of one role starts, closed by one past the end
    starts = F.expr("filter(sequence(1, size(turns)), i -> i = 1 or element_at(turns, i).role <> element_at(turns, i - 1).role)")
    cut = sorted_turns.withColumn("starts", F.concat(starts, F.array(F.size("turns") + 1)))
    merged = cut.select("conv_id", "turns", "starts", F.expr("transform(sequence(1, size(starts) - 1), i -> named_struct('role', element_at(turns, element_at(starts, i)).role, 'texts', transform(slice(turns, element_at(starts, i), element_at(starts, i + 1) - element_at(starts, i)), t -> t.text)))").alias("runs"))
    escaped = merged.select("conv_id", F.transform("runs", lambda r: F.struct(r["role"].alias("role"), F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("head"), F.transform(r["texts"], escape).alias("texts"))).alias("runs"))
    body = escaped.select("conv_id", F.transform("runs", lambda r: F.struct(r["role"].alias("role"), r["head"].alias("head"), r["texts"].alias("texts"), F.array_join(r["texts"], SEP).alias("body"))).alias("runs"))
    tail = len(END) + 1
    mask = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("skip"), F.array().cast("array<struct<skip:bigint,take:bigint>>").alias("runs")),
        lambda acc, r: F.when(
            r["role"] == loss_role,
            F.struct(F.lit(tail).cast("long").alias("skip"), F.concat(acc["runs"], F.transform(r["texts"], lambda t, i: F.struct(F.when(i == 0, acc["skip"] + F.length(r["head"])).otherwise(len(SEP)).cast("long").alias("skip"), F.length(t).cast("long").alias("take")))).alias("runs")),
        ).otherwise(F.struct((acc["skip"] + F.length(r["head"]) + F.length(r["body"]) + tail).cast("long").alias("skip"), acc["runs"].alias("runs"))),
        lambda acc: acc["runs"],
    )
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["head"], r["body"], F.lit(END + "\n"))), "")
    return body.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def masked(df: DataFrame) -> Column:
    """The texts that loss_mask takes from `formatted`, unescaped, with nothing between."""
    at = F.aggregate(
        "loss_mask",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("texts")),
        lambda acc, m: F.struct((acc["at"] + m["skip"] + m["take"]).alias("at"), F.concat(acc["texts"], F.array(df["formatted"].substr((acc["at"] + m["skip"]).cast("int"), m["take"].cast("int")))).alias("texts")),
        lambda acc: acc["texts"],
    )
    return F.array_join(F.transform(at, unescape), "")


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): turns array<struct<role, text>> parsed from `formatted` alone, and loss the
    text under loss_mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    messages = F.slice(parts, F.lit(1), F.size(parts) - 1)
    after = len(START) + 1

    def parse(m: Column) -> Column:
        line = F.instr(m, "\n")
        role = unescape_role(F.substring(m, F.lit(after), line - F.lit(after)))
        return F.transform(F.split(F.substring(m, line + 1, F.length(m)), r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return df.select("conv_id", "formatted", F.flatten(F.transform(messages, parse)).alias("turns"), masked(df).alias("loss"))
