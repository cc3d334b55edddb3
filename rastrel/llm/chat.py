"""Chat formatting by relational expressions: sorted turn structs, merged roles, reversible escapes, loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The control strings of the template.
START, TURN, SAYS, PART, END = "<s>", "[INST]", "[/INST]", "[SEP]", "</s>"
#: A control string, with any number of backslashes after its first character; escaping adds one, reading removes one.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SEP\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|SEP\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (array of start, length in code points from 0), n_merged.

    `<s>`, then for each run of turns of one role `[INST]role[/INST]text[SEP]text</s>`; control strings in texts
    and roles are escaped. Loss spans cover each assistant text. Rows are ordered by turn, then role and text, so
    ties and repeated rows all stay, in that order. Null text, role: empty; null turn: first; a null conv_id is a
    conversation; an empty table gives no rows; other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def segments(t):
        def one(x, i):
            first = i == 0
            new = first | (F.get(t, i - 1)["role"] != x["role"])
            head = F.when(first, F.lit(START + TURN)).otherwise(F.lit(END + TURN))
            head = F.when(new, F.concat(head, escape(x["role"]), F.lit(SAYS))).otherwise(F.lit(PART))
            return F.struct(head.alias("head"), escape(x["text"]).alias("body"), (x["role"] == LOSS_ROLE).alias("loss"), new.alias("new"))

        return F.transform(t, one)

    talks = talks.select("conv_id", let(F.col("t"), segments).alias("s"))
    empty = F.array().cast("array<struct<start:int,length:int,loss:boolean>>")

    def place(acc, x):
        start, n = acc["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.struct(start.alias("start"), n.alias("length"), x["loss"].alias("loss"))
        return F.struct((start + n).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate("s", F.struct(F.lit(0).alias("at"), empty.alias("spans")), place, lambda a: a["spans"])
    loss = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return talks.select(
        "conv_id",
        F.concat(F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"])), ""), F.lit(END)).alias("formatted"),
        loss.alias("loss_spans"),
        F.size(F.filter("s", lambda x: x["new"])).cast("long").alias("n_merged"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns of each conversation, read from its formatted string alone: conv_id, turns (array of role, text)."""
    runs = F.filter(F.split(F.substr("formatted", F.lit(len(START) + 1)), END), lambda x: x != "")

    def turns(run):
        cut = F.split(F.substr(run, F.lit(len(TURN) + 1)), r"\[/INST\]", 2)
        return let(cut, lambda c: F.transform(F.split(F.get(c, F.lit(1)), r"\[SEP\]"), lambda p: F.struct(unescape(F.get(c, F.lit(0))).alias("role"), unescape(p).alias("text"))))

    return formatted.select("conv_id", "formatted", "loss_spans", F.flatten(F.transform(runs, turns)).alias("turns"))


def digest(rows: DataFrame) -> DataFrame:
    """Digest of what the output holds: turns, text under the loss mask, lengths."""
    made = format_conversations(rows)
    back = read_back(made)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"]))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        loss.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
