"""Chat formatting by Spark expressions only: sorted turn structs, merged runs of a role, one concatenation.

A block is ``<|im_start|>role\\n`` + texts + ``<|im_end|>\\n``; the texts of adjacent turns of one role are one block with
``<|im_sep|>`` between. Control strings of this and of other common templates inside a text get a backslash
after their first character; one that has backslashes there already gets one more, so that it can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = r"\||/?s>|/?INST\]|/?SYS>|(?:start|end)_of_turn>|bos>|eos>"
_PLAIN, _ESCAPED = rf"([<\[])(\\*)({_CONTROL})", rf"([<\[])\\(\\*)({_CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_col, formatted, segments) for every conversation; each row with a null conv_col is one by itself.

    segments: array of (text, loss), which concatenate to formatted; loss marks each text of the role ``learn``, and
    nothing else. Turns go by turn_col, nulls first, then by role and text; equal rows are turns of their own. Null
    roles and texts are empty strings. A conversation is one output value and so must fit a row, as its text does.
    Other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).alias("at"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows that name no conversation have nothing in common, however many they are.
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(conv_col).alias("conv"), alone.alias("alone"), turn.alias("turn"))
    sorted_ = rows.groupBy("conv", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumnRenamed("conv", conv_col)
    n = F.size("turns")

    def part(t: Column, i: Column) -> Column:
        """The segments of turn i: what opens or continues its block, its text, and what ends the block."""
        role = lambda j: F.get("turns", j)["role"]
        joins = (i > 0) & (role(i - 1) == t["role"])
        ends = (i == n - 1) | (role(i + 1) != t["role"])
        head = F.when(joins, F.lit(SEP)).otherwise(F.concat(F.lit(START), _role_in(t["role"]), F.lit("\n")))
        segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"]), t["role"] == learn), segment(F.when(ends, F.lit(f"{END}\n")).otherwise(F.lit("")), F.lit(False)))

    out = sorted_.select(conv_col, F.flatten(F.transform("turns", part)).alias("segments"))
    return out.select(conv_col, F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "segments")


def read_chats(formatted: Column) -> Column:
    """array of (role, text), the turns of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.split_part(block, F.lit("\n"), F.lit(1))
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - F.lit(len(END) + 2))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda s: F.struct(_role_out(role).alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped, without anything between."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from format_chats(): numbers and digests of turns and of learned text."""
    turns = read_chats(F.col("formatted"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    out = formatted.withColumns({"turns": turns, "learned": learned_text(F.col("segments"))})
    return out.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
