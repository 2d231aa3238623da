"""Prefix-target expansion of conversations: one training example for every assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: <s>role[INST] text [/INST]</s>.  Control strings inside a role or text get one more backslash behind
# their first character than they had, so no text holds a control string and unescaping gives back every text.
CONTROL = r"s>|/s>|INST\]|/INST\]"
OPEN, ROLE_END, TEXT_END = "<s>", "[INST] ", " [/INST]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*+)(?={CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*+)(?={CONTROL})", r"$1$2")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(ROLE_END), escape(text), F.lit(TEXT_END))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, target, target_turns, formatted, loss_start, loss_end: the training examples of all conversations.

    Example `target` (from 1) of a conversation holds its turns up to the target-th assistant turn; the code points
    [loss_start, loss_end) of `formatted`, the escaped text of that turn, are trainable and nothing else is.  A
    conversation that does not end in an assistant turn gets one more example with all its turns and an empty span,
    so that every turn is in the output.  Turns go by (turn, role, text); null role and text count as empty, a null
    conv_id is a conversation of its own, repeated rows are turns of their own, an empty table gives no rows.  An
    example is one text, so a conversation's turns meet in one row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("is_reply"),
        F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("parts"),
    )
    # Position of the last turn of each example, and whether that turn is its target.
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("is_reply", i) | (i == F.size("parts")))
    cut = parts.select("conv_id", "is_reply", "parts", F.posexplode(ends).alias("at", "end"))
    built = cut.select(
        "conv_id",
        (F.col("at") + 1).cast("long").alias("target"),
        F.col("end").cast("long").alias("target_turns"),
        F.array_join(F.slice("parts", F.lit(1), F.col("end")), "").alias("formatted"),
        F.element_at("is_reply", F.col("end")).alias("trains"),
        F.element_at("parts", F.col("end")).alias("last_part"),
    )
    size = F.char_length("formatted")
    head = F.char_length(F.substring_index("last_part", ROLE_END, 1)) + len(ROLE_END)
    start = F.when(F.col("trains"), size - F.char_length("last_part") + head).otherwise(size)
    end = F.when(F.col("trains"), size - len(TEXT_END)).otherwise(size)
    return built.select(
        "conv_id", "target", "target_turns", "formatted",
        start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct(role, text)> of the turns in a formatted example."""
    pieces = F.slice(F.split(formatted, OPEN), F.lit(2), F.greatest(F.size(F.split(formatted, OPEN)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ROLE_END, 1)
        at = F.char_length(role) + len(ROLE_END)
        text = F.substr(piece, at + 1, F.char_length(piece) - at - len(TEXT_END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def digests(made: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text and loss spans.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn of the last example, which holds all turns),
    loss_chars and loss_sha256 (the unescaped texts under the loss spans, in order), formatted_chars (of all
    examples), n_examples.
    """
    loss = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    each = made.select(
        "conv_id",
        "target",
        F.char_length("formatted").cast("long").alias("size"),
        unescape(loss).alias("loss"),
        F.struct("target", "formatted").alias("whole"),
    )
    whole = each.groupBy("conv_id").agg(
        F.max("whole")["formatted"].alias("formatted"),
        F.sort_array(F.collect_list(F.struct("target", "loss"))).alias("losses"),
        F.sum("size").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    read = whole.select(
        "conv_id",
        "formatted_chars",
        "n_examples",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def probe_turns(turns: DataFrame) -> DataFrame:
    """The conversation -7 that the query adds: two turns whose text is made of control strings."""
    types = dict(turns.dtypes)
    text = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.range(2).select(
        F.lit(-7).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return rows.select(*(F.col(c).cast(types[c]).alias(c) for c in rows.columns))


def format_conversations(turns: DataFrame) -> DataFrame:
    """The digests of the examples of all conversations and of the probe."""
    own = turns.select("conv_id", "turn", "role", "text")
    return digests(examples(own.unionByName(probe_turns(own))))
