"""Operator 8: chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one event a row: ``conv_id``, ``seq`` (order in the conversation), ``turn``, ``kind``, ``role``, ``text``.

* ``delta``: text streamed onto the end of the turn;
* ``edit``: the turn's text becomes this text; later deltas go on from it;
* ``regenerate``: the turn starts anew with this text, and whatever the log had said of later turns is void.

``fold`` partitions the log by conversation (its one shuffle), orders by ``seq`` and folds the events of each turn: a turn begins at
its last edit or regeneration, events before a regeneration of an earlier turn do not count, the rest is joined in order.  Both are
window aggregates, so a conversation's events are never held as one array.  ``render`` writes the template and the loss mask,
``read_back`` takes both apart again.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Inside role and text a backslash becomes ``\\b`` and the first
letter of every control string becomes ``\\l`` (for <) or ``\\o`` (for [), so that none is left; a newline in a role becomes ``\\n``.
The loss mask is an array of spans (start, length in code points), one for each assistant text.

Defined results: null text is empty, a null role is empty, a null turn or seq comes last; equal seq are told apart by kind and text;
a null conv_id is a conversation of its own; an empty log gives an empty result.  A formatted conversation is one row, so its
whole text meets in one task; that is the result asked for and not a group of the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer may take for control tokens.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_LETTER = {"<": "\\l", "[": "\\o"}
_LAST = (1 << 63) - 1
#: Code points of one streamed delta in the log that is made of whole messages.
DELTA = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for s in CONTROL:
        text = F.replace(text, F.lit(s), F.lit(_LETTER[s[0]] + s[1:]))
    return text


def unescape(text: Column) -> Column:
    """Undoes ``escape``: every backslash there begins a pair, so pairs can be replaced one kind after the other, backslashes last."""
    for letter, pair in (("<", "\\l"), ("[", "\\o"), ("\n", "\\n"), ("\\", "\\b")):
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return text


def log_of_messages(messages: DataFrame) -> DataFrame:
    """The log that whole messages (conv_id, turn, role, text) would have left: each row streamed in deltas.

    Rows of one conversation are numbered by (turn, role, text), so repeated turns stay apart.
    """
    key = [F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = messages.select("conv_id", key[0].alias("_turn"), key[1].alias("role"), key[2].alias("text"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn", "role", "text")).cast("long"))
    deltas = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length("text") - 1), F.lit(DELTA))
    rows = rows.select("conv_id", "turn", "role", "text", F.explode(deltas).alias("_at"))
    return rows.select("conv_id", (F.col("turn") * F.lit(1 << 32) + F.col("_at")).alias("seq"), "turn", F.lit("delta").alias("kind"), "role", F.col("text").substr(F.col("_at") + 1, F.lit(DELTA)).alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, turn, role, text."""
    log = log.select("conv_id", *(F.coalesce(F.col(c).cast("long"), F.lit(_LAST)).alias(c) for c in ("seq", "turn")), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    void = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    log = log.withColumn("_void", void).where(F.col("_void").isNull() | (F.col("seq") > F.col("_void")))
    begin = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(Window.partitionBy("conv_id", "turn"))
    log = log.withColumn("_begin", begin).where(F.col("_begin").isNull() | (F.col("seq") >= F.col("_begin")))
    # at the same seq an edit or regeneration comes before deltas
    event = F.struct("seq", (F.col("kind") == "delta").alias("late"), "text")
    turns = log.groupBy("conv_id", "turn").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), F.sort_array(F.collect_list(event)).alias("events"))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("events.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, formatted, loss_spans."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.select("conv_id", "turn", "learn", F.char_length("head").alias("n_head"), F.char_length("body").alias("n_body"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("learn"), F.struct((before + F.col("n_head")).cast("long").alias("start"), F.col("n_body").cast("long").alias("length")))
    parts = parts.select("conv_id", "turn", "piece", span.alias("span"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return whole.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask say: conv_id, formatted, turns (role, text), learned (texts under the mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: p.substr(F.lit(len(START) + 1), F.char_length(p)))
    turns = F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(b.substr(F.instr(b, "\n") + 1, F.char_length(b))).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("learned", "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
