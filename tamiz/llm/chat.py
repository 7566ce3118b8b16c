"""Conversations as one training text each, with a loss mask.

The text of a conversation is a row of blocks::

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT ... <|end|>\\n

A block holds a run of adjacent turns of one role. Inside roles and texts ``\\``
is written ``\\\\`` and ``<|`` is written ``<\\|``, so no control string can stem
from a text and every turn can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Code points of the strings that a text is cut into before spans are read.
STEP = 1024


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, "".join("\\" + c if c in "<|>" else c for c in mark), -1)


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conversation``, ``formatted`` string,
    ``loss_spans`` array of struct(start, length): code points of ``formatted``
    under the loss mask, which covers each text of ``loss_role`` and no control
    string.

    Turns are sorted by (turn, role, text), nulls first; equal rows are all
    kept. A null role or text counts as empty; rows with a null conversation
    are one conversation. No rows give no rows. Other columns are ignored,
    whatever their names.

    A conversation is one output value, so it is also the unit of a task.
    """
    rows = turns.select(
        F.col(conversation).alias("c"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # A run of adjacent turns of one role: from its first turn to the next first turn.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s)["text"].alias("texts"),
        ),
    )
    one = (
        sorted_turns.withColumn("starts", starts)
        .select("c", F.posexplode(blocks).alias("k", "b"))
        .select(
            "c",
            "k",
            "b.texts",
            (F.col("b.role") == loss_role).alias("loss"),
            F.concat(F.lit(TURN), escape(F.col("b.role")), F.lit(TEXT)).alias("head"),
        )
    )
    made = one.withColumn("block", F.concat("head", F.array_join("texts", NEXT), F.lit(END)))
    before = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("at", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)) + F.length("head"))
    # Texts of a block follow each other with NEXT between; a second running
    # sum over its texts would only repeat the one over blocks. The block itself
    # goes with its first text alone, not with each.
    items = F.transform(
        F.when(F.col("loss"), F.col("texts")).otherwise(F.array(F.lit(""))),
        lambda x, j: F.struct(
            j.alias("j"), F.length(x).cast("long").alias("n"), F.when(j == 0, F.col("block")).alias("block")
        ),
    )
    texts = placed.select("c", "k", "loss", "at", F.inline(items))
    inside = Window.partitionBy("c", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("at") + F.coalesce(F.sum(F.col("n") + len(NEXT)).over(inside), F.lit(0))
    spans = texts.withColumn("span", F.when(F.col("loss"), F.struct(start.alias("start"), F.col("n").alias("length"))))
    piece = F.struct("k", "j", "block", "span")
    whole = spans.groupBy("c").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    return whole.select(
        F.col("c").alias(conversation),
        F.array_join(F.col("ps")["block"], "").alias("formatted"),
        F.filter(F.col("ps")["span"], lambda s: s.isNotNull()).alias("loss_spans"),
    )


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_blocks(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order: array of struct(role, text).
    Every block is split once, so the time grows with the length of the text."""
    blocks = F.filter(_split(formatted, END), lambda b: b != "")
    halves = F.transform(blocks, lambda b: _split(b, TEXT))
    parts = F.transform(
        halves,
        lambda h: F.struct(
            unescape(F.substr(F.get(h, F.lit(0)), F.lit(len(TURN) + 1))).alias("role"),
            _split(F.get(h, F.lit(1)), NEXT).alias("texts"),
        ),
    )
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                p["texts"], lambda x: F.struct(p["role"].alias("role"), unescape(x).alias("text"))
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, in order, as it was before escaping.

    A code point is found by counting from the start of a string, so the text
    is first cut into strings of ``STEP`` code points: a span is then cut from
    those it touches, and the time grows with the length of the text."""

    def cut(both: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.lit(STEP) * F.floor(s["start"] / STEP)
            numbers = F.sequence(F.floor(s["start"] / STEP).cast("int"), F.floor((s["start"] + s["length"]) / STEP).cast("int"))
            touched = F.array_join(F.transform(numbers, lambda i: F.get(both["pieces"], i)), "")
            return unescape(F.substring(touched, (s["start"] - first + 1).cast("int"), s["length"].cast("int")))

        return F.transform(both["spans"], one)

    pieces = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % STEP), F.lit(0))
    return F.array_join(_with(F.struct(pieces.alias("pieces"), spans.alias("spans")), cut), "")


def conversation_digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    read = formatted.withColumn("turns_back", parse_blocks(F.col("formatted"))).withColumn(
        "loss_back", loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conversation,
        F.size("turns_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_back").cast("long").alias("loss_chars"),
        F.sha2("loss_back", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
