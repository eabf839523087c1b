r"""Chat formatting from an event log.

A conversation is a log of events: whole messages, streamed deltas, edits and
regenerations. The log is partitioned by conversation, sorted by sequence number
and folded into the final turns, which are then rendered with a loss mask and can
be read back. Only DataFrame functions run here.

Events have conv_id, seq, turn, kind, role and text:

* ``message`` and ``edit`` set the text of a turn,
* ``delta`` is appended to it,
* ``regenerate`` empties a turn for the deltas that follow and drops all later
  turns that were written before it.

The template writes a user turn as ``[INST] text [/INST]``, an assistant turn as
``text</s>`` and any other as ``<|role|>role<|text|>text<|end|>``. Inside texts and
roles a backslash is doubled and each control string gets one after its first
character, so no text can end its turn or start another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SETS = ("message", "edit", "regenerate")
PIECE = r"(?s)\[INST\] .*? \[/INST\]|<\|role\|>.*?<\|end\|>|.*?</s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(\||/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each row is the message of a turn of its own.

    Rows are ordered by turn, role and text, NULL first; repeated rows are
    repeated turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.row_number().over(order).cast("bigint").alias("turn"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def fold(events: DataFrame) -> DataFrame:
    """The final turns of a log: conv_id, turn, role, text.

    NULL roles and texts count as empty, NULL ids are a conversation. Events with
    the same seq apply in the order of kind, then text; an unknown kind counts as
    a delta. A turn has the last role that an event gives it. Deltas of a turn
    that nothing started make its text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "text")
    # How many events have set the turn anew so far; only the last stretch counts.
    stretch = F.sum(F.coalesce(F.col("kind").isin(*SETS), F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.select("conv_id", "seq", "turn", "kind", "role", "text").select(
        "*", stretch.alias("_stretch"), F.row_number().over(order).alias("_at")
    )
    last = F.max("_stretch").over(Window.partitionBy("conv_id", "turn"))
    rows = rows.withColumn("_last", last)
    text = F.when(
        (F.col("_stretch") == F.col("_last")) & ~F.col("kind").eqNullSafe("regenerate"),
        F.struct("_at", F.coalesce("text", F.lit("")).alias("text")),
    )
    turns = rows.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["text"]), "").alias("text"),
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_at"))), F.lit("")).alias("role"),
        F.max("seq").alias("_seq"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.col("_seq") < F.max("_again").over(earlier)
    kept = turns.withColumn("_dropped", F.coalesce(dropped, F.lit(False))).where(~F.col("_dropped"))
    return kept.select("conv_id", "turn", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """Per conversation its formatted text and loss spans: conv_id, formatted, loss_spans.

    A span is the place (from 0, in code points) and length of an assistant's
    escaped text in the formatted text, without the mark that ends the turn.
    """
    said = escape(F.col("text"))
    rows = turns.withColumn("_said", said).withColumn(
        "_piece",
        F.when(F.col("role") == "user", F.concat(F.lit("[INST] "), "_said", F.lit(" [/INST]")))
        .when(F.col("role") == "assistant", F.concat("_said", F.lit("</s>")))
        .otherwise(
            F.concat(F.lit("<|role|>"), escape(F.col("role")), F.lit("<|text|>"), F.col("_said"), F.lit("<|end|>"))
        ),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("_piece")).over(before), F.lit(0)).alias("start")
    rows = rows.select("conv_id", "turn", "role", "_piece", start, F.char_length("_said").alias("length"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.col("length").cast("bigint").alias("length")))
    pieces = F.sort_array(F.collect_list(F.struct("turn", "_piece")))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(pieces, lambda x: x["_piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations, and what the loss mask covers.

    Gives conv_id, place, role, text and loss_text (NULL outside the mask). The
    text is cut once into its pieces; a span is then looked up by where it starts,
    so a long conversation costs no more per turn than a short one.
    """
    pieces = formatted.select("conv_id", F.posexplode(F.regexp_extract_all("formatted", F.lit(PIECE), F.lit(0))).alias("place", "_piece"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_start", F.coalesce(F.sum(F.char_length("_piece")).over(before), F.lit(0)))
    piece = F.col("_piece")
    is_user, is_other = piece.startswith("[INST] "), piece.startswith("<|role|>")

    def part(pattern: str) -> Column:
        return unescape(F.regexp_extract(piece, pattern, 1))

    role = F.when(is_user, "user").when(is_other, part(r"(?s)^<\|role\|>(.*?)<\|text\|>")).otherwise("assistant")
    text = (
        F.when(is_user, part(r"(?s)^\[INST\] (.*) \[/INST\]$"))
        .when(is_other, part(r"(?s)<\|text\|>(.*)<\|end\|>$"))
        .otherwise(part(r"(?s)^(.*)</s>$"))
    )
    spans = formatted.select(F.col("conv_id").alias("_conv"), F.explode("loss_spans").alias("_span"))
    under = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_start") == F.col("_span.start"))
    covered = F.substring(piece, F.lit(1), F.col("_span.length").cast("int"))
    return pieces.join(spans, under, "left").select(
        "conv_id",
        "place",
        role.alias("role"),
        text.alias("text"),
        F.when(F.col("_span").isNotNull(), unescape(covered)).alias("loss_text"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from its formatted text."""
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))

    def joined(column: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(column.isNotNull(), F.struct("place", column.alias("x")))))
        return F.array_join(F.transform(rows, lambda row: row["x"]), "")

    lengths = formatted.select(
        F.col("conv_id").alias("_conv"), F.char_length("formatted").cast("bigint").alias("formatted_chars")
    )
    return (
        read_back(formatted)
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            joined(turn).alias("_turns"),
            joined(F.col("loss_text")).alias("_loss"),
        )
        .join(lengths, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .select(
            "conv_id",
            "n_turns",
            F.sha2("_turns", 256).alias("turns_sha256"),
            F.char_length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
