"""Chat formatting with Spark expressions only: sorted turn structs, adjacent turns of one role merged by an array aggregate, text joined.

The format of a conversation::

    <turn>ROLE
    TEXT<part>TEXT</turn>
    <turn>...

A block holds adjacent turns of one role, their texts split by ``<part>``. In roles and texts ``\\`` is written ``\\s`` and ``<`` is written
``\\l`` (in roles a line break ``\\n``), so no marker can come from a text and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, PART, CLOSE = "<turn>", "<part>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant") -> DataFrame:
    """Per conversation: its id, ``formatted`` and ``loss_spans``, an array of (start, length) in code points from 0 over the texts of ``train_role``.

    Rows are ordered by turn, then role, then text, so ties and repeated rows have a fixed order and all are kept. A null role or text counts
    as empty, a null turn sorts first, rows with a null conversation id form one conversation. Empty tables give empty results; other columns
    are dropped before the shuffle. One shuffle, on the conversation. A conversation is one output row, so its text must fit one (2 GB).
    """
    rows = turns.select(F.col(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # adjacent turns of one role become one block of parts: a turn opens a block where its role differs from the one before
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    blocks = sorted_turns.withColumn("opens", opens).select(
        conv,
        F.transform("opens", lambda start, k: F.struct(
            F.col("turns")[start]["role"].alias("role"),
            F.transform(F.slice("turns", start + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - start), lambda t: escape(t["text"])).alias("parts"),
        )).alias("blocks"),
    )
    written = blocks.select(conv, F.transform("blocks", lambda b: F.struct(
        b["role"].alias("role"), b["parts"].alias("parts"), F.concat(F.lit(OPEN), F.replace(escape(b["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
        F.array_join(b["parts"], PART).alias("body"),
    )).alias("blocks"))

    # where each block starts is the running length of those before; the same holds for the parts in a block
    spans = F.aggregate(
        "blocks", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda state, b: F.struct(
            (state["at"] + F.length(b["head"]) + F.length(b["body"]) + len(CLOSE)).alias("at"),
            F.when(b["role"] == train_role, F.concat(state["spans"], F.aggregate(
                b["parts"], F.struct((state["at"] + F.length(b["head"])).alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
                lambda inner, p: F.struct(
                    (inner["at"] + F.length(p) + len(PART)).alias("at"),
                    F.concat(inner["spans"], F.array(F.struct(inner["at"].alias("start"), F.length(p).cast("bigint").alias("length")))).alias("spans"),
                ),
                lambda inner: inner["spans"],
            ))).otherwise(state["spans"]).alias("spans"),
        ),
        lambda state: state["spans"],
    )
    return written.select(conv, F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(CLOSE))), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were given."""
    blocks = F.slice(F.split(formatted, OPEN), 2, F.greatest(F.size(F.split(formatted, OPEN)) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, "\n", 1), F.lit("\\n"), F.lit("\n")))
        body = F.substr(block, F.locate("\n", block) + 1, F.length(block) - F.locate("\n", block) - len(CLOSE))
        return F.transform(F.split(body, PART), lambda part: F.struct(role.alias("role"), unescape(part).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    read = formatted.select(conv, "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        conv, F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
