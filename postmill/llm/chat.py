"""Chat formatting by token-level assembly.

Role names and texts are encoded on their own, so no token ever spans a border; turns are marked with reserved ids that no text
encodes to. Control strings that occur in a text are escaped first, so that the formatted string shows them only where the template
put them. The loss mask is a list of token spans, found by prefix sums over the lengths of the segments.

A turn is ``<s>[INST]role[/INST]text</s>``; the loss covers the texts of assistant turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.bpe import RANKS, Utf8Stream, read_ranks
from postmill.llm.common import text_of

# Control strings, in the order of their reserved ids, which follow the vocabulary's last.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
FIRST_RESERVED = 50256
OPEN, ROLE, TEXT, CLOSE = range(FIRST_RESERVED, FIRST_RESERVED + len(CONTROLS))
# A control string after its first character, and any backslashes an escape has put (or the text had) between the two.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """One backslash more behind the first character of each control string, and of what already looks like an escaped one."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    reserved = {control: FIRST_RESERVED + at for at, control in enumerate(CONTROLS)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens=reserved)


def _encoder(path: str):
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield texts.map(encoding.encode_ordinary)

    return encode


def _decoder(path: str):
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)

        def text_of_ids(ids) -> str:
            stream = Utf8Stream()
            return stream.feed(encoding.decode_bytes([int(i) for i in ids])) + stream.end()

        for lists in batches:
            yield lists.map(text_of_ids)

    return decode


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Conversations as tokens: conv_id, ids, spans (start and end of each learned stretch of ids, in order), n_turns.

    ``turns`` holds conv_id, turn, role and text. Turns are put in order by turn, then role and text; null roles and texts are
    empty, null turns come first. A turn is encoded where it lies; its ids travel to the conversation, with the role and text that put
    turns of one number in order.
    """
    path = path or public_tokenizers.path(RANKS)
    encode = _encoder(path)
    parts = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"),
    )
    segments = parts.withColumn("_role", encode(escaped(F.col("role")))).withColumn("_text", encode(escaped(F.col("text"))))
    head = F.concat(F.array(F.lit(OPEN), F.lit(ROLE)), F.col("_role"), F.array(F.lit(TEXT)))
    ids = F.concat(head, F.col("_text"), F.array(F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.select(
        "conv_id", "turn", "role", "text", ids.alias("_ids"), F.size(head).alias("_head"), F.size("_text").alias("_body")
    ).withColumn("_nth", F.row_number().over(order)).withColumn(
        "_start", (F.coalesce(F.sum(F.size("_ids")).over(earlier), F.lit(0)) + F.col("_head")).cast("int")
    )
    span = F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_body")).alias("end"))
    turn = F.struct("_nth", "_ids", F.when(F.col("role") == LEARNED, span).alias("_span"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    spans = F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull())
    return gathered.select(
        "conv_id", F.flatten(F.transform("_turns", lambda t: t["_ids"])).alias("ids"), spans.alias("spans"),
        F.size("_turns").cast("bigint").alias("n_turns"),
    )


def mask_of(ids: Column, spans: Column) -> Column:
    """The loss mask as one 0 or 1 per id: a running sum over the borders of the spans."""
    gaps = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    until = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(ids)))
    off = F.transform(F.arrays_zip(gaps.alias("a"), until.alias("b")), lambda g: F.array_repeat(F.lit(0), g["b"] - g["a"]))
    on = F.concat(F.transform(spans, lambda s: F.array_repeat(F.lit(1), s["end"] - s["start"])), F.array(F.array().cast("array<int>")))
    return F.flatten(F.transform(F.arrays_zip(off.alias("a"), on.alias("b")), lambda g: F.concat(g["a"], g["b"])))


def rendered(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """``formatted`` with what its ids say: ``text``, the formatted string, and ``learned``, the unescaped text under the mask.

    Each stretch under the mask is decoded on its own.
    """
    path = path or public_tokenizers.path(RANKS)
    decode = _decoder(path)
    joined = F.flatten(F.transform("spans", lambda s: F.concat(F.slice("ids", s["start"] + 1, s["end"] - s["start"]), F.array(F.lit(CLOSE)))))
    both = formatted.withColumn("text", decode("ids")).withColumn("_learned", decode(joined))
    stretches = F.slice(F.split("_learned", CONTROLS[-1]), 1, F.size("spans"))
    return both.withColumn("learned", F.array_join(F.transform(stretches, unescaped), "")).drop("_learned")


def read_turns(text: Column) -> Column:
    """Roles and texts read back from a formatted string: an array of (role, text)."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "[/INST]", 1)
        body = F.substr(piece, F.char_length(role) + len("[/INST]") + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(body, F.lit(1), F.char_length(body) - len("</s>"))).alias("text"))

    return F.transform(F.slice(F.split(text, r"<s>\[INST\]"), 2, 1 << 30), turn)


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Conversations formatted and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids, n_loss_ids.

    A null conv_id is a conversation. Repeated rows are turns of their own; ties of turn go by role, then text. An empty table gives
    no rows; other columns are ignored.
    """
    read = rendered(format_turns(turns, path), path).withColumn("_turns", read_turns(F.col("text")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("text").cast("bigint").alias("formatted_chars"), F.size("ids").cast("bigint").alias("n_ids"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("bigint").alias("n_loss_ids"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose two texts are made of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)
