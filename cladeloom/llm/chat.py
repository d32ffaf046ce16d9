"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it are the
text, and only that reply lies under the loss mask. A turn is written as
``[INST] role\\ntext</s>``. Inside roles and texts the characters that could form a
control string are escaped reversibly, so a text that holds ``</s>`` or ``[INST]``
cannot open or close a turn.

Defined results: null roles and texts are empty; a null ``conv_id`` is one
conversation, a null ``turn`` comes first; rows of one turn are ordered by role
and text and all are kept; a conversation that does not end with an assistant
turn has one more example, of all turns and without a mask, so that no turn is
lost; no rows give no examples. Columns besides the four named ones are ignored.
An example holds its whole context in one row, so a conversation must fit into
one task's memory, as the output form demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "[INST] "
CLOSE = "</s>"
CODES = [("~", "~t"), ("<", "~l"), ("[", "~b"), ("\n", "~n")]
TEXT_CODES = CODES[:3]


def escape(value: Column, codes=TEXT_CODES) -> Column:
    for raw, code in codes:
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value


def unescape(value: Column) -> Column:
    for raw, code in reversed(CODES):
        value = F.replace(value, F.lit(code), F.lit(raw))
    return value


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, n_context, trained, text, loss_start, loss_end), one row per example.

    ``n_context`` counts the turns in ``text``; the mask is a code point range,
    end exclusive, empty where ``trained`` is false.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ordered = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))
        ).alias("turns")
    )
    parts = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.transform(
            "turns",
            lambda t: F.concat(
                F.lit(OPEN), escape(t["role"], CODES), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)
            ),
        ).alias("blocks"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
    )
    n = F.size("blocks")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("replies", i))
    ends = F.when(F.element_at("replies", -1), replies).otherwise(F.concat(replies, F.array(n)))
    examples = parts.select("conv_id", "bodies", "blocks", "replies", F.explode(ends).alias("n_context"))
    shaped = examples.select(
        "conv_id",
        "n_context",
        F.element_at("replies", F.col("n_context")).alias("trained"),
        F.array_join(F.slice("blocks", 1, F.col("n_context")), "").alias("text"),
        F.length(F.element_at("bodies", F.col("n_context"))).alias("_reply"),
    )
    end = F.length("text") - len(CLOSE)
    return shaped.select(
        "conv_id",
        F.col("n_context").cast("bigint"),
        "trained",
        "text",
        F.when(F.col("trained"), end - F.col("_reply")).otherwise(0).cast("bigint").alias("loss_start"),
        F.when(F.col("trained"), end).otherwise(0).cast("bigint").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    blocks = F.filter(F.split(text, CLOSE, -1), lambda b: b != "")
    at = lambda b: F.instr(b, "\n")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring(b, F.lit(len(OPEN) + 1), at(b) - (len(OPEN) + 1))).alias("role"),
            unescape(F.substring(b, at(b) + 1, F.length(b))).alias("text"),
        ),
    )


def loss_text(example_text: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(example_text, (start + 1).cast("int"), (end - start).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the formatted examples alone."""
    reply = F.struct(
        "n_context", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply")
    )
    gathered = examples.groupBy("conv_id").agg(
        F.max_by("text", "n_context").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), reply))).alias("replies"),
        F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
    )
    told = gathered.select(
        "conv_id",
        "formatted_chars",
        parse_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"),
    )
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return told.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('[INST] ') + length(chr(10)) + length('</s>')
        + length(replace(replace(replace(replace(role, '~', '~t'), '<', '~l'), '[', '~b'), chr(10), '~n'))
        + length(replace(replace(replace(text, '~', '~t'), '<', '~l'), '[', '~b'))) OVER w AS chars
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
