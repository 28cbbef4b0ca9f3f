"""Conversations as training text, with the characters a model is to learn.

Rows are sorted by conversation and turn inside their partition and streamed through the compiled template, so
a conversation is never held as a whole; its text comes in parts of about a million characters.
Control strings inside roles and texts get a backslash in front, and so does each backslash, hence the text can be
read back. The reader undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .template import BEGIN, END, Template

TEMPLATE = """{%- for message in messages -%}
### {{ message.role | escape_line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else %}{{ message.text | escape }}{% endif %}</turn>
{% endfor -%}"""
CONTROL = re.compile(r"\\|###|</turn>")
CONTROL_LINE = re.compile(r"\\|###|</turn>|\n")
ESCAPED = re.compile(r"\\(\\|###|</turn>|\n)")
TURN = re.compile(r"### ((?:[^\\\n]|\\[\s\S])*+)\n((?:[^\\<]|\\[\s\S]|<(?!/turn>))*+)</turn>\n")
PART = 1 << 20
PARTS = "conv_id long, part int, formatted string, n_turns long, spans array<struct<start: long, end: long>>"


def escape(text: str | None) -> str:
    return CONTROL.sub(r"\\\g<0>", text or "")


def escape_line(text: str | None) -> str:
    return CONTROL_LINE.sub(r"\\\g<0>", text or "")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _turns(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(3)])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """``(conv_id, part, formatted, n_turns, spans)``: each conversation's text in consecutive parts of about ``part``
    characters (cut between pieces of the template), the turns begun in it, and the spans of its characters that are to be learned, from the
    conversation's first character on.

    Turns stand in the order of ``turn``, then role, then text; null turns first. Null role and null text are empty, a null
    conv_id is a conversation of its own, repeated rows are turns of their own. Other columns are ignored. The parts of a
    conversation are consecutive rows of one partition. ``escape`` and ``escape_line`` are filters of the template.
    """
    def run(batches):
        compiled = Template(template, {"escape": escape, "escape_line": escape_line})
        lazy = compiled.reads_once("messages")
        out, held = [], 0

        def emit():
            nonlocal out, held
            ready, out, held = out, [], 0
            columns = list(zip(*ready))
            fields = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), fields]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["conv_id", "part", "formatted", "n_turns", "spans"])

        for conv, rows in groupby(_turns(batches), key=lambda r: r[0]):
            seen = [0]

            def messages():
                for _, role, text in rows:
                    seen[0] += 1
                    yield {"role": role or "", "text": text or ""}
            pieces, spans, at, size, number, begun, counted = [], [], 0, 0, 0, None, 0
            for piece in compiled.render(messages=messages() if lazy else list(messages())):
                if piece is BEGIN:
                    begun = at
                elif piece is END:
                    spans.append((begun, at))
                    begun = None
                else:
                    pieces.append(piece)
                    at, size = at + len(piece), size + len(piece)
                    if size >= part and begun is None:
                        out.append((conv, number, "".join(pieces), seen[0] - counted, [{"start": a, "end": b} for a, b in spans]))
                        held += size
                        pieces, spans, size, number, counted = [], [], 0, number + 1, seen[0]
                        if held >= 4 * part:
                            yield emit()
            out.append((conv, number, "".join(pieces), seen[0] - counted, [{"start": a, "end": b} for a, b in spans]))
            held += size + 64
            if held >= 4 * part or len(out) >= 4096:
                yield emit()
        if out:
            yield emit()
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").alias("_turn"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
            .drop("_turn").mapInArrow(run, PARTS))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned text, read from the parts alone: counts and digests per conversation, as ``op6_chat`` returns.

    The template has to mark turns as the default one does; text that is no such turn raises ``ValueError``.
    """
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*[batch.column(i).to_pylist() for i in range(3)])
        out = []
        for conv, parts in groupby(rows(), key=lambda r: r[0]):
            turns, loss, n, chars, learned, rest, start = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, "", 0
            for _, text, spans in parts:
                for s in spans:
                    own = unescape(text[s["start"] - start:s["end"] - start])
                    loss.update(own.encode())
                    learned += len(own)
                start += len(text)
                rest, at = rest + text, 0
                while m := TURN.match(rest, at):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest, chars = rest[at:], chars + len(text)
            if rest:
                raise ValueError(f"conversation {conv} can't be read back at {rest[:40]!r}")
            out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          [c.split()[0] for c in DIGEST.split(", ")])
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, DIGEST)


PLANTED = r"\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length(regexp_replace(role, '\\|###|</turn>|\n', '\\\0', 'g'))
                + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op6_chat", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], given.schema)
    return read_back(format_conversations(given.union(planted)))
