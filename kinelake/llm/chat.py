"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor goes over them in order and flattens
each to a piece of template text. Text is escaped, so that no control string of the template can stand inside it;
other parts become numbered placeholders, and their reference and the number of tokens that the model will see in
their place are recorded. Conversations are read in order and written turn by turn: a worker holds one turn at a time,
however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import query, small_batches, table

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn:", "<|end|>", "<|image:", "<|audio:", "<|document:")
KINDS = ("image", "audio", "document")
#: Every place where a control string starts, and every backslash, gets a backslash and a letter in its stead.
HARD = re.compile(r"\\|<(?=/?s>|<SYS>>|</SYS>>|\|turn:|\|end\|>|\|image:|\|audio:|\|document:)|\[(?=/?INST\])")
SOFT = re.compile(r"\\(.)", re.S)
LETTERS = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
BACK = {"\\": "\\", "l": "<", "b": "[", "p": "|"}

PARTS = "array<struct<type: string, text: string, ref: string, tokens: int>>"


def escape(text: str) -> str:
    return HARD.sub(lambda m: LETTERS[m[0]], text)


def unescape(text: str) -> str:
    return SOFT.sub(lambda m: BACK.get(m[1], m[0]), text)


class Flattener:
    """Visits the parts of a conversation's turns; attachments are numbered from 0 over the whole conversation."""

    def __init__(self):
        self.attachments: list[tuple[int, str, str, int]] = []

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        if kind == "text":
            return escape(part.get("text") or "")
        if kind in KINDS:
            return self.visit_attachment(kind, part)
        raise ValueError(f"unknown content part {kind!r}")

    def visit_attachment(self, kind: str, part: dict) -> str:
        number = len(self.attachments)
        self.attachments.append((number, kind, part.get("ref") or "", max(0, part.get("tokens") or 0)))
        return f"<|{kind}:{number}|>"


def opening(role: str) -> str:
    """How a turn of this role starts; the pieces' forms are told apart when they are read back."""
    if role == "user":
        return "[INST] "
    if role == "system":
        return "<<SYS>>\n"
    return "" if role == "assistant" else f"<|turn:{escape(role).replace('|>', chr(92) + 'p>')}|>"


def closing(role: str) -> str:
    return {"user": " [/INST]", "system": "\n<</SYS>>\n", "assistant": "</s>"}.get(role, "<|end|>")


def parse(piece: str) -> tuple[str, str]:
    """(role, escaped text) of one formatted turn."""
    for role in ("user", "system"):
        if piece.startswith(opening(role)):
            return role, piece[len(opening(role)) : -len(closing(role))]
    if piece.startswith("<|turn:"):
        role, _, rest = piece[len("<|turn:") :].partition("|>")
        return unescape(role), rest[: -len(closing(""))]
    return "assistant", piece[: -len(closing("assistant"))]


def text_parts(text: Column) -> Column:
    """A plain text column as a list with one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


ATTACHMENT = pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place, piece, loss_start, loss_end, attachments, attachment_tokens.

    ``turns`` has conv_id, turn, role and ``parts`` (see PARTS). ``piece`` is the turn in the template; the pieces of a
    conversation in order of ``place`` are its formatted text. The loss mask is the span [loss_start, loss_end) of an
    assistant's piece (empty elsewhere). Null texts, refs, parts and roles are empty; turns are ordered by turn (nulls
    first), equal turns by role, then content; repeated rows stay; an empty table gives none.
    """

    def run(batches):
        conv, place, flat, started = None, 0, Flattener(), False
        for b in batches:
            rows = []
            for conv_id, role, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not started or conv_id != conv:
                    conv, place, flat, started = conv_id, 0, Flattener(), True
                role, before = role or "", len(flat.attachments)
                body = "".join(flat.visit(p or {}) for p in parts or [])
                head = opening(role)
                piece = head + body + closing(role)
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                new = [dict(zip(("number", "type", "ref", "tokens"), a)) for a in flat.attachments[before:]]
                rows.append((conv_id, place, piece, *loss, new, sum(a["tokens"] for a in new)))
                place += 1
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), ATTACHMENT, pa.int64()]
            names = ["conv_id", "place", "piece", "loss_start", "loss_end", "attachments", "attachment_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    schema = "conv_id long, place long, piece string, loss_start long, loss_end long, attachments array<struct<number: int, type: string, ref: string, tokens: int>>, attachment_tokens long"
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("parts").cast(PARTS).alias("parts"), F.col("turn").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json(F.struct("parts")))
    return dealt.select("conv_id", "role", "parts").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted pieces alone: what was said, what is learned, how long it is.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachment_tokens. Digests are
    taken as the pieces pass by, so a conversation is never held.
    """

    def run(batches):
        conv, state = None, None

        def close():
            return (conv, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"], state["tokens"])

        def made(rows):
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            rows = []
            for conv_id, piece, start, end, tokens in zip(*(b.column(i).to_pylist() for i in range(5))):
                if state is None or conv_id != conv:
                    if state is not None:
                        rows.append(close())
                    conv, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0}
                role, body = parse(piece)
                state["n"] += 1
                state["turns"].update(f"{role}\n{unescape(body)}\n".encode())
                learned = unescape(piece[start:end])
                state["loss_n"] += len(learned)
                state["loss"].update(learned.encode())
                state["chars"] += len(piece)
                state["tokens"] += tokens
            if rows:
                yield made(rows)
        if state is not None:
            yield made([close()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"
    rows = formatted.select("conv_id", "place", "piece", "loss_start", "loss_end", "attachment_tokens")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "piece", "loss_start", "loss_end", "attachment_tokens").mapInArrow(run, schema)


def _sql_escaped_length(text: str) -> str:
    """DuckDB: code points of a text after escaping."""
    pattern = r"\\|</?s>|<<SYS>>|<</SYS>>|<\|turn:|<\|end\|>|<\|image:|<\|audio:|<\|document:|\[/?INST\]"
    return f"length({text}) + len(regexp_extract_all({text}, '{pattern}'))"


ORACLE = f"""WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    s AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 18 WHEN 'assistant' THEN 4
                         ELSE 16 + {_sql_escaped_length("role")} + len(regexp_extract_all(role, '\\|>')) END + {_sql_escaped_length("text")} AS piece FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
      CAST(sum(piece) AS BIGINT) AS formatted_chars
    FROM s GROUP BY conv_id"""


@query("op7_chat_format", ORACLE)
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = rows.union(extra).withColumn("parts", text_parts(F.col("text")))
    return read_back(format_turns(turns)).drop("attachment_tokens")
