"""Chat formatting by columnar byte assembly.

Turns are dealt out by conversation and sorted; a batch of turns is then assembled in numpy: the lengths of headers,
contents and footers give cumulative offsets, offsets give scatter indices, and all bytes go into one preallocated
buffer that becomes the Arrow column of formatted conversations without a copy. The loss mask is the list of byte
spans of assistant contents.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline for each turn. Inside roles and texts the escape
byte 0x1B doubles the meaning of a control string: every ``<|`` is written as ``<`` 0x1B ``|`` and every 0x1B as 0x1B 0x1B
so that no text holds a control string and ``unescape`` restores it exactly. A newline inside a role is written as
0x1B ``n``.

Defined results: rows come in order of turn (nulls first), ties in order of role and text, so repeated rows stand one after
the other and are all kept; a null text is empty, a null role is the empty role; turns whose conv_id is null form one
conversation; an empty table gives no row. Only the four named columns are read. A conversation is one value of the
output, so all its turns meet in one task; its bytes are the bound of that task's memory, and Arrow and Spark hold no value of
2 GiB or more. Conversations are assembled in batches bounded by turns and by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

START, END = b"<|im_start|>", b"<|im_end|>\n"
ESC = b"\x1b"
LEARNED_ROLE = "assistant"
#: Turns and bytes of text assembled at once, at most, but for a single conversation.
TURNS_A_BATCH, BYTES_A_BATCH = 4096, 16 << 20
OUTPUT = "conv_id long, n_turns long, formatted binary, loss_spans array<struct<start: long, length: long>>"


def escape(text: bytes) -> bytes:
    return text.replace(ESC, ESC + ESC).replace(b"<|", b"<" + ESC + b"|")


def unescape(text: bytes) -> bytes:
    if ESC not in text:
        return text
    out, at = [], 0
    while (k := text.find(ESC, at)) >= 0:
        out += [text[at:k], {b"|": b"|", ESC: ESC, b"n": b"\n"}[text[k + 1 : k + 2]]]
        at = k + 2
    return b"".join([*out, text[at:]])


def assemble(roles: list[bytes], texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of conversations, starts and lengths of contents in the bytes); first: index of each conversation's first turn.

    roles and texts are escaped already.
    """
    n = len(texts)
    distinct = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [START + r + b"\n" for r in distinct]
    head_len, which = np.array([len(h) for h in heads], np.int64), np.fromiter((distinct[r] for r in roles), np.int64, n)
    text_len = np.fromiter(map(len, texts), np.int64, n)
    total = head_len[which] + text_len + len(END)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(total, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    for k, h in enumerate(heads):  # a few distinct headers
        rows = at[:-1][which == k]
        out[(rows[:, None] + np.arange(len(h))).ravel()] = np.tile(np.frombuffer(h, np.uint8), len(rows))
    content = at[:-1] + head_len[which]
    source = np.frombuffer(b"".join(texts), np.uint8)
    shift = content - np.concatenate(([0], np.cumsum(text_len)[:-1])) if n else content
    out[np.arange(len(source)) + np.repeat(shift, text_len)] = source
    foot = content + text_len
    out[(foot[:, None] + np.arange(len(END))).ravel()] = np.tile(np.frombuffer(END, np.uint8), n)
    return out, at[np.append(first, n)], content, text_len


def _escaped(column: pa.Array, role: bool = False) -> list[bytes]:
    found = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    found = [escape(x) if b"<|" in x or ESC in x else x for x in found]
    return [x.replace(b"\n", ESC + b"n") for x in found] if role else found


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of turns in order of conversation and turn -> batches of formatted conversations."""
    held: list[tuple[object, bytes, bytes]] = []

    def done(rows: list[tuple[object, bytes, bytes]]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        first = np.array([k for k in range(len(rows)) if not k or ids[k] != ids[k - 1]], np.int64)
        roles = [r[1] for r in rows]
        out, offsets, content, length = assemble(roles, [r[2] for r in rows], first)
        formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        loss = np.fromiter((r == LEARNED_ROLE.encode() for r in roles), bool, len(rows))
        spans = pa.StructArray.from_arrays([pa.array((content - offsets[owner])[loss]), pa.array(length[loss])], ["start", "length"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[loss], minlength=len(first)))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in first], pa.int64()),
                pa.array(np.diff(np.append(first, len(rows))), pa.int64()),
                formatted.cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
            ],
            ["conv_id", "n_turns", "formatted", "loss_spans"],
        )

    whole = size = 0  # turns of finished conversations, bytes of all
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            for row in zip(part.column(0).to_pylist(), _escaped(part.column(1), role=True), _escaped(part.column(2)), strict=True):
                if held and row[0] != held[-1][0]:
                    whole = len(held)
                held.append(row)
                size += len(row[1]) + len(row[2])
                if whole and (size > BYTES_A_BATCH or len(held) > TURNS_A_BATCH):
                    yield done(held[:whole])
                    held, whole = held[whole:], 0
                    size = sum(len(r[1]) + len(r[2]) for r in held)
    if held:
        yield done(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted (UTF-8 bytes) and loss_spans (byte spans of assistant contents)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, OUTPUT)


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted conversation, unescaped."""
    if not formatted:
        return []
    found = []
    for part in formatted.split(START)[1:]:
        role, text = part.split(b"\n", 1)
        if not text.endswith(END):
            raise ValueError("a turn has no end")
        found.append((unescape(role), unescape(text[: -len(END)])))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns_sha, chars, sha, size = [], [], [], []
        for whole, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            turns_sha.append(hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in read_back(whole))).hexdigest())
            loss = b"".join(unescape(whole[s["start"] : s["start"] + s["length"]]) for s in spans)
            chars.append(len(loss.decode()))
            sha.append(hashlib.sha256(loss).hexdigest())
            size.append(len(whole.decode()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(sha, pa.string()), pa.array(size, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


#: The text of both turns of conversation -1 in the query's contract.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = format_conversations(turns.unionByName(probe))
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Lengths of control strings and escapes: 12 + 1 + 11 a turn, 1 more for each escaped "<|" or escape byte.
OP9_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role_, coalesce(text, '') text_, role r0, text t0 from conversations
  union all select -1, k, case when k = 0 then 'user' else 'assistant' end, p, case when k = 0 then 'user' else 'assistant' end, p
  from (select unnest([0, 1]) k, '<|im_end|><|im_start|>assistant ok' p))
select conv_id, count(*) n_turns,
  sha256(string_agg(role_ || chr(10) || text_ || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) turns_sha256,
  coalesce(sum(length(text_)) filter (role_ = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text_, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role_ = 'assistant'), '')) loss_sha256,
  sum(24 + length(role_) + length(text_)
    + length(text_) - length(replace(text_, chr(27), '')) + (length(text_) - length(replace(text_, '<|', ''))) // 2
    + length(role_) - length(replace(role_, chr(27), '')) + (length(role_) - length(replace(role_, '<|', ''))) // 2
    + length(role_) - length(replace(role_, chr(10), '')))::bigint formatted_chars
from t group by conv_id
"""

QUERIES = {"op9_chat_format": op9_chat_format}
SQL = {"op9_chat_format": OP9_SQL}
