"""Chat turns of audited documents as training text, assembled column by column.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``, some ``%``, perhaps ``n``, ``|`` gets
one more ``%``, and a line end inside a role becomes ``<n|``; taking one ``%`` away again restores any text, so no text can
forge a mark. The loss mask covers the (escaped) texts of the trained role.

Turns are dealt by document and sorted in their partitions, so a task streams them: lengths, running offsets and
scatter positions are numpy columns over a batch, and headers and contents are copied into one preallocated buffer that
becomes the Arrow column. A long chat comes as several parts in order; no chat is held whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import words

START, END = b"<|im_start|>", b"<|im_end|>\n"
PART_BYTES = 4 << 20
PARTS = "doc_id long, part long, formatted string, loss array<struct<start:long,end:long>>"
_MARKED = re.compile(rb"<(%*)(n?)\|")
READ = "doc_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(%*)(n?)\|", r"<%\1\2|")


def unescape(data: bytes) -> bytes:
    return _MARKED.sub(lambda m: b"\n" if m[0] == b"<n|" else b"<" + m[1][1:] + m[2] + b"|", data)


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, limits: np.ndarray) -> None:
    """Copy the segments ``data[limits[i]:limits[i+1]]`` to the positions ``to[i]`` of out, all at once."""
    size = np.diff(limits)
    out[np.repeat(to - limits[:-1], size) + np.arange(limits[0], limits[-1])] = data[limits[0] : limits[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; the limits of the turns; start and end of each text in it."""
    role, role_at = words.text_bytes(pc.replace_substring(escape(roles), "\n", "<n|"))
    text, text_at = words.text_bytes(escape(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    limits = np.concatenate([[0], np.cumsum(len(START) + n_role + 1 + n_text + len(END))])
    at, out = limits[:-1], np.empty(limits[-1], np.uint8)
    for piece, where in ((START, at), (b"\n", at + len(START) + n_role), (END, limits[1:] - len(END))):
        out[where[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    scatter(out, at + len(START), role, role_at)
    begin = at + len(START) + n_role + 1
    scatter(out, begin, text, text_at)
    return out, limits, begin, begin + n_text


def _string_column(data: np.ndarray, limits: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def format_chats(chat_turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formatted chats with their loss mask, in parts.

    ``chat_turns``: (doc_id, at, role, text), the turns of the chat about each document; other columns are ignored. Returns
    (doc_id, part, formatted, loss): the parts of a chat in order make its text; ``loss`` has byte positions inside the
    part. Turns go by ``at`` (null first), then role and text, so ties are settled. A null role or text is empty; turns without a
    doc_id form one chat; an empty table gives no rows. Rows of a partition come by doc_id and part, ready for ``read_back``.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = chat_turns.select(F.col("doc_id").cast("long").alias("doc_id"), "at", filled("role"), filled("text"))
    ready = turns.repartition("doc_id").sortWithinPartitions("doc_id", "at", "role", "text").select("doc_id", "role", "text")

    def run(batches):
        last, part = object(), 0
        for batch in batches:
            for lo, hi in words.chunks(batch.column("text"), PART_BYTES):
                rows = batch.slice(lo, hi - lo)
                ids = rows.column("doc_id").to_pylist()
                first = np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]])
                data, limits, begin, end = assemble(rows.column("role"), rows.column("text"))
                trained = np.flatnonzero(np.asarray(pc.equal(rows.column("role"), trained_role)))
                chats = np.append(limits[first], limits[-1])
                chat = np.searchsorted(first, trained, side="right") - 1
                loss = pa.StructArray.from_arrays([pa.array(begin[trained] - chats[chat]), pa.array(end[trained] - chats[chat])], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(trained, np.append(first, len(ids))).astype(np.int32)), loss)
                parts = []
                for i in first:
                    part = part + 1 if ids[i] == last else 0
                    last = ids[i]
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first], pa.int64()), pa.array(parts, pa.int64()), _string_column(data, chats), spans], ["doc_id", "part", "formatted", "loss"])

    return ready.mapInArrow(run, PARTS)


_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """What formatted chats say, from their text and loss mask alone; one row per doc_id.

    ``parts``: the result of ``format_chats`` as it comes (sorted inside its partitions). Returns (doc_id, n_turns,
    turns_sha256 of role, line end, text, line end of each turn, loss_chars, loss_sha256 of the unescaped text under the mask,
    formatted_chars). Digests run over the parts; no chat is held whole.
    """

    def run(batches):
        now, sums = object(), None
        done: list[tuple] = []

        def close():
            if sums:
                done.append((now, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4]))

        def table():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)],
                ["doc_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for batch in batches:
            for doc, formatted, loss in zip(batch.column("doc_id").to_pylist(), batch.column("formatted"), batch.column("loss").to_pylist()):
                if not sums or doc != now:
                    close()
                    now, sums = doc, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = formatted.as_buffer().to_pybytes()
                for role, text in _TURN.findall(data):
                    sums[0] += 1
                    sums[1].update(unescape(role) + b"\n" + unescape(text) + b"\n")
                for span in loss:
                    text = unescape(data[span["start"] : span["end"]])
                    sums[2] += len(text.decode())
                    sums[3].update(text)
                sums[4] += len(data.decode())
            yield table()
        close()
        yield table()

    return parts.mapInArrow(run, READ)
