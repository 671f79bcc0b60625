"""Documents dealt into blocks of a bounded size, and count-min sketches whose answers come back to each block.

A block is a fixed group of documents (a hash of identifier and text), about ``block_bytes`` of text. An operator
that needs two or three looks at every text makes each of them a pass over the same blocks: the plan names one
``repartition("block")`` several times and Spark reuses its exchange, so texts move once. What a pass learns
elsewhere comes back to the block as a few packed rows. Nothing is broadcast and nothing passes the driver but
one sum of text lengths.

The sketch is one array of cells in shards of ``CELLS``; the number of shards follows the number of keys. Every block
sends the cells of its keys, sorted and packed, to the shards; a shard adds them up over all blocks (this is the merge
of the partition sketches) and answers every block with the merged counts of the cells it sent, in the order it sent
them. A key counts as the least of its cells: never less than its true count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import words

CELLS = 1 << 24
CELLS_PER_KEY = 16
LEAST_ID = -(2**63)
ANSWER = "block long, shard long, payload binary"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])


def dealt(df: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block) partitioned by block; the number of blocks; the bytes of all texts."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition("block"), n, total


def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(doc_id, null flag, text) of a block in an order that every pass finds again; equal rows are interchangeable."""
    text = table.column("text").combine_chunks()
    ids = table.column("doc_id").combine_chunks()
    null = np.asarray(ids.is_null())
    doc = np.asarray(ids.fill_null(LEAST_ID)).astype(np.int64)
    one, two = words.text_digest(text) if table.num_rows else (doc, doc)
    order = np.lexsort((two, one, doc, ~null))
    return doc[order], null[order], text.take(pa.array(order))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    width = 8 if len(values) and values.max() >= 2**32 else 4 if len(values) and values.max() >= 2**16 else 2
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(payload: bytes) -> np.ndarray:
    width, n = payload[0], int.from_bytes(payload[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(payload[9:], width * n, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


def shards_for(keys: int, depth: int) -> int:
    return max(1, -(-keys * CELLS_PER_KEY * depth // 2 // CELLS))


def cells_of(keys: np.ndarray, shards: int, depth: int) -> np.ndarray:
    width = np.uint64(shards * CELLS)
    salts = [np.uint64(0), np.uint64(0x5851F42D4C957F2D)][:depth]
    return np.concatenate([words.mix(keys ^ s) % width for s in salts]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def sketch_rows(block: int, keys: np.ndarray, shards: int, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """What a block sends: per shard the sorted cells of its keys as gaps."""
    cells = np.sort(cells_of(keys, shards, depth))
    limits = np.searchsorted(cells, np.arange(shards + 1) * CELLS)
    for s in range(shards):
        own = cells[limits[s] : limits[s + 1]] - s * CELLS
        if len(own):
            yield block, s, pack(np.diff(own, prepend=0))


def answered(keys: np.ndarray, answer: dict[int, bytes], shards: int, depth: int) -> np.ndarray:
    """Estimated counts of the keys from the merged counts of the cells that ``sketch_rows`` sent."""
    cells = cells_of(keys, shards, depth)
    got = np.empty(len(cells), np.int64)
    if len(cells):
        got[np.argsort(cells, kind="stable")] = np.concatenate([unpack(answer[s]) for s in sorted(answer)])
    return got.reshape(depth, -1).min(axis=0)


def merge_shard(table: pa.Table) -> pa.Table:
    """One shard: counts over all blocks (capped at 65535, which only orders keys), answered block by block."""
    counts = np.zeros(CELLS, np.uint16)
    payloads = table.column("payload")
    for p in payloads:
        cells = np.cumsum(unpack(p.as_py()))
        at = np.flatnonzero(np.diff(cells, prepend=-1))
        more = np.diff(np.append(at, len(cells)))
        counts[cells[at]] = np.minimum(counts[cells[at]].astype(np.int64) + more, 65535)
    back = [pack(counts[np.cumsum(unpack(p.as_py()))].astype(np.int64)) for p in payloads]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(back, pa.binary())}, schema=_ANSWER)


def merged(sent: DataFrame) -> DataFrame:
    """(block, shard, payload) of all blocks, merged by shard and answered."""
    return sent.groupBy("shard").applyInArrow(merge_shard, ANSWER)


def rows_table(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], schema=_ANSWER)


def answer_of(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("shard").to_pylist(), table.column("payload").to_pylist()))


def passed(docs: DataFrame, answer: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """A pass over every block together with the rows that came back to it."""
    return docs.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(f, schema)
