"""Encoding text layers into the pieces of a public piece model, with the N best segmentations, and decoding them.

The score of a segmentation is the sum of its pieces' scores in the model. Texts are taken byte for byte: a space is the
model's space mark, and a character without a piece of its own (line ends, an outright space mark) becomes byte pieces, so
decoding gives every text back exactly.

A text falls apart where no piece contains the two bytes on both sides; words repeat, so each distinct segment of a
chunk is solved once. Forward Viterbi scores of all segments are one sweep over the edges of their lattices in numpy.
The N best segmentations of a segment come from a backward A-star search from its end: the forward score of a node is
exactly the best that its prefix can add, so the first N paths that reach the front are the N best. Those of a whole
text are made of its ``n - 1`` segments with the smallest gap between best and second best; no other can take part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import words

N_BEST = 4
CHUNK_BYTES = 1 << 20
LOOKUP_PLACES = 1 << 18
_CHANGE = "array<struct<at:int,count:int,ids:array<int>>>"
_NBEST = f"array<struct<score:double,changes:{_CHANGE}>>"
_NBEST_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


@dataclass
class PieceModel:
    """Pieces as bytes with their scores: by identifier for decoding, by length and hash for encoding."""

    data: np.ndarray
    limits: np.ndarray
    scores: np.ndarray
    bytes_at: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    joined: np.ndarray
    unknown: float

    @property
    def width(self) -> int:
        return 2 if len(self.scores) <= 65536 else 4


def piece_model(pieces: list[bytes], scores: list[float], byte_ids: list[int]) -> PieceModel:
    """``byte_ids``: identifiers of the 256 byte pieces; an empty piece stands for one that texts never use."""
    limits = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    bytes_at, size = np.array(byte_ids, np.int64), np.diff(limits)
    scores_ = np.array(scores, float)
    normal = size > 0
    normal[bytes_at] = False
    hashes = _hashes(data, limits[:-1], limits[1:])
    tables = {}
    for n in np.unique(size[normal]):
        ids = np.flatnonzero(normal & (size == n))
        order = np.argsort(hashes[ids], kind="stable")
        tables[int(n)] = (hashes[ids][order], ids[order])
    joined = np.zeros((256, 256), bool)
    inner = np.ones(len(data), bool)
    inner[limits[:-1][size > 0]] = False
    at = np.flatnonzero(inner)
    joined[data[at - 1], data[at]] = True
    joined[:, 0x80:0xC0] = True  # never cut inside a character
    # a byte of a character without a piece costs more than any piece of one character
    chars = np.add.reduceat((data & 0xC0) != 0x80, limits[:-1][size > 0]) if len(data) else np.zeros(0, np.int64)
    one = normal.copy()
    one[np.flatnonzero(size > 0)[chars != 1]] = False
    return PieceModel(data, limits, scores_, bytes_at, tables, joined, float(scores_[one].min() if one.any() else 0.0) - 10.0)


def load_piece_model(path: str) -> PieceModel:
    """Read a model file with its library, on the driver; tasks get the tables."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    byte_ids = [0] * 256
    pieces = []
    for i in range(n):
        if m.is_byte(i):
            value = int(m.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            pieces.append(bytes([value]))
        else:
            skip = m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
            pieces.append(b"" if skip else m.id_to_piece(i).replace("▁", " ").encode())
    return piece_model(pieces, [m.get_score(i) for i in range(n)], byte_ids)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return words.mix(words.span_hash(words._BYTE_VALUE[data], start, end, words.BYTE_BASE) + (end - start).astype(np.uint64))


@dataclass
class Lattice:
    """Distinct segments and the edges of their lattices. Nodes are byte places, one more than bytes in each segment."""

    front: np.ndarray
    back: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    forward: np.ndarray
    chosen: np.ndarray
    gap: np.ndarray


def lattice(model: PieceModel, data: np.ndarray, limits: np.ndarray) -> Lattice:
    """Edges, forward scores, best path and gap to the second best of every segment ``data[limits[i]:limits[i+1]]``."""
    n, size = len(limits) - 1, np.diff(limits)
    owner = np.repeat(np.arange(n), size)
    stop = limits[1:][owner]
    inside = np.append((data & 0xC0) == 0x80, False)  # places inside a character
    values = words._BYTE_VALUE[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * words.powers(words.BYTE_BASE, len(values)), out=sums[1:])
    undo = words.powers(pow(words.BYTE_BASE, -1, 2**64), len(values) + 1)
    places = np.flatnonzero(~inside[:-1])
    starts, ends, pieces = [], [], []
    single = np.zeros(len(data), bool)
    char = np.diff(np.append(places, len(data)))
    for length, (hashes, ids) in model.tables.items():
        small = np.zeros(1 << 18, bool)
        small[(hashes >> np.uint64(46)).astype(np.int64)] = True
        for a in range(0, len(places), LOOKUP_PLACES):
            at = places[a : a + LOOKUP_PLACES]
            at = at[at + length <= stop[at]]
            at = at[~inside[at + length] | (at + length == stop[at])]
            h = words.mix((sums[at + length] - sums[at]) * undo[at] + np.uint64(length))
            keep = small[(h >> np.uint64(46)).astype(np.int64)]
            at, h = at[keep], h[keep]
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[where] == h
            starts.append(at[hit].astype(np.int32))
            ends.append((at[hit] + length).astype(np.int32))
            pieces.append(ids[where[hit]].astype(np.int32))
    del sums, values
    start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, ends, pieces))
    del starts, ends, pieces
    width = np.zeros(len(data), np.int64)
    width[places] = char
    whole = start[end - start == width[start]]
    single[whole] = True
    lost = np.repeat(places[~single[places]], char[~single[places]])
    lost = lost + (np.arange(len(lost)) - np.repeat(np.cumsum(char[~single[places]]) - char[~single[places]], char[~single[places]]))
    lost = lost.astype(np.int32)
    start, end = np.concatenate([start, lost]), np.concatenate([end, lost + 1])
    score = np.concatenate([model.scores[piece], np.full(len(lost), model.unknown)])
    piece = np.concatenate([piece, model.bytes_at[data[lost]].astype(np.int32)])
    shift = owner[start].astype(np.int32) if len(start) else start  # node number: place plus the segments before
    start, end = start + shift, end + shift
    front, back = limits[:-1] + np.arange(n), limits[1:] + np.arange(n)
    of = shift

    def sweep(from_: np.ndarray, to: np.ndarray, rank: np.ndarray, origin: np.ndarray) -> np.ndarray:
        best = np.full(len(data) + n, -np.inf)
        best[origin] = 0.0
        order = np.lexsort((to, rank)).astype(np.int32)
        cut = np.flatnonzero(np.diff(rank[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            own = order[a:b]
            t = to[own]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            best[t[first]] = np.maximum.reduceat(best[from_[own]] + score[own], first)
        return best

    forward = sweep(start, end, end - front.astype(np.int32)[of], front)
    backward = sweep(end, start, back.astype(np.int32)[of] - start, back)
    through = forward[start] + score + backward[end]
    into = np.full(len(data) + n, -1)
    tie = np.flatnonzero(forward[start] + score == forward[end])
    tie = tie[np.lexsort((start[tie], end[tie]))][::-1]  # the longest piece wins a tie
    into[end[tie]] = tie
    chosen = np.zeros(len(start), bool)
    now = back[size > 0]
    while len(now):
        edge = into[now]
        chosen[edge] = True
        now = start[edge]
        now = now[now > front[of[edge]]]
    second = np.full(n, -np.inf)
    np.maximum.at(second, of[~chosen], through[~chosen])
    return Lattice(front, back, start, end, piece, score, forward, chosen, forward[back] - second)


def n_best(lat: Lattice, segment: int, n: int, by_end: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, tuple[int, ...]]]:
    """Backward A-star from the segment's end; the forward Viterbi score of a node is the exact rest.

    ``by_end``: edges by end, the best first. Paths are links (piece, path behind it). An entry of the heap stands for an edge and
    the lesser ones into the same node; no node is entered more than ``n`` times, as only its n best ways to the end can matter.
    """
    order, first = by_end
    begin, end = int(lat.front[segment]), int(lat.back[segment])
    if begin == end:
        return [(0.0, ())]
    heap, found, entered, serial = [], [], {}, 0

    def push(k: int, stop: int, done: float, path) -> None:
        nonlocal serial
        e = int(order[k]) if k < stop else -1
        if e >= 0 and lat.forward[lat.start[e]] > -np.inf:
            serial -= 1  # of equals the last one goes on, so that ties are followed to the front
            heapq.heappush(heap, (-(done + (lat.forward[lat.start[e]] + lat.score[e])), serial, k, stop, done, path))

    push(int(first[end]), int(first[end + 1]), 0.0, None)
    while heap and len(found) < n:
        _, _, k, stop, done, path = heapq.heappop(heap)
        push(k + 1, stop, done, path)
        e = int(order[k])
        node, g, longer = int(lat.start[e]), done + float(lat.score[e]), (int(lat.piece[e]), path)
        if node == begin:
            found.append((g, longer))
        elif entered.get(node, 0) < n:
            entered[node] = entered.get(node, 0) + 1
            push(int(first[node]), int(first[node + 1]), g, longer)
    out = []
    for g, path in found:
        flat = []
        while path is not None:
            piece, path = path
            flat.append(piece)
        out.append((g, tuple(flat)))
    own, node, g = [], end, 0.0  # the best one that the lattice chose comes first, whatever ties there are
    while node > begin:
        e = int(order[first[node]])
        own.append(int(lat.piece[e]))
        node, g = int(lat.start[e]), g + float(lat.score[e])
    own = tuple(own[::-1])
    return [(g, own)] + [x for x in out if x[1] != own][: n - 1]


def segments(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the limits of their segments, and the first segment of each text."""
    data, limits = words.text_bytes(texts)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = ~model.joined[data[:-1], data[1:]] if len(data) else True
    cut[limits] = True
    at = np.flatnonzero(cut)
    return data, at if len(data) else np.zeros(1, np.int64), np.searchsorted(at, limits) if len(data) else np.zeros(len(limits), np.int64)


def encode_chunk(model: PieceModel, texts: pa.Array, n: int):
    """Per text: identifiers of the best segmentation as bytes, their number, the best score and the N best."""
    data, limits, first = segments(model, texts)
    many = len(limits) - 1
    hashes = np.concatenate([_hashes(data[limits[a] : limits[b]], limits[a:b] - limits[a], limits[a + 1 : b + 1] - limits[a]) for a, b in _pieces_of(limits)]) if many else np.zeros(0, np.uint64)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = limits[sample + 1] - limits[sample]
    own = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = data[np.repeat(limits[sample] - own[:-1], size) + np.arange(own[-1])] if many else data
    lat = lattice(model, flat, own)
    path = np.flatnonzero(lat.chosen)
    path = path[np.argsort(lat.start[path], kind="stable")]
    ids, at = lat.piece[path], np.searchsorted(lat.start[path], np.append(lat.front, lat.back[-1:] + 1))
    count = np.diff(at)
    reps = count[which]
    place = np.concatenate([[0], np.cumsum(reps)])
    every = ids[np.repeat(at[:-1][which] - place[:-1], reps) + np.arange(place[-1])] if many else ids
    kind = "<u2" if model.width == 2 else "<u4"
    raw, text_at = every.astype(kind).tobytes(), place[first]
    best = np.concatenate([[0.0], np.cumsum(lat.forward[lat.back][which])]) if many else np.zeros(1)
    order = np.lexsort((~lat.chosen, -(lat.forward[lat.start] + lat.score), lat.end)).astype(np.int32)
    by_end = (order, np.searchsorted(lat.end[order], np.arange(len(flat) + len(own) + 1)))
    solved: dict[int, list] = {}
    out_ids, out_n, out_best = [], [], []
    gaps = lat.gap[which]
    for t in range(len(first) - 1):
        a, b = first[t], first[t + 1]
        out_ids.append(raw[text_at[t] * model.width : text_at[t + 1] * model.width])
        out_n.append(int(text_at[t + 1] - text_at[t]))
        score = float(best[b] - best[a])
        near = np.arange(a, b)
        if b - a >= n:
            near = a + np.argpartition(gaps[a:b], n - 1)[:n]
            near = near[np.lexsort((near, gaps[near]))]
        near = near[np.isfinite(gaps[near])][: n - 1] if n > 1 else near[:0]
        best_n = [(score, [])]
        for s in near:
            d = int(which[s])
            if d not in solved:
                solved[d] = n_best(lat, d, n, by_end)
            ways = solved[d]
            more = [(total + (g - ways[0][0]), changes + ([(int(place[s] - text_at[t]), int(count[d]), list(p))] if k else [])) for total, changes in best_n for k, (g, p) in enumerate(ways)]
            best_n = heapq.nsmallest(n, more, key=lambda x: -x[0])
        out_best.append([{"score": s, "changes": [{"at": i, "count": c, "ids": p} for i, c, p in changes]} for s, changes in best_n])
    return out_ids, out_n, out_best


def _pieces_of(limits: np.ndarray):
    """Ranges of segments of about a megabyte, for hashing."""
    a, n = 0, len(limits) - 1
    while a < n:
        b = max(a + 1, min(n, int(np.searchsorted(limits, limits[a] + words.CHUNK_BYTES, side="right")) - 1))
        yield a, b
        a = b


def encode(text_layers: DataFrame, model: PieceModel, n: int = N_BEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every text layer.

    ``text_layers``: (doc_id, text); of other columns those in ``keep`` come along. Returns (doc_id, ids, n_pieces, nbest): ``ids`` are the identifiers of the
    best segmentation, little-endian, 2 bytes each for up to 65536 pieces and 4 beyond; ``nbest`` has the ``n`` best segmentations by
    falling score (fewer if there are fewer), each as the changes that turn the best one into it: at piece ``at``, ``count`` pieces
    give way to ``ids``. A null or empty text has no pieces and one segmentation of score 0. Repeated rows get equal
    results; an empty table gives an empty result. Nothing is shuffled; one chunk of texts is in memory.
    """

    passing = ["doc_id", *keep]
    kept = text_layers.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"`{c}`" for c in keep], F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in passing] + ["ids binary", "n_pieces long", f"nbest {_NBEST}"])

    def run(batches):
        for batch in batches:
            for lo, hi in words.chunks(batch.column("text"), CHUNK_BYTES):
                rows = batch.slice(lo, hi - lo)
                ids, count, best = encode_chunk(model, rows.column("text"), n)
                made = [pa.array(ids, pa.binary()), pa.array(count, pa.int64()), pa.array(best, _NBEST_TYPE)]
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in passing] + made, [*passing, "ids", "n_pieces", "nbest"])

    return kept.mapInArrow(run, schema)


def decode_ids(model: PieceModel, ids: np.ndarray) -> bytes:
    size = np.diff(model.limits)[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    return model.data[np.repeat(model.limits[:-1][ids] - to[:-1], size) + np.arange(to[-1])].tobytes()


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """The input with ``text`` in place of ``ids``: exactly the text that was encoded. Null ``ids`` give an empty text."""
    passing = [f for f in encoded.schema.fields if f.name not in ("ids", "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in passing] + ["text string"])
    kind = "<u2" if model.width == 2 else "<u4"

    def run(batches):
        for batch in batches:
            text = [decode_ids(model, np.frombuffer(v.as_buffer() if v.is_valid else b"", kind).astype(np.int64)).decode() for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in passing] + [pa.array(text, pa.string())], [f.name for f in passing] + ["text"])

    return encoded.select(*[f"`{f.name}`" for f in passing], "ids").mapInArrow(run, schema)
