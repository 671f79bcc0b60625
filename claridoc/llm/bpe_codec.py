"""Byte-pair encoding of text layers with content-defined chunk reuse, and decoding.

A rolling hash over ``WINDOW`` bytes cuts every text where the bytes themselves say so, hence equal passages in different
documents fall into equal chunks. Each distinct chunk is encoded once: chunks that several blocks of documents hold are encoded
by the block with the least number and sent, as identifiers, to the others; the rest where they lie.

A cut may fall inside a word, so of a chunk only its core is reused, the words between its first and its last white space.
At every join the words between two cores are encoded again together with the last word of the core before and the first of
the core after. The join is repaired when both of these come out with the identifiers that the cores have; until then more
words of both sides are taken in, at last the whole text. A chunk without a whole word joins its neighbours.

Three passes over the same blocks of documents (``llm/blocks.py``): texts move once, digests and shared identifiers besides.
Memory: one block, and in each worker the identifiers of the most recent words.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claridoc.llm import blocks, words
from claridoc.session import written

WINDOW = 32
CHUNK_MEAN, CHUNK_LEAST, CHUNK_MOST = 1024, 256, 8192
BLOCK_BYTES = 4 << 20
CACHE_WORDS = 300_000
LONG_WORD = 64
ENCODED = "doc_id long, ids binary, n_tokens long"
_DIGESTS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("block", pa.int64())])
_SHARED = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("core", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])


_MARK = re.compile(rb"(?<=[A-Za-z0-9])([.,;:!?])(?=\s|\Z)")


@dataclass(frozen=True)
class BpeModel:
    """A tokenizer file as it travels to the tasks (some hundred kilobytes)."""

    packed: bytes
    name: int

    @property
    def encoder(self) -> Encoder:
        """The process's own encoder, made once: functions travel by value, so what a module holds would not outlive a task."""
        made = sys.__dict__.setdefault("claridoc_encoders", {})
        if self.name not in made:
            made[self.name] = Encoder(zlib.decompress(self.packed).decode())
        return made[self.name]


class Encoder:
    """Words to identifiers, remembered, and identifiers to tokens."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [(self.library.id_to_token(i) or "").encode() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        one = lambda *texts: b"".join(self.encode(list(texts)))
        self.marks_alone = one(b"ab, c4.") == one(b"ab", b",", b"c4", b".")
        self.one_case = one(b"AB cD") == one(b"ab cd")

    def split(self, text: bytes) -> list[bytes]:
        """Words of a text in a form that repeats more often and has the same identifiers: a last mark set apart, plain ASCII in lower case.

        Letters with signs of their own stay as they are, for lower case and composition do not commute there, and so does
        whatever may hold the string of a special token."""
        if self.marks_alone:
            text = _MARK.sub(rb" \1", text)
        if self.one_case and text.isascii() and b"<|" not in text:
            text = text.lower()
        return text.split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Identifiers of whole texts, 4 bytes each."""
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode_words(self, lists: list[list[bytes]]) -> list[bytes]:
        """Identifiers of each list of words; a word is encoded when it is not among those met lately."""
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        new = set().union(*lists).difference(self.known)
        again = {w: self.older[w] for w in new if w in self.older}
        self.known.update(again)
        new = list(new.difference(again))
        self.known.update(zip(new, self.encode(new)))
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in lists]
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        return out


def load_bpe_model(path: str) -> BpeModel:
    """Read a tokenizer file on the driver. White space must only separate words, as in models with word ends; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    model = BpeModel(zlib.compress(spec.encode()), zlib.crc32(spec.encode()))
    one, two, both, spread = model.encoder.encode([b"ab", b"cd", b"ab cd", b" \tab\n\x0b\x0c\r cd "])
    if not one + two == both == spread:
        raise ValueError("white space is part of this model's tokens")
    return model


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of the bytes, and the hash of the ``WINDOW`` bytes before each place from ``WINDOW`` on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words._BYTE_VALUE[data] * words.powers(words.BYTE_BASE, len(data)), out=sums[1:])
    back = words.powers(pow(words.BYTE_BASE, -1, 2**64), len(data) + 1)
    return sums, (sums[WINDOW:] - sums[:-WINDOW]) * back[: max(0, len(sums) - WINDOW)]


def cuts(data: np.ndarray, limits: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the chunks of consecutive texts, and the number of chunks before each text. Cuts depend on nearby bytes alone and spare UTF-8 characters."""
    marks = WINDOW + np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(CHUNK_MEAN) == 0)
    inside = np.searchsorted(marks, limits)
    starts_char = np.append((data & 0xC0) != 0x80, True)
    out, first = [], [0]
    for t in range(len(limits) - 1):
        last, end = int(limits[t]), int(limits[t + 1])
        for mark in [*marks[inside[t] : inside[t + 1]].tolist(), end]:
            while mark - last > CHUNK_MOST:
                cut = last + CHUNK_MOST
                while not starts_char[cut]:
                    cut -= 1
                out.append(cut)
                last = cut
            if mark != end and mark - last >= CHUNK_LEAST and starts_char[mark]:
                out.append(mark)
                last = mark
        if end > last:
            out.append(end)
        first.append(len(out))
    return np.concatenate([limits[:1], np.array(out, np.int64)]), np.array(first)


@dataclass
class Chunks:
    """Chunks of some texts of a block. The core of chunk i is data[core[i]:core_end[i]], empty without a whole word."""

    rows: tuple[int, int]
    data: bytes
    limits: np.ndarray
    first: np.ndarray
    core: list[int]
    core_end: list[int]
    keys: list[tuple[int, int]]


def chunked(text: pa.Array):
    for lo, hi in words.chunks(text):
        data, limits = words.text_bytes(text.slice(lo, hi - lo))
        sums, hashes = rolling(data)
        at, first = cuts(data, limits, hashes)
        values, size = words._BYTE_VALUE[data], np.diff(at).astype(np.uint64)
        back = words.powers(pow(words.BYTE_BASE, -1, 2**64), len(data) + 1)
        one = words.mix((sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]] + size).view(np.int64)
        two = words.mix(words.span_hash(values, at[:-1], at[1:], words.GRAM_BASE_2) ^ size).view(np.int64)
        space = np.flatnonzero(words._SPACE[data])
        a, b = np.searchsorted(space, at[:-1]), np.searchsorted(space, at[1:])
        some = b > a
        core, end = at[:-1].copy(), at[:-1].copy()
        core[some], end[some] = space[a[some]], space[b[some] - 1] + 1
        end = np.where(end - core == b - a, core, end)  # white space alone
        yield Chunks((lo, hi), data.tobytes(), limits, first, core.tolist(), end.tolist(), list(zip(one.tolist(), two.tolist())))


def _ask(table: pa.Table) -> pa.Table:
    """Digests of the chunks of a block, each once."""
    keys = {k for part in chunked(table.column("text").combine_chunks()) for k, a, b in zip(part.keys, part.core, part.core_end) if b > a}
    return pa.table([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([table.column("block")[0].as_py()] * len(keys), pa.int64())], schema=_DIGESTS)


def _pairs(table: pa.Table) -> list[tuple[int, int]]:
    return list(zip(table.column("one").to_pylist(), table.column("two").to_pylist()))


def _share(model: BpeModel, table: pa.Table, owned: pa.Table) -> pa.Table:
    """Cores of the chunks that this block encodes for all."""
    wanted, out = set(_pairs(owned)), []
    for part in chunked(table.column("text").combine_chunks()) if wanted else ():
        mine = {k: part.data[a:b] for k, a, b in zip(part.keys, part.core, part.core_end) if k in wanted}
        wanted -= mine.keys()
        out += zip(mine, model.encoder.encode_words([model.encoder.split(core) for core in mine.values()]))
    small = [np.frombuffer(ids, "<u4") for _, ids in out]
    cores = [(b"\x02" + v.astype("<u2").tobytes()) if not len(v) or v.max() < 65536 else b"\x04" + v.tobytes() for v in small]
    return pa.table([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), pa.array(cores, pa.binary())], schema=_SHARED)


def _received(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {k: np.frombuffer(core[1:], f"<u{core[0]}").astype("<u4").tobytes() for k, core in zip(_pairs(table), table.column("core").to_pylist())}


def repaired(encoder: Encoder, before: list[bytes], seam: bytes, after: list[bytes]) -> bytes | None:
    """Identifiers of the seam between two runs of words, by windows that grow until both ends agree; None if they never do.

    ``seam`` is the text from the end of ``before`` to the start of ``after``, its white space included."""
    k = 1
    while True:
        left, right = before[-k:], after[:k]
        whole, one, two = encoder.encode([b" ".join(left) + seam + b" ".join(right), b" ".join(left), b" ".join(right)])
        if len(whole) >= len(one) + len(two) and whole.startswith(one) and whole.endswith(two):
            return whole[len(one) : len(whole) - len(two)]
        if k >= len(before) and k >= len(after):
            return None
        k *= 2


def _assemble(encoder: Encoder, part: Chunks, cores: dict[tuple[int, int], bytes]) -> list[bytes]:
    """Identifiers of each text from the cores of its chunks and the repaired joins between them."""
    usable = [i for i in range(len(part.keys)) if part.core_end[i] > part.core[i]]
    new = {part.keys[i]: encoder.split(part.data[part.core[i] : part.core_end[i]]) for i in usable if part.keys[i] not in cores}
    cores.update(zip(new, encoder.encode_words(list(new.values()))))
    windows, texts = [], []  # (last word before, seam, first word after) of every join; per text its joins (numbers) and cores (keys) in order
    for t in range(len(part.first) - 1):
        begin, left, mine = int(part.limits[t]), b"", []
        for i in range(int(part.first[t]), int(part.first[t + 1])):
            a, b = part.core[i], part.core_end[i]
            if a == b:
                continue
            core = part.data[a:b]
            right = core.split(None, 1)[0]
            lead = a + len(core) - len(core.lstrip())
            windows.append((left, part.data[begin:lead], right))
            mine += [len(windows) - 1, part.keys[i]]
            left = core.rsplit(None, 1)[-1]
            begin = a + len(core.rstrip())
        windows.append((left, part.data[begin : int(part.limits[t + 1])], b""))
        texts.append([*mine, len(windows) - 1])
    ends = encoder.encode_words([encoder.split(w) for left, _, right in windows for w in (left, right)])
    whole = encoder.encode([left + seam + right for left, seam, right in windows])
    out = []
    for t, mine in enumerate(texts):
        ids = []
        for place in mine:
            if isinstance(place, tuple):
                ids.append(cores[place])
                continue
            one, two, window = ends[2 * place], ends[2 * place + 1], whole[place]
            if not (len(window) >= len(one) + len(two) and window.startswith(one) and window.endswith(two)):
                # more words of both sides, and the whole text where not even they agree
                at = [p for p in mine if not isinstance(p, tuple)].index(place)
                runs = [part.data[part.core[i] : part.core_end[i]].split() for i in usable if part.first[t] <= i < part.first[t + 1]]
                seam = repaired(encoder, runs[at - 1] if at else [], windows[place][1], runs[at] if at < len(runs) else [])
                if seam is None:
                    ids = encoder.encode([part.data[int(part.limits[t]) : int(part.limits[t + 1])]])
                    break
                ids.append(seam)
                continue
            ids.append(window[len(one) : len(window) - len(two)])
        out.append(b"".join(ids))
    return out


def _finish(model: BpeModel, table: pa.Table, received: pa.Table) -> pa.Table:
    cores, ids = _received(received), []
    for part in chunked(table.column("text").combine_chunks()):
        ids += _assemble(model.encoder, part, cores)
    return pa.table([table.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], schema=_RESULT)


def encode(text_layers: DataFrame, model: BpeModel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Identifiers of every text layer, equal to those of one pass of the library over the whole text without special tokens added.

    ``text_layers``: (doc_id, text); other columns are ignored. Returns (doc_id, ids, n_tokens), ``ids`` as little-endian unsigned
    32-bit integers. The strings of special tokens in a text become these tokens, as in the library. A null or empty text has
    no identifiers; repeated rows and rows without doc_id give rows of their own; an empty table gives an empty result. A text
    without white space is one word and is encoded whole.
    """
    docs, _, _ = blocks.dealt(text_layers, block_bytes)
    asked = docs.groupBy("block").applyInArrow(_ask, "one long, two long, block long")
    same = Window.partitionBy("one", "two")  # a row a block that has the chunk, however often
    shared = written(asked.withColumns({"owner": F.min("block").over(same), "blocks": F.count("*").over(same)}).where("blocks > 1").drop("blocks"))
    owned = shared.where("block = owner").select("block", "one", "two")
    cores = blocks.passed(docs, owned, lambda table, mine: _share(model, table, mine), "one long, two long, core binary")
    received = shared.select("one", "two", "block").join(cores, ["one", "two"]).select("block", "one", "two", "core")
    return blocks.passed(docs, received, lambda table, answer: _finish(model, table, answer), ENCODED)


def decode(encoded: DataFrame, model: BpeModel) -> DataFrame:
    """Adds ``text`` to rows with ``ids``: their tokens with spaces between, special ones too, as the library decodes a model without
    a decoder. Null ``ids`` give a null text; numbers outside the vocabulary are left out."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "text"), "text string"])
    names = [f.name for f in encoded.schema.fields if f.name != "text"]

    def run(batches):
        tokens = model.encoder.tokens
        for batch in batches:
            texts = [None if ids is None else b" ".join(tokens[i] for i in array("I", ids) if i < len(tokens)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(texts, pa.string())], [*names, "text"])

    return encoded.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
