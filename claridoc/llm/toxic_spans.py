"""Toxic spans in text layers: a linear-chain conditional random field over tokens, in numpy.

Labels mark whole documents, so token labels are derived from them on the training sample: a token of a toxic document is
labelled toxic where one of its forms (the word, its first bytes) stands in many toxic and hardly any clean documents. The
chain has two states and hashed features (word, leading and trailing bytes, neighbours); it is trained by gradient steps
on the forward-backward marginals. A document's score comes from its marginals through a logistic curve fitted to the
document labels of the same sample; runs of tokens above one half are the offending spans.

Training sees a bounded sample (``SAMPLE_DOCS`` documents of each class, the first by a hash of doc_id, none longer than
``SAMPLE_CHARS``) and runs in one task. Scoring reads every whole text: messages go through stretches of ``STRETCH`` tokens, all of a
chunk at once, and from stretch to stretch, so the cut does not show. The model is a fixed number of weights and travels with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import words

SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
BITS = 16
STRETCH = 64
FOLDS = 3
PREFIXES, SUFFIX = (3, 4, 5), 3
SPAN = "start long, end long, marginal double"
RESULT = f"doc_id long, score double, predicted int, spans array<struct<{SPAN.replace(' long', ':long').replace(' double', ':double')}>>"
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}|*#"]] = True


@dataclass
class Tokens:
    """Trimmed, lower-cased tokens of some texts: features (n, k), text number, byte limits."""

    features: np.ndarray
    forms: np.ndarray
    text: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = words.split(texts, lower=True)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _EDGE[w.data[end - 1]] if len(end) else 0
        start += (end - start > 1) & _EDGE[w.data[np.minimum(start, len(w.data) - 1)]] if len(start) else 0
    values = words._BYTE_VALUE[w.data]

    def form(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return words.mix(words.span_hash(values, a, b, words.BYTE_BASE) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64) + (b - a).astype(np.uint64))

    forms = [form(1, start, end)] + [form(2 + i, start, np.minimum(start + p, end)) for i, p in enumerate(PREFIXES)]
    tail = form(9, np.maximum(start, end - SUFFIX), end)
    stem = forms[2]
    text = w.text
    alone = np.uint64(0x51ED270B)
    before = np.where(np.append(True, text[1:] != text[:-1])[: len(text)], alone, np.roll(stem, 1)) if len(text) else stem
    after = np.where(np.append(text[1:] != text[:-1], True)[: len(text)], alone, np.roll(stem, -1)) if len(text) else stem
    all_ = np.stack([*forms, tail, words.mix(before ^ np.uint64(0xB)), words.mix(after ^ np.uint64(0xA))], axis=1) if len(text) else np.zeros((0, len(forms) + 3), np.uint64)
    return Tokens((all_ >> np.uint64(64 - BITS)).astype(np.int32), np.stack(forms, axis=1) if len(text) else np.zeros((0, len(forms)), np.uint64), text, w.first, start, end, w.data)


@dataclass
class Stretches:
    """Pieces of chains by falling length: first token, length, number within its text, and the places of the pieces before and after (-1)."""

    begin: np.ndarray
    size: np.ndarray
    number: np.ndarray
    before: np.ndarray
    after: np.ndarray


def stretches(first: np.ndarray) -> Stretches:
    pieces = -(-np.diff(first) // STRETCH)
    total = int(pieces.sum())
    number = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first[:-1], pieces) + STRETCH * number
    size = np.minimum(STRETCH, np.repeat(first[1:], pieces) - begin)
    order = np.argsort(-size, kind="stable")
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    before = np.where(number > 0, place[np.arange(total) - 1], -1) if total else place
    after = np.where(number < np.repeat(pieces, pieces) - 1, np.append(place[1:], -1), -1) if total else place
    return Stretches(begin[order], size[order], number[order], before[order], after[order])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def marginals(toxic: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token and the summed expected transitions (2, 2), by forward-backward over whole texts.

    ``toxic``: score of the toxic state of each token (the clean one scores 0); ``chain``: log transition scores. All
    stretches go at once, step by step; first each one's transfer matrix, then the messages that enter it from both
    sides, handed from stretch to stretch of a text, then its own forward and backward pass with these.
    """
    s = stretches(first)
    n, steps = len(s.begin), int(s.size.max(initial=0))
    p, pairs = np.zeros(len(toxic)), np.zeros((2, 2))
    alive = np.searchsorted(-s.size, -np.arange(steps), side="left")  # stretches longer than t come first
    emit = lambda t, m: np.exp(np.clip(np.stack([-toxic[s.begin[:m] + t] / 2, toxic[s.begin[:m] + t] / 2], axis=1), -30, 30))
    move, opens = np.exp(chain), s.number == 0
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    if n and s.number.max() > 0:
        through = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        for t in range(steps):
            m = alive[t]
            moved = through[:m] @ move if t else np.where(opens[:m, None, None], through[:m], through[:m] @ move)
            moved = moved * emit(t, m)[:, None, :]
            through[:m] = moved / moved.sum(axis=(1, 2), keepdims=True)
        by_number = np.argsort(s.number, kind="stable")
        limits = np.searchsorted(s.number[by_number], np.arange(s.number.max() + 2))
        for k in range(1, len(limits) - 1):
            mine = by_number[limits[k] : limits[k + 1]]
            enter[mine] = _unit((enter[s.before[mine], None, :] @ through[s.before[mine]])[:, 0])
        for k in range(len(limits) - 2, 0, -1):
            mine = by_number[limits[k] : limits[k + 1]]
            leave[s.before[mine]] = _unit((through[mine] @ leave[mine, :, None])[:, :, 0])
    forward = []
    for t in range(steps):
        m = alive[t]
        a = forward[-1][:m] @ move if t else np.where(opens[:, None], 1.0, enter @ move)[:m]
        forward.append(_unit(a * emit(t, m)))
    back = leave.copy()
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        both = forward[t] * back[:m]
        p[s.begin[:m] + t] = both[:, 1] / both.sum(axis=1)
        onward = emit(t, m) * back[:m]
        if t:
            joint = forward[t - 1][:m, :, None] * move * onward[:, None, :]
            back[:m] = _unit(onward @ move.T)
        else:
            joint = (enter[:m, :, None] * move * onward[:, None, :])[~opens[:m]]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, pairs


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    chain: np.ndarray
    curve: np.ndarray

    def token_scores(self, t: Tokens) -> np.ndarray:
        out = np.full(len(t.text), self.bias)
        for column in t.features.T:  # column by column, so that no table of weights is built
            out += self.weights[column]
        return out

    def document_facts(self, p: np.ndarray, t: Tokens) -> np.ndarray:
        """Per document: 1, the log odds of its highest marginal, the log of its expected number of toxic tokens above one half."""
        n = len(t.first) - 1
        top = np.zeros(n)
        np.maximum.at(top, t.text, p)
        many = np.bincount(t.text, np.where(p >= 0.5, p, 0.0), minlength=n)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(many)], axis=1)

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        p, _ = marginals(self.token_scores(t), t.first, self.chain)
        return 1 / (1 + np.exp(-np.clip(self.document_facts(p, t) @ self.curve, -30, 30))), p


def marked_tokens(t: Tokens, label: np.ndarray, least: int, odds: float) -> np.ndarray:
    """Tokens of toxic documents with a form that ``least`` or more toxic documents have, at such odds against clean ones."""
    toxic = label[t.text] == 1
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    hit = np.zeros(len(t.text), bool)
    for k in range(t.forms.shape[1]):
        forms, inverse = np.unique(t.forms[:, k], return_inverse=True)
        seen = np.unique(inverse * np.int64(len(label)) + t.text)
        form, doc = seen // len(label), seen % len(label)
        a = np.bincount(form, label[doc] == 1, minlength=len(forms))
        b = np.bincount(form, label[doc] == 0, minlength=len(forms))
        good = (a >= least) & ((a + 0.5) / (n1 + 1) >= odds * (b + 0.5) / (n0 + 1))
        hit |= good[inverse]
    return hit & toxic


def _fit_chain(t: Tokens, label: np.ndarray, docs: np.ndarray, rounds: int, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """The chain of the documents ``docs`` (sorted numbers), fitted to token labels that are derived on these alone."""
    some = np.isin(t.text, docs)
    counts = np.diff(t.first)[docs]
    part = Tokens(t.features[some], t.forms[some], np.repeat(np.arange(len(docs)), counts), np.concatenate([[0], np.cumsum(counts)]), t.start[:0], t.end[:0], t.data)
    gold = marked_tokens(part, label[docs], max(3, int(0.01 * (label[docs] == 1).sum())), 20.0).astype(float)
    part.forms = part.forms[:0]
    model = Model(np.zeros(1 << BITS), -2.0, np.zeros((2, 2)), np.zeros(3))
    same = part.text[1:] == part.text[:-1]
    state = gold.astype(int)
    real = np.bincount(2 * state[:-1][same] + state[1:][same], minlength=4).reshape(2, 2).astype(float)
    grad2, chain2, bias2 = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    scale = 1.0 / max(1, len(gold))
    for _ in range(rounds):
        p, pairs = marginals(model.token_scores(part), part.first, model.chain)
        miss = gold - p
        g = sum(np.bincount(column, miss, minlength=1 << BITS) for column in part.features.T) * scale - l2 * model.weights * scale
        grad2 += g * g
        model.weights += rate * g / np.sqrt(grad2)
        c = (real - pairs) * scale
        chain2 += c * c
        model.chain = model.chain + 0.1 * rate * c / np.sqrt(chain2)
        b = miss.sum() * scale
        bias2 += b * b
        model.bias += 0.1 * rate * b / np.sqrt(bias2)
    return model


def _fit_curve(x: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Logistic curve over document facts by Newton steps with a little ridge; classes weighed as ``prior`` says."""
    share = (label == 1).mean()
    w = np.where(label == 1, prior / share, (1 - prior) / (1 - share))
    curve = np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        curve = curve + np.clip(np.linalg.solve(h, x.T @ (w * (label - q)) - 1e-2 * curve), -2, 2)
    return np.array([curve[0], max(curve[1], 0.02), max(curve[2], 0.0)])


def train(texts: list[str], label: np.ndarray, prior: float, rounds: int = 60, folds: int = FOLDS) -> Model:
    """Fit the chain to derived token labels and the score curve to document labels; ``prior`` is the share of toxic documents.

    The curve sees no document that its chain has learnt by heart: for each of the ``folds`` parts of the sample a chain is
    fitted without it and gives that part's facts. The chain that is returned has seen all parts.
    """
    model = Model(np.zeros(1 << BITS), -2.0, np.zeros((2, 2)), np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0.0, 0.0]))
    if not len(texts) or label.min() == label.max():
        return model
    t = tokens(pa.array(texts, pa.large_string()))
    every = np.arange(len(label))
    fold = np.empty(len(label), np.int64)
    for c in (0, 1):
        fold[label == c] = np.arange((label == c).sum()) % folds
    facts = np.zeros((len(label), 3))
    for k in range(folds):
        rest = every[fold != k]
        other = _fit_chain(t, label, rest, rounds // 2) if len(set(label[rest])) == 2 else model
        p, _ = marginals(other.token_scores(t), t.first, other.chain)
        facts[fold == k] = other.document_facts(p, t)[fold == k]
    model = _fit_chain(t, label, every, rounds)
    model.curve = _fit_curve(facts, label, prior)
    return model


def sample(text_layers: DataFrame, labels: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """A bounded training sample (doc_id, label, text): up to ``docs`` documents of each class that have a text of at most ``chars`` characters, by a hash of doc_id.

    A document that is listed several times counts once, with its least text; only then are documents chosen.
    """
    fitting = text_layers.where(F.char_length("text") <= chars)
    eligible = labels.join(fitting.select("doc_id").distinct(), "doc_id", "left_semi")
    by_class = [eligible.where(F.col("toxic") == c).select("doc_id", F.col("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs) for c in (1, 0)]
    chosen = F.broadcast(by_class[0].unionByName(by_class[1]))  # 2 * docs rows at most
    return fitting.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


_WEIGHTS = pa.schema([("weights", pa.binary()), ("chain", pa.binary()), ("bias", pa.float64()), ("curve", pa.binary())])


def _trained(rows: pa.Table, prior: float) -> pa.RecordBatch:
    """The model of a sample as one row. One document per text and per least shingle: near copies would make one text's words look like marks of toxicity."""
    frame = rows.to_pandas()
    frame = frame.assign(order=pd.util.hash_array(frame["doc_id"].to_numpy(np.int64))).sort_values(["label", "order", "doc_id"]).drop_duplicates("text")
    texts = frame["text"].tolist()
    w = words.split(pa.array(texts, pa.large_string()), lower=True)
    at, h = w.grams(3)
    least = np.full(len(texts), 2**64 - 1, np.uint64)
    np.minimum.at(least, w.text[at], h)
    frame = frame.assign(least=np.where(least == np.uint64(2**64 - 1), np.arange(len(texts), dtype=np.uint64), least)).drop_duplicates("least")
    m = train(frame["text"].tolist(), frame["label"].to_numpy(np.int64), prior)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((m.weights.tobytes(), m.chain.tobytes(), float(m.bias), m.curve.tobytes()), _WEIGHTS)], schema=_WEIGHTS)


def fit(text_layers: DataFrame, labels: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled text layers, trained by one task on the bounded sample; half a megabyte of weights comes back.

    ``text_layers``: (doc_id, text); ``labels``: (doc_id, toxic 0/1). Rows with a null label or text are not sampled; a document with
    several labels is toxic if one says so. Without documents of both classes the model scores the share of toxic labels.
    """
    one = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = one.agg(F.count("*"), F.sum("toxic")).first()
    prior = (toxic or 0) / n if n else 0.0

    def run(batches):
        batches = list(batches)  # 2 * docs rows of chars characters at most
        if any(b.num_rows for b in batches):
            yield _trained(pa.Table.from_batches(batches), prior)

    made = sample(text_layers, one, docs, chars).repartition(1).mapInArrow(run, "weights binary, chain binary, bias double, curve binary").collect()
    if not made:
        return train([], np.zeros(0, np.int64), prior)
    row = made[0]
    return Model(np.frombuffer(row.weights), row.bias, np.frombuffer(row.chain).reshape(2, 2), np.frombuffer(row.curve))


def score_text_layers(text_layers: DataFrame, model: Model) -> DataFrame:
    """Toxicity of every text layer and the spans that carry it.

    ``text_layers``: (doc_id, text); other columns are ignored. Returns (doc_id, score, predicted, spans): the score between 0 and
    1, 1 where it is 0.5 or more, and runs of tokens whose marginal is above one half as code point positions (end exclusive) with
    the highest marginal. A null or empty text has no spans and the score of no evidence. One row per input row; repeated
    rows get equal results; an empty table gives an empty result. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for lo, hi in words.chunks(text):
                t = tokens(text.slice(lo, hi - lo))
                score, p = model.score(t)
                hot = p > 0.5
                on = hot & np.append(True, ~hot[:-1] | (t.text[1:] != t.text[:-1]))[: len(hot)] if len(hot) else hot
                off = hot & np.append(~hot[1:] | (t.text[1:] != t.text[:-1]), True)[: len(hot)] if len(hot) else hot
                begin, stop = np.flatnonzero(on), np.flatnonzero(off)
                points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
                _, limits = words.text_bytes(text.slice(lo, hi - lo))
                base = points[limits[:-1]][t.text[begin]] if len(begin) else np.zeros(0, np.int64)
                best = np.maximum.reduceat(p, np.stack([begin, stop + 1], axis=1).ravel()[: 2 * len(begin) - (len(begin) > 0 and stop[-1] + 1 == len(p))])[::2] if len(begin) else np.zeros(0)
                spans = pa.StructArray.from_arrays([pa.array(points[t.start[begin]] - base), pa.array(points[t.end[stop]] - base), pa.array(best)], ["start", "end", "marginal"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t.text[begin], np.arange(hi - lo + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), lists], ["doc_id", "score", "predicted", "spans"])

    return text_layers.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)


def clean_text_layers(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns as they are. Null and empty texts stay if no evidence means clean."""
    kinds = documents.schema

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).fill_null("")
            keep = [model.score(tokens(text.slice(lo, hi - lo)))[0] < 0.5 for lo, hi in words.chunks(text)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return documents.mapInArrow(run, kinds)
