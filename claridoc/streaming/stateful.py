"""Keyed stream operators: numbering, snapshot, chunks, figures, rate limit, gate and deadline.

Every operator keeps one small state per key and takes rows of a micro-batch in their order. Late
rows behind the watermark are dropped by Spark and counted in its progress metrics. Where keys are many and small, the states
of a shelf of keys are read and written together (``Shelf``), since a call a key costs more than its work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claridoc.functions import fixed_values as fv
from claridoc.functions.blocks import split_blocks, strip_fence
from claridoc.operators.ledger import APPROVED, REJECTED, REQUESTED
from claridoc.operators.live import addressed

MICROS = 1_000_000
SHELVES, SLOT_SHELVES = 1 << 13, 16
DAY = 86_400 * MICROS


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """Rows of one key in one micro-batch, sorted. Their number is bounded by the batch size."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


def _one(key) -> object:
    return key[0]


def _frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Output rows as plain Python values; nothing at all when there are none."""
    if rows:
        yield pd.DataFrame(rows, columns=columns)


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class _Ending(_Processor):
    """State that ends: a key that hears nothing for ``keep`` (event time, microseconds) is forgotten; never when it is None."""

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint") if self.keep is not None else None

    def heard(self, at) -> None:
        """Arm the one timer of this key anew, for the latest row so far."""
        if self.due is None:
            return
        new, old = -(-(int(at) + self.keep) // 1000), self.due.get()[0] if self.due.exists() else None
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
            self.due.update((new,))

    def forget(self, key) -> Iterator[pd.DataFrame]:
        """Clear what the key has; may give rows."""
        raise NotImplementedError

    def ended(self) -> None:
        """The key is done before its time: no timer is left."""
        if self.due is not None and self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.due is not None and self.due.exists() and self.due.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
            yield from self.forget(key)


def _span(keep: str | None) -> int | None:
    """Microseconds of an interval such as ``3 days``."""
    if keep is None:
        return None
    n, unit = keep.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * MICROS


def _timed(rows: DataFrame, keep: str | None, delay: str) -> tuple[DataFrame, str]:
    """Rows under a watermark when their state is to end, and the time mode that goes with it."""
    return (rows, "None") if keep is None else (rows.withWatermark("ts", delay), "EventTime")


def _plain(value):
    """Lists and tuples for the rows that a state comes back with, which cannot be stored again as they are."""
    if isinstance(value, (tuple, list)):
        return [_plain(v) for v in value] if isinstance(value, list) else tuple(_plain(v) for v in value)
    return value


class Shelf(_Processor):
    """Keys side by side in one group, their states in one list that is read and written once per micro-batch.

    ``step(key, state, rows)`` takes the rows of one key in the order of ``by`` and gives its new state (None: none) and its output;
    ``due(state)`` says when a state ends (milliseconds of event time), ``end(key, state)`` what then comes out. A shelf has a timer for the
    earliest of its ends.
    """

    def __init__(self, state: str, by: list[str], out: list[str], step: Callable, due: Callable | None = None, end: Callable | None = None, id_type: str = "bigint"):
        self.state, self.by, self.out, self.step, self.due, self.end, self.id_type = state, by, out, step, due, end, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"kept array<struct<id:{self.id_type},{self.state}>>")

    def _read(self) -> dict:
        kept = self.kept.get()
        return {k: _plain(state) for k, *state in kept[0]} if kept else {}

    def _write(self, states: dict, had: bool) -> None:
        if states:
            self.kept.update(([(k, *state) for k, state in states.items()],))
            if self.due is not None:
                self.handle.registerTimer(min(map(self.due, states.values())))
        elif had:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues):
        states = self._read()
        had, out = bool(states), []
        place = lambda r: [(r[c] is None, r[c]) for c in self.by]
        # a number beside a null comes as a float; no column here is one
        whole = lambda v: (None if v != v else int(v)) if isinstance(v, float) else v
        found = [{c: whole(r[c]) for c in self.columns} for frame in rows for r in frame["row"]]
        found.sort(key=lambda r: ((r["id"] is None, r["id"]), place(r)))
        for k, own in groupby(found, key=lambda r: r["id"]):
            state, given = self.step(states.pop(k, None), list(own))
            if state is not None:
                states[k] = state
            out += [(k, *g) for g in given]
        self._write(states, had)
        yield from _frames(out, self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        states, out = self._read(), []
        over = [k for k, state in states.items() if self.due(state) <= timerValues.getCurrentWatermarkInMs()]
        for k in over:
            out += [(k, *g) for g in self.end(states.pop(k))]
        if over:
            self._write(states, True)
        yield from _frames(out, self.out)


def _frames_of(out: str) -> list[str]:
    return [c.split()[0] for c in out.split(", ")]


def _shelved(rows: DataFrame, key: str, columns: list[str], shelf: Shelf, out: str, mode: str = "None", number: Column | None = None) -> DataFrame:
    """Rows of a keyed stream through shelves; null keys have a shelf of their own."""
    shelf.columns = ["id", *columns]
    if number is None:
        number = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(SHELVES)))
    packed = rows.withColumn("shelf", F.coalesce(number, F.lit(-1).cast("bigint"))).select("shelf", F.struct(F.col(key).alias("id"), *columns).alias("row"), *(["ts"] if mode == "EventTime" else []))
    return packed.groupBy("shelf").transformWithStateInPandas(shelf, out, "append", mode)


class Numbering(_Ending):
    """Next free position per session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n bigint")

    def forget(self, key):
        self.count.clear()
        yield from ()

    def handleInputRows(self, key, rows, timerValues):
        start = self.count.get()[0] if self.count.exists() else 0
        batch = _in_order(rows, "at", "event_id")
        batch["seq"] = range(start + 1, start + 1 + len(batch))
        self.count.update((start + len(batch),))
        self.heard(batch["at"].max())
        yield batch[["session_id", "event_id", "at", "seq"]]


def sequence_stream(events: DataFrame, keep: str | None = None, delay: str = "1 day") -> DataFrame:
    """Numbered events: session_id, event_id, at, seq. ``events``: session_id, event_id, ts.

    A session without events for ``keep`` is over and its number forgotten; ``delay`` is how late events may come.
    """
    stamped = events.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows, mode = _timed(stamped.withColumn("at", F.unix_micros("ts")), keep, delay)
    return rows.groupBy("session_id").transformWithStateInPandas(
        Numbering(_span(keep)), "session_id bigint, event_id bigint, at bigint, seq bigint", "append", mode
    )


class Snapshot(_Processor):
    """Places of the blocks per session by block id; emits every change as (ord, html), a removed block with no html.

    The ids of a session, not its texts, are read and written once per micro-batch, in one call each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getValueState("blocks", "blocks array<struct<id:string,ords:array<bigint>>>")

    def handleInputRows(self, key, rows, timerValues):
        kept = self.blocks.get()
        places = {block: list(ords) for block, ords in kept[0]} if kept else {}

        def at(block: str) -> list[int]:
            return places.setdefault(block, [])

        out = []
        for seq, kind, block, html in _in_order(rows, "seq")[["seq", "type", "block_id", "html"]].itertuples(index=False):
            seq = int(seq)
            if kind == "append":
                out += [(seq, o, fv.LOADING_BLOCK, None) for o in at(fv.LOADING_BLOCK)]
                at(fv.LOADING_BLOCK).clear()
                at(block).append(seq)
                out.append((seq, seq, block, html))
            else:
                if not at(block):
                    at(block).append(seq)
                out += [(seq, o, block, html) for o in at(block)]
        left = [(block, ords) for block, ords in places.items() if ords]
        if left:
            self.blocks.update((left,))
        elif kept:
            self.blocks.clear()
        yield from _frames([(_one(key), *r) for r in out], ["session_id", "seq", "ord", "block_id", "html"])


def snapshot_stream(events: DataFrame) -> DataFrame:
    """Change log of the page: the last change per (session_id, ord) is the block, none is a removal."""
    return addressed(events).groupBy("session_id").transformWithStateInPandas(
        Snapshot(), "session_id bigint, seq bigint, ord bigint, block_id string, html string", "append", "None"
    )


def fold_changes(changes: DataFrame) -> DataFrame:
    """Current blocks from a change log."""
    last = changes.groupBy("session_id", "ord").agg(F.max_by(F.struct("block_id", "html"), "seq").alias("b"))
    return last.filter(F.col("b.html").isNotNull()).select("session_id", "ord", "b.block_id", "b.html")


class Chunks:
    """Open markup per document. Chunks that come early wait for their turn; a document that stops is given up when its time is over."""

    STATE = "text:string,next:bigint,block:bigint,due:bigint,early:array<struct<no:bigint,chunk:string,last:boolean>>"

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def step(self, state, rows):
        text, following, block, due, early = state or ("", 0, 0, None, [])
        waiting = {no: (chunk, last) for no, chunk, last in early}
        waiting |= {r["chunk_no"]: (r["chunk"], bool(r["last"])) for r in rows if r["chunk_no"] >= following}
        found, over = [], False
        while following in waiting:
            chunk, last = waiting.pop(following)
            done, text = split_blocks(text + chunk)
            following += 1
            found += done
            if last:
                tail = strip_fence(text).strip(fv.WHITESPACE)
                found += [tail] if tail else []
                text, over = "", True
        out = [(block + i, html, None) for i, html in enumerate(found, 1)]
        if over and self.keep is not None:
            return None, out
        if self.keep is not None:
            due = max(due or 0, -(-(max((r["at"] for r in rows if r["at"] is not None), default=0) + self.keep) // 1000))
        return (text, following, block + len(found), due, [(no, *w) for no, w in waiting.items()]), out

    def due(self, state) -> int:
        return state[3]

    def end(self, state):
        left = sorted((no, chunk) for no, chunk, _ in state[4])
        return ([(None, state[0], -1)] if state[0] else []) + [(None, chunk, no) for no, chunk in left]


_CHUNKS = "doc_id bigint, block_no bigint, html string, given_up bigint"


def chunk_stream(chunks: DataFrame) -> DataFrame:
    """Complete blocks as they close. ``chunks``: doc_id, chunk_no (from 0), chunk, last."""
    shelf = Shelf(Chunks.STATE, ["chunk_no"], _frames_of(_CHUNKS), Chunks().step)
    return _shelved(chunks, "doc_id", ["chunk_no", "chunk", "last"], shelf, _CHUNKS).drop("given_up")


def ending_chunk_stream(chunks: DataFrame, keep: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Blocks as they close, and what had to be given up: doc_id, block_no, html, given_up.

    ``chunks``: doc_id, chunk_no (from 0), chunk, last, ts. A document leaves no state once its last chunk is read. One that hears
    nothing for ``keep`` is given up: its open markup (``given_up`` -1) and the chunks whose predecessor never came
    (their numbers) come out with no block_no, so nothing is lost silently. Chunks that come after a document has ended wait and are given
    up the same way; a number that was read already is a repeat and is passed over.
    """
    rows = chunks.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    ending = Chunks(_span(keep))
    shelf = Shelf(Chunks.STATE, ["chunk_no"], _frames_of(_CHUNKS), ending.step, ending.due, ending.end)
    return _shelved(rows, "doc_id", ["at", "chunk_no", "chunk", "last"], shelf, _CHUNKS, "EventTime")


class Countdown(_Ending):
    """Figures that arrived per session; repeats do not count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "fig_id string", "x boolean")
        self.left = handle.getValueState("left", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        left = self.left.get()[0] if self.left.exists() else None
        out = []
        batch = _in_order(rows, "at", "fig_id")
        self.heard(batch["at"].max())
        for fig, pending in batch.drop_duplicates("fig_id")[["fig_id", "pending"]].itertuples(index=False):
            if self.seen.containsKey((fig,)):
                continue
            self.seen.updateValue((fig,), (True,))
            left = max(0, (int(pending) if left is None else left) - 1)
            out.append((fig, left, left == 0))
        if out:
            self.left.update((left,))
        yield from _frames([(_one(key), *r) for r in out], ["session_id", "fig_id", "remaining", "finished"])


    def forget(self, key):
        self.seen.clear()
        self.left.clear()
        yield from ()


_COUNTDOWN = "session_id bigint, fig_id string, remaining bigint, finished boolean"


def _count_down(state, rows):
    left, seen = state or (None, [])
    known, out = set(seen), []
    for r in rows:
        if r["fig_id"] not in known:
            known.add(r["fig_id"])
            left = max(0, (r["pending"] if left is None else left) - 1)
            out.append((r["fig_id"], left, left == 0))
    return (left, list(known)), out


def countdown_stream(ready: DataFrame, keep: str | None = None, delay: str = "1 day") -> DataFrame:
    """One row per figure that arrived first time. ``ready``: session_id, fig_id, at (microseconds), pending (1 when unknown).

    A session without figures for ``keep`` is forgotten.
    """
    if keep is None:
        return _shelved(ready, "session_id", ["at", "fig_id", "pending"], Shelf("left:bigint,seen:array<string>", ["at", "fig_id"], _frames_of(_COUNTDOWN), _count_down), _COUNTDOWN)
    rows, mode = _timed(ready.withColumn("ts", F.timestamp_micros("at")), keep, delay)
    return rows.groupBy("session_id").transformWithStateInPandas(
        Countdown(_span(keep)), _COUNTDOWN, "append", mode
    )


def _gate(state, rows):
    """Whether the gate of a document waits for a decision. A closed gate needs no state: it is what a document without state has."""
    is_open, out = state is not None, []
    for r in rows:
        if r["event"] == REQUESTED:
            is_open, outcome = True, "pending_review"
        elif not is_open:
            outcome = "no open gate"
        elif r["held"]:
            outcome = "deferred"
        else:
            is_open, outcome = False, "finalized" if r["event"] == APPROVED else "rejected"
        out.append((r["event_id"], r["event"], outcome))
    return (True,) if is_open else None, out


def _human(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event").isin(REQUESTED, APPROVED, REJECTED)).withColumn("at", F.unix_micros("ts"))


def gate_stream(events: DataFrame) -> DataFrame:
    """Outcome of every request and decision. ``events``: doc_id, event_id, ts, event, held."""
    out = "doc_id bigint, event_id bigint, event string, outcome string"
    return _shelved(_human(events), "doc_id", ["at", "event_id", "event", "held"], Shelf("open:boolean", ["at", "event_id"], _frames_of(out), _gate), out)


class Deadline:
    """The open request of a document and when it ends."""

    def __init__(self, days: int):
        self.span = days * DAY

    def due(self, waiting) -> int:
        # timers count milliseconds: the first one not before the deadline
        return -(-(waiting[1] + self.span) // 1000)

    def step(self, waiting, rows):
        out = []
        for r in rows:
            if r["held"] and r["event"] != REQUESTED:  # put off: the deadline stays armed (NULL is not held)
                continue
            if waiting:
                in_time = r["at"] <= waiting[1] + self.span
                out.append((*waiting, ("superseded" if r["event"] == REQUESTED else "decided") if in_time else "elapsed"))
            waiting = (r["event_id"], r["at"]) if r["event"] == REQUESTED else None
        return waiting, out

    def end(self, waiting):
        return [(*waiting, "elapsed")]


def sla_stream(events: DataFrame, days: int = fv.REVIEW_DAYS, delay: str = "1 day") -> DataFrame:
    """What became of each request, as soon as it is known: at the next human event or at its deadline.

    A decision that is held back leaves the deadline armed. The gate itself stays closed when a deadline
    passes. ``delay`` is how late events may come.
    """
    human = _human(events).withWatermark("ts", delay)
    deadline, out = Deadline(days), "doc_id bigint, event_id bigint, at bigint, outcome string"
    shelf = Shelf("event_id:bigint,at:bigint", ["at", "event_id"], _frames_of(out), deadline.step, deadline.due, deadline.end)
    return _shelved(human, "doc_id", ["at", "event_id", "event", "held"], shelf, out, "EventTime")


class Limiter:
    """Requests seen per key and window; a window is forgotten when the watermark passes its end."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def step(self, state, rows):
        start, slot = state[0] if state else 0, rows[0]["slot"]
        return (start + len(rows), (slot + self.seconds) * 1000), [(r["request_id"], slot, n, n <= self.limit) for n, r in enumerate(rows, start + 1)]

    def due(self, state) -> int:
        return state[1]

    def end(self, state):
        return ()


def rate_limit_stream(requests: DataFrame, limit: int = 15, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """Each request with its position in the window and whether it is accepted. ``requests``: key, ts, request_id.

    State is kept by key and window, so requests without a key, however many, spread over their windows; a window has ``SLOT_SHELVES`` shelves of keys.
    """
    at = F.unix_micros("ts")
    slotted = (
        requests.withWatermark("ts", delay).withColumn("key", F.coalesce("key", F.lit("anon"))).withColumn("at", at)
        .withColumn("slot", F.floor(at / (seconds * MICROS)) * seconds)
    )
    limiter, out = Limiter(limit, seconds), "key string, request_id bigint, slot bigint, n bigint, ok boolean"
    shelf = Shelf("n:bigint,until:bigint", ["at", "request_id"], _frames_of(out), limiter.step, limiter.due, limiter.end, "string")
    number = F.col("slot") * SLOT_SHELVES + F.pmod(F.xxhash64("key"), F.lit(SLOT_SHELVES))
    return _shelved(slotted, "key", ["at", "slot", "request_id"], shelf, out, "EventTime", number).select("request_id", "key", "slot", "n", "ok")


class Ring(_Processor):
    """The newest events of a session; a reader that comes gets those after its resume point."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getMapState("log", "seq bigint", "type string, html string")
        self.bounds = handle.getValueState("bounds", "low bigint, top bigint")

    def handleInputRows(self, key, rows, timerValues):
        low, top = self.bounds.get() or (None, None)
        first, last = (low, top) if low is not None else (0, -1)  # numbers that may be stored
        new, out = {}, []

        def event(seq: int):
            return new.get(seq) or (self.log.getValue((seq,)) if first <= seq <= last else None)

        batch = _in_order(rows, "at", "is_reader", "no")
        for is_reader, no, kind, html in batch[["is_reader", "no", "type", "html"]].itertuples(index=False):
            no = int(no)
            if not is_reader:
                if low is not None and top > self.limit and no < top - self.limit:
                    continue  # behind the ring already
                new[no] = (kind, html)
                low, top = (no, no) if low is None else (min(low, no), max(top, no))
                while top > self.limit and low < top - self.limit:  # in place: one step a new event
                    new.pop(low, None)
                    if first <= low <= last:
                        self.log.removeKey((low,))
                    low += 1
                continue
            for seq in range(max(no + 1, low), top + 1) if low is not None else ():
                if (found := event(seq)) is not None:
                    out.append((no, seq, *found))
        for seq, value in new.items():  # only what is still in the ring is stored
            self.log.updateValue((seq,), value)
        if low is not None:
            self.bounds.update((low, top))
        yield from _frames([(_one(key), *r) for r in out], ["session_id", "after", "seq", "type", "html"])


def replay_stream(rows: DataFrame, limit: int = fv.EVENT_LOG_LIMIT) -> DataFrame:
    """What each reader is sent when it comes: session_id, after, seq, type, html.

    ``rows``: session_id, at (microseconds), is_reader, no, type, html; ``no`` is the number of an event, or the resume point of a reader. Rows are
    taken in the order of ``at``, events before readers. State is a ring of ``limit`` + 1 events a session, trimmed in place.
    """
    return rows.groupBy("session_id").transformWithStateInPandas(
        Ring(limit), "session_id bigint, after bigint, seq bigint, type string, html string", "append", "None"
    )
