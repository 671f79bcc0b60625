"""The review ledger: events, latest rows, the human gate, its deadline and parked work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import trimmed, truthy
from claridoc.operators import criteria, ordered

REQUESTED, APPROVED, REJECTED = "human.review.requested", "human.approved", "human.rejected"
_ORDER = ["ts", "event_id"]


def _latest(*columns: str) -> Column:
    return F.struct(*(columns or _ORDER))


def ledger(events: DataFrame) -> DataFrame:
    """Position of each event in its document's log, by arrival."""
    return ordered.row_number(events, ["doc_id"], _ORDER, ordered.time_bucket("ts"), "seq")


def latest_rows(updates: DataFrame, values: list[str]) -> DataFrame:
    """Last update per document and agent; its time orders the rows of a report."""
    return ordered.last_per_key(updates, ["doc_id", "agent"], [F.col("ts"), F.col("event_id")], ["ts", "event_id", *values])


def step_state(events: DataFrame, docs: DataFrame) -> DataFrame:
    """State of the pipeline steps per document. The three usual steps start as pending; others join when seen."""
    seeds = docs.select("doc_id", F.explode(F.array(*[F.lit(s) for s in fv.STEPS])).alias("step"))
    marks = events.filter(F.col("status").isin("started", "done")).select("doc_id", "step", "status", "ts", "event_id")
    both = marks.unionByName(seeds, allowMissingColumns=True)
    when = lambda s: F.max(F.when(F.col("status") == s, F.col("ts")))
    position = F.when(F.col("ts").isNotNull(), _latest())
    return both.groupBy("doc_id", "step").agg(
        F.coalesce(F.max_by("status", position), F.lit("pending")).alias("status"), when("started").alias("started_at"), when("done").alias("done_at")
    )


def gate_fsm(events: DataFrame) -> DataFrame:
    """Replay of the human gate: what each request and decision did.

    A request opens the gate; the first decision that is not held back closes it; a held decision
    is put off; decisions on a closed gate are recorded without effect. So a decision acts exactly
    when the last request or free decision before it was a request, which is one carried value.
    """
    kinds = events.filter(F.col("event").isin(REQUESTED, APPROVED, REJECTED))
    held = F.coalesce("held", F.lit(False))
    mark = F.when(F.col("event") == REQUESTED, "request").when(~held, "decision")
    seen = ordered.last_before(kinds, ["doc_id"], _ORDER, ordered.time_bucket("ts"), mark, "__before")
    open_ = F.coalesce(F.col("__before") == "request", F.lit(False))
    outcome = (
        F.when(F.col("event") == REQUESTED, "pending_review").when(~open_, "no open gate").when(held, "deferred")
        .when(F.col("event") == APPROVED, "finalized").otherwise("rejected")
    )
    return seen.withColumn("outcome", outcome).drop("__before")


def gate_now(replayed: DataFrame) -> DataFrame:
    """The gate each document ended with."""
    moves = F.col("outcome").isin("pending_review", "finalized", "rejected")
    return replayed.groupBy("doc_id").agg(F.coalesce(F.max_by("outcome", F.when(moves, _latest())), F.lit("open")).alias("gate"))


def record_decide(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the last decision per document to its record, whatever the gate; decisions without a record are errors.

    ``decisions``: doc_id, ts, event_id, decision (approve or reject), note.
    """
    last = ordered.last_per_key(decisions, ["doc_id"], [F.col("ts"), F.col("event_id")], ["ts", "decision", "note"])
    known = records.select("doc_id", F.lit(True).alias("known"))
    approve = F.col("decision") == "approve"
    return last.join(known, "doc_id", "left").select(
        "doc_id", F.when(F.col("known"), F.when(approve, "finalized").otherwise("rejected")).alias("gate"),
        F.when(F.col("known"), F.when(approve, "Attested").otherwise("Audited")).alias("tier"),
        F.when(F.col("known"), approve).alias("finalized"), F.when(F.col("known"), F.col("ts")).alias("decided_at"),
        F.when(F.col("known"), F.col("note")).alias("note"), F.when(F.col("known").isNull(), "no_audit_record").alias("error"),
    )


def ends_deadline() -> Column:
    """Requests, and decisions that are not held back."""
    return (F.col("event") == REQUESTED) | (F.col("event").isin(APPROVED, REJECTED) & ~F.coalesce("held", F.lit(False)))


def review_sla(events: DataFrame, days: int = fv.REVIEW_DAYS, as_of: datetime | None = None) -> DataFrame:
    """What became of every review request: decided, superseded by a new request, elapsed or still open.

    A decision that is held back leaves the deadline armed. Only the next free human event counts, so
    logs of any length split by hour.
    """
    human = events.filter(ends_deadline()).select("doc_id", "ts", "event_id", "event")
    seen = ordered.next_row(human, ["doc_id"], _ORDER, ordered.time_bucket("ts"), ["ts", "event"], "next")
    deadline = F.col("ts") + F.expr(f"INTERVAL {days} DAYS")
    requests = seen.filter(F.col("event") == REQUESTED).select("*", deadline.alias("deadline"), F.col("next.ts").alias("next_ts"), F.col("next.event").alias("next_event"))
    in_time = F.col("next_ts") <= F.col("deadline")
    later = F.lit(False) if as_of is None else F.col("deadline") > F.lit(as_of)
    return requests.select(
        "doc_id", "event_id", F.col("ts").alias("requested_at"), "deadline",
        F.when(in_time & (F.col("next_event") == REQUESTED), "superseded").when(in_time, "decided").when(later, "open").otherwise("elapsed").alias("outcome"),
    )


def pending_domains(dispatched: DataFrame, reported: DataFrame, rows: DataFrame, parked: DataFrame) -> DataFrame:
    """Domains still missing per document, and its gate: open until all reported, then worst case."""
    missing = dispatched.select("doc_id", "domain").distinct().join(reported.select("doc_id", "domain"), ["doc_id", "domain"], "left_anti")
    waiting = missing.groupBy("doc_id").agg(F.count("*").alias("n_pending"))
    docs = dispatched.select("doc_id").distinct()
    gates = criteria.report_gate(docs, rows, parked)
    n = F.coalesce("n_pending", F.lit(0))
    return gates.join(waiting, "doc_id", "left").select("doc_id", n.alias("n_pending"), F.when(n > 0, "open").otherwise(F.col("gate")).alias("gate"))


def parked(events: DataFrame) -> DataFrame:
    """Work still parked: registered last, and neither finished nor released since.

    A release that failed leaves it parked, unless the message says it was gone already.
    """
    gone = F.lower("message").rlike("not found|does not exist|terminated|completed")
    failed = (F.col("kind") == "release") & F.col("message").isNotNull() & ~gone
    last = ordered.last_per_key(events.filter(~F.coalesce(failed, F.lit(False))), ["doc_id", "workflow_id"], [F.col("ts"), F.col("event_id")], ["kind", "domain"])
    return last.filter(F.col("kind") == "parked").select("doc_id", "workflow_id", "domain")


def supersede(rows: DataFrame, parked_runs: DataFrame) -> DataFrame:
    """Rows of the run that counts: the newest, but no run may pass one that is still parked."""
    newest = rows.groupBy("doc_id").agg(F.max("run").alias("newest"))
    stuck = parked_runs.groupBy("doc_id").agg(F.min("run").alias("stuck"))
    counts = newest.join(stuck, "doc_id", "left").select("doc_id", F.least(F.col("newest"), F.coalesce("stuck", "newest")).alias("run"))
    return rows.join(counts, ["doc_id", "run"], "left_semi")


def lifecycle_map(progress: DataFrame) -> DataFrame:
    """Progress messages to ledger events. A finished row yields one event, or two when a person is asked."""
    event = lambda name, detail: F.struct(F.lit(name).alias("event"), detail.alias("detail"))
    phase = F.col("phase")
    ready = F.array(
        event("machine.pre_assessment", F.concat(F.lit("verdict="), F.col("verdict"), F.lit(" ("), F.col("rationale"), F.lit(")"))),
        F.when(F.col("needs_human"), event(REQUESTED, F.col("rationale"))),
    )
    plain = F.array(F.struct(phase.alias("event"), F.lit(None).cast("string").alias("detail")))
    made = F.when(phase.isin("routine.started", "routine.done", "turn.started", "turn.done"), plain).when(phase == "row.ready", F.filter(ready, lambda e: e.isNotNull()))
    mine = (F.col("workflow") == "SPECIALIST_WORKFLOW") & truthy(F.col("domain")).isNotNull()
    return progress.filter(mine).select("doc_id", "event_id", "ts", F.col("domain").alias("agent"), F.posexplode(made).alias("ord", "e")).select(
        "doc_id", "event_id", "ts", "agent", F.col("ord").cast("bigint").alias("ord"), "e.*"
    )


def _display_class() -> Column:
    return F.when(F.startswith("event", F.lit("human")), "human").when(F.instr("event", ".done") > 1, "done").otherwise("")


def event_feed(events: DataFrame) -> DataFrame:
    """Every event of each document, ranked from the newest, with its display class.

    The rank is the number of events from here on, counted over hours of the log, so one long log splits.
    """
    count = ordered.row_number(events, ["doc_id"], _ORDER, ordered.time_bucket("ts"), "__nth")
    total = events.groupBy("doc_id").agg(F.count("*").alias("__all"))
    same = F.col("e.doc_id").eqNullSafe(F.col("t.doc_id"))
    ranked = count.alias("e").join(total.alias("t"), same).select("e.*", (F.col("__all") - F.col("__nth") + 1).alias("rank")).drop("__nth")
    return ranked.withColumn("class", _display_class())


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """A report of the newest ``n`` events per document, limited before the shuffle."""
    return ordered.smallest_k(events, ["doc_id"], [F.desc("ts"), F.desc("event_id")], n, "rank").withColumn("class", _display_class())


def context_summary(gates: DataFrame, steps: DataFrame, rollups: DataFrame, rows: DataFrame, events: DataFrame, shown_events: int = 6) -> DataFrame:
    """What a reader is told about each document: gate, steps, counters, rows and its last ``shown_events`` events."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in fv.STEPS]), F.col("step")).cast("int"), F.lit(0))
    shown = F.array_sort(F.collect_list(F.struct(F.when(place == 0, 99).otherwise(place).alias("at"), "step", "status")))
    step_text = steps.groupBy("doc_id").agg(F.array_join(F.transform(shown, lambda s: F.concat(s["step"], F.lit(":"), s["status"])), ", ").alias("steps"))
    recent = newest_events(events, shown_events).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), "event"))), lambda e: e["event"]), ", ").alias("recent")
    )
    n_rows = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    counters = F.format_string("WCAG 2.2 AA rollup — total %d, pass %d, fail %d, needs-human %d, n/a %d", "total", "passed", "failed", "needs_human", "not_applicable")
    told = rollups.select("doc_id", counters.alias("told"))
    joined = gates.select("doc_id", "gate").join(step_text, "doc_id", "left").join(told, "doc_id", "left").join(n_rows, "doc_id", "left").join(recent, "doc_id", "left")
    return joined.select(
        "doc_id", "gate", F.coalesce("steps", F.lit("none yet")).alias("steps"), F.coalesce("told", F.lit("WCAG rollup: not run yet")).alias("rollup"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("recent", F.lit("none")).alias("recent"),
    )


def chat_turns(turns: DataFrame) -> DataFrame:
    """Turns as kept: what people wrote trimmed and dropped when empty; answers as they are."""
    mine = F.col("role") == "user"
    kept = F.when(mine, trimmed(F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return turns.withColumn("text", kept).filter(~mine | (F.col("text") != ""))


def chat_state(turns: DataFrame) -> DataFrame:
    """Turns per conversation and whether an answer is still due."""
    return chat_turns(turns).groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.max_by("role", "turn") == "user").alias("thinking"))


def phase_done(steps: DataFrame, slices: DataFrame) -> DataFrame:
    """Whether each phase is finished: its step, its older name, or its stored result (doc_id, step)."""
    alias = F.create_map(*[F.lit(x) for phase, names in fv.STEP_ALIASES.items() for n in names for x in (n, phase)])
    named = steps.select("doc_id", F.try_element_at(alias, F.col("step")).alias("phase"), (F.col("status") == "done").alias("done"))
    stored = slices.select("doc_id", F.col("step").alias("phase"), F.lit(True).alias("done"))
    return named.unionByName(stored).filter(F.col("phase").isNotNull()).groupBy("doc_id", "phase").agg(F.bool_or("done").alias("done"))


def event_rates(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and time window; works on tables and on streams with a watermark."""
    w = F.window(F.col("ts"), width, slide) if slide else F.window(F.col("ts"), width)
    return events.groupBy(w.alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")
