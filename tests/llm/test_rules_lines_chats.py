import pytest
from pyspark.sql import functions as F

from claridoc.llm.chat_format import format_chats, read_back, unescape
from claridoc.llm.line_dedup import remove_repeated_lines
from claridoc.llm.quality_rules import POLICIES, ablations, mask_of, rule_ledger, verdicts

from .conftest import prose


def test_ablations_count_single_handed_rejections(spark):
    good = prose(1, 120)
    rows = [(1, good), (2, "short"), (3, "a b c " * 40), (4, good + " #" * 40), (5, "# " * 90), (6, None)]
    ledger = rule_ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.version, r["rule"]): (r.documents, r.failed, r.rejected, r.only_by_rule) for r in ablations(ledger).collect()}
    assert got["base", "few_words"] == (6, 2, 4, 2)
    assert got["base", "repeated_words"] == (6, 2, 4, 2)
    assert got["v1", "many_symbols"] == (6, 2, 5, 1)
    kept = {r.doc_id: (r.kept_base, r.kept_v1) for r in verdicts(ledger, POLICIES).collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False)}


def test_mask_of_rules():
    assert mask_of(("few_words", "many_symbols")) == 5
    with pytest.raises(KeyError):
        mask_of(("no such rule",))


def test_earliest_run_of_lines_stays(spark):
    run = "l1\nl2\n\nl3\nl4"
    rows = [(5, "x\n" + run + "\ny", 9), (2, run, 8), (7, "l2\nl3", 7), (8, run + "\n" + run, 6), (9, None, 5), (None, "q\nw\ne", 4), (1, "q\nw\ne\nr", 3), (8, run + "\n" + run, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_deleted int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in remove_repeated_lines(frame).collect()), key=str)
    assert got == sorted([(5, "x\n\ny", 6, 4), (2, run, 4, 0), (7, "l2\nl3", 2, 0), (8, "\n", 8, 8), (8, "\n", 8, 8), (9, None, 0, 0), (None, "q\nw\ne", 3, 0), (1, "r", 4, 3)], key=str)


def test_a_longer_match_goes_whole(spark):
    lines = [f"line {i}" for i in range(30)]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own"] + lines[4:20] + ["end"]))], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_lines(frame, 5).collect()}[2] == "own\nend"


def test_long_runs_of_one_or_two_lines_go_when_asked(spark):
    long, half, short = prose(3, 25).replace("\n", " "), prose(4, 12).replace("\n", " "), "a short line"
    pair = half + "\n" + half[::-1]
    rows = [(1, long), (2, "own\n" + long), (3, pair), (4, pair), (5, short), (6, short)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_lines(frame, long_words=20).collect()} == dict(rows) | {2: "own", 4: ""}
    assert {r.doc_id: r.text for r in remove_repeated_lines(frame).collect()} == dict(rows)


def test_long_chats_come_in_parts(spark, monkeypatch):
    from claridoc.llm import chat_format

    monkeypatch.setattr(chat_format, "PART_BYTES", 64)
    rows = [(d, i, "assistant" if i % 2 else "user", prose(d + i, 30)) for d in range(3) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, at long, role string, text string")
    parts = format_chats(frame)
    assert parts.where("part > 0").count() > 10
    whole = read_back(parts).collect()
    assert [r.n_turns for r in whole] == [20] * 3
    text = {}
    for r in parts.collect():
        text[r.doc_id] = text.get(r.doc_id, "") + r.formatted
    assert all(text[d] == "".join(f"<|im_start|>{role}\n{t}<|im_end|>\n" for e, _, role, t in rows if e == d) for d in range(3))
    spans = [unescape(r.formatted.encode()[s.start : s.end]).decode() for r in parts.collect() for s in r.loss]
    assert sorted(spans) == sorted(t for _, _, role, t in rows if role == "assistant")


def test_another_trained_role(spark):
    frame = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "xy")], "doc_id long, at long, role string, text string")
    assert read_back(format_chats(frame, "user")).select(F.col("loss_chars")).first()[0] == 3
