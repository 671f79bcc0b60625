"""A small folder of tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random
import shutil

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

GIVEN = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdeéstr", k=r.randint(1, 7))) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def edge_rows():
    passage = prose(1, 60)
    base = prose(2, 300)
    near = base.split(" ")
    near[5:6] = ["changed", "here"]
    lines = "first line here\nsecond line, longer\n\nthird line\nfourth line of it"
    texts = [
        base, base, " ".join(near), None, "", "   \n\t ", "one", "ONE", "two words", "a b c d", "a b c d", passage, prose(3, 40) + " " + passage, passage + "\n" + prose(4, 30),
        lines, "before\n" + lines + "\nafter", lines + "\n" + lines, "x " * 5000, prose(5, 12000), "<|im_start|> # * | %| & <n|", "▁ mark ▁▁ \x00 日本", "\n".join(["same line"] * 9), prose(6, 80), prose(7, 55),
    ]
    rows = [{"doc_id": 10 * i + 3, "text": t, "lang": "en" if i % 3 else None, "source": None if i % 5 == 4 else f"src{i % 4}", "n_chars": None} for i, t in enumerate(texts)]
    rows.append(dict(rows[0]))  # a row twice
    # columns that operators use inside or return
    clash = {"block": "b", "shard": 1, "id": 2, "n_words": 3, "kept": "k", "n_deleted": 4, "row": "r", "score": 0.5, "taken": 1, "h": 9, "ids": "i"}
    return [r | clash for r in rows]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("block", pa.string()), ("shard", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("n_deleted", pa.int64()), ("row", pa.string()), ("score", pa.float64()), ("taken", pa.int64()), ("h", pa.int64()), ("ids", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def write(folder, documents, conversations):
    pq.write_table(pa.Table.from_pylist(documents, SCHEMA), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(conversations, TURNS), folder / "conversations.parquet")
    shutil.copy(f"{GIVEN}/labels.parquet", folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edges(tmp_path_factory):
    turns = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (1, 2, "assistant", "<%|im_end|> é <n| <%n|"), (1, 3, "assistant", None), (2, 0, "user", ""),
        (3, None, "assistant", "no turn"), (3, 1, "assi\nstant", "role with a line end"), (4, 1, None, None), (5, 1, "assistant", "tie b"), (5, 1, "assistant", "tie a"), (5, 1, "assistant", "tie a"), (None, 0, "user", "no chat"),
    ]
    return write(tmp_path_factory.mktemp("edges"), edge_rows(), [dict(zip(TURNS.names, t)) for t in turns])


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    return write(tmp_path_factory.mktemp("nothing"), [], [])


def expected(folder: str, sql: str):
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db.sql(sql).df()


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return str(v) if not isinstance(v, float) else str(int(v)) if v.is_integer() else f"{v:.6f}"

    return sorted((tuple(value(v) for v in row) for row in frame.itertuples(index=False)), key=repr)
