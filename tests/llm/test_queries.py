"""Numbered queries against their SQL, on given tables, on edge cases and on empty tables."""

import pytest

from claridoc.llm.queries import CHECKS, QUERIES

from .conftest import GIVEN, canonical, expected


@pytest.mark.parametrize("name", list(CHECKS))
@pytest.mark.parametrize("where", ["given", "edges", "nothing"])
def test_query_equals_sql(spark, request, name, where):
    folder = GIVEN if where == "given" else request.getfixturevalue(where)
    got, want = QUERIES[name](spark, folder).toPandas(), expected(folder, CHECKS[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in CHECKS])
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("op5_chat_format", "op13_prefix_trie")])  # those are about chats
def test_one_row_a_document(spark, edges, name):
    assert QUERIES[name](spark, edges).count() == 25
