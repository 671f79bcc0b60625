"""Complete top-level blocks out of one growing buffer: the sequential form, used by the stream that holds the buffer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claridoc.functions import fixed_values as fv

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*>", re.A)
_WS = "[" + fv.WHITESPACE + "]"
_FENCE_OPEN = re.compile(rf"^{_WS}*```(?:html)?{_WS}*", re.I)
_FENCE_CLOSE = re.compile(rf"{_WS}*```{_WS}*\Z")
_VOID = frozenset(fv.VOID_TAGS)


def strip_fence(text: str) -> str:
    return _FENCE_CLOSE.sub("", _FENCE_OPEN.sub("", text, count=1), count=1)


def _lead(gap: str) -> tuple[list[str], str]:
    """Text between blocks: finished stray text as a paragraph, and what starts at a bare '<'."""
    gap = gap.lstrip(fv.WHITESPACE)
    at = gap.find("<")
    text, rest = (gap, "") if at < 0 else (gap[:at], gap[at:])
    text = text.strip(fv.WHITESPACE)
    return ([f"<p>{text}</p>"] if text else []), rest


def scan_blocks(text: str) -> tuple[list[str], str]:
    """Finished blocks and the unfinished tail, in one pass over the tags.

    A block ends where opened and closed tags balance again; a void tag between blocks is a block.
    """
    blocks: list[str] = []
    done, begin, depth, inside = 0, 0, 0, False
    for m in _TAG.finditer(text):
        closing = m.group().startswith("</")
        void = m.group().endswith("/>") or m.group(1).lower() in _VOID
        if not inside:
            stray, bare = _lead(text[done : m.start()])
            blocks += stray
            begin, depth, inside = m.start() - len(bare), 0, True
        if closing:
            depth -= 1
        elif not void:
            depth += 1
        if depth == 0:
            blocks.append(text[begin : m.end()].strip(fv.WHITESPACE))
            done, inside = m.end(), False
    if inside:
        return blocks, text[begin:]
    tail = text[done:].lstrip(fv.WHITESPACE)
    if "<" in tail and not tail.startswith("<"):
        stray, tail = _lead(tail)
        blocks += stray
    return blocks, tail


def split_blocks(buffer: str) -> tuple[list[str], str]:
    """The same for a buffer that a code fence may enclose."""
    return scan_blocks(strip_fence(buffer))


def all_blocks(text: str) -> list[str]:
    """Blocks of a finished text; what is left at the end counts as a block."""
    blocks, rest = split_blocks(text)
    rest = strip_fence(rest).strip(fv.WHITESPACE)
    return blocks + [rest] if rest else blocks


def _of_stretch(text: str, at: int, ended: bool, opening: bool) -> list[str]:
    """Blocks of one stretch, whose first tag is at ``at`` (-1: none): stray text before it as a paragraph, and the rest."""
    if opening:
        bare = _FENCE_OPEN.sub("", text, count=1)
        text, at = bare, at if at < 0 else at - len(text) + len(bare)
    gap, rest = (text, "") if at < 0 else (text[:at], text[at:])
    if at < 0 and "<" not in gap:
        stray, body = [], gap.lstrip(fv.WHITESPACE)
    else:
        stray, lead = _lead(gap)
        body = lead + rest
    block = (body if ended else strip_fence(body)).strip(fv.WHITESPACE)
    return stray + [block] if block else stray


def whole_blocks(text: str) -> list[str]:
    """Blocks of a finished text, as ``splitting`` finds them by prefix sums: one pass, a stretch ends where tags balance."""
    blocks: list[str] = []
    done, first, depth = 0, -1, 0
    for m in _TAG.finditer(text):
        if first < 0:
            first = m.start()
        tag = m.group()
        if tag.startswith("</"):
            depth -= 1
        elif not (tag.endswith("/>") or m.group(1).lower() in _VOID):
            depth += 1
        if depth == 0:
            blocks += _of_stretch(text[done : m.end()], first - done, True, done == 0)
            done, first = m.end(), -1
    if done < len(text):
        blocks += _of_stretch(text[done:], first - done if first >= 0 else -1, False, done == 0)
    return blocks


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), which Spark has no function for."""
    return texts.str.normalize("NFKD")
