"""Text and markup column functions. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.hashing import short_hash

# one whitespace character, as a pattern
WS = "[" + fv.WHITESPACE + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column) -> Column:
    """Strip every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def truthy(c: Column) -> Column:
    """A string counts only when it is neither NULL nor empty."""
    return F.nullif(c, F.lit(""))


def escape4(c: Column) -> Column:
    """Escape ampersand, angle brackets and double quotes; NULL becomes empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_html(c: Column) -> Column:
    """Escape the four characters above and the apostrophe."""
    return F.replace(escape4(c), F.lit("'"), F.lit("&#39;"))


def block_id(page: Column, order: Column, text: Column) -> Column:
    return F.concat_ws("-", F.lit("block"), page.cast("string"), order.cast("string"), short_hash(text))


def strip_fence(c: Column) -> Column:
    """Remove a code fence around streamed markup."""
    opened = F.regexp_replace(c, rf"(?i)^{WS}*```(?:html)?{WS}*", "")
    return F.regexp_replace(opened, rf"{WS}*```{WS}*\z", "")


def existing_block_id(html: Column) -> Column:
    """The id attribute of the first tag, NULL when there is none."""
    attrs = F.regexp_extract(html, r"^<([a-zA-Z][\w-]*)\b([^>]*)>", 2)
    return truthy(F.regexp_extract(attrs, r"""\bid\s*=\s*["']([^"']+)["']""", 1))


def with_block_id(html: Column, fallback: Column) -> Column:
    """Markup that carries an id: its own, or the fallback put right after the tag name."""
    tag = r"^<([a-zA-Z][\w-]*)\b"
    is_tag = html.rlike(tag + r"[^>]*>")
    name = F.regexp_extract(html, tag, 1)
    injected = F.concat(
        F.lit("<"), name, F.lit(' id="'), fallback, F.lit('"'), F.substr(html, F.length(name) + 2)
    )
    return F.when(is_tag & existing_block_id(html).isNull(), injected).otherwise(html)


def wrap_table(html: Column) -> Column:
    wrapped = F.concat(F.lit('<div class="a11y-table-scroll">'), html, F.lit("</div>"))
    return F.when(html.rlike(rf"(?i)^{WS}*<table(?:{WS}|>)"), wrapped).otherwise(html)


def safe_url(c: Column) -> Column:
    """True for the address forms that may stay in cleaned markup."""
    low = F.lower(trimmed(c))
    ok = F.lit(False)
    for start in fv.SAFE_URL_STARTS:
        ok = ok | F.startswith(low, F.lit(start))
    return ok


def displayed(df: DataFrame, texts: dict[str, int] | None = None, lists: dict[str, int] | None = None) -> DataFrame:
    """Last projection of a page: the first characters of long texts and the first items of long lists, by column.

    Operators keep full values; only what is shown is cut, here and nowhere else.
    """
    cuts = {c: F.substring(c, 1, n) for c, n in (texts or {}).items()} | {c: F.slice(c, 1, n) for c, n in (lists or {}).items()}
    return df.withColumns(cuts)


def status_label(c: Column) -> Column:
    return (
        F.when(c == "pending-human-review", "review")
        .when(c == "not_present", "n/a")
        .when(c == "cannot_tell", "needs human")
        .otherwise(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))
    )


def number_text(c: Column) -> Column:
    """A number rounded to two places, written without trailing zeros (4.5, 3, 21)."""
    fixed = F.format_string("%.2f", c)
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ""))
