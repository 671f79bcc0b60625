"""Address column functions: parts, network guard, ingest gate and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import let, trimmed, truthy

_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


_SPECIAL = ["http", "https", "ftp", "ws", "wss", "file"]
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\\\]*([^/\\\\?#]*)"


def scheme(url: Column) -> Column:
    """Lower-case scheme; NULL when the text does not start with one."""
    return F.lower(truthy(F.regexp_extract(trimmed(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def raw_host(url: Column) -> Column:
    """Host as written, lower-case, without user, port and brackets."""
    authority = F.regexp_replace(F.regexp_extract(trimmed(url), _AUTHORITY, 1), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))


def _ipv4(h: Column) -> Column:
    """Dotted form of a numeric host (decimal, octal or hex parts); NULL when it is out of range."""
    return let(F.split(h, r"\."), _dotted)


def _dotted(parts: Column) -> Column:

    def number(p: Column) -> Column:
        # leading zeros say nothing; more than 8 hexadecimal or 11 octal digits are out of range, which is NULL here
        return (
            F.when(p.rlike(r"^0x0*[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), F.regexp_replace(p, "^0x0*", "")), 16, 10))
            .when(p.rlike(r"^0+[0-7]{1,11}$"), F.conv(F.regexp_replace(p, "^0+", "0"), 8, 10))
            .when(p.rlike(r"^(0|[1-9][0-9]*)$"), p)
            .try_cast("bigint")
        )

    n = F.size(parts)
    room = F.pow(F.lit(256.0), 5 - n)

    def checked(numbers: Column) -> Column:
        last = F.try_element_at(numbers, F.lit(-1))
        heads = F.slice(numbers, F.lit(1), F.greatest(n - 1, F.lit(0)))
        fits = (n <= 4) & F.forall(heads, lambda v: F.coalesce(v <= 255, F.lit(False))) & (last < room)
        value = last
        for i in range(3):
            place = 256 ** (3 - i)
            value = value + F.coalesce(F.when(n > i + 1, F.try_element_at(numbers, F.lit(i + 1)) * place), F.lit(0))
        return F.when(fits, value)

    def written(value: Column) -> Column:
        octets = [F.shiftright(value, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)]
        return F.when(value.isNotNull(), F.concat_ws(".", *octets))

    return let(let(F.transform(parts, number), checked), written)


def host(url: Column) -> Column:
    """Host as a browser names it: numeric hosts become dotted quads. NULL when it is not valid."""

    def named(h: Column) -> Column:
        valid = (h != "") & ~h.rlike(r"[\s<>^|%@]") & (~h.rlike(r"[\[\]]") | h.rlike(r"^\[[0-9a-f:.]+\]$"))
        numeric = h.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return F.when(valid, F.when(numeric, _ipv4(F.regexp_replace(h, r"\.$", ""))).otherwise(h))

    return let(raw_host(url), named)


def blocked_host(raw: Column) -> Column:
    """True for hosts inside a private, reserved or local network."""
    return let(F.regexp_replace(F.lower(raw), r"^\[(.*)\]$", "$1"), _blocked)


def _blocked(h: Column) -> Column:
    quad = F.transform(F.split(h, r"\."), lambda p: p.try_cast("int"))
    return (
        F.when((h == "") | h.isin(fv.BLOCKED_HOSTS), True)
        .when(h.rlike(r"\.(localhost|internal|local)$"), True)
        .when(F.contains(h, F.lit(":")), True)
        .when(h.rlike(_QUAD), let(quad, _reserved))
        .otherwise(h.rlike(r"^(0x[0-9a-f]+|\d+)$"))
    )


def _reserved(o: Column) -> Column:
    a, b, c = o[0], o[1], o[2]
    return (
        (F.array_max(o) > 255)
        | a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & (c == 0))
        | (a >= 224)
    )


# rule -> (admitted, level, what is said about the host)
_RULES = {
    "invalid": (False, "L3", "Invalid URL."),
    "scheme": (False, "L3", "Only http(s) URLs are allowed."),
    "internal": (False, "L3", " is an internal/reserved address — refusing to fetch (that would defeat a network access control)."),
    "gated": (False, "L3", " is license/permission-gated (L3) — cannot fetch. Upload the file you lawfully obtained instead."),
    "open": (True, "L0", " is an open/public-record source (L0)."),
    "lawful": (True, "L1", " is lawfully reachable (L1) — rendered privately for you, not published."),
    "private": (True, "P", " unclassified — treated as a private, user-asserted view (P); never published."),
}


def gate_rule(s: Column, h: Column) -> Column:
    """Name of the first rule that applies to a scheme and host."""
    return (
        F.when(s.isNull(), "invalid")
        .when(~s.isin("http", "https"), "scheme")
        .when(h.isNull(), "invalid")
        .when(blocked_host(h), "internal")
        .when(h.rlike(fv.GATED_HOSTS), "gated")
        .when(h.rlike(fv.OPEN_HOSTS), "open")
        .when(h.rlike(fv.LAWFUL_HOSTS), "lawful")
        .otherwise("private")
    )


def gate_answer(rule: Column, h: Column) -> Column:
    """STRUCT<ok, level, reason> of a rule."""
    answer = None
    for name, (ok, level, text) in _RULES.items():
        reason = F.concat(h, F.lit(text)) if text.startswith(" ") else F.lit(text)
        row = F.struct(F.lit(ok).alias("ok"), F.lit(level).alias("level"), reason.alias("reason"))
        answer = F.when(rule == name, row) if answer is None else answer.when(rule == name, row)
    return answer


def redact_url(url: Column) -> Column:
    """Origin and path only; says so when a query or fragment was cut."""
    parts = F.struct(trimmed(url).alias("text"), scheme(url).alias("s"), host(url).alias("h"), url.alias("url"))
    return let(parts, _redacted)


def _redacted(p: Column) -> Column:
    text, s, h = p["text"], p["s"], p["h"]
    port = F.regexp_extract(F.regexp_extract(text, _AUTHORITY, 1), r":([0-9]+)$", 1)
    usual = F.when(s.isin("http", "ws"), "80").when(s.isin("https", "wss"), "443").when(s == "ftp", "21").otherwise("")
    origin = F.concat(s, F.lit("://"), h, F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_extract(text, _AUTHORITY + r"([^?#]*)", 2)
    cut = text.rlike(r"^[^#]*\?[^#]|#.")
    parsed = F.concat(origin, F.when(path == "", "/").otherwise(path), F.when(cut, " (query redacted)").otherwise(""))
    return F.when(s.isin(_SPECIAL) & h.isNotNull(), parsed).otherwise(F.regexp_extract(p["url"], r"^([^?#]*)", 1))
