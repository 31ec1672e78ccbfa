"""Text columns: trimming, markup removal, entity decoding, formatting."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body, and letters/digits/underscore in any script.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

# The part of a tag after its name; quotes only count after "=".
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""

_MARKUP = (
    r"<(?is)(?:!--.*?(?:-->|\z)"
    r"|script(?:\s[^>]*)?>(.*?)</script\s*>"
    r"|style(?:\s[^>]*)?>(.*?)</style\s*>"
    r"|[!?][^>]*>"
    rf"|/?[a-z][^\s>/]*{ATTRS}>)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def apply_sql(value: Column, body: str) -> Column:
    """``body``, an SQL expression over ``v``, applied to a column."""
    return F.call_function("transform", F.array(value), F.expr(f"v -> {body}")).getItem(0)


def let_sql(name: str, value: str, body: str) -> str:
    """SQL expression ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


# One piece after a "&": p is the piece, m the map of names, e the reference.
_DECODE = let_sql(
    "e",
    "regexp_extract(p, '^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);', 1)",
    "coalesce(concat(if(startswith(e, '#'), "
    + let_sql(
        "n",
        "cast(if(lower(e) like '#x%', conv(substr(e, 3), 16, 10), substr(e, 2)) as bigint)",
        "if(n between 1 and 55295 or n between 57344 and 1114111,"
        " decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32'), null)",
    )
    + ", try_element_at(v.m, e)), substr(p, length(e) + 2)), concat('&', p))",
)


def decode_entities(text: Column) -> Column:
    """Replace named and numeric character references; unknown ones stay as they are."""
    names = {name: chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}
    named = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    body = (
        "if(contains(v.t, '&'), array_join(transform(split(v.t, '&'), (p, i) -> "
        f"if(i = 0, p, {_DECODE})), ''), v.t)"
    )
    return apply_sql(F.named_struct(F.lit("t"), text, F.lit("m"), named), body)


def strip_markup(html: Column) -> Column:
    """Text nodes only: tags and comments go, script and style text stays."""
    return F.regexp_replace(html, _MARKUP, "$1$2")


def text_content(html: Column) -> Column:
    """All text of an element with character references decoded, trimmed."""
    return strip(decode_entities(strip_markup(html)))


def text_nodes(fragment: Column) -> Column:
    """Text between tags, in order, with character references decoded."""
    pieces = F.filter(F.split(fragment, rf"(?is)</?[a-z][^\s>/]*{ATTRS}>"), lambda p: p != "")
    return F.transform(pieces, decode_entities)


def page_text(html: Column) -> Column:
    """Every tag replaced by one space, for pattern search."""
    return F.regexp_replace(html, "<[^>]+>", " ")


def micros(time: Column) -> Column:
    """Microseconds of a time with or without zone."""
    return F.unix_micros(time.cast("timestamp"))


def format_bytes(size: Column) -> Column:
    """``1.5 KB`` style sizes; exact half steps round to the even digit."""
    size = size.cast("long")

    def scaled(power: int, unit: str) -> Column:
        step = F.lit(1024**power).cast("long")
        rest = F.pmod(size, step) * 10
        whole = _div(size, step)
        digit = _div(rest, step)
        tail = F.pmod(rest, step) * 2
        up = (tail > step) | ((tail == step) & (F.pmod(digit, F.lit(2)) == 1))
        tenths = whole * 10 + digit + up.cast("long")
        return F.concat(
            _div(tenths, F.lit(10)).cast("string"),
            F.lit("."),
            F.pmod(tenths, F.lit(10)).cast("string"),
            F.lit(f" {unit}"),
        )

    units = ["B", "KB", "MB", "GB", "TB"]
    out = scaled(5, "PB")
    for power in range(len(units) - 1, -1, -1):
        out = F.when(size < 1024 ** (power + 1), scaled(power, units[power])).otherwise(out)
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def format_duration(seconds: Column) -> Column:
    """``1h 30m 45s``; zero parts are left out."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    secs = F.floor(F.pmod(seconds, F.lit(60.0)))

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit)))

    none = (hours <= 0) & (minutes <= 0)
    return F.concat_ws(
        " ", part(hours, "h"), part(minutes, "m"), F.when(none & (secs <= 0), "0s").otherwise(part(secs, "s"))
    )


def first_semester(text: Column) -> Column:
    found = F.regexp_extract(text, f"(?i)(Spring|Fall|Summer|Winter)[{SPACE}]+[0-9]{{4}}", 0)
    return F.when(found != "", found)


# Date shapes looked for next to a link, in this order, with the
# formats that read them.
_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_SHAPES = [
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"),
    (rf"[0-9]{{1,2}}\s+{_MONTHS}\s+[0-9]{{4}}", "d MMM yyyy"),
    (rf"{_MONTHS}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}", "MMM d yyyy"),
]


def find_date(text: Column) -> Column:
    """First date shape found in ``text`` that is a real date."""

    def read(fmt: str) -> Callable[[Column], Column]:
        # What is not found is not parsed: a failed parse costs far more than the search.
        plain = lambda hit: F.initcap(F.regexp_replace(hit, r"[,\s]+", " "))
        return lambda hit: F.when(hit != "", F.try_to_timestamp(plain(hit), F.lit(fmt)).cast("date"))

    return F.coalesce(*[let(F.regexp_extract(text, f"(?i){pattern}", 0), read(fmt)) for pattern, fmt in DATE_SHAPES])


def meta_prefix_map(entries: Column, prefix: str) -> Column:
    """Map of the entries (key, value) whose key starts with ``prefix``, prefix
    removed; the last of equal keys counts, empty keys and values are left out."""
    picked = F.filter(
        entries,
        lambda e: e["key"].startswith(prefix)
        & (F.replace(e["key"], F.lit(prefix), F.lit("")) != "")
        & (e["value"] != ""),
    )
    short = F.transform(
        picked, lambda e: F.struct(F.replace(e["key"], F.lit(prefix), F.lit("")).alias("key"), e["value"].alias("value"))
    )
    return last_wins_map(short)


def last_wins_map(entries: Column) -> Column:
    """Map from an array of (key, value); the last of equal keys counts. Sorted by key and place, so that the
    last of a run of equal keys is found by a look at the next entry; keys stay in the order of their last place."""

    def lasts(rows: Column) -> Column:
        return F.filter(rows, lambda r, i: F.coalesce(F.get(rows, i + 1)["key"] != r["key"], F.lit(True)))

    placed = F.transform(
        entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))
    )
    kept = let(F.array_sort(placed), lasts)
    ordered = F.array_sort(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["key"].alias("key"), r["value"].alias("value"))))
    return F.map_from_entries(F.transform(ordered, lambda r: F.struct(r["key"], r["value"])))


def map_json(entries: Column) -> Column:
    """A string map as JSON text with sorted keys."""
    rows = F.array_sort(F.map_entries(entries))
    return F.to_json(F.map_from_entries(rows))
