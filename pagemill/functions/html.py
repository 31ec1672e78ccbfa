"""Element columns. Elements are found by patterns that read linearly: a container
ends at its first closing tag, attribute quotes only count after ``=``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import ATTRS, decode_entities, let, strip, strip_markup

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
# Flags and choices stand behind the "<", so that a search only stops where a tag may begin.
_CODE = (
    r"<(?is)(?:!--.*?(?:-->|\z)"
    r"|script(?=[\s>])[^>]*>.*?</script\s*>"
    r"|style(?=[\s>])[^>]*>.*?</style\s*>)"
)


def without_code(html: Column) -> Column:
    """Drop comments, scripts and styles, whose text may look like tags."""
    return F.regexp_replace(html, _CODE, "")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def _open(tag: str) -> str:
    return rf"<(?is){tag}(?=[\s/>]){ATTRS}>"


def void_pattern(tag: str) -> str:
    """Pattern of an open tag."""
    return _open(tag)


def element_pattern(tag: str, stop: str | None = None) -> str:
    """Pattern of an element from its open tag up to (not including) the first
    closing tag, or up to any tag whose name matches ``stop``."""
    ends = rf"/{tag}[\s>]" + (f"|{stop}" if stop else "")
    return rf"{_open(tag)}[^<]*+(?:<(?!{ends})[^<]*+)*+"


# Elements that close one another implicitly.
ANCHOR = element_pattern("a", r"a[\s>]")
ROW = element_pattern("tr", r"tr[\s>]|/?(?:table|tbody|thead|tfoot)[\s>]")
CELL = element_pattern("t[dh]", r"/?t[dhr][\s>]|/?(?:table|tbody|thead|tfoot)[\s>]")
OPTION = element_pattern("option", r"/?(?:option|optgroup|select)[\s>]")


def find_all(html: Column, pattern: str) -> Column:
    """All matches of a pattern, in document order."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def inner(element: Column) -> Column:
    """The element without its open tag."""
    return F.regexp_replace(element, rf"(?is)\A<[^\s/>]++{ATTRS}>", "")


def element_text(element: Column) -> Column:
    """All text of an element found by ``find_all``, trimmed."""
    return strip(decode_entities(strip_markup(inner(element))))


def _before(name: str) -> str:
    return (
        rf"(?is)\A<[^\s/>]++(?:[\s/]*+(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]*+{name}"
    )


def attr(element: Column, name: str) -> Column:
    """Value of an attribute with character references decoded; NULL when absent."""
    raw = F.regexp_extract(element, rf"{_before(name)}\s*+=\s*+({_VALUE})", 1)

    def unquoted(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        bare = F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        decoded = F.when(F.contains(v, F.lit("&")), decode_entities(bare)).otherwise(bare)
        return F.when(v != "", decoded)

    return let(raw, unquoted)


def has_attr(element: Column, name: str) -> Column:
    return element.rlike(rf"{_before(name)}[\s=/>]")


def tag_name(element: Column) -> Column:
    return F.lower(F.regexp_extract(element, r"\A<([^\s/>]+)", 1))


def first_text(html: Column, tag: str) -> Column:
    """Trimmed text of the first element with this tag; NULL when there is none."""
    el = F.regexp_extract(html, element_pattern(tag), 0)
    return F.when(el != "", element_text(el))
