"""URL columns: split, resolve, normalise, decode, predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import WORD, apply_sql, let, let_sql

# Schemes whose references resolve against a base, and those whose
# paths carry ";parameters".
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]

# Path endings that are never crawled.
SKIP_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip", ".exe", ".dmg", ".mp3", ".mp4", ".avi", ".mov",
]

# Path parts of navigation pages.
NAVIGATION_PARTS = [
    "/contact", "/about", "/privacy", "/terms", "/login", "/logout", "/register", "/signup",
    "/search", "/help", "/faq", "/sitemap",
]

# Paths that mark a download, endings of downloadable files and
# words in the text of a download link.
DOWNLOAD_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".mp4", ".avi", ".mov", ".wmv", ".webm",
    ".mp3", ".wav", ".ogg",
    ".txt", ".md", ".csv", ".json", ".xml",
    ".jpg", ".jpeg", ".png", ".gif", ".svg",
]
DOWNLOAD_WORDS = ["download", "pdf", "slides", "homework", "assignment", "lecture"]
DOWNLOAD_PATHS = ["/download/", "/files/", "/documents/", "/media/"]

# Fixed value: URLs inside free text.
URL_IN_TEXT = r"https?://[^\s<>" + '"' + r"{}|\\^`\[\]]+"

_CONTROL_OR_SPACE = "".join(map(chr, range(0x21)))


def ends_with_any(text: Column, endings: Sequence[str]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(e) for e in endings) + r")\z")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts))


def clean(url: Column) -> Column:
    """Drop leading control characters and blanks, and tabs and line ends anywhere."""
    return F.translate(F.ltrim(url, F.lit(_CONTROL_OR_SPACE)), "\t\r\n", "")


def _cleaned(text: str) -> str:
    """SQL expression of ``clean``."""
    blanks = "".join(f"\\u{ord(c):04x}" for c in _CONTROL_OR_SPACE)
    return f"translate(ltrim('{blanks}', {text}), '\t\r\n', '')"


def _after(text: str, mark: str) -> str:
    return f"if(instr({text}, '{mark}') > 0, substr({text}, instr({text}, '{mark}') + 1), '')"


def _matches(text: str, names: Sequence[str]) -> str:
    return f"{text} rlike '^(?:{'|'.join(n.replace('+', '[+]') for n in names)})$'"


_NO_FRAGMENT = "substring_index(r, '#', 1)"


def _with_parts(url: str, name: str, body: str) -> str:
    """SQL expression ``body`` in which ``name`` holds scheme, netloc, path, query and
    fragment of a clean URL; the path keeps its parameters."""
    split = let_sql(
        "s",
        f"named_struct('u', {url}, 'scheme', lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)))",
        let_sql(
            "r",
            "if(s.scheme = '', s.u, substr(s.u, length(s.scheme) + 2))",
            let_sql(
                "h",
                f"substring_index({_NO_FRAGMENT}, '?', 1)",
                let_sql(
                    "n",
                    "if(startswith(h, '//'), substring_index(substr(h, 3), '/', 1), '')",
                    "named_struct('scheme', s.scheme, 'netloc', n,"
                    " 'path', if(startswith(h, '//'), substr(h, length(n) + 3), h),"
                    f" 'query', {_after(_NO_FRAGMENT, '?')}, 'fragment', {_after('r', '#')})",
                ),
            ),
        ),
    )
    return let_sql(name, split, body)


def _params(parts: str) -> str:
    """SQL expression: the parameters of the last path part, with their semicolon."""
    last = f"substring_index({parts}.path, '/', -1)"
    at = f"instr({last}, ';')"
    return (
        f"if(contains({parts}.path, ';') and {at} > 0 and {_matches(parts + '.scheme', PARAM_SCHEMES)},"
        f" substr({last}, {at}), '')"
    )


def _path(parts: str, params: str) -> str:
    return f"substr({parts}.path, 1, length({parts}.path) - length({params}))"


_URL_PARTS = _with_parts(
    "v",
    "p",
    let_sql(
        "k",
        _params("p"),
        f"named_struct('scheme', p.scheme, 'netloc', p.netloc, 'path', {_path('p', 'k')},"
        " 'params', substr(k, 2), 'query', p.query, 'fragment', p.fragment)",
    ),
)


# Visible ASCII characters that end no part: of a host, and of a path without parameters.
_HOST_CHAR, _PATH_CHAR = r"""[!"$-.0->@-~]""", r"""[!"$-.0-:<->@-~]"""

# A URL of such characters, without parameters and fragment, whose parts lie between its marks.
_PLAIN_URL = rf"""^[a-z][a-z0-9+.\-]*://{_PATH_CHAR}+(?:/[!"$-:<->@-~]*+)?(?:\?[!"$-~]*+)?\z"""
_PLAIN_PARTS = (
    "named_struct('scheme', substring_index(v, '://', 1),"
    " 'netloc', substring_index(substring_index(substring_index(v, '?', 1), '/', 3), '/', -1),"
    " 'path', substr(substring_index(v, '?', 1), length(substring_index(substring_index(v, '?', 1), '/', 3)) + 1),"
    f" 'params', '', 'query', {_after('v', '?')}, 'fragment', '')"
)


def url_parts(url: Column) -> Column:
    """struct(scheme, netloc, path, params, query, fragment); absent parts are empty. Plain URLs are cut at
    their marks, the others read in full."""
    full = let_sql("v", _cleaned("v"), _URL_PARTS)
    return apply_sql(url, f"if(v rlike r'{_PLAIN_URL}', {_PLAIN_PARTS}, {full})")


def _join(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    """SQL expression of a URL put together; empty parts leave no mark."""
    slash = f"if({netloc} <> '' and {path} <> '' and not startswith({path}, '/'), '/', '')"
    rooted = (
        f"({netloc} <> '' or startswith({path}, '//')"
        f" or (startswith({path}, '/') and {_matches(scheme, RELATIVE_SCHEMES[1:])}))"
    )
    return (
        f"concat(if({scheme} <> '', concat({scheme}, ':'), ''), if({rooted}, concat('//', {netloc}), ''),"
        f" {slash}, {path}, if({query} <> '', concat('?', {query}), ''),"
        f" if({fragment} <> '', concat('#', {fragment}), ''))"
    )


# Fold "." and ".." out of the path segments g.
_NO_DOTS = let_sql(
    "f",
    "aggregate(g, slice(g, 1, 0), (acc, s) -> case when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 0))"
    " when s = '.' then acc else array_append(acc, s) end)",
    let_sql(
        "j",
        "array_join(if(element_at(g, -1) in ('.', '..'), array_append(f, ''), f), '/')",
        "if(j = '', '/', j)",
    ),
)


def _merged(base: str, path: str) -> str:
    """SQL expression: a relative path put on the folder of the base path."""
    folder = f"if({base} = '', '/', substr({base}, 1, length({base}) - length(substring_index({base}, '/', -1))))"
    relative = let_sql(
        "l",
        f"split(concat({folder}, {path}), '/')",
        "if(size(l) < 3, l, concat(slice(l, 1, 1), filter(slice(l, 2, size(l) - 2), x -> x <> ''), slice(l, -1, 1)))",
    )
    segments = f"if(startswith({path}, '/'), split({path}, '/'), {relative})"
    return f"if(startswith({path}, '/') and not contains({path}, '/.'), {path}, {let_sql('g', segments, _NO_DOTS)})"


# The same in visible ASCII characters, which need no cleaning; and the origin of a plain page URL.
_ROOTED_ASCII = rf"^(?:/(?![/.]){_PATH_CHAR}*+)++\z"
_ORIGIN = rf"^(https?://{_HOST_CHAR}+)(?:[/?#][!-~]*+)?\z"

# A rooted path without query, fragment, parameters, "//" and dot segments.
_PLAIN_ROOTED = "(startswith({0}, '/') and not {0} rlike '[?#;]|/[./]')"


def _target(base: str, href: str) -> str:
    """SQL expression: parts of the URL that a clean reference means on a page whose URL
    has the parts ``base``; the path keeps its parameters."""

    def parts(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
        return (
            f"named_struct('scheme', {scheme}, 'netloc', {netloc}, 'path', {path},"
            f" 'query', {query}, 'fragment', {fragment})"
        )

    full = _with_parts(
        href,
        "w",
        let_sql(
            "c",
            f"if(w.scheme = '', {base}.scheme, w.scheme)",
            f"case when c <> {base}.scheme or not {_matches('c', RELATIVE_SCHEMES)} then w"
            " when w.netloc <> '' then "
            + parts("c", "w.netloc", "w.path", "w.query", "w.fragment")
            + " when w.path = '' then "
            + parts("c", f"{base}.netloc", f"{base}.path", f"if(w.query <> '', w.query, {base}.query)", "w.fragment")
            + " else "
            + let_sql(
                "k",
                _params("w"),
                let_sql(
                    "q",
                    _path("w", "k"),
                    parts(
                        "c",
                        f"{base}.netloc",
                        f"concat({_merged(f'{base}.path', 'q')}, k)",
                        "w.query",
                        "w.fragment",
                    ),
                ),
            )
            + " end",
        ),
    )
    return (
        f"case when {href} = '' then {base} when {_PLAIN_ROOTED.format(href)} then "
        + parts(f"{base}.scheme", f"{base}.netloc", href, "''", "''")
        + f" else {full} end"
    )


_RESOLVED = _with_parts(
    "v.base",
    "b",
    "case when v.raw_href = '' then v.raw_base when v.raw_base = '' then v.raw_href else "
    + let_sql(
        "t",
        _target("b", "v.href"),
        f"if(t.scheme <> b.scheme or not {_matches('t.scheme', RELATIVE_SCHEMES)}, v.raw_href, "
        + _join("t.scheme", "t.netloc", "t.path", "t.query", "t.fragment")
        + ")",
    )
    + " end",
)


def _named(**columns: Column) -> Column:
    return F.named_struct(*[part for name, column in columns.items() for part in (F.lit(name), column)])


# A relative reference in visible ASCII: steps up, then segments that begin with no dot, without scheme, query and parameters.
_SEGMENT = r"""(?!\.)[!"$-.0-9<->@-~]++"""
_RELATIVE_ASCII = rf"^(?:\.\./)*+{_SEGMENT}(?:/{_SEGMENT})*+/?+(?:#[!-~]*+)?\z"

# A plain web address: its origin and its folder, without a slash at the end, which has neither empty segments nor such
# that begin with a dot.
_PLAIN_FOLDER = (
    rf"^(https?://{_PATH_CHAR}++)((?:/(?![/.]){_PATH_CHAR}++(?=/))*+)(?:/(?![/.]){_PATH_CHAR}*+)?+(?:\?[!\"$-~]*+)?+\z"
)


_FOLDER = f"regexp_extract(v.raw_base, r'{_PLAIN_FOLDER}', 2)"


def _rooted(ref: str, rest: str, folder: str, depth: str) -> str:
    """SQL expression: the rooted path of a relative reference, of which ``rest`` follows its steps up, in a folder of
    ``depth`` segments; steps above the root stay there."""
    steps = f"cast((length({ref}) - length(ltrim('./', {ref}))) / 3 as int)"
    return f"concat(substring_index({folder}, '/', greatest({depth} + 1 - {steps}, 0)), '/', {rest})"


def _depth(folder: str) -> str:
    return f"length({folder}) - length(replace({folder}, '/', ''))"


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on the page ``base``."""
    pieces = _named(raw_base=base, raw_href=href)
    full = let_sql(
        "v",
        f"named_struct('raw_base', v.raw_base, 'raw_href', v.raw_href, 'base', {_cleaned('v.raw_base')},"
        f" 'href', {_cleaned('v.raw_href')})",
        _RESOLVED,
    )
    plain = f"v.raw_href rlike r'{_ROOTED_ASCII}' and v.raw_base rlike r'{_ORIGIN}'"
    relative = f"v.raw_href rlike r'{_RELATIVE_ASCII}' and not endswith(v.raw_href, '#') and v.raw_base rlike r'{_PLAIN_FOLDER}'"
    path = _rooted("v.raw_href", "ltrim('./', v.raw_href)", "f", _depth("f"))
    under = f"concat(regexp_extract(v.raw_base, r'{_PLAIN_FOLDER}', 1), {let_sql('f', _FOLDER, path)})"
    return apply_sql(
        pieces,
        f"case when {plain} then concat(regexp_extract(v.raw_base, r'{_ORIGIN}', 1), v.raw_href)"
        f" when {relative} then {under} else {full} end",
    )


def _shown(parts: str) -> str:
    """SQL expression: parts as a normalised URL and the parts that decide on a visit."""
    rooted = f"if({parts}.netloc <> '' and {parts}.path <> '' and not startswith({parts}.path, '/'), '/', '')"
    return let_sql(
        "k",
        f"concat({rooted}, {_path(parts, _params(parts))})",
        let_sql(
            "w",
            f"concat({parts}.scheme, '://', {parts}.netloc, k, if({parts}.query <> '', concat('?', {parts}.query), ''))",
            f"named_struct('url', lower(if(endswith(w, '/') and length(k) > 1, substr(w, 1, length(w) - 1), w)),"
            f" 'scheme', {parts}.scheme, 'netloc', lower({parts}.netloc), 'path', lower(k))",
        ),
    )


# The parts of a plain address; the path has no parameters.
_PLAIN_BASE = (
    "named_struct('scheme', substring_index(v.base, '://', 1), 'netloc', substring_index(v.origin, '/', -1),"
    " 'path', substr(substring_index(v.base, '?', 1), length(v.origin) + 1),"
    f" 'query', {_after('v.base', '?')}, 'fragment', '')"
)


def _of_references(base: Column, hrefs: Column, rooted: str, other: str) -> Column:
    """Array of what the references of one page give. The page URL is read once; ``o`` has its origin in lower case, its
    parts, and whether it is a web address. Most references x are rooted paths in plain characters, for which
    ``rooted`` is the result, or relative ones on a plain page, which are made rooted first; ``other`` is
    that for the normalised target t of any other."""
    origin = (
        "named_struct('url', lower(v.origin), 'scheme', substring_index(v.origin, ':', 1),"
        " 'netloc', lower(substring_index(v.origin, '/', -1)), 'web', true,"
        f" 'depth', {_depth('v.folder')}, 'parts', null)"
    )
    full = _with_parts(
        "v.base",
        "b",
        "named_struct('url', concat(b.scheme, '://', lower(b.netloc)), 'scheme', b.scheme, 'netloc', lower(b.netloc),"
        " 'web', b.scheme in ('http', 'https') and b.netloc <> '', 'depth', 0, 'parts', b)",
    )
    relative = f"v.origin <> '' and not startswith(x, '/') and x rlike r'{_RELATIVE_ASCII}'"
    path = _rooted("x", "substring_index(ltrim('./', x), '#', 1)", "v.folder", "o.depth")
    odd = let_sql(
        "b",
        f"coalesce(o.parts, {_PLAIN_BASE})",
        let_sql(
            "h",
            "translate(ltrim(v.blanks, x), '\t\r\n', '')",
            let_sql("r", _target("b", "h"), let_sql("t", _shown("r"), other)),
        ),
    )
    body = let_sql(
        "o",
        f"if(v.origin <> '', {origin}, {full})",
        f"transform(transform(v.hrefs, x -> if({relative}, {path}, x)),"
        f" x -> if(x rlike r'{_ROOTED_ASCII}', {rooted}, {odd}))",
    )
    plain = base.rlike(_PLAIN_FOLDER)
    pieces = _named(
        base=F.when(plain, base).otherwise(clean(base)),
        origin=F.regexp_extract(base, _PLAIN_FOLDER, 1),
        folder=F.regexp_extract(base, _PLAIN_FOLDER, 2),
        hrefs=hrefs,
        blanks=F.lit(_CONTROL_OR_SPACE),
    )
    return apply_sql(pieces, body)


#: The normalised target of a rooted path x.
_ROOTED_TARGET = "concat(o.url, lower(if(endswith(x, '/') and length(x) > 1, substr(x, 1, length(x) - 1), x)))"


def link_targets(base: Column, hrefs: Column) -> Column:
    """ARRAY<STRUCT<url, scheme, netloc, path>>: normalised targets of the references of
    one page. A target is not put together and read again."""
    rooted = f"named_struct('url', {_ROOTED_TARGET}, 'scheme', o.scheme, 'netloc', o.netloc, 'path', lower(x))"
    return _of_references(base, hrefs, rooted, "t")


_NORMALIZED = _with_parts(
    "v",
    "p",
    let_sql(
        "k",
        _path("p", _params("p")),
        let_sql(
            "w",
            "concat(p.scheme, '://', p.netloc, k, if(p.query <> '', concat('?', p.query), ''))",
            "if(endswith(w, '/') and length(k) > 1, substr(w, 1, length(w) - 1), w)",
        ),
    ),
)


# A lower case URL that normalising leaves as it is.
_ALREADY_NORMAL = r"^[a-z][a-z0-9+.\-]*://[^/?#;\s]+(?:/|/[^?#;\s]*[^/?#;\s])(?:\?[^#;\s]*[^/#;\s])?\z"


def normalize_url(url: Column) -> Column:
    """Lower case, no fragment, no path parameters, at most one trailing slash removed."""
    low = F.lower(url)
    return F.when(low.rlike(_ALREADY_NORMAL), low).otherwise(apply_sql(clean(low), _NORMALIZED))


# A plain web address, and one whose path is never crawled.
_PLAIN_WEB_URL = _PLAIN_URL.replace(r"[a-z][a-z0-9+.\-]*", "https?")
_SKIPPED = "[.](?i:" + "|".join(e.removeprefix(".") for e in SKIP_EXTENSIONS) + ")"
_SKIPPED_WEB_URL = rf"^https?://[^/?]++/[^?]*+(?<={_SKIPPED})(?:\?|\z)"


def is_valid_url_basic(url: Column) -> Column:
    return let(url_parts(url), lambda p: (p["scheme"] != "") & (p["netloc"] != ""))


def _crawlable(parts: Column, allowed_domains: Sequence[str] | None, strict: bool) -> Column:
    ok = parts["scheme"].rlike("^https?$") & (parts["netloc"] != "")
    if allowed_domains:
        names = "|".join(re.escape(d if strict else d.lstrip(".")) for d in allowed_domains)
        before = "" if strict else r"(?:^|\.)"
        ok = ok & F.lower(parts["netloc"]).rlike(rf"{before}(?:{names})\z")
    return ok & ~ends_with_any(F.lower(parts["path"]), SKIP_EXTENSIONS)


def is_crawlable_url(
    url: Column,
    allowed_domains: Sequence[str] | None = None,
    url_filter=None,
    strict: bool = False,
) -> Column:
    """Web page URL inside the allowed domains. ``url_filter`` maps the URL column to a
    boolean column. ``strict`` compares domains as bare text endings, so
    ``evilexample.com`` passes for ``example.com``; otherwise a dot must precede."""
    ok = let(url_parts(url), lambda p: _crawlable(p, allowed_domains, strict))
    if not allowed_domains:
        ok = F.when(url.rlike(_PLAIN_WEB_URL), ~url.rlike(_SKIPPED_WEB_URL)).otherwise(ok)
    return ok & url_filter(url) if url_filter is not None else ok


def crawlable_targets(
    base: Column,
    hrefs: Column,
    allowed_domains: Sequence[str] | None = None,
    url_filter=None,
    strict: bool = False,
) -> Column:
    """ARRAY<STRING>: distinct normalised targets of a page that may be crawled."""

    if not allowed_domains and url_filter is None:
        # No more than the URLs is kept of the targets.
        rooted = rf"if(o.web and not x rlike r'{_SKIPPED}\z', {_ROOTED_TARGET}, null)"
        other = rf"if(t.scheme rlike '^https?$' and t.netloc <> '' and not t.path rlike r'{_SKIPPED}\z', t.url, null)"
        return F.array_distinct(F.array_compact(_of_references(base, hrefs, rooted, other)))

    def keep(t: Column) -> Column:
        ok = _crawlable(t, allowed_domains, strict)
        return ok & url_filter(t["url"]) if url_filter is not None else ok

    return F.array_distinct(F.transform(F.filter(link_targets(base, hrefs), keep), lambda t: t["url"]))


def is_navigation_url(url: Column) -> Column:
    return let(F.lower(url_parts(url)["path"]), lambda path: contains_any(path, NAVIGATION_PARTS))


def is_downloadable(url: Column, link_text: Column, has_download: Column) -> Column:
    def check(path: Column) -> Column:
        return (
            ends_with_any(path, DOWNLOAD_EXTENSIONS)
            | has_download
            | contains_any(F.lower(link_text), DOWNLOAD_WORDS)
            | contains_any(path, DOWNLOAD_PATHS)
        )

    return let(F.lower(url_parts(url)["path"]), check)


def unquote(text: Column) -> Column:
    """Percent decoding; a plus sign stays, malformed text is returned unchanged."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(decoded, text)).otherwise(text)


# Pairs of a query string; a plus sign is a blank, malformed text stays.
_QUERY_MAP = let_sql(
    "e",
    "filter(transform(split(v, '&'), p -> named_struct('key', substring_index(p, '=', 1), 'value', "
    + _after("p", "=")
    + ")), e -> e.value <> '')",
    let_sql(
        "d",
        "transform(e, x -> named_struct('key', coalesce(try_url_decode(x.key), x.key),"
        " 'value', coalesce(try_url_decode(x.value), x.value)))",
        let_sql(
            "k",
            "array_distinct(transform(d, x -> x.key))",
            "map_from_arrays(k, transform(k, n -> transform(filter(d, x -> x.key = n), x -> x.value)))",
        ),
    ),
)


def query_map(query: Column) -> Column:
    """MAP<STRING, ARRAY<STRING>> of a query string; blank values are dropped."""
    return apply_sql(query, _QUERY_MAP)


# Path parts that name a course, and query keys that hold its id.
COURSE_PART = r"(?i)^(?:[A-Z]{2,4}[-_]?[0-9]{3,4}|course[-_][0-9]+)\z"
COURSE_KEYS = ["course", "id", "cid", "course_id"]


def parse_course_url(url: Column) -> Column:
    """struct(domain, path, course_id, query, full_url)."""

    def build(p: Column) -> Column:
        query = query_map(p["query"])
        parts = F.split(F.btrim(p["path"], F.lit("/")), "/")
        named = F.get(F.filter(parts, lambda s: s.rlike(COURSE_PART)), F.lit(0))
        from_query = [F.get(F.try_element_at(query, F.lit(k)), F.lit(0)) for k in COURSE_KEYS]
        return F.struct(
            p["netloc"].alias("domain"),
            p["path"].alias("path"),
            F.coalesce(named, *from_query).alias("course_id"),
            query.alias("query"),
            url.alias("full_url"),
        )

    return let(url_parts(url), build)


def course_id(url: Column, name: Column) -> Column:
    """First path part that starts with a digit or holds a hyphen, else a course code
    at the start of the name, else the name as an identifier."""
    parts = F.split(url_parts(url)["path"], "/")
    from_path = F.get(
        F.filter(parts, lambda s: s.rlike(r"^\p{Nd}") | F.contains(s, F.lit("-"))), F.lit(0)
    )
    code = F.replace(F.regexp_extract(name, r"^([A-Z]{2,4}\s?[0-9]{3,4})", 1), F.lit(" "), F.lit(""))
    plain = F.substring(F.regexp_replace(name, f"[^{WORD}]", "_"), 1, 50)
    return F.coalesce(from_path, F.when(code != "", code), plain)


def robots_url(url: Column) -> Column:
    return let(
        url_parts(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/robots.txt"))
    )


def host_of(url: Column) -> Column:
    """Host with port; most URLs are read by one pattern, the others in full."""
    plain = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]+)(?:[/?#]|\z)", 1)
    return F.when(plain != "", plain).otherwise(url_parts(url)["netloc"])


def harvest_urls(text: Column) -> Column:
    """Array of all URLs in free text."""
    return F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))
