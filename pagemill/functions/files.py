"""File columns: names, types, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import SPACE, WORD, let
from pagemill.functions.urls import contains_any, ends_with_any, unquote, url_parts

# File endings of each type, tried in this order.
TYPE_EXTENSIONS = {
    "lecture_video": [".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v"],
    "lecture_slide": [".ppt", ".pptx", ".pdf", ".odp"],
    "assignment": [".docx", ".doc", ".pdf", ".txt", ".md"],
    "resource": [".zip", ".tar", ".gz", ".rar", ".7z"],
    "reading": [".pdf", ".epub", ".mobi", ".txt"],
    "syllabus": [".pdf", ".docx", ".doc", ".html"],
}

# Words in a URL or name that tell the type, tried in this order.
TYPE_WORDS = [
    ("lecture_slide", "lecture|slides?|presentation|week[0-9]+|module[0-9]+"),
    ("assignment", "assignment|homework|hw|problem|pset|quiz|exam"),
    ("resource", "resource|material|download|file|document"),
    ("lecture_video", "video|recording|stream|media"),
    ("syllabus", "syllabus|schedule|calendar|outline"),
]

# Words in the link text that tell the type, tried in this order.
TEXT_WORDS = [
    ("lecture_video", ["video", "recording"]),
    ("lecture_slide", ["slide", "presentation"]),
    ("assignment", ["assignment", "homework"]),
    ("syllabus", ["syllabus"]),
    ("reading", ["reading"]),
]

# Folder of each type.
TYPE_FOLDERS = {
    "lecture_video": "lectures/videos",
    "lecture_slide": "lectures/slides",
    "assignment": "assignments",
    "resource": "resources",
    "reading": "readings",
    "syllabus": "",
    "other": "misc",
}

# Endings that several types claim; outside strict mode words decide first.
_SHARED = [".pdf", ".html"]

_BAD_IN_NAME = '<>:"|?*\\/\0'
_BAD_IN_PATH = '<>:"|?*\0'
_CONTROL = r"[\x00-\x1F]"
# Blanks and underscores; most other characters are told apart by two ranges, before the long class is tried.
_BLANKS = rf"(?![!-^`-~])[{SPACE}_]+"


def stable_number(url: Column) -> Column:
    """Number below 10,000 that is the same in every run."""
    return F.pmod(F.xxhash64(url), F.lit(10000)).cast("string")


def file_type(url: Column, name: Column, link_text: Column, strict: bool = True) -> Column:
    """Type from the ending, then words in the URL and name, then words in the link
    text. ``strict`` lets every ``.pdf`` be a slide and every ``.html`` a syllabus, as
    the first listed type; otherwise words decide before these two endings do."""

    def decide(check: Column) -> Column:
        steps: list[tuple[Column, str]] = []
        for kind, endings in TYPE_EXTENSIONS.items():
            own = endings if strict else [e for e in endings if e not in _SHARED]
            steps.append((ends_with_any(check, own), kind))
        steps += [(check.rlike(f"(?i){words}"), kind) for kind, words in TYPE_WORDS]
        text = F.lower(F.coalesce(link_text, F.lit("")))
        steps += [(contains_any(text, words), kind) for kind, words in TEXT_WORDS]
        if not strict:
            steps.append((check.endswith(".pdf"), "reading"))
        out = F.when(*[steps[0][0], F.lit(steps[0][1])])
        for condition, kind in steps[1:]:
            out = out.when(condition, F.lit(kind))
        return out.otherwise("other")

    return let(F.lower(F.concat(url, F.coalesce(name, F.lit("")))), decide)


def file_type_simple(url: Column, name: Column) -> Column:
    """Type from parts anywhere in the URL and name."""

    def decide(c: Column) -> Column:
        return (
            F.when(contains_any(c, [".mp4", ".avi", ".mov", ".webm"]), "lecture_video")
            .when(F.contains(c, F.lit(".ppt")), "lecture_slide")
            .when(F.contains(c, F.lit(".pdf")) & F.contains(c, F.lit("slide")), "lecture_slide")
            .when(
                F.contains(c, F.lit(".doc")) & contains_any(c, ["assignment", "homework", "hw"]),
                "assignment",
            )
            .when(F.contains(c, F.lit("syllabus")), "syllabus")
            .when(contains_any(c, [".zip", ".tar", ".gz", ".rar"]), "resource")
            .when(contains_any(c, [".pdf", ".epub"]), "reading")
            .otherwise("other")
        )

    return let(F.lower(F.concat(url, name)), decide)


def _last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def filename_link(url: Column, link_text: Column, download: Column) -> Column:
    """Name for a linked file: the download attribute, the last path part when it has a
    dot, the link text as a slug (which may be empty), else a number."""
    part = let(url_parts(url)["path"], lambda p: _last_part(unquote(p)))
    text = F.regexp_replace(F.trim(link_text), f"[^{WORD}{SPACE}-]", "")
    slug = F.substring(F.regexp_replace(text, f"[{SPACE}-]+", "-"), 1, 100)

    def pick(p: Column) -> Column:
        return (
            F.when(download.isNotNull() & (download != ""), download)
            .when(F.contains(p, F.lit(".")), p)
            .when(link_text != "", slug)
            .otherwise(F.concat(F.lit("file_"), stable_number(url)))
        )

    return let(part, pick)


def filename_download(url: Column) -> Column:
    """Name to store a download under; always has an ending."""
    low = F.lower(url)

    def named(p: Column) -> Column:
        ending = (
            F.when(F.contains(p, F.lit(".")), "")
            .when(F.contains(low, F.lit("pdf")), ".pdf")
            .when(contains_any(low, ["mp4", "video"]), ".mp4")
            .otherwise(".bin")
        )
        return F.translate(F.concat(p, ending), _BAD_IN_NAME, "_" * len(_BAD_IN_NAME))

    return let(let(url_parts(url)["path"], lambda p: _last_part(unquote(p))), named)


def filename_url(url: Column) -> Column:
    """Last path part as it stands, else a number."""
    return let(
        _last_part(url_parts(url)["path"]),
        lambda p: F.when(p != "", p).otherwise(F.concat(F.lit("file_"), stable_number(url))),
    )


def filename_async(url: Column) -> Column:
    """Last path part when it has a dot, else a number with ending ``.bin``."""
    return let(
        _last_part(url_parts(url)["path"]),
        lambda p: F.when(F.contains(p, F.lit(".")), p).otherwise(
            F.concat(F.lit("file_"), stable_number(url), F.lit(".bin"))
        ),
    )


def _safe(name: Column, limit: int) -> Column:
    tidy = F.translate(name, _BAD_IN_NAME, "_" * len(_BAD_IN_NAME))
    tidy = F.regexp_replace(F.regexp_replace(tidy, _CONTROL, ""), _BLANKS, "_")
    return let(
        F.substring(F.btrim(tidy, F.lit(". ")), 1, limit),
        lambda s: F.when(s != "", s).otherwise("unnamed"),
    )


def sanitize_filename(name: Column, preserve_extension: bool = False) -> Column:
    if not preserve_extension:
        return _safe(name, 250)
    ending = F.substring_index(name, ".", -1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ending) - 1)
    return (
        F.when(~F.contains(name, F.lit(".")), _safe(name, 250))
        .when(ending == "", _safe(stem, 250))
        .otherwise(F.concat(_safe(stem, 200), F.lit("."), ending))
    )


def sanitize_path(path: Column, max_length: int = 255) -> Column:
    """Make every component of a path safe; a drive letter stays."""

    def shorten(part: Column) -> Column:
        ending = F.substring_index(part, ".", -1)
        stem = F.substr(part, F.lit(1), F.length(part) - F.length(ending) - 1)
        with_ending = F.concat(
            F.substr(stem, F.lit(1), F.greatest(max_length - F.length(ending) - 1, F.lit(0))),
            F.lit("."),
            ending,
        )
        short = F.when(F.contains(part, F.lit(".")), with_ending).otherwise(F.substring(part, 1, max_length))
        return F.when(F.length(part) > max_length, short).when(part == "", "unnamed").otherwise(part)

    def component(part: Column) -> Column:
        tidy = F.regexp_replace(
            F.translate(part, _BAD_IN_PATH, "_" * len(_BAD_IN_PATH)), _CONTROL, ""
        )
        return F.when(part.rlike(r"(?s)\A.:\z"), part).otherwise(let(tidy, shorten))

    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(F.transform(parts, component), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def prepare_filename(
    name: Column,
    course: Column,
    sanitize: bool = True,
    course_prefix: bool = False,
    date_prefix: str | None = None,
) -> Column:
    """File name with optional course prefix and ``YYYYMMDD`` run date prefix."""
    out = sanitize_filename(name, preserve_extension=True) if sanitize else name
    if course_prefix:
        # Each name is made once and then looked at.
        pair = F.struct(F.substring(sanitize_filename(course), 1, 20).alias("p"), out.alias("n"))
        out = let(pair, lambda v: F.when(F.startswith(v["n"], v["p"]), v["n"]).otherwise(F.concat(v["p"], F.lit("_"), v["n"])))
    if date_prefix:
        dated = F.lit(date_prefix + "_")
        out = let(out, lambda n: F.when(n.rlike("^[0-9]{8}_"), n).otherwise(F.concat(dated, n)))
    return out


def type_folder(kind: Column) -> Column:
    out = F.when(kind == "lecture_video", TYPE_FOLDERS["lecture_video"])
    for name, folder in list(TYPE_FOLDERS.items())[1:]:
        out = out.when(kind == name, folder)
    return out.otherwise("misc")


def target_dir(
    base: Column, kind: Column, course: Column, flatten: bool = False, by_course: bool = True, by_type: bool = True
) -> Column:
    """Folder a file belongs in."""
    if flatten:
        return base
    parts = [base]
    if by_course:
        parts.append(sanitize_filename(course))
    if by_type:
        parts.append(let(type_folder(kind), lambda f: F.when(f != "", f)))
    return F.concat_ws("/", *parts)


def checksum_match(content: Column, etag: Column) -> Column:
    """Does the MD5 of the content equal the tag, quotes dropped?"""
    return F.md5(content.cast("binary")) == F.lower(F.btrim(etag, F.lit('"')))


def suffix_of(name: Column) -> Column:
    """Ending with its dot, lower case; empty for names like ``.profile`` or ``a.``."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def file_visible(name: Column, recent: bool = False) -> Column:
    shown = ~name.startswith(".")
    return shown & (name != "README.md") if recent else shown
