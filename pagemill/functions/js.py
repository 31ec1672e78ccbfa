"""JavaScript columns: detection, score, endpoints, routing, embedded data."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.html import without_comments
from pagemill.functions.text import WORD, let, strip, strip_markup
from pagemill.functions.urls import contains_any

# Framework marks, any of which names the framework.
FRAMEWORKS = {
    "react": ["react", "ReactDOM", "__REACT_"],
    "angular": ["angular", "ng-", "ng-app"],
    "vue": ["Vue", "v-", "__VUE__"],
    "ember": ["Ember", "ember-"],
    "backbone": ["Backbone"],
    "jquery": ["jQuery", "$"],
    "nextjs": ["__NEXT_", "_next"],
    "nuxtjs": ["__NUXT__"],
    "gatsby": ["___gatsby"],
    "svelte": ["__svelte"],
}

# The same without marks that occur in ordinary text (a bare "$", "ng-", "v-").
PRECISE_FRAMEWORKS = {
    **FRAMEWORKS,
    "angular": ["angular", " ng-", "ng-app"],
    "vue": ["Vue", " v-", "__VUE__"],
    "jquery": ["jQuery", "$(", "$."],
}

# Marks of pages built by scripts.
INDICATORS = [
    "<noscript>",
    "data-react",
    "data-ng-",
    "v-bind",
    "ng-controller",
    'id="root"',
    'id="app"',
    "__INITIAL_STATE__",
    "__PRELOADED_STATE__",
    "window.__",
    "require.js",
    "webpack",
    "bundle.js",
]

# Marks of single page applications that add to the score.
SPA_MARKS = ["#root", "#app", 'id="root"', 'id="app"']

# Endpoint patterns, and parts of static files that are left out.
ENDPOINT_PATTERNS = [
    r"""["'](/api/[^"']+)["']""",
    r"""["'](/v[0-9]+/[^"']+)["']""",
    r"""fetch\(["']([^"']+)["']""",
    r"""axios\.[get|post|put|delete]\(["']([^"']+)["']""",
    r"""XMLHttpRequest.*open\(["'][^"']*["'],\s*["']([^"']+)["']""",
]
# What the fourth pattern means to find.
AXIOS_CALL = r"""axios\.(?:get|post|put|delete)\(["']([^"']+)["']"""
STATIC_PARTS = [".css", ".js", ".jpg", ".png", ".gif"]

# Route patterns.
ROUTE_PATTERNS = [
    r"""path:\s*["']([^"']+)["']""",
    r"""route:\s*["']([^"']+)["']""",
    r"""["']path["']:\s*["']([^"']+)["']""",
]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _holds_any(html: Column, marks: list[str]) -> Column:
    """Does a long text hold any of the marks? Plain search, no pattern."""
    return F.exists(F.split(F.lit("\n".join(marks)), "\n"), lambda m: F.contains(html, m))


def js_frameworks(html: Column, strict: bool = True) -> Column:
    marks = FRAMEWORKS if strict else PRECISE_FRAMEWORKS
    table = F.from_json(
        F.lit(json.dumps([{"name": n, "marks": m} for n, m in marks.items()])),
        "array<struct<name: string, marks: array<string>>>",
    )
    hits = F.filter(table, lambda f: F.exists(f["marks"], lambda m: F.contains(html, m)))
    return F.transform(hits, lambda f: f["name"])


def js_indicators(html: Column) -> Column:
    return F.filter(F.split(F.lit("\n".join(INDICATORS)), "\n"), lambda m: F.contains(html, m))


def js_score(html: Column) -> Column:
    """0 to 100: how much the page depends on scripts."""
    scripts = F.size(F.split(html, "<script")) - 1
    text = strip(strip_markup(html))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    total = (
        F.least(scripts * 5, F.lit(30))
        + points(_holds_any(html, ["onclick=", "onload="]), 10)
        + points(_holds_any(html, ["XMLHttpRequest", "fetch("]), 20)
        + points(_holds_any(html, ["__INITIAL_DATA__", "window.__"]), 15)
        + points(_holds_any(html, SPA_MARKS), 20)
        + points(F.length(text) < 100, 15)
    )
    return F.least(total, F.lit(100))


def noscript_asks_for_js(html: Column) -> Column:
    bodies = _all(html, r"(?is)<noscript>(.*?)</noscript>")
    return F.contains(html, F.lit("<noscript>")) & F.exists(
        bodies, lambda b: contains_any(b, ["JavaScript", "enable"])
    )


def js_detect(html: Column, strict: bool = True) -> Column:
    """struct(uses_javascript, requires_js_rendering, frameworks, indicators, score)."""

    def build(v: Column) -> Column:
        return F.struct(
            ((F.size(v["f"]) > 0) | (F.size(v["i"]) > 0)).alias("uses_javascript"),
            ((v["s"] > 50) | (F.size(v["f"]) > 0) | v["n"]).alias("requires_js_rendering"),
            v["f"].alias("frameworks"),
            v["i"].alias("indicators"),
            v["s"].alias("dynamic_content_score"),
        )

    return let(
        F.struct(
            js_frameworks(html, strict).alias("f"),
            js_indicators(html).alias("i"),
            js_score(html).alias("s"),
            noscript_asks_for_js(html).alias("n"),
        ),
        build,
    )


def skip_static_endpoint(endpoint: Column, strict: bool = True) -> Column:
    """Is the endpoint a static file? ``strict`` also drops ``.json`` (it holds ``.js``)."""
    low = F.lower(endpoint)
    if strict:
        return contains_any(low, STATIC_PARTS)
    return low.rlike(r"\.(?:css|js|jpg|png|gif)(?![a-z0-9])")


def ajax_endpoints(html: Column, strict: bool = True) -> Column:
    """Distinct endpoints called by scripts, static files left out. ``strict`` keeps the
    character class that never matches a call such as ``axios.get(``."""
    patterns = list(ENDPOINT_PATTERNS)
    if not strict:
        patterns[3] = AXIOS_CALL
    found = F.flatten(F.array(*[_all(html, f"(?i){p}") for p in patterns]))
    return F.filter(F.array_distinct(found), lambda e: ~skip_static_endpoint(e, strict))


def spa_routing(html: Column) -> Column:
    """struct(type, routes)."""
    kind = (
        F.when(_holds_any(html, ["react-router", "BrowserRouter"]), "react-router")
        .when(_holds_any(html, ["vue-router", "VueRouter"]), "vue-router")
        .when(_holds_any(html, ["RouterModule", "@angular/router"]), "angular-router")
        .otherwise("unknown")
    )
    return F.struct(
        kind.alias("type"), F.concat(*[_all(html, p) for p in ROUTE_PATTERNS]).alias("routes")
    )


def clean_js_object(text: Column) -> Column:
    """JavaScript object text made readable as JSON."""
    tidy = F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")
    return F.regexp_replace(F.replace(tidy, F.lit("'"), F.lit('"')), f"([{WORD}]+):", '"$1":')


def json_or_null(text: Column) -> Column:
    """The JSON text itself when it parses, else NULL."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def window_vars(html: Column) -> Column:
    """ARRAY<STRUCT<key, value>> of ``window.name = {...};`` data as JSON text."""
    pattern = rf"(?s)window\.([{WORD}]+)\s*=\s*(\{{.*?\}});"
    pairs = F.arrays_zip(_all(html, pattern, 1).alias("key"), _all(html, pattern, 2).alias("value"))
    parsed = F.transform(
        pairs,
        lambda p: F.struct(
            F.concat(F.lit("window."), p["key"]).alias("key"),
            F.coalesce(json_or_null(p["value"]), json_or_null(clean_js_object(p["value"]))).alias("value"),
        ),
    )
    return F.filter(parsed, lambda p: p["value"].isNotNull())


def jsonld(html: Column) -> Column:
    """ARRAY<STRING> of the JSON-LD blocks that parse."""
    blocks = _all(
        without_comments(html),
        r"""(?is)<script\s[^>]*?type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>""",
    )
    return F.filter(F.transform(blocks, lambda b: strip(b)), lambda b: json_or_null(b).isNotNull())
