"""Robots rules. A robots body is one cell, so it is read inside its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let, strip
from pagemill.functions.urls import host_of, unquote, url_parts
from pagemill.session import cut

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _lines(body: Column) -> Column:
    return F.split(F.regexp_replace(body, rf"(?:{_LINE_END})\z", ""), _LINE_END)


def robots_lines(robots: DataFrame) -> DataFrame:
    """(host, line_no, line) of ``robots(host, body)``."""
    return robots.select("host", F.posexplode(_lines(F.col("body"))).alias("line_no", "line"))


def robots_groups(robots: DataFrame) -> DataFrame:
    """(host, group_no, pos, agent, directive, value): every directive with the agent
    named last before it; agent is NULL before the first one."""
    flat = F.array_join(F.transform(_lines(F.col("body")), strip), "\n")
    sections = F.split(flat, r"(?im)^(?=user-agent:)")
    groups = robots.select("host", F.posexplode(sections).alias("group_no", "_s"))
    agent = F.regexp_extract("_s", r"(?i)\Auser-agent:([^\n]*)", 1)
    groups = groups.select(
        "host",
        "group_no",
        F.when(F.col("_s").rlike(r"(?i)\Auser-agent:"), strip(agent)).alias("agent"),
        F.posexplode(F.split("_s", "\n")).alias("pos", "_line"),
    )
    named = F.contains(F.col("_line"), F.lit(":")) & ~F.col("_line").startswith("#")
    return groups.filter(named).select(
        "host",
        "group_no",
        "pos",
        "agent",
        F.lower(F.substring_index("_line", ":", 1)).alias("directive"),
        strip(F.substr("_line", F.instr("_line", ":") + 1)).alias("value"),
    )


def one_per_host(robots: DataFrame) -> DataFrame:
    """(host, body): one file per host, letter case of the host ignored; of several captures the one whose text
    comes first counts. Reduced before the shuffle."""
    return robots.groupBy(F.lower("host").alias("host")).agg(F.min("body").alias("body"))


def _for_agent(groups: DataFrame, agent: str) -> DataFrame:
    """Directives of groups without agent, for everyone or for exactly this agent."""
    named = F.col("agent")
    return groups.filter(named.isNull() | named.isin("", "*", agent))


def robots_crawl_delay(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, delay): the last readable delay of a host's file; 0 when there is none."""
    robots = one_per_host(robots)
    groups = _for_agent(robots_groups(robots), agent).filter(F.col("directive") == "crawl-delay")
    seconds = groups.withColumn("delay", F.col("value").try_cast("double")).filter("delay IS NOT NULL")
    last = seconds.groupBy("host").agg(F.max_by("delay", F.struct("group_no", "pos")).alias("delay"))
    return robots.select("host").join(last, "host", "left").select(
        "host", F.coalesce("delay", F.lit(0.0)).alias("delay")
    )


def robots_sitemaps(robots: DataFrame, agent: str = "*", strict: bool = False) -> DataFrame:
    """(host, group_no, pos, sitemap_url). ``strict`` leaves out sitemaps named under
    another agent; a sitemap line belongs to no group, so by default all count."""
    groups = robots_groups(robots)
    groups = _for_agent(groups, agent) if strict else groups
    return groups.filter((F.col("directive") == "sitemap") & F.col("value").startswith("http")).select(
        "host", "group_no", "pos", F.col("value").alias("sitemap_url")
    )


def _paths(robots: DataFrame, directive: str, agent: str) -> DataFrame:
    groups = _for_agent(robots_groups(robots), agent)
    return (
        groups.filter((F.col("directive") == directive) & (F.col("value") != ""))
        .select("host", F.col("value").alias("path"))
        .distinct()
    )


def robots_allowed_paths(robots: DataFrame, agent: str = "*") -> DataFrame:
    return _paths(robots, "allow", agent)


def robots_disallowed_paths(robots: DataFrame, agent: str = "*") -> DataFrame:
    return _paths(robots, "disallow", agent)


def _quote(text: Column) -> Column:
    """Percent encoding that leaves slashes and unreserved characters alone."""
    out = F.url_encode(text)
    for encoded, plain in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def _token(raw: Column) -> Column:
    """One line as a token: B blank, U agent, A allow, D disallow, O other group line;
    NULL for lines that change nothing."""
    line = strip(F.substring_index(raw, "#", 1))

    def classify(text: Column) -> Column:
        name = F.lower(strip(F.substring_index(text, ":", 1)))
        value = unquote(strip(F.substr(text, F.instr(text, ":") + 1)))
        return (
            F.when(~F.contains(text, F.lit(":")), F.lit(None).cast("string"))
            .when(name == "user-agent", F.concat(F.lit("U"), F.lower(value)))
            .when(name == "allow", F.concat(F.lit("A"), value))
            .when(name == "disallow", F.concat(F.lit("D"), value))
            .when(name.isin("crawl-delay", "request-rate"), F.lit("O"))
        )

    return F.when(raw == "", F.lit("B")).otherwise(let(line, classify))


def robots_policy(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules ARRAY<STRUCT<path, allow>>): the rules that bind ``agent``, in file
    order. Agent lines that follow one another share a group, a blank line ends it; the
    first group that names part of the agent counts, then the first group for everyone."""
    tokens = F.array_compact(F.transform(_lines(F.col("body")), _token))
    # A token holds no line end, so groups can be cut out of the joined tokens.
    joined = F.concat(F.array_join(tokens, "\n"), F.lit("\n"))
    groups = F.regexp_extract_all(joined, F.lit(r"(?:U[^\n]*+\n)++(?:[ADO][^\n]*+\n)++"), F.lit(0))
    short = agent.split("/")[0].lower()

    def agents(group: Column) -> Column:
        return F.transform(
            F.filter(F.split(group, "\n"), lambda t: t.startswith("U")), lambda t: F.substr(t, F.lit(2))
        )

    def for_all(group: Column) -> Column:
        return F.array_contains(agents(group), "*")

    def for_agent(group: Column) -> Column:
        return ~for_all(group) & F.exists(agents(group), lambda a: F.contains(F.lit(short), a))

    staged = robots.select("host", groups.alias("_g"))
    chosen = F.coalesce(
        F.get(F.filter("_g", for_agent), F.lit(0)), F.get(F.filter("_g", for_all), F.lit(0))
    )

    def rule(token: Column) -> Column:
        path = F.regexp_replace(F.substr(token, F.lit(2)), r"[?#]+\z", "")
        return F.struct(
            _quote(path).alias("path"), (token.startswith("A") | (F.length(token) == 1)).alias("allow")
        )

    lines = F.filter(F.split(chosen, "\n"), lambda t: t.rlike("^[AD]"))
    empty = F.array().cast("array<struct<path:string,allow:boolean>>")
    return staged.select("host", F.coalesce(F.transform(lines, rule), empty).alias("rules"))


def _checked_path(url: Column) -> Column:
    """What follows the host, percent encoded once."""

    def rest(p: Column) -> Column:
        whole = F.concat(
            p["path"],
            F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(""),
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
            F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
        )
        return F.when(whole == "", "/").otherwise(_quote(whole))

    # Most paths hold only characters that are never encoded.
    plain = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#%;\s]+(/[A-Za-z0-9/._~\-]*)\z", 1)
    return F.when(plain != "", plain).otherwise(let(url_parts(unquote(url)), rest))


#: Rules of a policy that a URL meets one by one at most.
FEW_RULES = 100


def robots_can_fetch(urls: DataFrame, robots: DataFrame, agent: str = "*", few_rules: int = FEW_RULES) -> DataFrame:
    """``urls`` with ``allowed``: the first rule in file order whose path starts the URL's
    path decides; no rule, no robots file: allowed.

    One policy row per host is joined,
    so a URL meets its rules inside its row and no URL-rule pairs are made; a host with
    many URLs is split by the adaptive skew join. A policy of more than ``few_rules`` rules does not travel with
    each URL: the beginnings of the path that are as long as some rule of the host are looked up among the
    rules, so a URL costs as much as there are such lengths, however many rules there are."""
    policy = cut(robots_policy(one_per_host(robots), agent).withColumnRenamed("host", "_host"))
    keyed = urls.withColumns({"_host": F.lower(host_of(F.col("url"))), "_path": _checked_path(F.col("url"))})
    hits = F.filter("rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    small = policy.filter(F.size("rules") <= few_rules)
    joined = keyed.join(small, "_host", "left")
    decided = F.get(hits, F.lit(0))["allow"]
    large = policy.filter(F.size("rules") > few_rules)
    if not large.isEmpty():
        joined = joined.join(_looked_up(keyed, large), ["_host", "_path"], "left")
        decided = F.coalesce(F.col("_found"), decided)
    return joined.select(
        *[F.col(c) for c in urls.columns],
        F.coalesce(decided, F.lit(True)).alias("allowed"),
    )


def _looked_up(keyed: DataFrame, policy: DataFrame) -> DataFrame:
    """(_host, _path, _found): what the first matching rule says, for the paths of hosts with these policies. Each
    path is looked up once."""
    rules = policy.select("_host", F.posexplode("rules").alias("_at", "_rule"))
    rules = rules.groupBy("_host", F.col("_rule.path").alias("_start")).agg(
        F.min(F.struct("_at", "_rule.allow")).alias("_first")
    )
    rules = cut(rules)
    sizes = rules.groupBy("_host").agg(F.collect_set(F.length("_start")).alias("_sizes"))
    paths = keyed.select("_host", "_path").distinct().join(sizes, "_host")
    starts = F.transform(
        F.filter("_sizes", lambda n: n <= F.length("_path")), lambda n: F.substr(F.col("_path"), F.lit(1), n)
    )
    tried = paths.select("_host", "_path", F.explode(starts).alias("_start"))
    return tried.join(rules, ["_host", "_start"]).groupBy("_host", "_path").agg(F.min("_first")["allow"].alias("_found"))
