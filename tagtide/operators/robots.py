"""Robots files as an opt-out, judged inside each row with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.arrays import once
from tagtide.functions.text import trim_edges


def _directives(body: Column) -> Column:
    """The user-agent, allow and disallow lines as structs of field and value."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: trim_edges(F.regexp_extract(x, r"^([^#]*)", 1)))
    with_colon = F.filter(lines, lambda x: F.instr(x, ":") > 0)
    parsed = F.transform(with_colon, lambda x: F.struct(
        F.lower(trim_edges(F.regexp_extract(x, r"^([^:]*):", 1))).alias("field"),
        trim_edges(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"),
    ))
    return F.filter(parsed, lambda d: d["field"].isin("user-agent", "allow", "disallow"))


def _groups(directives: Column) -> Column:
    """Slices of the directive list: consecutive agent lines open one group.

    Rules standing before the first agent line belong to the first group.
    """
    places = F.sequence(F.lit(0), F.size(directives) - 1)
    opening = F.filter(places, lambda i: (F.get(directives, i)["field"] == "user-agent") & (
        (i == 0) | (F.get(directives, i - 1)["field"] != "user-agent")))
    return once(opening, lambda starts: F.transform(starts, lambda s, k: F.slice(
        directives,
        F.when(k == 0, F.lit(1)).otherwise(s + 1),
        F.coalesce(F.get(starts, k + 1), F.size(directives)) - F.when(k == 0, F.lit(0)).otherwise(s),
    )))


def _judged_groups(body: Column, token: str) -> Column:
    """Rules of each applicable group, and whether it names the token."""
    groups = once(_directives(body), lambda d: F.when(F.size(d) > 0, _groups(d)).otherwise(F.array()))

    def judge(group: Column) -> Column:
        agents = F.transform(
            F.filter(group, lambda d: d["field"] == "user-agent"), lambda d: F.lower(d["value"])
        )
        named = F.exists(agents, lambda a: (a != "*") & F.contains(F.lit(token.lower()), a))
        rules = F.transform(
            F.filter(group, lambda d: (d["field"] != "user-agent") & (d["value"] != "")),
            lambda d: F.struct(F.length(d["value"]).alias("length"), (d["field"] == "allow").alias("allow"),
                               d["value"].alias("path")),
        )
        return F.struct(named.alias("named"), (named | F.array_contains(agents, "*")).alias("applies"), rules.alias("rules"))

    return F.filter(F.transform(groups, judge), lambda g: g["applies"])


def robots_permit(
    body: Column, token: str = C.COLLECTOR_TOKEN, paths: tuple[str, ...] = C.COLLECTION_PATHS, max_chars: int | None = None
) -> Column:
    """True if a robots file leaves every needed path open to the token.

    Missing and HTML bodies say nothing and permit; so do those over
    ``max_chars``, where a caller sets it (the published service stops at
    ``ROBOTS_MAX_CHARS``). A group naming
    the token replaces the wildcard; the longest matching path decides, and an
    allow beats a disallow of the same length.
    """
    readable = body.isNotNull() & ~body.rlike(r"\A\s*<")
    if max_chars is not None:
        readable = readable & (F.length(body) <= max_chars)

    def decide(rules: Column) -> Column:
        open_paths = F.lit(True)
        for path in paths:
            best = F.array_max(F.filter(rules, lambda r: F.startswith(F.lit(path), r["path"])))
            open_paths = open_paths & F.coalesce(best["allow"], F.lit(True))
        return open_paths

    def choose(groups: Column) -> Column:
        return once(F.filter(groups, lambda g: g["named"]), lambda named: F.when(F.size(named) > 0, named).otherwise(groups))

    chosen = once(_judged_groups(body, token), choose)
    rules = F.flatten(F.transform(chosen, lambda g: g["rules"]))
    return F.when(readable, once(rules, decide)).otherwise(F.lit(True))


def robots_opt_outs(bodies: DataFrame, token: str = C.COLLECTOR_TOKEN) -> DataFrame:
    return bodies.select("host", (~robots_permit(F.col("robots_body"), token)).alias("opted_out"))
