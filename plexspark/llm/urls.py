"""URL filters (operator 5): redirect equivalence.

Addresses are nodes. An address as it is written is linked to its plain form:
without scheme, fragment, ``www.`` or ``m.`` in front of the host, tracking
parameters, ``index.html``, ``.html`` and trailing slashes; other parameters
stay. A page is linked to the target of its canonical link and to the target of
an immediate refresh, and redirects link what they are given. What is connected
is one resource under several aliases: a block rule on one of them blocks those
that no rule names, unless an alias is explicitly allowed. Rules are held
against every alias as it is written, whether or not it is a page of the table.
A page's own rule always decides for the page itself.

DataFrame functions only; the component search exchanges one row per link and
round, aggregates before it shuffles, and ends after a number of rounds that
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared
from plexspark.plans.connected import components

#: (host, path, verdict); the longest path that fits decides, then the longest host.
RULES = (("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its question mark, or an empty text."""
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


#: Names of parameters that say where a reader came from and not what they read.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def address(host: Column, path: Column, query: Column) -> Column:
    """The plain form of an address; null without a host."""
    kept = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING)))
    kept = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    bare = F.regexp_replace(host, r"^(www|m)\.(?=.)", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/index\.html|\.html)?/*$", ""), F.when(query == "", query).otherwise(kept)))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit("/" + rule[1]))


def own_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The rule that names the address, as struct(rule, verdict), or null: the longest path, then the longest host."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r[1]), len(r[0]))):
        out = F.when(fits(host, path, r), F.struct(F.lit(f"{r[0]}/{r[1]}").alias("rule"), F.lit(r[2]).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved."""
    kept = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)),
    )
    folder = F.when(F.rlike(path, F.lit(r"/\.\.?$")) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def _target(found: Column, host: Column, path: Column, query: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a link's target, resolved against its page; all null for none and for schemes without a host."""
    own = F.regexp_extract(found, "^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))
    there_host, there_path = host_path(F.when(F.startswith(found, F.lit("//")), F.concat(F.lit("x:"), found)).otherwise(found))
    there = F.startswith(found, F.lit("//")) | F.rlike(found, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://"))
    void = (found == "") | (~there & F.rlike(found, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")))
    here = F.when(own == "", path).when(F.startswith(own, F.lit("/")), _without_dots(own)).otherwise(_without_dots(F.concat(folder, own)))
    asked = query_of(found)
    asked = F.when((own == "") & (asked == ""), query).otherwise(asked)
    return F.when(~void, F.when(there, there_host).otherwise(host)), F.when(~void, F.when(there, there_path).otherwise(here)), F.when(~void, asked)


def _end(host: Column, path: Column, query: Column, rules: tuple) -> Column:
    """A link's end: its plain address, and the verdict of the rule that names it as it is written."""
    return F.struct(address(host, path, query).alias("address"), own_rule(host, path, rules)["verdict"].alias("verdict"))


def _of_tag(html: Column, tag: str, holds: str, attribute: str) -> Column:
    """The attribute's value in every such tag that holds the expression; a tag ends at the next bracket of either kind."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\b[^<>]*>)"), 1), lambda t: F.rlike(t, F.lit(rf"(?i){holds}")))
    return F.transform(tags, lambda t: F.regexp_extract(t, rf"(?i)\b{attribute}\s*=\s*[\"']?([^\"'\s>]+)", 1))


def aliases(html: Column, host: Column, path: Column, query: Column, rules: tuple = RULES) -> Column:
    """Addresses that a page says are its own, with their verdicts: of its canonical links and refreshes; null without html."""
    canonical = _of_tag(html, "link", r"\brel\s*=\s*[\"']?canonical\b", "href")
    refresh = _of_tag(html, "meta", r"\bhttp-equiv\s*=\s*[\"']?refresh\b", "url")
    one = lambda word, c: F.when(F.ilike(html, F.lit(f"%{word}%")), c).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.concat(one("canonical", canonical), one("refresh", refresh)), lambda c: c != "")
    return F.when(html.isNotNull(), F.transform(found, lambda c: _end(*_target(c, host, path, query), rules)))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """For each row of ``pages`` its page_id, host, path, rule, verdict, address (plain) and component (the least plain address).

    ``redirects`` may add links (from_url, to_url) known from elsewhere. The
    verdict is that of the page's own rule. Without one, it is ``allow`` if any
    alias has an allow rule, else ``block`` if any has a block rule, else
    ``allow``; the ends of all links count as aliases, also those that no row of
    ``pages`` has. Relative links are resolved against the page's url (or
    from_url). A null url, or one without ``://``, has an empty host and path,
    no alias and no rule, and is allowed; null html has no links; repeated rows
    get equal results; other columns are dropped; no pages give no rows.
    """
    host, path = host_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), query_of(F.col("url")).alias("query"), F.regexp_extract("url", "^[^#]*", 0).alias("url"), F.col("html"))
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    plain = address(host, path, query)
    # Written forms are nodes that begin with the plain one, so the least node of a component is always plain.
    written = F.concat(plain, F.lit(" "), F.col("url"))
    seen = seen.select("page_id", "host", "path", own_rule(host, path, rules).alias("own"), plain.alias("address"), written.alias("written"), aliases(F.col("html"), host, path, query, rules).alias("aliases"))
    seen = shared.cut(seen)  # the pages are read and searched once
    pairs = seen.where("address IS NOT NULL").select(F.col("written").alias("a"), F.explode("aliases").alias("end")).where("end.address IS NOT NULL")
    links, ends = pairs.select("a", F.col("end.address").alias("b")), pairs.select("end.*")
    links = links.union(seen.where("address IS NOT NULL").select(F.col("written").alias("a"), F.col("address").alias("b")))
    if redirects is not None:
        source = (*host_path(F.col("from_url")), query_of(F.col("from_url")))
        moves = redirects.select(_end(*source, rules).alias("a"), _end(*_target(F.col("to_url"), *source), rules).alias("b"))
        links = links.union(moves.select("a.address", "b.address"))
        ends = ends.union(moves.select(F.explode(F.array("a", "b")).alias("end")).select("end.*"))
    ruled = seen.select("page_id", "host", "path", "own.rule", "own.verdict", "address", "written")
    whole = components(links)
    alone = F.concat(F.lit("#"), F.pmod(F.xxhash64("page_id"), F.lit(65536)).cast("string"))  # spreads pages without an address
    named = shared.cut(ruled.join(whole, F.col("written") == F.col("node"), "left").select("page_id", "host", "path", "rule", "verdict", "address", F.coalesce("component", "address", alone).alias("component")))
    ends = ends.where("address IS NOT NULL AND verdict IS NOT NULL").distinct()
    ends = ends.join(whole, F.col("address") == F.col("node"), "left").select(F.coalesce("component", "address").alias("component"), "verdict")
    verdicts = named.select("component", "verdict", F.lit(1).alias("rows")).union(ends.select("component", "verdict", F.lit(0)))
    flags = verdicts.groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.sum("rows").alias("rows"))
    out = shared.join_counted(named, shared.cut(flags.where("allowed IS NOT NULL")), "component", "rows", "left")
    verdict = F.coalesce("verdict", F.when(~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "address", F.when(F.col("address").isNotNull(), F.col("component")).alias("component"))
