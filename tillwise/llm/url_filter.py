"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a pattern in the common filter-list notation: ``||`` at the front means a host
or any of its subdomains, ``|`` an end of the url, ``*`` any text, ``^`` a separator or the end;
everything else is literal and compared without case. A *literal token* of a rule is a run of letters and
digits with a separator on both sides, so it is a whole token of every url that the rule can match.

For each rule, the token that the fewest distinct urls hold is its index entry. A url's tokens fetch the
rules entered under them, and only those run their regular expression. The cost per url follows the
candidates, not the number of rules. Rules without a literal token run on every url; keep them few.

Host rules (``host/path``) fit a host and its subdomains if the url's path starts with the rule's path;
the longest one decides. Else the filter's own patterns do: an ``allow`` pattern before a ``block``
pattern; a url without a host is blocked, any other allowed.

Scale. Each distinct url is judged once; the rule table is bounded by the rule list, which the caller
holds in memory (the index is broadcast up to ``MAX_BROADCAST_RULES`` rules, shuffled beyond). The
verdict goes back to the pages by a join on the url whose skewed side Spark splits, so a url that many
pages share is no hot spot. Three shuffles of urls; no other column is read.

Defined cases. Null url, or one without ``://``: host and path are empty, no rule, blocked. Empty
tables: empty results. Repeated pages: a row each. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's host rules, in the order given.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The filter's own patterns: gambling and adult hosts, tracking pixels, logins, binaries.
PATTERNS = (
    ("block", ".free-bets."), ("block", "||casino.*^"), ("block", ".casino."), ("block", ".online-casino."), ("block", "||poker.*^"),
    ("block", ".porn."), ("block", ".xxx/"), ("block", "/adserver/"), ("block", "/pixel.gif|"), ("block", "/wp-login.php^"),
    ("block", "/wp-admin/"), ("block", "/login?"), ("block", "/cgi-bin/"), ("block", "?replytocom="), ("block", ".exe|"),
    ("block", ".zip|"), ("block", ".apk|"), ("allow", "/robots.txt|"), ("allow", "||archive.org^"),
)
MAX_BROADCAST_RULES = 10_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEPARATOR = r"(?:[^a-zA-Z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # lower decides first
    on_site: bool  # matched against host and path, else against the whole url


def host_rule(action: str, rule: str) -> Rule:
    host, slash, path = rule.partition("/")
    bounded = [t for t, after in re.findall(r"([a-z0-9]+)(?=([^a-z0-9]|$))", rule.lower()) if after] if slash else []
    body = re.escape(host.lower() + slash + path) + ("" if slash else "(?:/|$)")
    return Rule(rule, action, rf"^(?:[^/]*\.)?{body}", tuple(bounded), -len(rule), True)


def pattern_rule(action: str, pattern: str) -> Rule:
    body, anchored, host = pattern, False, False
    if body.startswith("||"):
        body, host = body[2:], True
    elif body.startswith("|"):
        body, anchored = body[1:], True
    end = body.endswith("|")
    body = body[:-1] if end else body
    regex = "".join({"*": ".*", "^": _SEPARATOR}.get(c, re.escape(c)) for c in body)
    front = r"^[^:/?#]*://(?:[^/?#]*\.)?" if host else "^" if anchored else ""
    edged = ("/" if host or anchored else "*") + body.lower() + ("/" if end else "*")
    tokens = tuple(m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", edged))
    return Rule(pattern, action, f"(?i){front}{regex}{'$' if end else ''}", tokens, 1 if action == "allow" else 2, False)


def site(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for a null url and one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, *_LOWER), path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(url, *_LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """One row per page: its id, host, path, ``rule`` (the deciding host rule), ``verdict``, and ``pattern`` (the deciding pattern)."""
    spark = pages.sparkSession
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(*r) for r in patterns]
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    urls = rows.select(F.col("__url").alias("url")).where("url IS NOT NULL").distinct()
    host, path = site(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    words = sorted({t for r in rules for t in r.tokens})
    # how many urls hold each token of a rule; a row per token of the rule list
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    token_schema, rule_schema = "token string", "token string, name string, action string, regex string, rank int, on_site boolean"
    vocabulary = spark.createDataFrame([(w,) for w in words], token_schema)
    small = len(rules) <= MAX_BROADCAST_RULES
    freq = {r.token: r.n for r in seen.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token")
            .agg(F.count("*").alias("n")).collect()}
    entry = [(min(r.tokens, key=lambda t: (freq.get(t, 0), t)) if r.tokens else None, r.name, r.action, r.regex, r.rank, r.on_site) for r in rules]
    index = spark.createDataFrame([e for e in entry if e[0] is not None], rule_schema)
    fetched = urls.select("url", "host", "path", F.explode(_tokens(F.col("url"))).alias("token")) \
        .join(F.broadcast(index) if small else index, "token")
    for token, name, action, regex, rank, on_site in entry:
        if token is None:
            fetched = fetched.unionByName(urls.select("url", "host", "path", *(F.lit(v).alias(k) for k, v in (
                ("token", ""), ("name", name), ("action", action), ("regex", regex), ("rank", rank), ("on_site", on_site)))))
    text = F.when(F.col("on_site"), F.concat("host", "path")).otherwise(F.col("url"))
    best = fetched.where(F.regexp_like(text, F.col("regex"))).groupBy("url") \
        .agg(F.min(F.struct("rank", "name", "action", "on_site")).alias("best"))
    judged = rows.join(best, rows["__url"] == best["url"], "left")
    host, path = site(F.col("__url"))
    by_host = F.coalesce(F.col("best.on_site"), F.lit(False))
    return judged.select(
        F.col("__id").alias(id_col), host.alias("host"), path.alias("path"), F.when(by_host, F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.action"), F.when(host == "", "block").otherwise("allow")).alias("verdict"),
        F.when(~by_host, F.col("best.name")).alias("pattern"))


#: The rows of the query with HOST_RULES and PATTERNS in DuckDB's SQL: no index, every condition on every url.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
  CASE
  WHEN regexp_matches(url, '/robots\.txt$', 'i') THEN '/robots.txt|'
  WHEN regexp_matches(url, '^[^:/?#]*://([^/?#]*\.)?archive\.org([^a-z0-9_.%-]|$)', 'i') THEN '||archive.org^'
  WHEN regexp_matches(url, '\?replytocom=', 'i') THEN '?replytocom='
  WHEN regexp_matches(url, '\.apk$', 'i') THEN '.apk|'
  WHEN regexp_matches(url, '\.casino\.', 'i') THEN '.casino.'
  WHEN regexp_matches(url, '\.exe$', 'i') THEN '.exe|'
  WHEN regexp_matches(url, '\.free-bets\.', 'i') THEN '.free-bets.'
  WHEN regexp_matches(url, '\.online-casino\.', 'i') THEN '.online-casino.'
  WHEN regexp_matches(url, '\.porn\.', 'i') THEN '.porn.'
  WHEN regexp_matches(url, '\.xxx/', 'i') THEN '.xxx/'
  WHEN regexp_matches(url, '\.zip$', 'i') THEN '.zip|'
  WHEN regexp_matches(url, '/adserver/', 'i') THEN '/adserver/'
  WHEN regexp_matches(url, '/cgi-bin/', 'i') THEN '/cgi-bin/'
  WHEN regexp_matches(url, '/login\?', 'i') THEN '/login?'
  WHEN regexp_matches(url, '/pixel\.gif$', 'i') THEN '/pixel.gif|'
  WHEN regexp_matches(url, '/wp-admin/', 'i') THEN '/wp-admin/'
  WHEN regexp_matches(url, '/wp-login\.php([^a-z0-9_.%-]|$)', 'i') THEN '/wp-login.php^'
  WHEN regexp_matches(url, '^[^:/?#]*://([^/?#]*\.)?casino\..*([^a-z0-9_.%-]|$)', 'i') THEN '||casino.*^'
  WHEN regexp_matches(url, '^[^:/?#]*://([^/?#]*\.)?poker\..*([^a-z0-9_.%-]|$)', 'i') THEN '||poker.*^' END AS hit FROM s)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN hit IN ('/robots.txt|', '||archive.org^') THEN 'allow' WHEN hit IS NOT NULL OR host = '' THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern
FROM r"""
