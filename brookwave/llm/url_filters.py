"""URL filters: rules indexed by their rarest literal token.

A rule is either a host rule (a host with its subdomains, and a path prefix) or a pattern (a
regular expression over ``host + path``). Each rule names the literal tokens any url it fits must
hold; it is filed under the one that the fewest rules name (longer, then smaller, on ties). A
url's own tokens (runs of letters and digits, A-Z lowered) fetch candidate rules, and only those
run their expressions. The longest host rule that fits decides (block before allow on ties); without
one a fitting pattern does, and without that the url is allowed.

Rules are given by the caller and so bounded by the driver; they go out once. One pass, no shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule;
ports and user names stay part of the host; repeated pages are judged row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read

SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string"
TOKEN = re.compile(r"[a-z0-9]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class Rule(NamedTuple):
    verdict: str  # allow or block
    name: str  # what is reported
    expression: str  # matched from the start of host + path
    literals: tuple[str, ...]  # whole tokens that every fitting url holds
    rank: int  # the length that decides; 0 for patterns


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    host = host.translate(LOWER)
    where = rf"(?:[^/?#]*\.)?{re.escape(host)}(?![^/?#]){re.escape(path)}"
    # the host ends in whole tokens, the path may end within one
    ends_open = TOKEN.findall(path.translate(LOWER))[: -1 if path[-1:].isalnum() else None]
    return Rule(verdict, host + path, where, (*TOKEN.findall(host), *ends_open), len(host + path))


def pattern_rule(verdict: str, name: str, expression: str, *literals: str) -> Rule:
    return Rule(verdict, name, expression, literals, 0)


#: The query's own rules, then the patterns of the method.
RULES = (
    host_rule("block", "net"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"),
    pattern_rule("block", "casino", r"[^/?#]*\bcasino\b", "casino"), pattern_rule("block", "bets", r"[^/?#]*\bbets\b", "bets"),
    pattern_rule("block", "pills", r"[^/?#]*\bpills\b", "pills"), pattern_rule("block", "ads-track", r"[^/?#]*\bads-track\b", "ads", "track"),
)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(LOWER), m[2]


class Index:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        named = Counter(t for r in rules for t in set(r.literals))
        self.under: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            key = min(r.literals, key=lambda t: (named[t], -len(t), t), default="")
            self.under.setdefault(key, []).append((r, re.compile(r.expression, re.S)))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, rule, verdict, pattern."""
        host, path = parts(url)
        if not host and not path:
            return host, path, None, "allow", None
        text, best, pattern = host + path, None, None
        for token in {*TOKEN.findall(text.translate(LOWER)), ""}:
            for rule, expression in self.under.get(token, ()):
                if expression.match(text):
                    if rule.rank:
                        best = max(best or rule, rule, key=lambda r: (r.rank, r.verdict == "block", r.name))
                    else:
                        pattern = max(pattern or rule, rule, key=lambda r: (r.verdict == "block", r.name))
        verdict = (best or pattern).verdict if best or pattern else "allow"
        return host, path, best.name if best else None, verdict, pattern.name if pattern else None


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page with host, path, the deciding host rule, the verdict and the fitting pattern."""
    index = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(index.value)
        for b in batches:
            found = [known.judge(u) for u in b.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *,
  CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
  CASE WHEN regexp_matches(host, '\bpills\b') THEN 'pills' WHEN regexp_matches(host, '\bcasino\b') THEN 'casino'
       WHEN regexp_matches(host, '\bbets\b') THEN 'bets' WHEN regexp_matches(host, '\bads-track\b') THEN 'ads-track' END AS pattern
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  pattern FROM r
"""
