"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression together with the literal tokens every matching URL must hold. Each rule is
filed under the one of its tokens that the fewest URLs of the table hold; a URL fetches the rules filed under
its own tokens, and only those run.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatguard.llm.store import free_name

_TOKEN = "[^a-z0-9]+"
_JUDGED = "rule string, verdict string"


class PathRule(NamedTuple):
    """A rule on a host with all its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """A free pattern over the whole lower-cased URL; literal is a text that every match holds at token bounds."""

    verdict: str
    name: str
    pattern: str
    literal: str


# The path rules of the query contract.
BASE_RULES = [
    PathRule("allow", "org", "/"),
    PathRule("block", "example.org", "/es/"),
    PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"),
    PathRule("block", "com", "/de/"),
]

# Our own patterns; the first match of this order decides where no path rule fits.
PATTERN_RULES = [
    PatternRule("block", "pills", r"[/.-]cheap-pills[.-]", "cheap-pills"),
    PatternRule("block", "casino", r"[/.-]casino[/.-]", "casino"),
    PatternRule("block", "torrent", r"[/.-]torrents[/.-]", "torrents"),
    PatternRule("block", "porn", r"[/.-]porn[/.-]", "porn"),
    PatternRule("block", "adserver", r"://ads\.", "ads"),
    PatternRule("block", "login", r"/login(?:[/?#.]|$)", "login"),
]


def host_of(url: str) -> Column:
    """Host after the first :// with A-Z lower-cased; empty for null or a URL without ://."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _TOKEN)), lambda t: t != "")


def _literal_tokens(rule: PathRule | PatternRule) -> list[str]:
    """Tokens that are whole in every match: all of a host and those path parts that end at a separator."""
    if isinstance(rule, PatternRule):
        return [t for t in re.split(_TOKEN, rule.literal.lower()) if t]
    inner = re.split(_TOKEN, rule.path.lower())[:-1]
    return [t for t in [*re.split(_TOKEN, rule.host.lower()), *inner] if t]


class _Test:
    """One rule ready to run; a path rule looks at host and path apart, so no sign in one can stand for the other."""

    def __init__(self, rule: PathRule | PatternRule):
        free = isinstance(rule, PatternRule)
        self.said = (None if free else rule.host + rule.path, rule.verdict)
        self.pattern = re.compile(rule.pattern if free else rf"(?:.*\.)?{re.escape(rule.host)}", re.S)
        self.path = None if free else rule.path

    def fits(self, address: str, host: str, path: str) -> bool:
        if self.path is None:
            return self.pattern.search(address) is not None
        return path.startswith(self.path) and self.pattern.fullmatch(host) is not None


def build_index(urls: DataFrame, url: str, rules: list) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; rarity is counted over all URLs, by rule token only."""
    wanted = sorted({t for r in rules for t in _literal_tokens(r)})
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")  # at most the tokens of max_rules rules
    seen = urls.select(F.explode(tokens_of(F.coalesce(F.col(url), F.lit("")))).alias("token")).join(F.broadcast(known), "token")
    counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}  # at most one row for each rule token
    index: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        own = _literal_tokens(rule)
        if not own:
            raise ValueError(f"rule {rule} has no literal token")
        index.setdefault(min(own, key=lambda t: (counts.get(t, 0), t)), []).append(n)
    return index


def judge_urls(pages: DataFrame, url: str = "url", base_rules: list[PathRule] | None = None, pattern_rules: list[PatternRule] | None = None, max_rules: int = 200_000) -> DataFrame:
    """All columns of pages and url_host, url_path, rule, verdict (columns of these names are replaced).

    The longest path rule that fits gives rule and verdict. Where none fits, rule is null and the first
    matching pattern of the method's own list gives the verdict, else allow. Null URLs and URLs without ://
    have an empty host and path, fit no path rule and are allowed. Repeated rows are judged alike; very long URLs
    are read whole. Of path rules of equal length the first in order of (verdict, host, path) counts.
    The rule list is held by every task, so its length is checked against max_rules.
    """
    base = BASE_RULES if base_rules is None else base_rules
    free = PATTERN_RULES if pattern_rules is None else pattern_rules
    rules = [*sorted(base, key=lambda r: (-len(r.host) - len(r.path), r)), *free]
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; raise max_rules or split the list")
    pages = pages.withColumns({"url_host": host_of(url), "url_path": path_of(url)})
    index = build_index(pages, url, rules) if rules else {}

    @F.pandas_udf(_JUDGED)
    def verdicts(address: pd.Series, host: pd.Series, path: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        ready: dict[int, _Test] = {}
        out = []
        for a, h, p, own in zip(address, host, path, tokens, strict=True):
            lowered, said = a.lower() if a else "", (None, "allow")
            # Rule numbers follow precedence: longest path rules first, then patterns in their order.
            for n in sorted(n for t in own if t in index for n in index[t]):
                test = ready.get(n) or ready.setdefault(n, _Test(rules[n]))
                if test.fits(lowered, h, p):
                    said = test.said
                    break
            out.append(said)
        return pd.DataFrame(out, columns=["rule", "verdict"])

    said = free_name("__said", pages.columns)
    judged = pages.withColumn(said, verdicts(F.col(url), "url_host", "url_path", tokens_of(F.coalesce(F.col(url), F.lit("")))))
    return judged.withColumns({"rule": F.col(f"{said}.rule"), "verdict": F.col(f"{said}.verdict")}).drop(said)
