"""Allow and block rules for URLs, fetched by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal tokens that any
match must contain. The tokens' frequencies over all URLs decide which token of a rule is the
rarest; that token is the rule's only index entry. A URL's tokens fetch the candidate rules,
and only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base rules, (action, host and path).
BASE_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# The method's own patterns, which decide where no base rule fits: (name, expression, literal tokens).
PATTERNS = [
    ("spam-farm", r"(?:^|[.-])spam-farm[.-]", ("spam", "farm")),
    ("pills", r"(?:^|[.-])(?:cheap|buy|online)-pills[.-]", ("pills",)),
    ("casino", r"(?:^|[./-])casino(?:$|[./-])", ("casino",)),
    ("adult", r"(?:^|[./-])xxx(?:$|[./-])", ("xxx",)),
    ("adult", r"(?:^|[./-])porn(?:$|[./-])", ("porn",)),
    ("click-bait", r"(?:^|[./-])click-bait(?:$|[./-])", ("click", "bait")),
]

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TOKEN = re.compile(r"[0-9a-z]+")
TOKEN_SQL = r"[^0-9a-z]+"
AFTER = re.compile(r"://([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    expression: str
    tokens: tuple[str, ...]
    weight: int  # the longest base rule wins; patterns weigh nothing


def base_rule(action: str, rule: str) -> Rule:
    """A host, whose subdomains count too, and the beginning of a path."""
    host, slash, path = rule.partition("/")
    return Rule(action, rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(TOKEN.findall(rule)), len(rule))


def default_rules() -> list[Rule]:
    return [base_rule(*r) for r in BASE_RULES] + [Rule("block", name, expression, tokens, 0) for name, expression, tokens in PATTERNS]


def split_url(url: str | None) -> tuple[str, str]:
    found = AFTER.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class RuleIndex:
    """Rules by their rarest token; rules without a literal are candidates of every URL."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.expression))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        target = host + path
        candidates = list(self.always)
        for token in set(TOKEN.findall(target.translate(LOWER))):
            candidates += self.by_token.get(token, ())
        fits = [rule for rule, pattern in candidates if pattern.search(target)]
        base = max((r for r in fits if r.weight), key=lambda r: (r.weight, r.name), default=None)
        own = min((r.name for r in fits if not r.weight and r.action == "block"), default=None)
        return host, path, base.name if base else None, base.action if base else ("block" if own else "allow"), own


def token_frequency(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each of the rules' tokens, over all URLs; a row per token comes back."""
    words = F.array_distinct(F.split(F.lower("url"), TOKEN_SQL))
    found = pages.select(F.explode(words).alias("token")).filter(F.col("token").isin(sorted(tokens)))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every row of ``pages`` (page_id, url).

    A null URL, or one without ``://``, has an empty host and path and is allowed by default.
    ``rule`` is the longest base rule that fits, ``pattern`` the first blocking pattern. Repeated
    rows keep a row each; an empty table gives no rows; other columns are ignored.
    """
    rules = default_rules() if rules is None else rules
    frequency = token_frequency(pages, {t for r in rules for t in r.tokens})
    shared = pages.sparkSession.sparkContext.broadcast((rules, frequency))  # as large as the rule list
    schema = pa.schema([("page_id", pa.int64())] + [(n, pa.string()) for n in ("host", "path", "rule", "verdict", "pattern")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(*shared.value)
        for batch in batches:
            judged = [index.judge(u) for u in batch.column("url").to_pylist()]
            columns = [pa.array([j[k] for j in judged], pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *columns], schema=schema)

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")
