"""URL filtering by pattern rules that are indexed by their rarest literal token.

Rules
-----
``||host/path`` fits that host and all its subdomains where the URL's path starts with ``/path``.  Any other pattern is
looked for anywhere in the URL after ``://``: ``*`` is any run of characters, ``^`` is a separator (no letter, digit, ``_``,
``-``, ``.`` or ``%``) or the end; all else is literal, with case.

A pattern's tokens are the runs of ASCII letters and digits in its literal parts that end on both sides at another literal
character, at ``^`` or at the host's edge; only such runs must be whole tokens of every URL that the pattern fits.  A rule is
filed under the one that is rarest among all URLs of the table.  A URL's tokens fetch the rules filed under them (and the few
rules without a token), and only those run their regular expressions.

A host rule beats any other rule, then the longest pattern wins, then blocking, then the pattern's order.  A URL that no rule
fits is allowed, and one without a host is blocked.

Rules are a parameter, not data: they are compiled on the driver and sent to workers ``RULES_PER_PASS`` at a time; more rules
make more passes over the rows, each carrying the best rule so far.  Rows are never shuffled.  Null urls and urls without
``://`` have an empty host and path.  Repeated rows are judged alike; other columns stay untouched and don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_PER_PASS = 50_000
_TOKEN = re.compile("[A-Za-z0-9]+")
_SEPARATOR = r"(?:[^A-Za-z0-9_\-.%]|$)"


class Rule(NamedTuple):
    pattern: str
    action: str  # "block" or "allow"

    @property
    def is_host(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def rank(self) -> tuple:
        """Greater wins."""
        return self.is_host, len(self.name), self.action == "block", self.pattern

    def regex(self) -> str:
        text = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in self.name)
        return rf"(?s:^(?:[^/?#]*\.)?{text})" if self.is_host else f"(?s:{text})"

    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has."""
        found = []
        for m in _TOKEN.finditer(self.name):
            opens = self.is_host if m.start() == 0 else self.name[m.start() - 1] != "*"
            closes = m.end() < len(self.name) and self.name[m.end()] != "*"
            if opens and closes:
                found.append(m.group())
        return found


#: Rules of a production run: addresses that are rarely worth their text.
PATTERNS = tuple(
    Rule(p, "block")
    for p in (
        "/login^", "/signin^", "/logout^", "/register^", "/cart^", "/checkout^", "/wp-admin/", "/wp-login.php", "/cgi-bin/", "/search?", "/calendar/", "/ads/",
        "/adserver/", "/banner/", "/tracking/", "/feed/", "/trackback^", "replytocom=", "sessionid=", "phpsessid=", "^casino^", "^porn^", "^viagra^", "^torrent^",
        ".exe^", ".zip^", ".apk^", "^doubleclick.",
    )
) + (Rule("/robots.txt^", "allow"), Rule("/wiki/Search?", "allow"))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the host (path, query and fragment)."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    rest = F.substr(after, F.length(host) + F.lit(1))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(lower), empty(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)), empty(rest)


def _count_tokens(wanted: frozenset[str]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for pdf in batches:
            for text in pdf["_text"]:
                for token in wanted.intersection(_TOKEN.findall(text)):
                    total[token] = total.get(token, 0) + 1
        if total:
            yield pd.DataFrame({"token": list(total), "n": list(total.values())})

    return count


def token_frequencies(urls: DataFrame, url_col: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs, over all rows; only the rules' own tokens come to the driver."""
    host, _, rest = url_parts(F.col(url_col))
    texts = urls.select(F.concat(host, rest).alias("_text"))
    wanted = frozenset(t for r in rules for t in r.tokens())
    counts = texts.mapInPandas(_count_tokens(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


def index_rules(rules: Sequence[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (ties: the longer, then the first by name), and those without a token."""
    index: dict[str, list[Rule]] = {}
    loose = []
    for rule in rules:
        if tokens := rule.tokens():
            index.setdefault(min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t)), []).append(rule)
        else:
            loose.append(rule)
    return index, loose


def _judge(index: dict[str, list[Rule]], loose: list[Rule]):
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled: dict[str, re.Pattern] = {}

        def fits(rule: Rule, text: str) -> bool:
            if rule.pattern not in compiled:
                compiled[rule.pattern] = re.compile(rule.regex())
            return compiled[rule.pattern].search(text) is not None

        known = frozenset(index)
        for texts, so_far, its_action in batches:
            found: list[tuple[str | None, str | None]] = []
            for text, pattern, action in zip(texts, so_far, its_action, strict=True):
                best = Rule(pattern, action) if isinstance(pattern, str) else None
                candidates = [r for t in known.intersection(_TOKEN.findall(text)) for r in index[t]]
                for rule in sorted({*candidates, *loose}, key=lambda r: r.rank, reverse=True):
                    if best is not None and rule.rank <= best.rank:
                        break
                    if fits(rule, text):
                        best = rule
                        break
                found.append((best.pattern, best.action) if best else (None, None))
            yield pd.DataFrame(found, columns=["pattern", "action"], dtype=object)

    return judge


def read_rules(table: DataFrame) -> list[Rule]:
    """The rules of a table (pattern, action: "block" or "allow"), e.g. a filter list of thousands; rows with nulls are skipped.
    Rules are a parameter: they come to the driver."""
    rows = table.select("pattern", "action").where("pattern is not null and pattern <> '' and action in ('block', 'allow')").distinct()
    return [Rule(r["pattern"], r["action"]) for r in rows.orderBy("pattern", "action").collect()]


def judge_urls(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", carry: tuple[str, ...] = ("page_id",), rules_per_pass: int = RULES_PER_PASS) -> DataFrame:
    """``carry`` columns, ``host``, ``path``, ``rule`` (the fitting host rule's name, or null), ``pattern`` (that of the
    winning rule of any kind, or null) and ``verdict`` of every row."""
    host, path, rest = url_parts(F.col(url_col))
    given = urls.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], host.alias("_host"), path.alias("_path"), F.concat(host, rest).alias("_text"))
    given = given.withColumn("_best", F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("action")))
    frequency = token_frequencies(urls, url_col, rules)
    for lo in range(0, len(rules), rules_per_pass):
        index, loose = index_rules(rules[lo : lo + rules_per_pass], frequency)
        better = F.pandas_udf(_judge(index, loose), "pattern string, action string").asNondeterministic()
        given = given.withColumn("_best", better("_text", "_best.pattern", "_best.action"))
    given = given.withColumns({"_pattern": F.col("_best.pattern"), "_action": F.col("_best.action")})
    default = F.when(F.col("_host") == "", "block").otherwise("allow")
    return given.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_pattern").startswith("||"), F.substring("_pattern", 3, 1 << 30)).alias("rule"),
        F.col("_pattern").alias("pattern"),
        F.coalesce("_action", default).alias("verdict"),
    )
