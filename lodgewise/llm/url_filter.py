"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names literal tokens that every URL it fits must contain. The corpus is counted once for these tokens
alone, and a rule is filed under the one that the fewest URLs contain. Judging a URL looks up its own tokens,
fetches the few rules filed there, and runs only their regular expressions. Judging is a projection: no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules go to every task with the code, so there may be so many at most.
MOST_RULES = 200_000
_TOKEN = re.compile("[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``subject``: "site" (host and path) or "url" (the whole URL, A-Z in lower case).

    ``tokens``: runs of [a-z0-9] that stand alone in every match. Without any, the rule is tried on all URLs.
    ``rank``: a fitting rule of higher rank wins; among equal ranks the longer name, then the lesser.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    subject: str = "site"
    rank: int = 0


def _order(rule: Rule) -> tuple:
    return -rule.rank, -len(rule.name), rule.name


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and all paths that start with ``path``."""
    tokens = _TOKEN.findall(host.lower()) + _TOKEN.findall(path.lower())[: None if path[-1:] in "/-._" else -1]
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, tuple(tokens), "site", 1)


def pattern_rule(name: str, pattern: str, verdict: str, *tokens: str) -> Rule:
    """A regular expression on the whole URL; its name is not reported as a site rule."""
    return Rule(name, pattern, verdict, tokens, "url", 0)


def token_counts(pages: DataFrame, tokens: Iterable[str], url: str = "url") -> dict[str, int]:
    """How many URLs contain each token. At most one row per asked token comes back."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    found = pages.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.translate(url, _UPPER, _LOWER), F.lit("([a-z0-9]+)")))).alias("token")
    )
    asked = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counts = found.join(F.broadcast(asked), "token").groupBy("token").count()  # one row per rule token: at most MOST_RULES
    return {r["token"]: r["count"] for r in counts.collect()}


def index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Files each rule under its rarest token; rules without tokens are under the empty one."""
    filed: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        filed[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(filed)


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``; columns of these names are replaced.

    The host stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; the path goes
    on to ``?``, ``#`` or the end. Null, empty and scheme-less URLs have neither. The verdict is that of the
    fitting site rule with the longest name, else of the fitting pattern rule with the longest name, else
    ``default``; ``rule`` and ``pattern`` name them, or are null. Repeated rows are judged alike, row by row.
    """
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit into a task")
    filed = index(rules, token_counts(pages, (t for r in rules for t in r.tokens), url))

    @F.pandas_udf("site string, loose string, verdict string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {t: [(r, re.compile(r.pattern)) for r in found] for t, found in filed.items()}
        for urls, sites in batches:
            rows = []
            for whole, site in zip(urls, sites):
                best: dict[str, Rule] = {}
                for token in {"", *_TOKEN.findall(whole)}:
                    for rule, pattern in compiled.get(token, ()):
                        had = best.get(rule.subject)
                        if (had is None or _order(rule) < _order(had)) and pattern.search(
                            site if rule.subject == "site" else whole
                        ):
                            best[rule.subject] = rule
                by_site, loose = best.get("site"), best.get("url")
                winner = by_site or loose
                rows.append((by_site and by_site.name, loose and loose.name, winner.verdict if winner else default))
            yield pd.DataFrame(rows, columns=["site", "loose", "verdict"])

    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    place = F.struct(
        F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    whole = F.coalesce(F.translate(url, _UPPER, _LOWER), F.lit(""))
    told = pages.withColumn("host", place["host"]).withColumn("path", place["path"])
    told = told.withColumn("_told", verdicts(whole, F.concat("host", "path")))
    return told.withColumns(
        {"rule": F.col("_told.site"), "pattern": F.col("_told.loose"), "verdict": F.col("_told.verdict")}
    ).drop("_told")
