"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a host suffix and a path prefix. It is compiled to one regular
expression over ``host || path`` and filed under one literal token that any fitting
URL must contain as a whole token: the one shared with the fewest other rules. A
URL's own tokens fetch candidate rules and only those run their expression. The
longest fitting rule decides; without one the default verdict holds.

Small lists become a literal map inside the projection (no shuffle, no join). Longer
lists join distinct URLs with the rule table on the token.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no
rule and gets the default verdict; an empty table gives an empty result; repeated
rows are judged alike; of equally long fitting rules the greater text wins; columns
of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import side

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: Rules up to which the index is a literal inside the plan.
INLINE_RULES = 256


@dataclass(frozen=True)
class UrlRule:
    """``action`` is "allow" or "block"; ``path`` starts with a slash."""

    action: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"unknown action {self.action!r}")
        if not self.host or "/" in self.host or not self.path.startswith("/"):
            raise ValueError(f"not a host suffix and path prefix: {self.host!r} {self.path!r}")

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", self.text)
        return rf"\A(?:[^/]*\.)?{quoted}"

    def tokens(self) -> list[str]:
        """Literal tokens that are complete in every fitting URL: a path may go on after the rule's end."""
        found = re.findall(r"[a-z0-9]+", self.text.translate(str.maketrans(_UPPER, _LOWER)))
        open_end = self.path[-1].isascii() and self.path[-1].isalnum()
        return found[:-1] if open_end else found


def rarest_tokens(rules: Sequence[UrlRule]) -> dict[UrlRule, str]:
    """The index token of each rule; rules without any are filed under the empty token, which every URL fetches."""
    uses = Counter(t for r in rules for t in set(r.tokens()))
    return {r: min(set(r.tokens()), key=lambda t: (uses[t], -len(t), t), default="") for r in rules}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _url_tokens(key: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(key, _UPPER, _LOWER), "[^a-z0-9]+")))


def _best(hits: Column) -> Column:
    return F.array_max(F.transform(hits, lambda c: F.struct(c["n"].alias("n"), c["rule"].alias("rule"), c["action"].alias("action"))))


def judge_urls(df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null without a fitting rule) and ``verdict``."""
    index = rarest_tokens(list(dict.fromkeys(rules)))
    key = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    name, best = _free(df, "key"), _free(df, "best")
    if len(index) <= inline_rules:
        return _finish(df.withColumn(best, _inline(key, index)), url, default, best)
    spark = df.sparkSession
    listed = spark.createDataFrame([(t, r.text, len(r.text), r.action, r.regex) for r, t in index.items()], "token string, rule string, n int, action string, regex string")
    # Keys without a host fetch no rule, so the null addresses, which may be many, stay out of the join.
    keyed = df.withColumn(name, F.when(key != "", key))
    urls = keyed.select(name).where(F.col(name).isNotNull()).distinct()
    hits = (
        urls.select(name, F.explode(_url_tokens(F.col(name))).alias("token"))
        .join(side(listed, len(index)), "token")
        .where(F.regexp_like(name, F.col("regex")))
        .groupBy(name)
        .agg(F.max(F.struct("n", "rule", "action")).alias(best))
    )
    return _finish(keyed.join(hits, name, "left").drop(name), url, default, best)


def _free(df: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    while (name := f"__{name}") in df.columns:
        pass
    return name


def _inline(key: Column, index: dict[UrlRule, str]) -> Column:
    by_token: dict[str, list[UrlRule]] = {}
    for rule, token in index.items():
        by_token.setdefault(token, []).append(rule)
    if not by_token:
        return F.lit(None).cast("struct<n:int,rule:string,action:string>")
    entry = lambda r: F.struct(F.lit(r.text).alias("rule"), F.lit(len(r.text)).alias("n"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))
    table = F.create_map(*(x for t, rs in by_token.items() for x in (F.lit(t), F.array(*map(entry, rs)))))
    fetched = F.flatten(F.filter(F.transform(_url_tokens(key), lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull()))
    return _best(F.filter(fetched, lambda c: F.regexp_like(key, c["regex"])))


def _finish(df: DataFrame, url: str, default: str, best: str) -> DataFrame:
    added = {"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.action"), F.lit(default))}
    return df.withColumns(added).drop(best)
