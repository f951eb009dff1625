"""URL filters: fixed host/path rules, and association rules mined from labelled URLs.

Host, path and fixed rule come from DataFrame expressions. Spark's FP-growth mines combinations of URL tokens (host labels, path
segments, query keys, endings) together with the label of labelled URLs; the combinations that imply a label with the asked
confidence and support are kept, and those implied by a shorter kept one at no lower confidence are pruned. An inverted index from tokens to
rules matches every URL; the most confident rule that fits decides, and without one the verdict is ``allow``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from tilespark.functions.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` ((verdict, host/path)) that fits ``host`` and ``path``, as struct(length, rule, verdict) or null."""
    tried = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        tried.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*tried))


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL, sorted; numbers are folded. A null or schemeless URL has none."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return []
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    tail, host = rest[len(host) :].split("#", 1)[0], host.lower()
    path, _, query = tail.partition("?")
    labels = host.split(".")
    out = {f"scheme:{scheme.lower()}", *(f"host:{'.'.join(labels[-n:])}" for n in range(1, min(4, len(labels) + 1)))}
    for part in path.split("/"):
        name, dot, ending = part.rpartition(".")
        if dot:
            out.add(f"ending:{ending.lower()}")
            part = name
        if part:
            out.add("path:#" if part.isdigit() else f"path:{part.lower()}")
    out |= {f"key:{pair.split('=', 1)[0].lower()}" for pair in query.split("&") if pair}
    return sorted(out)


def _tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda u: url_tokens(u if isinstance(u, str) else None))


def same_pages(baskets: DataFrame, least: int) -> dict[str, str]:
    """Tokens of ``baskets(tokens)`` on ``least`` and more pages, with the first token that stands on exactly the same pages.

    A page has few tokens, and each of these stands on a fixed share of all pages at least: their number doesn't grow with the table.
    """
    marked = materialize(baskets.select("tokens", F.monotonically_increasing_id().alias("page")), "baskets")
    each = marked.select(F.explode("tokens").alias("token"), F.xxhash64("page").alias("h"), F.xxhash64("page", F.lit(1)).alias("g"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("n") >= least)
    first = F.min("token").over(Window.partitionBy("n", "h", "g"))
    return {r["token"]: r["first"] for r in found.select("token", first.alias("first")).toLocalIterator()}


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_pages: int = 5) -> tuple[list[tuple[frozenset, str, float]], dict[str, str]]:
    """``labelled(url, verdict)`` -> rules (tokens, verdict, confidence), most confident first, and the name that each frequent token has in them.

    A rule's tokens occur together in at least ``min_support`` of the labelled URLs (and in ``min_pages`` of them), so there are at most (subsets of a URL's tokens) /
    ``min_support`` of them whatever the input's size; that is what reaches the driver and is broadcast. Tokens that stand on
    exactly the same pages, as the parts of one long query do, count as one token; their subsets would multiply without saying more.
    """
    tokens = F.pandas_udf(_tokens, "array<string>")
    known = labelled.where("verdict is not null").select(tokens("url").alias("tokens"), "verdict")
    n = known.count()
    if not n:
        return [], {}
    support = min(1.0, max(min_support, min_pages / n))
    names = same_pages(known, math.ceil(support * n))

    @F.pandas_udf("array<string>")
    def frequent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda found: sorted({names[t] for t in found if t in names}))

    baskets = known.select(F.concat(frequent("tokens"), F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rows = model.associationRules.where("consequent[0] like 'verdict=%' and not exists(antecedent, x -> x like 'verdict=%')").collect()
    rules = sorted(((frozenset(r["antecedent"]), r["consequent"][0][8:], r["confidence"]) for r in rows), key=lambda r: (len(r[0]), sorted(r[0])))
    kept: dict[frozenset, tuple[str, float]] = {}
    for items, verdict, confidence in rules:
        shorter = (items - {x} for x in items)
        stack, implied = list(shorter), False
        while stack and not implied:
            part = stack.pop()
            if part in kept and kept[part][0] == verdict and kept[part][1] >= confidence:
                implied = True
            elif len(part) > 1:
                stack += [part - {x} for x in part]
        if not implied:
            kept[items] = (verdict, confidence)
    return sorted(((i, v, c) for i, (v, c) in kept.items()), key=lambda r: (-r[2], -len(r[0]), r[1], sorted(r[0]))), names


class RuleIndex:
    """Inverted index from tokens to rules; ``judge`` counts a rule's tokens met, tokens going by their ``names``."""

    def __init__(self, rules: list[tuple[frozenset, str, float]], names: dict[str, str] | None = None):
        self.rules, self.names, self.index = rules, names or {}, {}
        for k, (items, _, _) in enumerate(rules):
            for x in items:
                self.index.setdefault(x, []).append(k)

    def judge(self, tokens: list[str]) -> tuple[str, str | None]:
        met: dict[int, int] = {}
        for x in {self.names.get(t, t) for t in tokens}:
            for k in self.index.get(x, ()):
                met[k] = met.get(k, 0) + 1
        best = min((k for k, n in met.items() if n == len(self.rules[k][0])), default=None)
        if best is None:
            return "allow", None
        items, verdict, _ = self.rules[best]
        return verdict, " & ".join(sorted(items))


def judge(pages: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """``pages(page_id, url)`` -> ``page_id, host, path, rule, verdict, mined``, one row a page.

    Pages under a fixed rule take its verdict and serve as the labels; all others are judged by the mined rules (``mined`` names
    the rule that decided, null where none fits and the verdict is ``allow``). Null urls have empty host and path.
    """
    found = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host_of()).withColumn("path", path_of())
    found = found.withColumn("fixed", fixed_rule(rules))
    index = RuleIndex(*mine(found.select("url", F.col("fixed.verdict").alias("verdict")), min_support, min_confidence))
    shared = pages.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("struct<verdict:string,mined:string>")
    def by_rules(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([shared.value.judge(url_tokens(u if isinstance(u, str) else None)) for u in part], columns=["verdict", "mined"], dtype=object)

    judged = found.withColumn("by", by_rules("url"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "by.verdict").alias("verdict"),
                         F.when(F.col("fixed").isNull(), F.col("by.mined")).alias("mined"))
