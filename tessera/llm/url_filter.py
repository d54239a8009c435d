"""URL filter: a trie over reversed host labels, then path segments; the longest rule decides.

Rules are (action, host, path). A rule fits its host and every subdomain when the URL's path starts
with the rule's path; of the rules that fit, the one with the most host labels, then the longest
path wins. Two rules on the same host and path: block wins over allow.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict. Repeated rows each get their own answer; an empty table gives no rows; columns of
the input are passed through untouched; one that has the name of a result column gets an underscore in front of its own.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, free_name

#: Most rules that one broadcast trie holds (under 100 bytes a node, so at most some tens of MB); longer lists are taken in blocks.
MAX_RULES_PER_TRIE = 50_000


class Trie:
    """Host labels from the right, then path segments; a node keeps the rules that end there."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            host = host.lower()
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            labels = host.count(".") + 1
            *whole, rest = path.split("/")
            node = node.setdefault("path", {})
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            ends = node.setdefault("ends", {})  # the unfinished last segment, '' after a slash, and under None their lengths
            if rest not in ends or action == "block":
                ends[rest] = (labels, len(path), f"{host}{path}", action)
            lengths = ends.setdefault(None, [])
            if len(rest) not in lengths:
                insort(lengths, len(rest))

    def match(self, host: str, path: str):
        best, node = None, self.root
        if not host:
            return None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            if "path" in node and (found := self._path(node["path"], segments)):
                best = found  # more labels than any before
        return best

    @staticmethod
    def _path(node: dict, segments: Sequence[str]):
        best = None
        for segment in segments:
            ends = node.get("ends", {None: ()})
            for length in reversed(ends[None]):  # the longest that fits here is longer than any found before
                if length <= len(segment) and (rule := ends.get(segment[:length])):
                    best = rule
                    break
            node = node.get(("s", segment))
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _judge(trie):
    @F.pandas_udf("labels int, length int, rule string, block int")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [trie.value.match(h, p) or (None, None, None, None) for h, p in zip(hosts, paths, strict=True)]
        rows = [(a, b, c, None if d is None else int(d == "block")) for a, b, c, d in rows]
        return pd.DataFrame(rows, columns=["labels", "length", "rule", "block"]).astype({"labels": "Int32", "length": "Int32", "block": "Int32"})

    return judge


def filter_urls(df: DataFrame, url: str, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """df plus host, path, rule, verdict. Rules beyond MAX_RULES_PER_TRIE go to further tries, whose answers compete."""
    made = ("host", "path", "rule", "verdict")
    given, df = df.columns.index(url), aside(df, made)
    url, best_name = df.columns[given], free_name(df, "_best")
    spark = df.sparkSession
    out = df.withColumns({"host": host_of(df[url]), "path": path_of(df[url])})
    found = []
    for at in range(0, len(rules), MAX_RULES_PER_TRIE):
        trie = spark.sparkContext.broadcast(Trie(rules[at : at + MAX_RULES_PER_TRIE]))
        found.append(_judge(trie)("host", "path"))
    if not found:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = F.array_max(F.array([F.struct(*[x[c].alias(c) for c in ("labels", "length", "block", "rule")]) for x in found])) if len(found) > 1 else found[0]
    out = out.withColumn(best_name, best)
    rule, block = F.col(best_name)["rule"], F.col(best_name)["block"]
    verdict = F.when(rule.isNull(), default).when(block == 1, "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": verdict}).drop(best_name)
