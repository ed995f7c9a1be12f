"""URL filters: host and path rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

The trees are trained from labelled URLs: those to which a rule gives a verdict. They are fitted on a bounded sample of them
(``most_labelled``, by hash of the id). Suffix statistics (how often a host's last label is labelled, and how often blocked)
come from all labelled rows, out of fold: a host is in one of ``FOLDS``, and a training row's statistics leave out its own
fold, so that no row's label is among its features. They are kept in ``SUFFIX_BUCKETS`` hashed buckets, so what reaches the
driver and the workers has a fixed size. Every row is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.sampling import by_hash

# Verdict, host, path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUFFIX_BUCKETS, FOLDS = 1024, 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "specials", "longest_label", "https", "www", "fragment", "file", "suffix_log_count", "suffix_block_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null; a later rule of equal length loses."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest ends up outermost
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix(host: str) -> int:
    return zlib.crc32(host.rpartition(".")[2].encode()) % SUFFIX_BUCKETS


def lexical(url: str | None, host: str, path: str, stats: np.ndarray) -> list[float]:
    """The features of one URL; ``stats``: [bucket, (log count, block rate)]."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), len([x for x in path.split("/") if x]), host.count(".") + 1,
        len(re.findall("[0-9]", url)) / n, len(re.findall("[0-9]", host)) / max(1, len(host)), _entropy(url), _entropy(host),
        len([x for x in query.split("&") if x]), len(query), host.count("-"), len(re.findall(r"[^A-Za-z0-9/:.]", url)),
        max(map(len, host.split("."))), url.startswith("https"), host.startswith("www."), "#" in url, "." in path.rpartition("/")[2],
        *stats[suffix(host)],
    ]


class Boosted:
    """Binary gradient-boosted trees on binned features, logistic loss. Fitting is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.edges, self.forest = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, p * (1 - p))
            self.forest.append(tree)
            f += self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """A full tree of self.depth levels: rows of (feature, bin) for inner nodes in heap order, then leaf values."""
        node, splits = np.zeros(len(g), dtype=np.int64), []
        for level in range(self.depth):
            width, best = 1 << level, np.zeros((1 << level, 2), dtype=np.int64)
            top = np.full(width, 1e-9)
            best[:, 1] = self.bins  # no split: all rows go left
            for j in range(b.shape[1]):
                key = node * (self.bins + 1) + b[:, j]
                gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + self.least) + (ga - gl) ** 2 / (ha - hl + self.least) - ga**2 / (ha + self.least)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > top
                top = np.where(better, gain[np.arange(width), k], top)
                best[better, 0], best[better, 1] = j, k[better]
            splits.append(best)
            node = 2 * node + (b[np.arange(len(g)), best[node, 0]] > best[node, 1])
        width = 1 << self.depth
        return [splits, -self.rate * np.bincount(node, g, width) / (np.bincount(node, h, width) + self.least)]

    def _walk(self, tree: list, b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), dtype=np.int64)
        for best in tree[0]:
            node = 2 * node + (b[np.arange(len(b)), best[node, 0]] > best[node, 1])
        return tree[1][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        b = self._binned(x)
        f = self.base + sum((self._walk(t, b) for t in self.forest), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))


def fold(host: str) -> int:
    return zlib.crc32(host.encode()) % FOLDS


def suffix_statistics(counts: np.ndarray) -> np.ndarray:
    """[fold, bucket, (log count, block rate)] of ``counts`` [fold, bucket, (rows, blocked)]: fold k without its own rows,
    and last of all rows."""
    n = np.concatenate([counts.sum(0)[None] - counts, counts.sum(0)[None]])
    return np.stack([np.log1p(n[..., 0]), (n[..., 1] + 1) / (n[..., 0] + 2)], axis=-1)


def trained(sample: list, stats: np.ndarray) -> Boosted | None:
    """Trees of rows (url, host, path, y), or None where all have one label."""
    y = np.array([r["y"] for r in sample], dtype=float)
    if len(set(y)) < 2:
        return None
    return Boosted().fit(np.array([lexical(r["url"], r["host"], r["path"], stats[fold(r["host"])]) for r in sample], dtype=float), y)


def _labelled(pages: DataFrame, rules, id_col: str, url_col: str, most_labelled: int) -> tuple[DataFrame, list, np.ndarray]:
    """(rows with host, path, rule and verdict; the sample of labelled ones; counts by fold and suffix)."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "fit.rule", "fit.verdict")
    labelled = rows.where("rule is not null").withColumn("y", (F.col("verdict") == "block").cast("int"))
    hashed = lambda c, n: (F.crc32(c.cast("binary")) % n).cast("int")
    counted = labelled.groupBy(hashed(F.col("host"), FOLDS).alias("fold"), hashed(F.element_at(F.split("host", r"\."), -1), SUFFIX_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))
    counts = np.zeros((FOLDS, SUFFIX_BUCKETS, 2))
    for r in counted.collect():  # at most FOLDS * SUFFIX_BUCKETS rows
        counts[r["fold"], r["bucket"]] = r["n"], r["blocked"]
    sample = by_hash(labelled, int(counts[..., 0].sum()), most_labelled, "id", "url").select("id", "url", "host", "path", "y").collect()
    return rows, sorted(sample, key=lambda r: (str(r["id"]), r["url"])), counts  # the fit adds in this order


def held_out_accuracy(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most_labelled: int = 20_000) -> float:
    """Share of the sample's labelled URLs that trees fitted on the hosts of other folds judge as the rules do."""
    _, sample, counts = _labelled(pages, rules, id_col, url_col, most_labelled)
    right = 0
    for k in range(FOLDS):
        others = counts.copy()
        others[k] = 0
        stats = suffix_statistics(others)
        model = trained([r for r in sample if fold(r["host"]) != k], stats)
        test = [r for r in sample if fold(r["host"]) == k]
        if model and test:
            score = model.score(np.array([lexical(r["url"], r["host"], r["path"], stats[FOLDS]) for r in test], dtype=float))
            right += int(((score >= 0.5) == np.array([r["y"] == 1 for r in test])).sum())
    return right / max(1, len(sample))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most_labelled: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, verdict, block_score (the trees' probability of ``block``, for every row).

    The verdict is the rule's, else ``block`` where block_score >= threshold. Without labelled rows of both verdicts there
    is no model: the score is the share of blocked rows among the labelled (0 without any). Null and empty URLs have empty
    host and path and are judged by the trees. Equal URLs get equal verdicts; rows that repeat an id are judged each. Other
    columns are not read, so their names cannot clash."""
    rows, sample, counts = _labelled(pages, rules, id_col, url_col, most_labelled)
    stats = suffix_statistics(counts)
    model, overall = trained(sample, stats), stats[FOLDS]
    only = float(np.mean([r["y"] for r in sample])) if sample else 0.0

    @F.pandas_udf("double")
    def block_score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for url, h, p in parts:
            if model is None or not len(url):
                yield pd.Series(np.full(len(url), only))
            else:
                yield pd.Series(model.score(np.array([lexical(*x, overall) for x in zip(url, h, p)], dtype=float)))

    verdict = F.coalesce("verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return rows.withColumn("block_score", block_score("url", "host", "path")).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
