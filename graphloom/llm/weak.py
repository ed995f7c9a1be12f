"""Quality classifier from weak labels.

Overlapping heuristic labellers vote or abstain on every document: each of FLAWS votes ``bad`` where it sees its flaw, each
of MERITS ``good`` where it sees none. Expectation-maximisation over the counts of all vote patterns (at most 2 to the
number of labellers, whatever the corpus) estimates how often each votes on good and on bad documents, hence its accuracy,
and the share of good ones, without true labels. The posteriors label a bounded sample of documents (``SAMPLE``, by hash of
the id), on which a linear scorer over hashed features of word shapes is fitted. Every document is then scored.

A word's shape: upper-case letters, lower-case letters and digits become A, a and 0, other characters stay, and runs become
one. A word that equals the one before it, or one of the eight before it, and a line that occurred before, count as shapes
of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, table
from graphloom.llm.exchange import release
from graphloom.llm.sampling import by_hash

SAMPLE, WIDTH = 4000, 2048
SAME, RECENT, LINE, ANY = "=", "~", "\n", ""
PLAIN = frozenset(".,;:!?'\"()-–—’“”«»¿¡…")


class Kinds(dict):
    """Code point to what stands for it in a shape."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS, RUN = Kinds(), re.compile(r"(.)\1+", re.DOTALL)


class Shapes(dict):
    """Word to shape, of the whole word; bounded, and words of more than 64 characters are not kept."""

    def __missing__(self, word: str) -> str:
        shape = RUN.sub(r"\1", word.translate(KINDS))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = shape
        return shape


def shape_counts(text: str | None, shapes: Shapes) -> Counter:
    """Counts of shapes; ANY counts words."""
    text = text or ""
    # WORD splits at six ASCII characters only, as bytes do
    words = [w.decode("utf-8") for w in text.encode("utf-8").split()]
    out = Counter(map(shapes.__getitem__, words))
    out[ANY] = len(words)
    recent: deque[str] = deque(maxlen=8)
    before, same, seen = None, 0, 0
    for w in words:
        if w == before:
            same += 1
        if w in recent:
            seen += 1
        before = w
        recent.append(w)
    lines = [x for x in text.split("\n") if x.strip()]
    out[SAME], out[RECENT], out[LINE] = same, seen, len(lines) - len(set(lines))
    return out


def _share(test):
    return lambda c: sum(n for shape, n in c.items() if shape not in (ANY, SAME, RECENT, LINE) and test(shape)) / max(1, c[ANY])


#: name, share of words, and the share from which the labeller votes ``bad``.
FLAWS = (
    ("shouting", _share(lambda s: s[0] == "A" and "a" not in s and s not in ("A", "A,", "A.")), 0.4),
    ("symbols", _share(lambda s: any(k not in "Aa0" and k not in PLAIN for k in s)), 0.25),
    ("bare marks", _share(lambda s: not any(k in "Aa0" for k in s)), 0.2),
    ("stutter", lambda c: c[SAME] / max(1, c[ANY]), 0.25),
    ("circling", lambda c: c[RECENT] / max(1, c[ANY]), 0.6),
    ("repeated lines", lambda c: c[LINE] / (1 + c[LINE]) if c[LINE] > 3 else 0.0, 0.9),
    ("numbers", _share(lambda s: "0" in s and "a" not in s), 0.6),
)
#: name, test for ``good``: no share near its limit; mostly lower-case words that do not repeat.
MERITS = (
    ("no flaw near", lambda c: all(share(c) < limit / 2 for _, share, limit in FLAWS)),
    ("plain words", lambda c: _share(lambda s: s.strip("".join(PLAIN)) in ("a", "Aa"))(c) > 0.8 and c[SAME] < 0.1 * c[ANY]),
)
LABELLERS = len(FLAWS) + len(MERITS)


def votes(c: Counter) -> str:
    """One letter for each labeller: b, g or - (abstains). All abstain below five words."""
    if c[ANY] < 5:
        return "-" * LABELLERS
    return "".join("b" if share(c) >= limit else "-" for _, share, limit in FLAWS) + "".join("g" if test(c) else "-" for _, test in MERITS)


#: How often a labeller votes on documents of the class it votes for, and on others, before any are seen; these count as
#: ``PRIOR`` documents of each class, whatever the corpus.
VOTES_RIGHT, VOTES_WRONG, PRIOR = 0.3, 0.03, 50.0


def log_likelihood(patterns: dict[str, int], good: np.ndarray, bad: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each pattern with votes, sorted, in each class; their counts), where labellers vote with the
    probabilities ``good`` and ``bad`` on documents of the class and ``share`` are good."""
    keys = [k for k in sorted(patterns) if k.strip("-")]
    voted = np.array([[v != "-" for v in k] for k in keys], dtype=float).reshape(len(keys), LABELLERS)
    each = [voted @ np.log(rate) + (1 - voted) @ np.log(1 - rate) + np.log(part) for rate, part in ((good, share), (bad, 1 - share))]
    return np.stack(each), np.array([patterns[k] for k in keys], dtype=float)


def log_prior(good: np.ndarray, bad: np.ndarray, share: float) -> float:
    """Of the rates and the share: beta distributions, PRIOR documents strong."""
    first_good, first_bad = first_rates()
    beta = lambda rate, at: (PRIOR * (at * np.log(rate) + (1 - at) * np.log(1 - rate))).sum()
    return float(beta(good, first_good) + beta(bad, first_bad) + PRIOR * 0.5 * (np.log(share) + np.log(1 - share)))


def first_rates() -> tuple[np.ndarray, np.ndarray]:
    merit = np.arange(LABELLERS) >= len(FLAWS)
    return np.where(merit, VOTES_RIGHT, VOTES_WRONG), np.where(merit, VOTES_WRONG, VOTES_RIGHT)


def fitted(patterns: dict[str, int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(rates in good documents, rates in bad ones, share of good ones, posterior of good of each pattern with votes):
    expectation-maximisation of likelihood and prior, from the prior."""
    (good, bad), share = first_rates(), 0.5
    first_good, first_bad = first_rates()
    voted = np.array([[v != "-" for v in k] for k in sorted(patterns) if k.strip("-")], dtype=float).reshape(-1, LABELLERS)
    for _ in range(rounds):
        each, n = log_likelihood(patterns, good, bad, share)
        posterior = 1 / (1 + np.exp(np.clip(each[1] - each[0], -500, 500)))
        mass, rest = n * posterior, n * (1 - posterior)
        new_good = (mass @ voted + PRIOR * first_good) / (mass.sum() + PRIOR)
        new_bad = (rest @ voted + PRIOR * first_bad) / (rest.sum() + PRIOR)
        new_share = (mass.sum() + PRIOR / 2) / (n.sum() + PRIOR)
        done = max(np.abs(new_good - good).max(), np.abs(new_bad - bad).max(), abs(new_share - share)) < 1e-10
        good, bad, share = new_good, new_bad, new_share
        if done:
            break
    return good, bad, float(share), posterior


def expectation_maximisation(patterns: dict[str, int]) -> tuple[np.ndarray, dict[str, float]]:
    """(accuracy of each labeller: how many of its votes are right; posterior probability of good for each pattern). A
    labeller votes one way only, so what is estimated is how often it votes on good and on bad documents. A pattern without
    votes stays at one half and takes no part."""
    good, bad, share, posterior = fitted(patterns)
    for_good, for_bad = good * share, bad * (1 - share)
    accuracy = np.where(np.arange(LABELLERS) >= len(FLAWS), for_good, for_bad) / (for_good + for_bad)
    found = dict.fromkeys(patterns, 0.5)
    return accuracy, found | dict(zip([k for k in sorted(patterns) if k.strip("-")], posterior.tolist()))


def hashed(c: Counter, width: int = WIDTH) -> np.ndarray:
    """Shares of shapes in ``width`` signed hash buckets, as square roots."""
    x, n = np.zeros(width, dtype=np.float32), max(1, c[ANY])
    for shape, k in c.items():
        if shape != ANY and k:
            h = zlib.crc32(shape.encode("utf-8"))
            x[h % width] += (1 if h >> 31 else -1) * (k / n) ** 0.5
    return x


class Linear:
    """Logistic regression on soft labels, both classes weighted alike; full-batch gradient descent with momentum."""

    def __init__(self, width: int = WIDTH) -> None:
        self.w, self.b = np.zeros(width, dtype=np.float32), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Linear:
        weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean())) / max(1, len(y))
        vw, vb = np.zeros_like(self.w), 0.0
        for _ in range(rounds):
            g = weight * (self.score(x) - y)
            vw = 0.9 * vw - rate * 0.1 * (x.T @ g.astype(np.float32) + decay * self.w)
            vb = 0.9 * vb - rate * 0.1 * float(g.sum())
            self.w, self.b = self.w + vw, self.b + vb
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -50, 50)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with quality (the scorer's probability that the document is good) and kept (quality >= threshold).

    Texts without words, null included, have quality 0. Equal texts get equal results. If the sample's posteriors are all on
    one side, there is nothing to tell apart and every text with words has quality 1. Rows that repeat an id are judged
    each. ``quality`` and ``kept`` replace input columns of these names."""

    @F.pandas_udf("string")
    def vote(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for part in parts:
            yield pd.Series([votes(shape_counts(x, shapes)) for x in part], dtype=object)
        shapes.clear()
        release()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    filled = F.col("text").rlike(WORD)
    counted = texts.where(filled).select(vote("text").alias("votes")).groupBy("votes").count()
    patterns = {r["votes"]: r["count"] for r in counted.collect()}  # at most 2 ** LABELLERS rows
    _, good = expectation_maximisation(patterns)
    shapes = Shapes()
    some = by_hash(texts.where(filled), sum(patterns.values()), sample, "id", "text").select(F.col("id").cast("string").alias("id"), "text")
    # by id, for the fit adds in this order
    rows = [shape_counts(r["text"], shapes) for r in sorted(some.toLocalIterator(), key=lambda r: (r["id"] or "", r["text"]))]
    rows = [c for c in rows if votes(c).strip("-")]
    y = np.array([good.get(votes(c), 0.5) for c in rows])
    model = Linear().fit(np.stack([hashed(c) for c in rows]), y) if len(rows) and y.min() < 0.5 < y.max() else None
    rows.clear()
    shapes.clear()
    release()  # the driver's memory

    @F.pandas_udf("double")
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for part in parts:
            out = []
            for at in range(0, len(part), 256):
                counts = [shape_counts(x, shapes) for x in part.iloc[at : at + 256]]
                scores = model.score(np.stack([hashed(c) for c in counts])).tolist() if model else [1.0] * len(counts)
                out += [s if c[ANY] else 0.0 for s, c in zip(scores, counts)]
            yield pd.Series(out, dtype=float)
        shapes.clear()
        release()

    return docs.withColumn("quality", quality(F.col(text_col).cast("string"))).withColumn("kept", F.col("quality") >= threshold)


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "kept")


QUERIES = {"op7_weak_label_quality": op7_weak_label_quality}
