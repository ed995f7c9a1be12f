"""Entity matching: a ladder of lookups from exact to loose, ending in a blocked fuzzy join, and profiles of aliases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import lookup, norm_key, trim_unicode
from graphloom.operators.topology import with_checkpoints


def jaro_winkler(a: str, b: str) -> float:
    """Half transpositions are rounded down; a prefix of at most four characters counts 0.1 each, whatever the similarity
    without it."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swapped = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used) if u))) // 2
    score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + prefix * 0.1 * (1 - score)


def _codes(keys: list[str]) -> np.ndarray:
    """Code points of keys of one length, a row for each."""
    return np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32).reshape(len(keys), -1)


#: Scores are rounded to so many places, so that thresholds and ties do not hang on the last bit of a sum.
PLACES = 12


def _score(hits: np.ndarray, swaps: np.ndarray | int, prefix: np.ndarray, n: int, m: int) -> np.ndarray:
    jaro = (hits / n + hits / m + (hits - swaps) / np.maximum(hits, 1)) / 3
    return jaro + prefix * 0.1 * (1 - jaro)


#: Letters are counted by code point modulo this, which can only raise the bound on what two keys have in common.
FOLD = 128


class Alike:
    """Keys of one length, sorted into groups of at most ``most`` that begin with the same four characters and have the same
    letters, each as often. ``columns``: their code points, a row for each place; ``counts``: of a letter in each group."""

    def __init__(self, keys: list[str], rows: np.ndarray, most: int) -> None:
        points = _codes(keys)
        self.n = points.shape[1]
        start = np.full((len(keys), 4), np.iinfo(np.uint32).max, dtype=np.uint32)
        start[:, : self.n] = points[:, :4]
        letters = np.sort((points % FOLD).astype(np.uint8), axis=1)
        signs = np.concatenate([start.view(np.uint8).reshape(len(keys), -1), letters], axis=1)
        signs = np.ascontiguousarray(signs).view(np.dtype((np.void, signs.shape[1]))).ravel()
        order = np.argsort(signs, kind="stable")
        signs, every = signs[order], np.arange(len(keys))
        first = np.concatenate([[True], signs[1:] != signs[:-1]])
        self.starts = np.flatnonzero((every - np.maximum.accumulate(np.where(first, every, 0))) % most == 0)
        self.sizes = np.diff(np.append(self.starts, len(keys)))
        self.group = np.repeat(np.arange(len(self.starts)), self.sizes)
        high = int(points.max())
        self.rows, self.columns = rows[order], np.ascontiguousarray(points[order].T.astype(np.uint8 if high < 1 << 8 else np.uint16 if high < 1 << 16 else np.uint32))
        at = order[self.starts]
        self.prefix, letters = start[at].T.copy(), letters[at]
        self.counts = {int(c): (letters == c).sum(1).astype(np.uint8 if self.n < 256 else np.uint32) for c in np.unique(letters)}

    def common(self, low: int, high: int, other: Alike) -> tuple[np.ndarray, np.ndarray]:
        """(letters, prefix) that groups low to high can have in common with each group of ``other``."""
        shape = high - low, len(other.starts)
        found, part = np.zeros(shape, dtype=np.uint8 if max(self.n, other.n) < 256 else np.uint32), None
        for c, mine in self.counts.items():
            if c not in other.counts:
                continue
            mine, theirs = mine[low:high], other.counts[c]
            if (mine == mine[0]).all() and (theirs == theirs[0]).all():
                found += min(mine[0], theirs[0])
                continue
            part = np.minimum(mine[:, None], theirs[None, :], out=part, dtype=found.dtype)
            found += part
        so_far = np.ones(shape, dtype=bool)
        prefix = np.zeros(shape, dtype=np.uint8)
        for mine, theirs in zip(self.prefix, other.prefix):
            so_far &= mine[low:high, None] == theirs[None, :]
            prefix += so_far
        return found, prefix


def _similar(a: np.ndarray, x: np.ndarray, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the pairs of columns of ``a`` and ``x`` whose ``jaro_winkler`` reaches ``at_least``.

    Leading characters that two keys share match each other in place, so those that all pairs share are counted and left
    out. All pairs take a step together."""
    (n, pairs), m = a.shape, len(x)
    reach, at = max(max(n, m) // 2 - 1, 0), 0
    while at < min(n, m) and (a[at] == x[at]).all():
        at += 1
    prefix, same = np.zeros(pairs, dtype=np.int64), np.ones(pairs, dtype=bool)
    for i in range(min(4, n, m)):
        same &= a[i] == x[i]
        prefix += same
    free, miss, hit = np.ones((m - at, pairs), dtype=bool), np.ones((n - at, pairs), dtype=bool), np.empty(pairs, dtype=bool)
    for i in range(at, n):
        for j in range(max(at, i - reach), min(m, i + reach + 1)):
            np.equal(x[j], a[i], out=hit)
            hit &= free[j - at]
            hit &= miss[i - at]
            free[j - at] ^= hit
            miss[i - at] ^= hit
    hits = n - miss.sum(0, dtype=np.int64)
    some = np.flatnonzero((hits > 0) & (_score(hits, 0, prefix, n, m) >= at_least - 1e-9))
    # pair by pair, the characters of one key that match and those of the other, each in their own order
    of, mine = np.nonzero(~miss[:, some].T)
    _, theirs = np.nonzero(~free[:, some].T)
    differ = a[at + mine, some[of]] != x[at + theirs, some[of]]
    swaps = np.bincount(of[differ], minlength=len(some)) // 2
    scores = np.round(_score(hits[some], swaps, prefix[some], n, m), PLACES)
    keep = scores >= at_least[some]
    return some[keep], scores[keep]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, places) of the places of each range."""
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) + (starts - np.cumsum(sizes) + sizes)[which]


class Keys:
    """Distinct keys in groups (``Alike``) by length."""

    #: Pairs of groups that are bounded at once, and about how many pairs of keys take a step together.
    BOUNDED, PAIRS = 1 << 20, 1 << 16

    def __init__(self, keys: list[str], most: int = 1024) -> None:
        by_length: dict[int, list[int]] = {}
        for k, key in enumerate(keys):
            by_length.setdefault(len(key), []).append(k)
        self.alike = [Alike([keys[k] for k in rows], np.array(rows), most) for _, rows in sorted(by_length.items())]

    def close_to(self, key: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the keys whose ``jaro_winkler`` with ``key`` is ``least`` or more."""
        return self.best_for(Keys([key]), least, 2.0, None)[1:]

    def best_for(self, keys: Keys, least: float, ties: float, most_length: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of ``keys``, rows, scores) of the pairs that reach ``least`` and come within ``ties`` of the best for the
        key; lengths differ by at most ``most_length``.

        No more characters can match than both have of each, and none need be swapped: a bound that pairs of groups share.
        A key meets the groups from the greatest bound down, and none whose bound is too far below its best so far."""
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for mine in keys.alike:
            others = [x for x in self.alike if most_length is None or abs(x.n - mine.n) <= most_length]
            step = max(1, self.BOUNDED // max(1, sum(len(x.starts) for x in others)))
            for low in range(0, len(mine.starts) if others else 0, step):
                found += self._best(mine, low, min(low + step, len(mine.starts)), others, least, ties)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _best(self, mine: Alike, low: int, high: int, others: list[Alike], least: float, ties: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bounds = []
        for x in others:
            most = np.arange(min(mine.n, x.n) + 1)
            bound = np.stack([_score(most, 0, min(p, mine.n, x.n), mine.n, x.n) for p in range(5)])
            bound[:, 0] = -1.0
            bounds.append(bound)
        levels = np.unique(np.concatenate([b.ravel() for b in bounds]))
        levels = levels[levels >= max(least, 0.0) - 1e-9]
        rank = []
        for x, bound in zip(others, bounds):
            letters, prefix = mine.common(low, high, x)
            ranks = np.where(bound >= max(least, 0.0) - 1e-9, np.searchsorted(levels, bound), len(levels)).astype(np.uint16)
            rank.append(ranks.ravel()[prefix * np.uint32(bound.shape[1]) + letters])
        known = [np.bincount(r.ravel(), minlength=len(levels)) for r in rank]
        offset, last = mine.starts[low], mine.starts[high] if high < len(mine.starts) else len(mine.rows)
        best, found = np.zeros(last - offset), []
        for k in range(len(levels) - 1, -1, -1):
            open_ = levels[k] + ties + 1e-9 >= best
            if not open_.any():
                break
            groups = np.flatnonzero(np.logical_or.reduceat(open_, mine.starts[low:high] - offset))
            for x, r, n in zip(others, rank, known):
                if not n[k]:
                    continue
                u, v = np.nonzero(r[groups] == k)
                u = low + groups[u]
                pairs = np.cumsum(mine.sizes[u] * x.sizes[v])
                cuts = np.searchsorted(pairs, np.arange(self.PAIRS, pairs[-1] if len(pairs) else 0, self.PAIRS))
                for i, j in zip([0, *cuts], [*cuts, len(u)]):
                    if i == j:
                        continue
                    which, left = _ranges(mine.starts[u[i:j]], mine.sizes[u[i:j]])
                    some = open_[left - offset]
                    which, left = v[i:j][which[some]], left[some]
                    of, right = _ranges(x.starts[which], x.sizes[which])
                    if not len(of):
                        continue
                    left = left[of]
                    at, scores = _similar(mine.columns[:, left], x.columns[:, right], np.maximum(least, best[left - offset] - ties - 1e-9))
                    left, right = left[at], right[at]
                    np.maximum.at(best, left - offset, scores)
                    found.append((left, x.rows[right], scores))
        out = []
        for left, right, scores in found:
            keep = scores + ties >= best[left - offset]
            out.append((mine.rows[left[keep]], right[keep], scores[keep]))
        return out


def cascade(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``queries``: id, cls, pset, prop (normalised keys). ``index``: cls, pset, prop, code. Per query the first level that
    has candidates: exact (all three), pset and prop, class and prop, prop alone. One code: matched with the level's
    confidence; several: ambiguous; none: unmapped. Levels look up counted keys, so no join multiplies rows."""
    levels = (("exact", ("cls", "pset", "prop"), 1.0), ("pset_prop", ("pset", "prop"), 0.95), ("class_prop", ("cls", "prop"), 0.9), ("prop", ("prop",), 0.85))
    out = queries
    for name, keys, _ in levels:
        counted = index.groupBy(*keys).agg(F.count_distinct("code").alias(f"n_{name}"), F.min("code").alias(f"c_{name}"))
        out = out.join(counted, list(keys), "left")
    level, status, code, confidence = F.lit("none"), F.lit("unmapped"), F.lit(None).cast("string"), F.lit(0.0)
    for name, _, sure in reversed(levels):
        n = F.col(f"n_{name}")
        level = F.when(n.isNotNull(), name).otherwise(level)
        status = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise(status)
        code = F.when(n == 1, F.col(f"c_{name}")).when(n > 1, F.lit(None)).otherwise(code)
        confidence = F.when(n == 1, F.lit(sure)).when(n > 1, F.lit(0.0)).otherwise(confidence)
    return out.select("id", level.alias("level"), status.alias("status"), code.alias("code"), confidence.alias("confidence"))


#: Keys of a part of a block of the fuzzy join: those asked for, and those of the index. A task compares two parts.
FUZZY_ASKED, FUZZY_KNOWN = 1 << 14, 1 << 18


def _compared(least: float, ties: float, most_length: int):
    """Two parts: a row for each key, with the keys that reach ``least`` and come within ``ties`` of the best that the part
    has for it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, known = left.column("key").combine_chunks(), right.column("key").combine_chunks()
        if len(asked) and len(known):
            rows, others, scores = Keys(known.to_pylist()).best_for(Keys(asked.to_pylist(), 64), least, ties, most_length)
        else:
            rows, others, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        order = np.argsort(rows, kind="stable")
        rows, others, scores = rows[order], others[order], scores[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        close = pa.StructArray.from_arrays([known.take(pa.array(others)), pa.array(scores)], ["other", "score"])
        close = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), close)
        best = np.maximum.reduceat(scores, starts) if len(starts) else scores
        cls = left.column("cls")[0].as_py() if left.num_rows else None
        return pa.table({"cls": pa.array([cls] * len(starts), pa.string()), "key": asked.take(pa.array(rows[starts])).cast(pa.string()), "best": pa.array(best, pa.float64()), "close": close.cast(pa.list_(pa.struct([("other", pa.string()), ("score", pa.float64())])))})

    return run


def _close(keys: DataFrame, index: DataFrame, least: float, ties: float, most_length: int) -> DataFrame:
    """(cls, key, close) of distinct keys: an array of (other, score), see ``close_keys``."""
    first = lambda df: df.where("cls IS NOT NULL AND key <> ''").select("cls", "key", F.substring("key", 1, 1).alias("first")).distinct()
    left, right = first(keys), first(index)
    parts = lambda df, most, name: df.groupBy("cls", "first").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = parts(left, FUZZY_ASKED, "ln").join(parts(right, FUZZY_KNOWN, "rn"), ["cls", "first"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    left = left.join(blocks, ["cls", "first"]).select("cls", "key", "first", own("ln").alias("i"), every("rn").alias("j"))
    right = right.join(blocks, ["cls", "first"]).select("cls", "key", "first", every("ln").alias("i"), own("rn").alias("j"))
    at = ["cls", "first", "i", "j"]
    # a number of partitions that is asked for stays: a few rows are much work, and would be put together into one task
    n = max(64, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = left.repartition(n, *at).groupBy(*at).cogroup(right.repartition(n, *at).groupBy(*at))
    scored = sides.applyInArrow(_compared(least, ties, most_length), "cls string, key string, best double, close array<struct<other string, score double>>")
    best = F.max("best").over(Window.partitionBy("cls", "key"))
    return scored.select("cls", "key", "close", best.alias("best")).select("cls", "key", F.filter("close", lambda x: x["score"] + ties >= F.col("best")).alias("close"))


def close_keys(keys: DataFrame, index: DataFrame, least: float = 0.94, ties: float = 0.02, most_length: int = 3) -> DataFrame:
    """(cls, key, other, score): for each distinct key of ``keys`` (cls, key) those of ``index`` (cls, key) in the same block
    (class and first character), of a length that differs by at most ``most_length``, with a similarity of ``least`` or more
    and within ``ties`` of the key's best.

    Each side of a block is cut into parts of about FUZZY_ASKED and FUZZY_KNOWN keys; a part meets every part of the other
    side, so a block that holds everything is as many tasks as it needs, and a pair is met once. Within two parts, keys meet
    by groups of the same letters, and only groups whose bound can still reach what a key's best asks for (``Keys``)."""
    return _close(keys, index, least, ties, most_length).select("cls", "key", F.inline("close"))


#: Values in a list of ``_lists``.
LIST = 1024


def _lists(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): arrays of at most LIST structs of ``value``, as many as it takes."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1) / LIST)
    return rows.select(*by, value, at.alias("_at")).groupBy(*by, "_at").agg(F.collect_list(F.struct(value)).alias(value)).drop("_at")


def fuzzy(queries: DataFrame, index: DataFrame, least: float = 0.94, ties: float = 0.02, most_length: int = 3, places: int | None = None) -> DataFrame:
    """id, code, score (rounded to ``places``, if given) of each query's best candidates (see ``close_keys``). ``queries``:
    id, cls, key; ``index``: cls, key, code. Distinct keys are compared once, whatever the number of queries that share one.
    A code that several keys of the index lead to counts with its best score.

    Pairs of keys meet lists of ids and of codes, which are expanded last, so that a row costs little more than itself.
    Rows can only repeat for an id that comes with several keys, and scores only differ for a code that does: without such,
    rows are not compared with each other."""
    queries = queries.select("id", "cls", "key").distinct()
    known = index.select("cls", F.col("key").alias("other"), "code").distinct()
    several = lambda df, *by: not df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    close, ids = _close(queries, index, least, ties, most_length), _lists(queries, ["cls", "key"], "id")
    rounded = lambda df: df if places is None else df.withColumn("score", F.round("score", places))
    if several(known, "cls", "code"):
        coded = rounded(close.select("cls", "key", F.inline("close"))).join(known, ["cls", "other"])
        coded = coded.groupBy("cls", "key", "code").agg(F.max("score").alias("score"))
        found = ids.join(coded, ["cls", "key"]).select(F.inline("id"), "code", "score")
    else:
        pairs = rounded(close.join(ids, ["cls", "key"]).select("cls", "id", F.inline("close")))
        found = pairs.join(_lists(known, ["cls", "other"], "code"), ["cls", "other"]).select(F.inline("id"), "code", "score").select("id", F.inline("code"), "score")
    return found.distinct() if several(queries, "id") else found


@dataclass(frozen=True)
class Profile:
    """Aliases (normalised key to name) of classes, property sets and properties, of properties within a set, of classes
    within a schema; codes set by hand for ``class|set|property`` or ``schema|class|set|property``; the fuzzy rung."""

    name: str = ""
    class_aliases: dict[str, str] = field(default_factory=dict)
    set_aliases: dict[str, str] = field(default_factory=dict)
    prop_aliases: dict[str, str] = field(default_factory=dict)
    set_prop_aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    schema_class_aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    hard: dict[str, str] = field(default_factory=dict)
    fuzzy: bool = True
    least: float = 0.94
    scope: str = "class"  # or set, or never

    def over(self, base: Profile) -> Profile:
        """This profile on top of ``base``: its entries win, key by key; its fuzzy rung too where it sets one."""
        nested = lambda low, high: {k: low.get(k, {}) | high.get(k, {}) for k in low | high}
        rung = self if self.least != Profile.least or not self.fuzzy else base
        return Profile(
            self.name or base.name, base.class_aliases | self.class_aliases, base.set_aliases | self.set_aliases, base.prop_aliases | self.prop_aliases,
            nested(base.set_prop_aliases, self.set_prop_aliases), nested(base.schema_class_aliases, self.schema_class_aliases), base.hard | self.hard, rung.fuzzy, rung.least, rung.scope,
        )


def inherited(profiles: dict[str, tuple[Profile, str | None]], name: str) -> Profile:
    """The profile with all it extends under it; ``profiles``: name to (profile, name of what it extends)."""
    chain: list[Profile] = []
    seen: set[str] = set()
    at: str | None = name
    while at is not None:
        if at in seen or at not in profiles:
            raise ValueError(f"profile {at} {'extends itself' if at in seen else 'is unknown'}")
        seen.add(at)
        own, at = profiles[at]
        chain.append(own)
    out = chain.pop()
    while chain:
        out = chain.pop().over(out)
    return replace(out, name=profiles[name][0].name or name)


def surfaces(c: Column, segments: bool) -> Column:
    """array<string> of the forms of a name: trimmed; with single colons; without the prefix that some programs write; and
    with ``segments`` also what follows the last separator, and the first space, of each of these."""
    plain = trim_unicode(c)
    compact = F.replace(plain, F.lit("::"), F.lit(":"))
    head, tail = F.substring_index(compact, " ", 1), trim_unicode(F.when(F.instr(compact, " ") > 0, F.substring(compact, F.instr(compact, " ") + 1, F.length(compact))))
    # The starts of such prefixes.
    prefixed = norm_key(head).startswith("bsdpset") | norm_key(head).startswith("psetrevit")
    forms = F.array(plain, compact, F.when(prefixed, tail))
    if segments:
        after = lambda x: [trim_unicode(F.substring_index(x, sep, -1)) for sep in (":", "/", "\\", "|")] + [trim_unicode(F.when(F.instr(x, " ") > 0, F.substring(x, F.instr(x, " ") + 1, F.length(x))))]
        forms = F.concat(forms, F.flatten(F.transform(forms, lambda x: F.array(*after(x)))))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def variants(c: Column, *aliases: Column, segments: bool = False) -> Column:
    """array<string> of distinct normalised keys, best first: those of the aliases (null: none), then of the name."""
    names = F.filter(F.array(*aliases, c), lambda x: x.isNotNull())
    return F.array_distinct(F.filter(F.flatten(F.transform(names, lambda n: F.transform(surfaces(n, segments), norm_key))), lambda x: x != ""))


def keyed(queries: DataFrame, profile: Profile) -> DataFrame:
    """``queries`` (schema, cls, pset, prop) with arrays of variants _c, _s, _p."""
    scoped = {f"{s}|{k}": v for s, names in profile.set_prop_aliases.items() for k, v in names.items()}
    by_schema = {f"{s}|{k}": v for s, names in profile.schema_class_aliases.items() for k, v in names.items()}
    key = lambda c: norm_key(F.col(c))
    rows = queries.withColumn("_s", variants(F.col("pset"), lookup(profile.set_aliases, key("pset"))))
    rows = rows.withColumn("_c", variants(F.col("cls"), lookup(profile.class_aliases, key("cls")), lookup(by_schema, F.concat_ws("|", "schema", key("cls")))))
    set_key = F.coalesce(F.get("_s", F.lit(0)), F.lit(""))
    return rows.withColumn("_p", variants(F.col("prop"), lookup(profile.prop_aliases, key("prop")), lookup(scoped, F.concat_ws("|", set_key, key("prop"))), segments=True))


def ladder(queries: DataFrame, index: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """``queries`` with status, method, code, candidates (sorted array of codes of an ambiguous match) and confidence.

    ``queries``: any columns, with schema, cls, pset and prop as they are written; ``index``: cls, pset, prop (normalised)
    and code. The first rung with candidates decides: codes set by hand and exact keys (the first variant that has one),
    set and property, class and property, property, and close properties of the class. One code: mapped or normalized;
    several: ambiguous; none at all: unmapped. Distinct keys are resolved once, whatever the number of their rows; they, and
    what the rungs before the last find, are checkpointed."""
    names = ["schema", "cls", "pset", "prop"]
    text = queries.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in names])
    keys = text.select(*[F.col(f"_{c}").alias(c) for c in names]).distinct().withColumn("_id", F.sha1(F.to_json(F.struct(*names))))
    with_checkpoints(queries.sparkSession)
    keys = keyed(keys, profile).checkpoint()  # every rung reads them
    crossed = lambda df, *arrays: _positions(df, arrays)
    exact = crossed(keys.select("_id", "schema", "_c", "_s", "_p"), "_c", "_s", "_p")
    rungs = []
    hard = lookup(profile.hard, F.concat_ws("|", F.lower("schema"), "_c", "_s", "_p")), lookup(profile.hard, F.concat_ws("|", "_c", "_s", "_p"))
    rows = exact.withColumn("_hard", F.coalesce(*hard)).join(index.groupBy("cls", "pset", "prop").agg(F.min("code").alias("code")), [exact["_c"] == F.col("cls"), exact["_s"] == F.col("pset"), exact["_p"] == F.col("prop")], "left")
    rows = rows.where("_hard IS NOT NULL OR code IS NOT NULL").groupBy("_id").agg(F.min_by(F.struct(F.coalesce("_hard", "code").alias("code"), F.when(F.col("_hard").isNotNull(), "hard_override").otherwise("exact_class_pset_prop").alias("method")), "_at").alias("r"))
    rungs.append(rows.select("_id", F.lit(1).alias("rung"), F.array("r.code").alias("codes"), F.col("r.method").alias("method"), F.lit(1.0).alias("sure")))
    for rung, (name, used, sure) in enumerate((("pset_prop", ("_s", "_p"), 0.95), ("class_prop", ("_c", "_p"), 0.9), ("prop", ("_p",), 0.85)), 2):
        real = {"_c": "cls", "_s": "pset", "_p": "prop"}
        some = crossed(keys.select("_id", *used), *used)
        hits = some.join(index.select(*[F.col(real[u]).alias(u) for u in used], "code").distinct(), list(used))
        rungs.append(hits.groupBy("_id").agg(F.sort_array(F.collect_set("code")).alias("codes")).select("_id", F.lit(rung).alias("rung"), "codes", F.lit(name).alias("method"), F.lit(sure).alias("sure")))
    found = rungs[0]
    for r in rungs[1:]:
        found = found.union(r)
    found = found.groupBy("_id").agg(F.min_by(F.struct("rung", "codes", "method", "sure"), "rung").alias("r")).checkpoint()
    if profile.fuzzy and profile.scope != "never":
        found = found.union(_fuzzy_rung(keys.join(found, "_id", "left_anti"), index, profile))
    one, at = F.size("r.codes") == 1, F.col("r.rung")
    method = F.when(at == 1, F.col("r.method")).when(at == 5, F.when(one, "fuzzy").otherwise("fuzzy_ambiguous")).otherwise(F.concat(F.when(one, "normalized_").otherwise("ambiguous_"), F.col("r.method")))
    status = F.when(at.isNull(), "unmapped").when(~one, "ambiguous").when(at == 1, "mapped").otherwise("normalized")
    none = F.array().cast("array<string>")
    done = keys.select(*names, "_id").join(found, "_id", "left").select(
        *[F.col(c).alias(f"_{c}") for c in names], status.alias("status"), F.coalesce(method, F.lit("unmapped")).alias("method"), F.when(one, F.get("r.codes", F.lit(0))).alias("code"),
        F.when(~one, F.col("r.codes")).otherwise(none).alias("candidates"), F.when(one, F.col("r.sure")).alias("confidence"),
    )
    return text.join(done, [f"_{c}" for c in names]).drop(*[f"_{c}" for c in names])


def _positions(df: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    """A row for every combination of the arrays' elements, with _at: its place in their order."""
    at = F.lit(0)
    for a in arrays:
        rest = [c for c in df.columns if c != a and c != "_at"]
        df = df.withColumn("_at", at).select(*rest, "_at", F.posexplode(a).alias("_n", a))
        df = df.withColumn("_at", F.col("_at") * 1000 + F.col("_n")).drop("_n")
        at = F.col("_at")
    return df


def _fuzzy_rung(keys: DataFrame, index: DataFrame, profile: Profile) -> DataFrame:
    """The rung of close properties, in the scope of the first class (or set) variant: the first property variant that has
    any decides; its codes within the ties of the best."""
    scope, column = ("_s", "pset") if profile.scope == "set" else ("_c", "cls")
    asked = _positions(keys.select("_id", F.get(scope, F.lit(0)).alias("cls"), "_p"), ("_p",)).withColumnRenamed("_p", "key")
    known = index.select(F.col(column).alias("cls"), F.col("prop").alias("key"), "code")
    close = close_keys(asked, known, profile.least).join(known.select("cls", F.col("key").alias("other"), "code").distinct(), ["cls", "other"])
    close = close.groupBy("cls", "key").agg(F.max("score").alias("sure"), F.sort_array(F.collect_set("code")).alias("codes"))
    rows = asked.join(close, ["cls", "key"])
    return rows.groupBy("_id").agg(F.min_by(F.struct(F.lit(5).alias("rung"), "codes", F.lit("fuzzy").alias("method"), "sure"), "_at").alias("r"))


def resolve_classes(names: DataFrame, classes: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(name, code) of ``names`` (name): the first variant that ``classes`` (key normalised, code) has, then the name with
    and without IFC before it; null if none. Distinct names are resolved once."""
    asked = names.select("name").distinct()
    bare = F.regexp_replace(F.upper(trim_unicode(F.col("name"))), "^IFC", "")
    forms = F.concat(variants(F.col("name"), lookup(profile.class_aliases, norm_key(F.col("name")))), F.array(norm_key(F.col("name")), norm_key(F.concat(F.lit("IFC"), bare))))
    rows = _positions(asked.select("name", F.array_distinct(forms).alias("key")), ("key",)).join(classes.select("key", "code"), "key")
    return asked.join(rows.groupBy("name").agg(F.min_by("code", "_at").alias("code")), "name", "left")


def histogram(matches: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` unmapped ``pset|prop`` by rows, then by name."""
    rows = matches.where("status = 'unmapped'").groupBy(F.concat_ws("|", "pset", "prop").alias("key")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "key").limit(top)


def score(matches: DataFrame, places: int = 3) -> DataFrame:
    """One row: shares of mapped, normalized, ambiguous and unmapped rows, and of fuzzy ones the least, mean and greatest
    confidence; the mean confidence of all that have one."""
    share = lambda s: F.round(F.avg((F.col("status") == s).cast("int")), places).alias(s)
    close = F.when(F.col("method") == "fuzzy", F.col("confidence"))
    return matches.agg(F.count("*").alias("rows"), *[share(s) for s in ("mapped", "normalized", "ambiguous", "unmapped")], F.round(F.avg("confidence"), places).alias("confidence"), F.round(F.min(close), places).alias("fuzzy_min"), F.round(F.avg(close), places).alias("fuzzy_avg"), F.round(F.max(close), places).alias("fuzzy_max"))


def build_index(entries: DataFrame) -> DataFrame:
    """(scope, key, codes, n) of ``entries`` (cls, pset, prop, code as written): sorted distinct codes for each normalised
    key of the four scopes."""
    c, s, p = norm_key(F.col("cls")), norm_key(F.col("pset")), norm_key(F.col("prop"))
    scopes = F.array(*[F.struct(F.lit(n).alias("scope"), F.concat_ws("|", *k).alias("key")) for n, k in (("exact", (c, s, p)), ("pset_prop", (s, p)), ("class_prop", (c, p)), ("prop", (p,)))])
    rows = entries.select("code", F.explode(scopes).alias("k")).groupBy("k.scope", "k.key").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return rows.select("scope", "key", "codes", F.size("codes").alias("n"))


def inspect(index: DataFrame, scope: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows of an index of one scope whose key holds a piece of text; without either, a summary by scope."""
    if scope is None and contains is None:
        return index.groupBy("scope").agg(F.count("*").alias("keys"), F.sum((F.col("n") > 1).cast("int")).cast("long").alias("ambiguous"))
    rows = index if scope is None else index.where(F.col("scope") == scope)
    return rows if contains is None else rows.where(F.col("key").contains(contains))


def statistics(matches: DataFrame) -> DataFrame:
    total = matches.agg(F.count("*").alias("total"))
    return matches.groupBy("status", "level").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("status", "level", "n", F.round(F.col("n") / F.col("total"), 3).alias("ratio"))
