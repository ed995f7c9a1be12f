"""Secret scans by sliding-window Shannon entropy, in DataFrame functions only.

Base rules are three patterns. Beside them, every run of 20 (WINDOW) or more key characters is a candidate string. A window of 20
characters slides over it for each character class (hexadecimal, base 64); counts per character are kept up incrementally:
one character enters, one leaves, two counts change, and ``sum c*log2(c)`` changes by the terms of those two. A candidate that
has a window of the class's threshold is a span, unless the allow list knows it.

Time is linear in the text: counts are five bits each in a few longs, long candidates are cut into overlapping pieces (each
window lies in one of them) and judged up to the first piece with a window that reaches the threshold, running sums go by
blocks, and no pattern repeats a group without being possessive, so none recurses or backtracks over a long string.

Null and empty texts have no spans. Equal rows give equal rows. Texts of any length are scanned whole. Columns of the
input other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same runs with their least lengths inside the pattern: a run's later starts are shorter, so nothing else matches.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidate strings of the entropy method.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Alphabet of each class, and the bits a character that its windows must reach: a random window of 20 characters has
#: about 3.5 bits of 16 symbols and 4.1 of 64.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.0), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.6)}
#: A word of fewer letters than a window, in one case, capitalised or in camel case, or a number.
PIECE = r"(?:[A-Z]?[a-z]{2,18}+(?:[A-Z][a-z]{2,18}+)*+|[A-Za-z]{1,2}|[A-Z]{3,19}|[0-9]++)"
#: Keys in dash-joined groups of one length: with a digit, or all in capitals.
GROUPS = "(?:" + "|".join(rf"[A-Za-z0-9]{{{n}}}(?:-[A-Za-z0-9]{{{n}}}){{2,}}+" for n in range(4, 9)) + ")"
#: Whole strings that look random and are not secret: UUIDs, words and numbers joined by - _ / + or = (dates too), numbers,
#: one repeated short unit, and placeholders. Other strings without a digit are judged by their entropy, as all are.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]++$",
    rf"^(?!(?=.*[0-9]|[^a-z]*+$)(?=.*[A-Za-z]){GROUPS}$)[-_/=+]*+(?:{PIECE}(?:[-_/=+]++|$))*+$",
    r"^(.{1,6}?)\1+.{0,6}$",
    r"(?i)^[-_/=+]*+(?:(?:example|placeholder|changeme|dummy|lorem)[0-9]{0,4}+[-_/=+]*+)++$",
)
#: Characters of a piece of a candidate, or of a text that is redacted; elements of a block of a running sum.
PART, BLOCK = 4096, 64
#: Counts are at most WINDOW, so five bits hold one, and a long holds twelve.
BITS, PER_LONG = 5, 12


def states(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for every element of ``items``, what ``step`` made of 0 and the elements before it. Elements go in blocks,
    as each step copies its state: first the states at the starts of blocks, then those inside."""
    none = F.array().cast("array<int>")
    after = lambda acc, state: F.struct(state.alias("state"), F.array_append(acc["own"], acc["state"]).alias("own"))
    start = lambda state: F.struct(state.alias("state"), none.alias("own"))
    blocks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda b: F.slice(items, b + 1, F.lit(BLOCK)))
    starts = F.aggregate(blocks, start(F.lit(0)), lambda acc, xs: after(acc, F.aggregate(xs, acc["state"], step)), lambda acc: acc["own"])
    inside = lambda at, xs: F.aggregate(xs, start(at), lambda acc, x: after(acc, step(acc["state"], x)), lambda acc: acc["own"])
    return F.when(F.size(items) > 0, F.flatten(F.zip_with(starts, blocks, inside))).otherwise(none)


MATCH = "struct<s:int,e:int,m:string>"


def found(rows: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """``rows`` with, for each name, array<MATCH> of the pattern's leftmost non-overlapping matches, s and e in code points,
    e exclusive.

    Spark has no function for match positions; the lengths of the texts between matches, by ``split`` at the same pattern,
    give them: a match starts after all gaps and matches before it."""
    rows = rows.withColumns({f"_hits_{n}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    gap = lambda n, p: F.when(F.size(f"_hits_{n}") > 0, F.zip_with(F.slice(F.split(text, p, -1), 1, F.size(f"_hits_{n}")), F.col(f"_hits_{n}"), lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("n"), m.alias("m"))))
    rows = rows.withColumns({f"_pairs_{n}": gap(n, p) for n, p in patterns.items()})
    rows = rows.withColumns({f"_at_{n}": states(F.col(f"_pairs_{n}"), lambda at, x: at + x["gap"] + x["n"]) for n in patterns})
    match = lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["m"].alias("m"))
    rows = rows.withColumns({n: F.when(F.size(f"_hits_{n}") > 0, F.zip_with(f"_pairs_{n}", f"_at_{n}", match)).otherwise(F.array().cast(f"array<{MATCH}>")) for n in patterns})
    return rows.drop(*[f"_{x}_{n}" for x in ("hits", "pairs", "at") for n in patterns])


def _entering(count: int) -> float:
    """What the sum of c*log2(c) gains when a count rises from ``count``."""
    return (count + 1) * math.log2(count + 1) - (count * math.log2(count) if count else 0.0)


def least_sum(piece: Column, alphabet: str) -> Column:
    """The least sum of c*log2(c) over the counts c of any window of ``piece``, whose characters are all in ``alphabet``;
    1e9 if it is shorter than a window. State: the counts, the sum, the least sum so far."""
    longs = -(-len(alphabet) // PER_LONG)
    # a character's place: its long, the first bit of its count there, and a one at that bit
    place = lambda c: F.instr(F.lit(alphabet), c) - 1
    coded = F.transform(F.split(piece, ""), lambda c: F.struct(F.floor(place(c) / PER_LONG).cast("int").alias("w"), (place(c) % PER_LONG * BITS).alias("b")))
    none = F.lit(None).cast("struct<w:int,b:int>")
    rises = F.array(*[F.lit(_entering(c)) for c in range(WINDOW + 1)])

    def count(acc: Column, at: Column) -> Column:
        word = acc["w0"]
        for k in range(1, longs):
            word = F.when(at["w"] == k, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, at["b"]).bitwiseAND((1 << BITS) - 1).cast("int")

    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["b"])

    def leave(acc: Column, old: Column) -> list[Column]:
        changed = [F.when(old["w"] == k, acc[f"w{k}"] - one(old)).otherwise(acc[f"w{k}"]).alias(f"w{k}") for k in range(longs)]
        return [*changed, (acc["total"] - F.get(rises, count(acc, old) - 1)).alias("total"), acc["best"].alias("best")]

    def enter(acc: Column, new: Column, full: Column) -> Column:
        changed = [F.when(new["w"] == k, acc[f"w{k}"] + one(new)).otherwise(acc[f"w{k}"]).alias(f"w{k}") for k in range(longs)]
        total = acc["total"] + F.get(rises, count(acc, new))
        return F.struct(*changed, total.alias("total"), F.when(full, F.least(acc["best"], total)).otherwise(acc["best"]).alias("best"))

    # each character twice: it enters a window, after the one WINDOW places before it has left
    def step(acc: Column, x: Column) -> Column:
        gone = F.when(x["old"].isNotNull(), F.struct(*leave(acc, x["old"]))).otherwise(acc)
        return F.element_at(F.transform(F.array(gone), lambda a: enter(a, x["new"], x["full"])), 1)

    start = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(longs)], F.lit(0.0).alias("total"), F.lit(1e9).alias("best"))
    moves = lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(cs, i - WINDOW)).otherwise(none).alias("old"), (i >= WINDOW - 1).alias("full")))
    return F.element_at(F.transform(F.array(coded), lambda cs: F.aggregate(moves(cs), start, step, lambda acc: acc["best"])), 1)


def _pieces(string: Column) -> Column:
    """Parts of ``string`` that overlap, so that each of its windows lies in one of them."""
    return F.regexp_extract_all(string, F.lit(rf"(?=(.{{1,{PART + WINDOW - 1}}}+)).{{1,{PART}}}+"), F.lit(1))


def _entropy(piece: Column, alphabet: str) -> Column:
    return F.lit(math.log2(WINDOW)) - least_sum(piece, alphabet) / WINDOW


def _fits(string: Column, alphabet: str) -> Column:
    return string.rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]++$") & (F.char_length(string) >= WINDOW)


def window_entropy(string: Column, alphabet: str) -> Column:
    """The largest Shannon entropy, in bits, of a window of WINDOW characters of ``string``; null if it is shorter or has
    a character outside ``alphabet``."""
    return F.when(_fits(string, alphabet), F.array_max(F.transform(_pieces(string), lambda p: _entropy(p, alphabet))))


def reaches(string: Column, alphabet: str, least: float) -> Column:
    """Whether ``window_entropy`` is ``least`` or more; looks no further than the first part where it is."""
    return _fits(string, alphabet) & F.exists(_pieces(string), lambda p: _entropy(p, alphabet) >= least)


def allowed(string: Column) -> Column:
    out = F.lit(False)
    for pattern in reversed(ALLOW):
        out = F.when(string.rlike(pattern), True).otherwise(out)
    return out


def _in_class(string: Column, k: Column) -> Column:
    out = F.lit(False)
    for n, (alphabet, least) in enumerate(CLASSES.values()):
        out = F.when(k == n, reaches(string, alphabet, least)).otherwise(out)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, text_col, ``base`` and ``spans``: array<struct<s, kind, e>>, sorted by start and kind.

    kind is the index in KINDS. Base spans: ``assign`` needs a value of 6 or more characters, ``access`` 20, ``hex`` 24,
    judged after matching. Entropy spans that coincide with or lie within a base span add nothing and are left out."""
    tag = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    rows = found(docs.select(F.col(id_col), F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")), {"_a": ASSIGN, "_k": LONG_ACCESS, "_h": LONG_HEX, "_c": CANDIDATE})
    rows = rows.withColumn("_a", F.filter("_a", lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6))
    rows = rows.withColumn("base", F.sort_array(F.concat(tag(F.col("_a"), 0), tag(F.col("_k"), 1), tag(F.col("_h"), 2))))
    # in order of starts, base spans first: a candidate lies within one of those before it if any ends as late
    rows = rows.withColumn("_all", F.when(F.size("_c") > 0, F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"], x["kind"], x["e"], F.lit("").alias("m"))), F.transform("_c", lambda x: F.struct(x["s"], F.lit(3).alias("kind"), x["e"], x["m"]))))))
    rows = rows.withColumn("_ends", states(F.col("_all"), lambda end, x: F.when((x["kind"] < 3) & (x["e"] > end), x["e"]).otherwise(end)))
    rows = rows.withColumn("_more", F.filter("_all", lambda x, k: (x["kind"] == 3) & (x["e"] > F.get("_ends", k))))
    # a filter of its own first, so that only strings outside the allow list pay for the windows
    more = F.filter(F.filter("_more", lambda x: ~allowed(x["m"])), lambda x: F.exists(F.array(*[F.lit(k) for k in range(len(CLASSES))]), lambda k: _in_class(x["m"], k)))
    rows = rows.withColumn("_more", F.when(F.size("_more") > 0, tag(more, 3)))
    spans = F.when(F.size("_more") > 0, F.sort_array(F.concat("base", "_more"))).otherwise(F.col("base"))
    return rows.withColumn("spans", spans).select(id_col, text_col, "base", "spans")


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark``; overlapping spans become one mark. All other columns and
    rows stay; a text without spans stays as it is, null included. Texts are rebuilt part by part, each from the spans that
    reach into it."""
    names = docs.columns
    box = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = scan(box.withColumn("_pair", F.struct("_id", "_row")), "_pair", "_text")
    # what a span covers beyond those before it, and whether it starts a mark of its own
    rows = rows.withColumn("_ends", states(F.col("spans"), lambda end, x: F.greatest(end, x["e"])))
    cut = lambda x, end: F.struct(F.greatest(x["s"], end).alias("s"), x["e"].alias("e"), (x["s"] >= end).alias("new"))
    rows = rows.withColumn("_cuts", F.filter(F.zip_with("spans", "_ends", cut), lambda x: x["new"] | (x["e"] > x["s"])))
    rows = rows.withColumn("_parts", F.when(F.size("_cuts") > 0, F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{PART}}}+"), F.lit(0))))

    def rebuilt(part: Column, k: Column) -> Column:
        low = k * PART
        own = F.filter("_cuts", lambda x: (x["s"] < low + PART) & (x["e"] > low))

        def step(acc: Column, x: Column) -> Column:
            start, end = F.greatest(x["s"] - low, F.lit(0)), F.least(x["e"] - low, F.lit(PART))
            text = F.concat(acc["out"], F.substring(part, acc["at"] + 1, start - acc["at"]), F.when(x["new"] & (x["s"] >= low), mark).otherwise(""))
            return F.struct(end.alias("at"), text.alias("out"))

        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] + 1, F.lit(PART))))

    new = F.when(F.size("_cuts") > 0, F.array_join(F.transform("_parts", rebuilt), "")).otherwise(F.col("_text"))
    return rows.select(*[(new if c == text_col else F.col("_pair._row")[c]).alias(c) for c in names])


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op10_entropy_secrets": op10_entropy_secrets}
