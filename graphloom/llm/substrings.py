"""Substring deduplication by level-wise doubling.

Lengths double up to the window's: 13, 25, 50 for windows of 50 words. At each length only those windows are looked at that
were repeated at the length before, and when none survives the search ends. Of a window's parts of a level's length one is
enough to look at, and the least by hash (its *anchor*) is taken: equal windows take the same one, so nothing is lost, and
few positions are sent instead of all. What is repeated at the full length alone is covered.

Documents are dealt into parts by a hash of their id, of ``PART_BYTES`` of text at most on average. Each level is one packed
exchange (see ``exchange``): a part sends each of its distinct anchors, at last windows, once, with the least doc_id it has
it in; the bucket answers with what is repeated, and the least doc_id of all. So a passage in a third of all documents costs
a bucket one entry for each part.

Windows are compared by 63-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialize, shuffle_partitions, table
from graphloom.llm.exchange import mix, release, split_sorted, windows, word_hashes

LOW = np.uint64(1)
#: The least length that is looked at first is more than half of this, or the window's own.
SHORTEST = 16
PART_BYTES = 16 << 20


def levels(window: int) -> list[int]:
    """The lengths that are looked at, each at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out
SENT = "bucket int, part int, hashes binary, docs binary"
ANSWER = "part int, hashes binary, docs binary"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def even(hashes: np.ndarray) -> np.ndarray:
    """The lowest bit is kept for a mark."""
    return hashes & ~LOW


def anchors(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """Of every window, the least of its parts of ``length`` words; mixed once more, as least values are no even spread."""
    return even(mix(sliding_least(windows(words, length), window - length + 1)))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _first(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, sorted; the least document of each; whether it has others."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    last = docs[np.r_[at[1:], len(docs)] - 1] if len(at) else docs[:0]
    return hashes[at], docs[at], last > docs[at]


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


SENT_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])
ANSWER_ARROW = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])


def _packed(got: list[tuple[np.ndarray, int]], buckets: int) -> pa.RecordBatch:
    """Distinct (anchor, part), by bucket; ``docs`` holds the part of each anchor as int32. An anchor that comes from two
    documents of one part is marked in its lowest bit."""
    h = np.concatenate([x for x, _ in got])
    p = np.concatenate([np.full(len(x), part, dtype=np.int32) for x, part in got])
    order = np.lexsort((p, h))
    h, p = h[order], p[order]
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]) if len(h) else np.empty(0, dtype=np.int64)
    many = np.diff(np.r_[at, len(h)]) > 1
    h, p = h[at] | many.astype(np.uint64), p[at]
    cut = split_sorted(h, buckets)
    return _batch({"bucket": [b for b, _, _ in cut], "part": [0] * len(cut), "hashes": [h[i:j].tobytes() for _, i, j in cut], "docs": [p[i:j].tobytes() for _, i, j in cut]}, SENT_ARROW)


def _send_first(window: int, length: int, buckets: int, most: int = 1_000_000):
    """The first level: the anchors of every window of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for text, part in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                words = word_hashes(text.as_py() or b"")
                if len(words) >= window:
                    got.append((np.unique(anchors(words, window, length)), part))
                    held += len(got[-1][0])
                if held >= most:
                    yield _packed(got, buckets)
                    got, held = [], 0
                    release()
        if got:
            yield _packed(got, buckets)
        got.clear()
        release()

    return run


def _surviving(docs: pa.Table, answers: pa.Table, window: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, its word hashes, which of its windows have a repeated anchor of ``length``) of the documents of a part
    that have any."""
    repeated = np.sort(np.frombuffer(b"".join(answers.column("hashes").to_pylist()), dtype=np.uint64))
    if not len(repeated):
        return
    for chunk in docs.to_batches():
        for doc, text in zip(chunk.column("id").to_pylist(), chunk.column("text").cast(pa.binary())):
            words = word_hashes(text.as_py() or b"")
            if len(words) >= window:
                keep = member(anchors(words, window, length), repeated)
                if keep.any():
                    yield doc, words, keep


def _send_next(window: int, before: int, length: int, buckets: int):
    """A further level, for one part: the anchors of the windows that survived the level ``before``."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        got = [(np.unique(anchors(words, window, length)[keep]), 0) for _, words, keep in _surviving(docs, answers, window, before)]
        if not got:
            return SENT_ARROW.empty_table()
        part = docs.column("part")[0].as_py()
        return pa.Table.from_batches([_packed([(x, part) for x, _ in got], buckets)])

    return run


def _answer_anchors(t: pa.Table) -> pa.Table:
    """A bucket of level 1: to each part, those of its anchors that are marked or come from several parts or tasks."""
    h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), dtype=np.uint64)
    p = np.frombuffer(b"".join(t.column("docs").to_pylist()), dtype=np.int32)
    order = np.argsort(h, kind="stable")
    h, p = h[order], p[order]
    value, mark = even(h), (h & LOW).astype(bool)
    at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    group = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1
    keep = ((np.diff(np.r_[at, len(h)]) > 1) | np.bitwise_or.reduceat(mark, at))[group]
    value, p = value[keep], p[keep]
    order = np.lexsort((value, p))
    value, p = value[order], p[order]
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
    ends = [*at[1:], len(p)] if len(p) else []
    return pa.table({"part": pa.array([int(p[i]) for i in at], pa.int32()), "hashes": pa.array([np.unique(value[i:j]).tobytes() for i, j in zip(at, ends)], pa.binary()), "docs": pa.array([b""] * len(at), pa.binary())})


def _answer_windows(t: pa.Table) -> pa.Table:
    """A bucket of level 2: to each part, its windows that a smaller document has elsewhere, or several of its own have,
    with the least document of all."""
    parts = t.column("part").to_numpy()
    blobs = t.column("hashes").to_pylist()
    h = np.frombuffer(b"".join(blobs), dtype=np.uint64)
    d = np.frombuffer(b"".join(t.column("docs").to_pylist()), dtype=np.int64)
    p = np.repeat(parts, [len(x) // 8 for x in blobs])
    value, mark = even(h), (h & LOW).astype(bool)
    order = np.lexsort((d, value))
    value, mark, d, p = value[order], mark[order], d[order], p[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.empty(0, dtype=bool)
    owner = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(value) else d
    keep = mark | (owner < d)
    value, owner, p = value[keep], owner[keep], p[keep]
    order = np.lexsort((value, p))
    value, owner, p = value[order], owner[order], p[order]
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
    ends = [*at[1:], len(p)] if len(p) else []
    return pa.table({"part": pa.array([int(p[i]) for i in at], pa.int32()), "hashes": pa.array([value[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), "docs": pa.array([owner[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())})


def _send_windows(window: int, before: int, buckets: int):
    """The last level, for one part: its distinct windows that survived the level ``before``, with the least document of
    each; marked in the lowest bit if several of the part's documents have it."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hs, ds = [], []
        for doc, words, keep in _surviving(docs, answers, window, before):
            hs.append(np.unique(even(windows(words, window))[keep]))
            ds.append(np.full(len(hs[-1]), doc, dtype=np.int64))
        if not hs:
            return SENT_ARROW.empty_table()
        part = docs.column("part")[0].as_py()
        h, d, many = _first(np.concatenate(hs), np.concatenate(ds))
        h = h | many.astype(np.uint64)
        cut = split_sorted(h, buckets)
        return pa.Table.from_batches([_batch({"bucket": [b for b, _, _ in cut], "part": [part] * len(cut), "hashes": [h[i:j].tobytes() for _, i, j in cut], "docs": [d[i:j].tobytes() for _, i, j in cut]}, SENT_ARROW)])

    return run


def _remove(window: int):
    """For one part: documents without the words that a window owned by a smaller document covers."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = cleaned(docs, answers)
        release()
        return out

    def cleaned(docs: pa.Table, answers: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(answers.column("hashes").to_pylist()), dtype=np.uint64)
        owner = np.frombuffer(b"".join(answers.column("docs").to_pylist()), dtype=np.int64)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        kept, n_words, n_removed = [], [], []
        for chunk in docs.select(["id", "text"]).to_batches():
            for doc, text in zip(chunk.column("id").to_pylist(), chunk.column("text").cast(pa.binary())):
                text = text.as_py() or b""
                found = text.split()
                n = len(found)
                if n >= window and len(h):
                    w = even(windows(word_hashes(text), window))
                    at = np.minimum(np.searchsorted(h, w), len(h) - 1)
                    hit = np.flatnonzero((h[at] == w) & (owner[at] < doc))
                    if len(hit):
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, hit, 1)
                        np.subtract.at(edge, hit + window, 1)
                        keep = np.cumsum(edge[:n]) == 0
                        found = [x for x, k in zip(found, keep.tolist()) if k]
                kept.append(b" ".join(found))
                n_words.append(n)
                n_removed.append(n - len(found))
        return pa.table({"row": docs.column("row"), "text": docs.column("text"), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (struct of all columns but the text), ``text``, ``kept_text``, ``n_words``, ``n_removed`` of every row.

    Removed is each word that stands in a window of ``window`` consecutive words whose sequence also starts in a document
    with a smaller id; windows are judged on the input. ``kept_text``: the other words, joined by one space. Null and empty
    texts have no words. Rows that repeat an id do not remove each other's words. Rows without an id own nothing and lose
    nothing: they come back as they are."""
    spark = docs.sparkSession
    lengths, tasks = levels(window), shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    parts = max(2 * tasks, math.ceil(size / PART_BYTES))
    buckets = max(tasks, parts // 4)
    # as many tasks as the parts need; the session's own number, which adaptive execution may lower, where that is enough
    dealt = lambda df, n, key: df.repartition(n, key).groupBy(key) if n > 2 * tasks else df.groupBy(key)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    bare = rows.where("id is null").select("row", "text", F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ").alias("kept_text"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
    rows = rows.where("id is not null")
    light = rows.select("part", "id", "text")
    answered = lambda sent, answer, name: materialize(dealt(sent, buckets, "bucket").applyInArrow(answer, ANSWER), name)
    if len(lengths) == 1:
        lengths = lengths * 2  # a short window is its own anchor
    owned = answered(rows.select("text", "part").mapInArrow(_send_first(window, lengths[0], buckets), SENT), _answer_anchors, "repeated")
    for before, length in zip(lengths, lengths[1:]):
        if owned.isEmpty():
            break
        last = length == window
        send = _send_windows(window, before, buckets) if last else _send_next(window, before, length, buckets)
        sent = dealt(light, parts, "part").cogroup(dealt(owned, parts, "part")).applyInArrow(send, SENT)
        owned = answered(sent, _answer_windows if last else _answer_anchors, "windows" if last else "repeated")
    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return dealt(rows, parts, "part").cogroup(dealt(owned, parts, "part")).applyInArrow(_remove(window), schema).unionByName(bare)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
