"""Hierarchical multi-length packing of documents into token sequences.

Each document's ids end with one end id. Whole windows of the longest context are cut off first; what remains of a document
is routed to the smallest tier that holds it. Tiers are packed from the longest to the shortest: the largest remaining piece
opens a window, and its gap is filled from the shorter pieces, best fit first; if none fits, one is cut to fill the gap
exactly. What a batch cannot fill is carried into the next one; a task's last pieces are chained into windows and the tail
is cut at powers of two. All windows have a power of two as their length, so no sequence holds padding.

Step groups: within a task and tier, consecutive windows form groups of ``step_tokens`` tokens, so every full group costs
the same whatever its tier (8 windows of 2,048 or 64 of 256).

No shuffle: a task packs the documents it reads, in batches; memory is one batch. Sequence ids start with the number of the
partition, so a repeated task gives the same ids. Null and empty texts: one piece, the end id alone. Repeated rows are
packed each on its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import table
from graphloom.llm.tokens import default_vocabulary

TIERS = (256, 512, 1024, 2048)
END = 1
LONG_RUN = 2048


def _run(n: int) -> regex.Pattern:
    return regex.compile("|".join(rf"{kind}{{{n}}}+" for kind in (r"\s", r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")))


RUN, START = _run(LONG_RUN), _run(64)


def has_long_run(text: str) -> bool:
    """Whether ``text`` has LONG_RUN characters of one kind in a row. Such a run holds a multiple of half its length and
    what follows, so most texts are told by a few short looks."""
    return any(START.match(text, k) for k in range(0, len(text), LONG_RUN // 2)) and RUN.search(text) is not None


#: Characters of the texts of a batch, but for a longer text, which is a batch of its own.
BATCH_CHARS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to a uint32 array of ids: the same vocabulary in a faster library, which merges by id and so
    needs the ids in the order of the merges; else the transducer. That library's stack grows with a run of white space, and
    its time with the square of a pre-token: texts with a run of more than ``LONG_RUN`` characters of one kind go through
    the transducer, whose memory and time a character are constant."""
    c = bpe.coder(path)
    slow = lambda text: np.fromiter((x for part in c.encode(text) for x in part), dtype="<u4")
    if c.new != list(range(256, 256 + len(c.new))):
        return slow
    import tiktoken

    fast = tiktoken.Encoding("bytes", pat_str=bpe.PATTERN, mergeable_ranks={v: k for k, v in c.bytes.items() if k not in c.special.values()}, special_tokens=c.special)
    special = set(c.special)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and has_long_run(text):
            return slow(text)
        if any(x in text for x in special):
            return fast.encode_to_numpy(text, allowed_special=special)
        return np.asarray(fast.encode_ordinary(text), dtype="<u4")

    return encode


class Packer:
    """Packs documents given batch by batch. ``out``: rows of SCHEMA."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16384) -> None:
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.step_tokens, self.task = tiers, step_tokens, task
        self.sequences, self.windows = 0, dict.fromkeys([1 << k for k in range(tiers[-1].bit_length())], 0)
        self.docs: dict[int, tuple[int, np.ndarray]] = {}  # of pieces that are not yet placed, by a running number
        self.pool: list[tuple[int, int, int]] = []  # (length, number, start), sorted
        self.total, self.seen, self.out = 0, 0, []

    def _put(self, pieces: list[tuple[int, int, int]], context: int) -> None:
        per = max(1, self.step_tokens // context)
        group = (self.windows[context] // per * len(self.windows) + context.bit_length() - 1) + (self.task << 33)
        self.windows[context] += 1
        sequence, offset = (self.task << 33) + self.sequences, 0
        self.sequences += 1
        for length, number, start in pieces:
            doc_id, ids = self.docs[number]
            self.out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset, context, group))
            offset += length

    def add(self, batch: list[tuple[int, np.ndarray]]) -> None:
        most = self.tiers[-1]
        for doc_id, ids in batch:
            number = self.seen
            self.seen += 1
            self.docs[number] = (doc_id, ids)
            whole = len(ids) // most * most
            for start in range(0, whole, most):
                self._put([(most, number, start)], most)
            if rest := len(ids) - whole:
                self.pool.append((rest, number, whole))
                self.total += rest
        self.pool.sort()
        self._pack()
        left = {number for _, number, _ in self.pool}
        self.docs = {k: v for k, v in self.docs.items() if k in left}

    def _pack(self) -> None:
        """Windows of each tier, as long as the pool can fill them."""
        for context in reversed(self.tiers):
            least = context // 2 if context != self.tiers[0] else 0
            while self.pool and self.total >= context:
                at = bisect_right(self.pool, (context, 1 << 62, 0)) - 1
                if at < 0 or self.pool[at][0] <= least:
                    break
                pieces, gap = [], context
                while gap:
                    at = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
                    length, number, start = self.pool.pop(max(at, 0))
                    if length > gap:
                        insort(self.pool, (length - gap, number, start + gap))
                        length = gap
                    pieces.append((length, number, start))
                    gap -= length
                self.total -= context
                self._put(pieces, context)

    def close(self) -> None:
        """Chain what is left; windows of the longest tier, then powers of two."""
        chain, self.pool = self.pool[::-1], []
        while self.total:
            context = min(self.tiers[-1], 1 << (self.total.bit_length() - 1))
            pieces, gap = [], context
            while gap:
                length, number, start = chain.pop()
                if length > gap:
                    chain.append((length - gap, number, start + gap))
                    length = gap
                pieces.append((length, number, start))
                gap -= length
            self.total -= context
            self._put(pieces, context)


def pack(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", end: int = END, batch_docs: int = 2000) -> DataFrame:
    """One row per piece (see SCHEMA): the piece is ids [start, start + length) of its document and stands at ``offset``
    in its sequence; ``context`` is the sequence's length, ``step_group`` its step group. Other columns are not read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId(), tiers)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def taken() -> pd.DataFrame:
            rows, packer.out = packer.out, []
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            batch, held = [], 0
            for i, t in zip(frame["id"], frame["text"]):
                t = t or ""
                if batch and (len(batch) == batch_docs or held + len(t) > BATCH_CHARS):
                    packer.add(batch)
                    yield taken()
                    batch, held = [], 0
                batch.append((i, np.append(encode(t), np.uint32(end)).astype("<u4")))
                held += len(t)
            packer.add(batch)
            yield taken()
        packer.close()
        yield taken()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA).withColumnRenamed("doc_id", id_col)


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op8_hierarchical_packing": op8_hierarchical_packing}
