"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine.

The transducer reads a pre-token's bytes in pieces, keeps a short buffer, and emits a token once no later byte can change
it. How many bytes must be seen past a token's end is computed from the merge list alone (``lookahead``). State: the buffer
(at most ``piece + 2 * lookahead`` bytes) and a bounded cache of short pre-tokens; memory does not grow with the text.

Why the lookahead suffices. A token t = (a, b) fails to form from its bytes only because a merge that ranks before t takes
b, or a token on b's right edge, together with a token w to the right: that needs len(w) bytes, and w itself may be
undecided for G(w) bytes. So G(t) = max(G(b), max over merges (b, w) ranked before t of len(w) + G(w)), computed in rank
order; a finished token may still be the left part of any merge, so the bound is the largest over all tokens of G(t) and of
len(w) + G(w) over all its merges (t, w).
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import regex

# Fixed value: the byte-level pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 256
#: Pre-tokens in each of the cache's two generations, each of at most CACHED_LENGTH characters.
CACHED, CACHED_LENGTH = 200_000, 48
#: Buffers of the transducer whose tokens are remembered.
BUFFERS = 2048


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def check(spec: dict) -> None:
    """ValueError for a vocabulary file that asks for what the transducer does not do."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = {
        "a normalizer": spec.get("normalizer"),
        "another pre-tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
        "another model": model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"),
        "added tokens that strip, stand alone or are normalized": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, v in wrong.items() if v]:
        raise ValueError("not supported: " + ", ".join(found))


class Coder:
    """``encode`` and ``decode`` for one byte-level vocabulary file. Equal to the tokenizers library with
    add_special_tokens=False and to its decode(ids, skip_special_tokens=False). A file with a normalizer, another
    pre-tokenizer or model, or added tokens with conditions is refused (``check``)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.new: list[int] = []
        length = {v: len(k) for k, v in vocab.items()}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.new.append(vocab[a + b])
        self.none = len(self.new)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {v: bytes(back[c] for c in k) for k, v in vocab.items() if k not in special} | {v: k.encode() for k, v in special.items()}
        self.special = special
        self.split = regex.compile("|".join(regex.escape(k) for k in sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PATTERN).finditer
        self.lookahead = self._lookahead(length)
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.buffers: dict[bytes, list[int]] = {}

    def _lookahead(self, length: dict[int, int]) -> int:
        own: dict[int, int] = {}  # G
        right: dict[int, int] = {}  # of each token, max of len(w) + G(w) over its merges (t, w) so far
        for (a, b), rank in sorted(self.rank.items(), key=lambda x: x[1]):
            new = self.new[rank]
            own[new] = max(own.get(new, 0), own.get(b, 0), right.get(b, 0))
            right[a] = max(right.get(a, 0), length[b] + own.get(b, 0))
        return max([1, *own.values(), *right.values()])

    def _merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals, on one buffer."""
        ids = [self.single[x] for x in data]
        rank, new, none = self.rank.get, self.new, self.none
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = (new[best],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def transduce(self, data: bytes, piece: int = PIECE) -> Iterator[list[int]]:
        """Token ids of one pre-token, in lists, each as soon as it is stable."""
        size, held, at = self.bytes, b"", 0
        while at < len(data):
            held += data[at : at + piece]
            at += piece
            last = at >= len(data)
            if (ids := self.buffers.get(held)) is None:  # long runs come back to the same buffers
                if len(self.buffers) >= BUFFERS:
                    self.buffers.clear()
                self.buffers[held] = ids = self._merge(held)
            end, k = 0, 0
            for x in ids:
                if not last and end + len(size[x]) + self.lookahead > len(held):
                    break
                end += len(size[x])
                k += 1
            yield ids[:k]
            held = held[end:]

    def _word(self, word: str) -> list[int]:
        ids = self.older.get(word) or [x for part in self.transduce(word.encode("utf-8")) for x in part]
        if len(self.cache) >= CACHED:
            self.cache, self.older = {}, self.cache
        self.cache[word] = ids
        return ids

    def _plain(self, text: str, block: int) -> Iterator[list[int]]:
        out: list[int] = []
        extend = out.extend
        for m in self.find(text):
            word = m[0]
            ids = self.cache.get(word)
            if ids is not None:
                extend(ids)
            elif len(word) <= CACHED_LENGTH:
                extend(self._word(word))
            else:
                for part in self.transduce(word.encode("utf-8")):
                    extend(part)
            if len(out) >= block:
                yield out
                out = []
                extend = out.extend
        yield out

    def encode(self, text: str | None, block: int = 8192) -> Iterator[list[int]]:
        """Lists of about ``block`` ids. Null and empty texts have none. Strings of special tokens become their ids."""
        text, at = text or "", 0
        for m in self.split.finditer(text) if self.split else ():
            if m.start() > at:
                yield from self._plain(text[at : m.start()], block)
            yield [self.special[m[0]]]
            at = m.end()
        if at < len(text):
            yield from self._plain(text[at:] if at else text, block)

    def ids(self, text: str | None) -> list[int]:
        return [x for part in self.encode(text) for x in part]


class ByteText:
    """Bytes in, text out, a few at a time. State: the bytes of an unfinished character. Malformed sequences become
    U+FFFD, one for each maximal part of a character."""

    def __init__(self) -> None:
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def close(self) -> str:
        return self._state.decode(b"", True)


def decode(coder: Coder, parts) -> Iterator[str]:
    """Text of lists of ids, piece by piece."""
    machine, size = ByteText(), coder.bytes
    for ids in parts:
        yield machine.feed(b"".join([size[x] for x in ids]))
    yield machine.close()


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def digests(path: str, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers, SHA-256 of the decoded text; the text
    is encoded and decoded block by block."""
    import numpy as np

    c, machine = coder(path), ByteText()
    n, ids_hash, text_hash, size = 0, hashlib.sha256(), hashlib.sha256(), c.bytes
    for ids in c.encode(text):
        n += len(ids)
        ids_hash.update(np.asarray(ids, dtype="<u4").tobytes())
        text_hash.update(machine.feed(b"".join([size[x] for x in ids])).encode("utf-8"))
    text_hash.update(machine.close().encode("utf-8"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()
