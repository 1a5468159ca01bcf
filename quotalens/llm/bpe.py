"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

**Sufficient lookahead.** Apply the merges in rank order to a text x and to a longer text xy. At first both agree on
all bytes of x. The common part shrinks only when a merge (u, v) has u as the last common token and v beyond it, and
then by |u|. The next such merge (u', v') has a higher rank, and v' must begin, somewhere down its left-most
derivation, with u. So the longest chain of merges with rising ranks, each |u| long, bounds how far back bytes still
unseen can reach. :func:`lookahead` finds that chain in one pass over the merge list. A token that ends so many bytes
before the end of what has been read is final: the transducer emits it and forgets its bytes, so memory stays constant
however long the text or a single word of it is.

Words are cut off the text as they come (a cut between a visible character and white space is always one), and a
bounded table keeps the tokens of short words.

Null text counts as empty: no tokens, decoded as the empty text. Ids are packed as little-endian unsigned 32-bit
integers. Rows are independent, so repeated rows and ids, null ids and extra columns stay as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from quotalens.llm.common import append_columns, by_value, field, Shared

by_value(__name__)

#: How the byte-level scheme cuts words. Fixed value: part of the vocabulary format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for the faster standard matcher, which has no letter and number classes of its own: its word characters
#: without digits are the letters, and its white space is white space, in texts without the characters of RARE.
FAST_WORDS = r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: Characters looked at in one go, words remembered, and the longest word (in characters) that is remembered.
CHUNK, REMEMBERED, SHORT = 1 << 16, 1 << 17, 48


def byte_of_symbol() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """single: byte -> id; merges: (id, id) -> rank; made: rank -> id; pieces: id -> bytes; special: text -> id; reach: lookahead in bytes."""

    single: list[int]
    merges: dict[tuple[int, int], int]
    made: list[int]
    pieces: dict[int, bytes]
    special: dict[str, int]
    reach: int
    rare: frozenset[str] = frozenset()
    encoder: Encoder | None = None


def rare_characters() -> frozenset[str]:
    """The characters that the two matchers see differently, found by asking both about every one."""
    fast, full = re.compile(r"([^\W\d_])|(\d)|(\s)"), regex.compile(r"(\p{L})|(\p{Nd})|(\p{White_Space})")
    kind = lambda found: found and found.lastindex
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if kind(fast.match(c)) != kind(full.match(c)))


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that can still change it, at most. ``merges`` in rank order."""
    chain: dict[bytes, int] = {}
    spine: dict[bytes, tuple[bytes, ...]] = {}
    most = 0
    for left, right in merges:
        reach = len(left) + max((chain.get(x, 0) for x in spine.get(right, (right,))), default=0)
        chain[left] = max(chain.get(left, 0), reach)
        spine[left + right] = (*spine.get(left, (left,)), left + right)
        most = max(most, reach)
    return most


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file (JSON). Its size is bounded: it is read by the driver and broadcast."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    cut = given["pre_tokenizer"]
    if given["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
        raise ValueError("only plain byte-level vocabularies are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in given["added_tokens"]):
        raise ValueError("added tokens that strip or normalise are not supported")
    known, ids = byte_of_symbol(), given["model"]["vocab"]
    raw = {name: bytes(known[c] for c in name) for name in ids}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in given["model"]["merges"]]
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    return Vocabulary(
        single=[ids[c] for c, _ in sorted(known.items(), key=lambda x: x[1])],
        merges={(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)},
        made=[ids[a + b] for a, b in pairs],
        pieces={i: raw[name] for name, i in ids.items()} | {i: name.encode() for name, i in special.items()},
        special=special,
        reach=lookahead([(raw[a], raw[b]) for a, b in pairs]),
        rare=rare_characters(),
    )


class Encoder:
    """Text to packed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words, self.fast_words, self.rare = regex.compile(WORDS), re.compile(FAST_WORDS), vocabulary.rare
        self.known: dict[str, bytes] = _Table(self._short)
        names = sorted(map(re.escape, vocabulary.special), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not any(name in text for name in self.v.special):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.special.split(text)):
            out.append(array("I", [self.v.special[part]]).tobytes() if k % 2 else b"".join(self._plain(part)))
        return b"".join(out)

    def _plain(self, text: str):
        """Packed ids of one stretch after another; no stretch ends inside a word."""
        at = 0
        find = (self.fast_words if self.rare.isdisjoint(text) else self.words).findall
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                cut = _CUT.search(text, end)
                end = cut.end() if cut else len(text)
            words = find(text, at, end)
            if max(map(len, words)) <= SHORT:
                yield b"".join(map(self.known.__getitem__, words))
            else:
                for word in words:
                    yield self.known[word] if len(word) <= SHORT else array("I", self.stream(word.encode())).tobytes()
            at = end

    def _short(self, word: str) -> bytes:
        return array("I", self.merged([self.v.single[b] for b in word.encode()])).tobytes()

    def stream(self, word: bytes):
        """Ids of one word of any length, each as soon as it is final."""
        reach, window = self.v.reach, max(4 * self.v.reach, 64)
        at = 0
        while at < len(word):
            ids = self.merged([self.v.single[b] for b in word[at:at + window]])
            last = at + window >= len(word)
            final = window - reach
            taken = 0
            for i in ids:
                size = len(self.v.pieces[i])
                if not last and taken + size > final:
                    break
                taken += size
                yield i
            at += taken

    def merged(self, ids: list[int]) -> list[int]:
        if len(ids) > 4 * SHORT:
            return self._merged_long(ids)
        find, made = self.v.merges.get, self.v.made
        ranks = [find(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            k = ranks.index(best)
            ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = find((ids[k - 1], ids[k]), _NEVER)
            if k < len(ranks):
                ranks[k] = find((ids[k], ids[k + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same through a queue of pairs by (rank, place)."""
        merges, made, n = self.v.merges, self.v.made, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(merges[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapify(queue)
        while queue:
            rank, k, a, b = heappop(queue)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made[rank], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (p := (ids[k], ids[after[k]])) in merges:
                    heappush(queue, (merges[p], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], ids[k])) in merges:
                heappush(queue, (merges[p], before[k], *p))
        return [i for i in ids if i >= 0]


_NEVER = 1 << 40

#: The first character of white space after a visible one lies behind this match.
_CUT = re.compile(r"\S(?=\s)")


class _Table(dict):
    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.fill(key)
        return value


class Decoder:
    """Packed ids to text: bytes come piece by piece, characters leave as soon as they are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces

    def decode(self, packed: bytes) -> str:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids = memoryview(packed).cast("I")
        out = []
        for at in range(0, len(ids), CHUNK):
            out.append(state.decode(b"".join(map(self.pieces.__getitem__, ids[at:at + CHUNK]))))
        out.append(state.decode(b"", final=True))
        return "".join(out)


def transcode(
    df: DataFrame, vocabulary_path: str, text: str = "text", keep: list[str] | None = None, decoded: bool = True,
) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (packed) and ``decoded`` (the text that the ids stand for) to every row.

    ``decoded=False`` compares that text with the given one in place of it, and adds ``round_trip``.
    """
    shared = Shared(df, load_vocabulary(vocabulary_path))

    def start():
        vocabulary = shared.value
        if vocabulary.encoder is None:  # the word table outlives the task, as long as the worker does
            vocabulary.encoder = Encoder(vocabulary)
        encoder, decoder = vocabulary.encoder, Decoder(vocabulary)

        def work(texts):
            ids = [encoder.encode(t) for t in texts]
            sizes = [len(x) // 4 for x in ids]
            if decoded:
                return [sizes, ids, [decoder.decode(x) for x in ids]]
            return [sizes, ids, [decoder.decode(x) == (t or "") for x, t in zip(ids, texts)]]

        return work

    last = field("decoded", "string") if decoded else field("round_trip", "boolean")
    return append_columns(df, text, [field("n_tokens", "long"), field("ids", "binary"), last], start, keep, target=4 << 20)
