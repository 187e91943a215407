"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.common import give_back, lean, table

#: The pattern whose matches are found for a whole batch at once; those of any other are found text by text.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at once, about (twice as many with the generation before); bytes of one that is remembered, and of one that shares a queue.
MOST_WORDS, SHORT, LONGEST = 1_000_000, 23, 64
#: Characters that are encoded at once, and ids that are spelled at once.
AT_ONCE, IDS = 4_200_000, 1 << 18
#: As many for round_trip(), which runs beside what earlier stages have left in memory.
ROUND_TRIP = 1_000_000
#: A single blank between two characters that are no white space: no match of PLAIN reaches over it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@cache
def _kinds() -> np.ndarray:
    """What each code point is to PLAIN: 0 white space but the blank, 1 the blank, 2 a letter, 3 a number, 4 any other."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    kinds = np.full(0x110000, 4, np.uint8)
    for kind, pattern in ((2, r"\p{L}+"), (3, r"\p{N}+"), (0, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    kinds[32] = 1
    return kinds


def match_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of PLAIN begin in texts that follow each other.

    points: their code points; first: whether a text begins there. Matches are
    runs of letters, of numbers and of other signs, each with a blank before it,
    the white space before that, and the seven endings after an apostrophe.
    """
    kinds = _kinds()[points]
    white = kinds < 2
    group = np.where(white, 0, kinds)
    begins = first.copy()
    begins[1:] |= group[1:] != group[:-1]
    behind = np.flatnonzero(begins & ~white & ~first)
    behind = behind[white[behind - 1]]
    begins[behind - 1] = True
    begins[behind[kinds[behind - 1] == 1]] = False
    n = len(points)
    quote = np.flatnonzero(begins & (points == ord("'")))
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
    more = (quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)]
    is_ = lambda c, letters: np.isin(c, [ord(x) for x in letters])
    long = more & ((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")))
    for at, width in ((quote[is_(one, "stmd")], 2), (quote[long], 3)):
        begins[at + 1] = False
        begins[(at + width)[at + width < n]] = True
    return np.flatnonzero(begins)


class _Words:
    """Ids of words of up to SHORT bytes: an open hash table whose keys are the words' own bytes, three 64-bit numbers each."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros((3, 1024), np.uint64)
        self.starts, self.counts, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.uint8), np.zeros(4096, np.uint32)
        self.slots = np.full(4096, -1, np.int32)

    def copy(self) -> _Words:
        out = _Words()
        out.__dict__.update((k, v.copy() if isinstance(v, np.ndarray) else v) for k, v in self.__dict__.items())
        return out

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        mask = len(self.slots) - 1
        out = np.full(len(hashes), -1, np.int32)
        at, todo = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            place = self.slots[at]
            some = place >= 0
            if not some.all():
                todo, at, place = todo[some], at[some], place[some]
            same = (self.keys[0][place] == keys[0][todo]) & (self.keys[1][place] == keys[1][todo]) & (self.keys[2][place] == keys[2][todo])
            out[todo[same]] = place[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        return out

    def room(self, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2 + ids, np.uint32)])

    def _place(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            lost = self.slots[at] != places
            at, places = (at[lost] + 1) & mask, places[lost]

    def add(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places of new keys, each once, with their ids."""
        m, n = len(hashes), self.n
        if n + m > len(self.starts):
            wider = lambda x, size: np.concatenate([x, np.zeros((*x.shape[:-1], size), x.dtype)], axis=-1)
            more = max(n + m - len(self.starts), len(self.starts) // 2)
            self.keys, self.starts, self.counts = wider(self.keys, more), wider(self.starts, more), wider(self.counts, more)
        self.room(len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.keys[:, n : n + m] = keys
        self.counts[n : n + m] = counts
        self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
        self.n, self.used = n + m, self.used + len(ids)
        places = np.arange(n, n + m, dtype=np.int32)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (3 * self.n).bit_length(), -1, np.int32)
            self._place(self.hashes(self.keys[:, : self.n]), np.arange(self.n, dtype=np.int32))
        else:
            self._place(hashes, places)
        return places


#: Masks that keep the first so many bytes of a word of eight.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_keys(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of words of up to SHORT bytes, and how many, as three numbers each."""
    padded = data + b"\0" * 32
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))
    out = np.stack([eight[starts + k] & _KEEP[np.clip(sizes - k, 0, 8)] for k in (0, 8, 16)])
    out[2] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Codec:
    """Encoder and decoder of one rank file, for the matches of one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.tokens.values()) + 1
        self.bytes = [self.tokens[bytes([i])] for i in range(256)]
        # The rank of each pair of tokens that join to a token; ranks are ids.
        self.pairs: dict[int, int] = {}
        get = self.tokens.get
        for token, rank in self.tokens.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    self.pairs[a << 32 | b] = rank
        by_id = [b""] * self.size
        for token, rank in self.tokens.items():
            by_id[rank] = token
        self.spelled = _Spelling(by_id)
        self.lengths = self.spelled.lengths
        if self.size > 10**7:
            raise ValueError("ids of more than seven digits")
        self.numbers = np.array([b"%d," % i for i in range(self.size)], "S8").view("<u8")
        self.find = None if pattern == PLAIN else regex.compile(pattern).finditer
        self.byte_ids = np.array(self.bytes, np.int64)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        own = self.byte_ids
        self.byte_pairs = self._rank(own[:, None] << 32 | own[None, :])
        # A word that is a token is that token, whatever its bytes would merge to.
        short = [t for t in self.tokens if len(t) <= SHORT]
        sizes = np.fromiter(map(len, short), np.int64, len(short))
        keys = word_keys(b"".join(short), np.cumsum(sizes) - sizes, sizes)
        self.base = _Words()
        self.base.add(keys, _Words.hashes(keys), np.array([self.tokens[t] for t in short], np.uint32), np.ones(len(short), np.uint8))
        self.known, self.before = self.base.copy(), self.base

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair (left id << 32 | right id), or -1."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], -1)

    def merge(self, data: bytes) -> list[int]:
        """Join the adjacent pair of least rank, the leftmost first, until none is left.

        Positions wait in a bucket for each rank, and two levels of bitmaps show
        which buckets have any: finding the first set bit of the upper and the
        lower level gives the next rank. Positions are linked, so a merge costs
        the same wherever it is; an entry whose pair has changed since is stale
        and skipped. A bucket may be refilled, so its positions form a heap only
        if they don't come in order.
        """
        ids = list(map(self.bytes.__getitem__, data))
        n = len(ids)
        if n == 1:
            return ids
        rank_of = self.pairs.get
        buckets: dict[int, list[int]] = {}
        lower: dict[int, int] = {}
        upper = 0
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    lower[word] = lower.get(word, 0) | 1 << (rank & 255)
                    upper |= 1 << word
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << 8 | ((bits & -bits).bit_length() - 1)
            # Nothing of a lower rank waits, but a merge may make one: then the rest of the bucket waits again.
            bucket = buckets.pop(rank)
            bits &= bits - 1
            lower[word] = bits
            if not bits:
                upper &= upper - 1
            if len(bucket) > 1:
                bucket.sort()
            for at, i in enumerate(bucket):
                j = after[i]
                if j >= n or ids[i] < 0 or rank_of(ids[i] << 32 | ids[j]) != rank:
                    continue
                k = after[j]
                ids[i], ids[j], after[i] = rank, -1, k
                least = rank
                if k < n:
                    before[k] = i
                    new = rank_of(rank << 32 | ids[k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            word = new >> 8
                            lower[word] = lower.get(word, 0) | 1 << (new & 255)
                            upper |= 1 << word
                        if new < least:
                            least = new
                h = before[i]
                if h >= 0:
                    new = rank_of(ids[h] << 32 | rank)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            word = new >> 8
                            lower[word] = lower.get(word, 0) | 1 << (new & 255)
                            upper |= 1 << word
                        if new < least:
                            least = new
                if least < rank and at + 1 < len(bucket):
                    buckets[rank] = buckets.get(rank, []) + bucket[at + 1 :]
                    word = rank >> 8
                    lower[word] = lower.get(word, 0) | 1 << (rank & 255)
                    upper |= 1 << word
                    break
        return [x for x in ids if x >= 0]

    def merge_all(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short words, given as spans of data, by one queue: their ids one after the other, and how many each has.

        All words lie in one linked list, parted by an id that pairs with none.
        Popping a rank handles its leftmost position in every word at once; what
        a word has beyond that waits again, behind any lower rank that came up.
        """
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1 if len(ends) else 0
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        word_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        held = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        held[inside] = data[np.repeat(starts, sizes) + _within(sizes)]
        ids = self.byte_ids[held]
        ids[ends] = self.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1)
        rank[:-1] = self.byte_pairs[held[:-1], held[1:]]
        rank[ends] = -1
        rank[ends[sizes > 0] - 1] = -1
        buckets: dict[int, list[int]] = {}
        lower, upper = [0] * ((self.size >> 8) + 1), 0
        first = np.flatnonzero(rank >= 0)
        first = first[np.argsort(rank[first], kind="stable")]
        own = rank[first]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        for r, at, to in zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=False):
            buckets[r] = first[at:to].tolist()
            lower[r >> 8] |= 1 << (r & 255)
            upper |= 1 << (r >> 8)
        while upper:
            cell = (upper & -upper).bit_length() - 1
            bits = lower[cell]
            r = cell << 8 | ((bits & -bits).bit_length() - 1)
            bits &= bits - 1
            lower[cell] = bits
            if not bits:
                upper &= upper - 1
            pos = np.array(buckets.pop(r))
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if len(pos) > 1:
                pos.sort()
                w = word_of[pos]
                leftmost = np.ones(len(w), bool)
                np.not_equal(w[1:], w[:-1], out=leftmost[1:])
                if not leftmost.all():
                    buckets[r] = pos[~leftmost].tolist()
                    lower[cell] |= 1 << (r & 255)
                    upper |= 1 << cell
                    pos = pos[leftmost]
            j = after[pos]
            k, h = after[j], before[pos]
            ids[pos], ids[j], after[pos], before[k], rank[j] = r, -1, k, pos, -1
            ends_ = np.concatenate([pos, h])
            new = self._rank(np.concatenate([r << 32 | ids[k], ids[h] << 32 | r]))
            rank[ends_] = new
            some = np.flatnonzero(new >= 0)
            for x, at in zip(new[some].tolist(), ends_[some].tolist(), strict=True):
                bucket = buckets.get(x)
                if bucket is None:
                    buckets[x] = [at]
                    lower[x >> 8] |= 1 << (x & 255)
                    upper |= 1 << (x >> 8)
                else:
                    bucket.append(at)
        keep = (ids >= 0) & (ids != self.size)
        return ids[keep].astype(np.uint32), np.bincount(word_of[keep], minlength=len(sizes))

    def _spans(self, texts: list[str], whole: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in data the pre-tokens begin, their bytes, and how many each text has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        upto = np.zeros(len(points) + 1, np.int64 if len(data) >> 31 else np.int32)
        np.cumsum(1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF), out=upto[1:])
        if self.find is None:
            first = np.zeros(len(points), bool)
            first[(ends - sizes)[sizes > 0]] = True
            begins = match_starts(points, first) if len(points) else np.zeros(0, np.int64)
            starts = upto[begins].astype(np.int64)
            return starts, np.diff(np.append(starts, len(data))), np.diff(np.searchsorted(begins, ends), prepend=0)
        found = [[m.span() for m in self.find(x) if m.end() > m.start()] for x in texts]
        counts = np.fromiter(map(len, found), np.int64, len(texts))
        spans = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 2) + np.repeat(ends - sizes, counts)[:, None]
        starts = upto[spans[:, 0]].astype(np.int64)
        return starts, upto[spans[:, 1]] - starts, counts

    def _flush(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        data = whole.encode()
        starts, sizes, per_text = self._spans(texts, whole, data)
        if self.known.n > MOST_WORDS + self.base.n:
            self.known, self.before = self.base.copy(), self.known
        known, flat = self.known, np.frombuffer(data, np.uint8)
        short = np.flatnonzero(sizes <= SHORT)
        keys = word_keys(data, starts[short], sizes[short])
        hashes = _Words.hashes(keys)
        place = known.find(keys, hashes)
        # The words that aren't remembered, each once (but for two of one hash).
        new = np.flatnonzero(place < 0)
        _, one, of = np.unique(hashes[new], return_index=True, return_inverse=True)
        odd = (keys[:, new] != keys[:, new[one[of]]]).any(axis=0)
        one, alone = new[one], new[odd]
        old = self.before.find(keys[:, one], hashes[one])
        again = one[old >= 0]
        old = old[old >= 0].astype(np.int64)
        if len(again):
            counts = self.before.counts[old].astype(np.int64)
            known.add(keys[:, again], hashes[again], self.before.ids[np.repeat(self.before.starts[old], counts) + _within(counts)], counts)
        one = one[known.find(keys[:, one], hashes[one]) < 0]
        # Words of up to LONGEST bytes share a queue; longer ones have their own.
        rest = np.concatenate([short[alone], np.flatnonzero(sizes > SHORT)])
        words = [data[a : a + n] for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
        own = {w: np.array([self.tokens[w]] if w in self.tokens else self.merge(w), np.uint32) for w in set(words) if w in self.tokens or len(w) > LONGEST}
        some = list({w: i for w, i in zip(words, rest.tolist(), strict=True) if w not in own}.items())
        spans = np.concatenate([short[one], np.array([i for _, i in some], np.int64)])
        ids, counts = self.merge_all(flat, starts[spans], sizes[spans])
        upto = np.cumsum(counts)
        at = int(upto[len(one) - 1]) if len(one) else 0
        known.add(keys[:, one], hashes[one], ids[:at], counts[: len(one)])
        own.update(zip((w for w, _ in some), np.split(ids[at:], upto[len(one) : -1] - at) if some else [], strict=True))
        # Ids of words that aren't remembered lie behind the others for now.
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        missing = place < 0
        place[missing] = known.find(keys[:, missing], hashes[missing])
        place[alone] = 0
        begin[short], count[short] = known.starts[place], known.counts[place]
        if words:
            lengths = np.fromiter((len(own[w]) for w in words), np.int64, len(words))
            known.room(int(lengths.sum()))
            known.ids[known.used : known.used + int(lengths.sum())] = np.concatenate([own[w] for w in words])
            begin[rest], count[rest] = known.used + np.cumsum(lengths) - lengths, lengths
        out = known.ids[np.repeat(begin, count) + _within(count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = upto[np.cumsum(per_text)]
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_all(self, texts: Iterable[str], most: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each whole text, each match of the pattern by itself; `most` characters (AT_ONCE) at once, but for a longer text's."""
        most = most or AT_ONCE
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > most:
                yield from self._flush(held)
                held, size = [], 0
            if len(text) > AT_ONCE and self.find is None:
                yield np.concatenate([self._flush([part])[0] for part in _parts(text)])
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._flush(held)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spelled(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.numbers[ids].tobytes().translate(None, b"\0")[:-1]


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut where no match of PLAIN can be."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + AT_ONCE)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


class _Spelling:
    """Joins the byte strings of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array(list(map(len, strings)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), IDS):
            part = ids[at : at + IDS]
            lengths = self.lengths[part]
            out.append(self.data[np.repeat(self.starts[part], lengths) + _within(lengths)].tobytes())
        return b"".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file: where it is named, or as the driver handed it on."""
    key = (path, pattern)
    if key not in _codecs:
        try:
            _codecs[key] = Codec(path, pattern)
        except FileNotFoundError:
            _codecs[key] = Codec(SparkFiles.get(path.rsplit("/", 1)[-1]), pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs (text, any others) with ids, an array of the token ids of each whole text.

    path is that of a rank file (base64 token and rank on each line). Text is
    cut by the pattern, each match encoded by itself, without special tokens.
    Null and empty texts have no ids; repeated rows stay; a column ids is replaced.
    """
    return _mapped(docs.drop("ids"), path, pattern, "text", "ids array<int>", _encoded)


def decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs (ids, any others) with decoded, the bytes that the ids stand for; a null array gives no bytes."""
    return _mapped(docs.drop("decoded"), path, pattern, "ids", "decoded binary", _decoded)


def _encoded(own: Codec, column: pa.Array) -> list[pa.Array]:
    return [_lists(list(own.encode_all(x or "" for x in column.to_pylist())))]


def _decoded(own: Codec, column: pa.Array) -> list[pa.Array]:
    return [pa.array([own.decode(x) for x in _arrays(column)], pa.binary())]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _mapped(docs: DataFrame, path: str, pattern: str, source: str, more: str, function: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    names = [x.split(" ")[0] for x in more.split(", ")]
    at = docs.columns.index(source)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        give_back()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *function(own, b.column(at))], names=[*b.schema.names, *names])

    schema = docs.sparkSession.createDataFrame([], more).schema
    return lean(docs).mapInArrow(each, type(schema)([*docs.schema.fields, *schema.fields]))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encode(), with lossless: whether the ids decode to the text's bytes. One pass, so each task needs one worker."""

    def both(own: Codec, column: pa.Array) -> list[pa.Array]:
        texts = [x or "" for x in column.to_pylist()]
        ids, same = [], []
        for text, found in zip(texts, own.encode_all(texts, ROUND_TRIP), strict=True):
            ids.append(found)
            same.append(own.decode(found) == text.encode())
        return [_lists(ids), pa.array(same, pa.bool_())]

    return _mapped(docs.drop("ids", "lossless"), path, pattern, "text", "ids array<int>, lossless boolean", both)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, without keeping ids: encoded, then decoded from the ids."""
    def both(own: Codec, column: pa.Array) -> list[pa.Array]:
        n, ids_, decoded = [], [], []
        for ids in own.encode_all(x or "" for x in column.to_pylist()):
            n.append(len(ids))
            ids_.append(hashlib.sha256(own.decimals(ids)).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), path, pattern, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", both)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
