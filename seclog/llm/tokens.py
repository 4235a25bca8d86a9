"""Token ids of Arrow text columns by a public vocabulary of the ``tokenizers`` library.

The library's own pipeline takes white space away and parts letters from other marks before
it merges anything, so a text's ids are those of its pieces between spaces and line ends,
and of a word and the marks behind it, put together. Pieces are found and hashed with
numpy; each worker keeps the ids of the pieces it has met, by their 64-bit hashes (at most
``KEEP`` of them), and asks the library for new ones only. Pieces met lately have a place by
their hash's first bits, so that frequent ones need no search; when too many are kept, those
without a place are forgotten. Texts that hold the vocabulary's
special strings are encoded whole by the library.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seclog.llm import text as X

KEEP = 1_000_000
PLACES_BITS = 18
#: Pieces learned last that stand apart, so that a few new ones don't move all.
RECENT = 32_768
#: Bytes of a piece that are hashed eight at a time; longer pieces are hashed by running sums.
SHORT = 64

#: A lower-case word, composed as the library composes it.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")

#: Bytes that end no piece.
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 10]] = False
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: Second bytes of the letters from U+00E0 on.
_ACCENT = np.zeros(256, bool)
_ACCENT[0xA0:0xC0] = True
_ACCENT[0xB7] = False
#: The first bytes of a word of eight.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.direct = self._is_direct()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Letters beyond ASCII of a plain word, as the model spells their bytes.
        self.spelt = str.maketrans({c: "".join(x for x, _ in byte_level.pre_tokenize_str(c)) for c in map(chr, range(0xDF, 0x100)) if _PLAIN.fullmatch(c)})
        self._forget()

    def _is_direct(self) -> bool:
        """Whether white space only separates, words lose their case and marks stand alone: what the short cuts rely on."""
        a = self.library.encode("Ab, cd\nef", add_special_tokens=False).ids
        return a == [i for x in ("ab", ",", "cd", "ef") for i in self.library.encode(x, add_special_tokens=False).ids]

    def _forget(self) -> None:
        # sorted hashes, where their ids start and their number
        self.known = self.recent = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        # hash at each place, with where its ids start and their number; an empty place holds a hash that belongs elsewhere
        self.placed = np.full(1 << PLACES_BITS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.placed[-1] = 0
        self.placed_start, self.placed_length = np.zeros(1 << PLACES_BITS, np.int64), np.zeros(1 << PLACES_BITS, np.int64)

    def _forget_displaced(self) -> None:
        """Keep only pieces that have a place."""
        own = np.flatnonzero((self.placed >> np.uint64(64 - PLACES_BITS)).view(np.int64) == np.arange(len(self.placed)))
        start, length = self.placed_start[own], self.placed_length[own]
        end = np.cumsum(length)
        ids = self.ids.take(np.repeat(start - end + length, length) + np.arange(length.sum()))
        self.ids, self.used = np.concatenate([ids, np.empty(1 << 20, np.uint32)]), len(ids)
        self.placed_start[own] = end - length
        self.known, self.recent = (self.placed[own], end - length, length), tuple(x[:0] for x in self.recent)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of new pieces; ``hashes`` are sorted. Gives where their ids start and their numbers."""
        tokenize, spelt = self.library.model.tokenize, self.spelt
        # pieces have no capitals of ASCII
        plain = [(x if x.isalpha() else None) if x.isascii() else x.translate(spelt) if _PLAIN.fullmatch(x) else None for x in pieces]
        odd = [x for x, p in zip(pieces, plain) if p is None]
        other = iter([ids for i in range(0, len(odd), 1000) for ids in self._whole(odd[i:i + 1000])])
        found = [next(other) if p is None else [t.id for t in tokenize(p)] for p in plain]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = np.concatenate([[0], np.cumsum(sizes)])
        fresh = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(first[-1]))
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used:self.used + len(fresh)] = fresh
        begins = first[:-1] + self.used
        self.recent = _merged(self.recent, (hashes, begins, sizes))
        if len(self.recent[0]) > RECENT:
            self.known, self.recent = _merged(self.known, self.recent), tuple(x[:0] for x in self.recent)
        self.used += len(fresh)
        return begins, sizes

    def _kept(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of the kept pieces start, their numbers, and which pieces are not kept."""
        begins, lengths, new = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
        for known, start, length in (self.known, self.recent):
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                same = known.take(place) == hashes
                begins[same], lengths[same] = start[place[same]], length[place[same]]
                new &= ~same
        return begins, lengths, new

    def _found(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the pieces from ``a`` to ``b`` start in the kept ones, and their numbers."""
        at = (hashes >> np.uint64(64 - PLACES_BITS)).view(np.int64)
        start, length = self.placed_start.take(at), self.placed_length.take(at)
        other = np.flatnonzero(self.placed.take(at) != hashes)
        if not len(other):
            return start, length
        distinct, one, back = np.unique(hashes.take(other), return_index=True, return_inverse=True)
        kept = len(self.known[0]) + len(self.recent[0])
        if kept and kept + len(distinct) > KEEP:
            self._forget_displaced()
            if 4 * len(self.known[0]) > 3 * KEEP or len(self.known[0]) + len(distinct) > KEEP:
                self._forget()
            return self._found(data, a, b, hashes)
        begins, lengths, new = self._kept(distinct)
        if new.any():
            raw, at = data.tobytes(), other[one[new]]
            begins[new], lengths[new] = self._learn(distinct[new], [raw[x:y].decode() for x, y in zip(a[at].tolist(), b[at].tolist())])
        start[other], length[other] = begins[back], lengths[back]
        at = distinct >> np.uint64(64 - PLACES_BITS)
        self.placed[at], self.placed_start[at], self.placed_length[at] = distinct, begins, lengths
        return start, length

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and where each row starts and ends in them; null is empty."""
        column = pc.fill_null(column, "")
        if not self.direct:
            return _joined(self._whole(column.to_pylist()))
        special = np.zeros(len(column), bool)
        for mark in self.special:
            special |= pc.match_substring(column, mark, ignore_case=True).to_numpy(zero_copy_only=False)
        if special.any():
            ids, first = self.encode(pc.if_else(pa.array(special), "", column))
            rows = [ids[a:b] for a, b in zip(first, first[1:])]
            for i in np.flatnonzero(special).tolist():
                rows[i] = self._whole([column[i].as_py()])[0]
            return _joined(rows)
        data, offsets = X.column_bytes(column)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        padded = np.zeros(len(data) + 8, np.uint8)
        data = X.LOWER.take(data, out=padded[:len(data)], mode="clip")
        starts, ends, _ = X.words(data, offsets, _INSIDE)
        last = ends - 1
        marked = np.flatnonzero(_MARK.take(data.take(last)) & (last > starts))
        cut, at = ends[marked], np.arange(len(marked))  # without the marks behind a word
        while len(at):
            cut[at] -= 1
            at = at[_MARK[data[cut[at] - 1]] & (cut[at] - 1 > starts[marked[at]])]
        last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
        apart = _LETTER[last] | (_ACCENT[last] & (before == 0xC3) & (cut - starts[marked] > 1))
        at, cut = marked[apart], cut[apart]
        a = np.insert(starts, at + 1, cut)
        b = np.insert(ends, at, cut)
        start, length = self._found(data, a, b, _hashes(padded, a, b))
        end = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(start - end[:-1], length)
        at += np.arange(end[-1])
        return self.ids.take(at), end[np.searchsorted(a, offsets)]


def _hashes(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces from ``a`` to ``b``; eight bytes follow the last text."""
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # of eight bytes, at every byte
    left = b - a
    found = X.mix((words[a] & _BYTES.take(np.minimum(left, 8))) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero((left > 8) & (left <= SHORT))
    at, left = a.take(more), left.take(more)
    while len(more):
        at, left = at + 8, left - 8
        found[more] = X.mix(found.take(more) ^ (words[at] & _BYTES.take(np.minimum(left, 8))))
        rest = np.flatnonzero(left > 8)
        more, at, left = more.take(rest), at.take(rest), left.take(rest)
    long = np.flatnonzero(b - a > SHORT)
    if len(long):
        found[long] = X.span_hash(X.prefix_hash(padded), a.take(long), b.take(long))
    return found


def _merged(one: tuple, more: tuple) -> tuple:
    """Two tables of sorted hashes as one."""
    at = np.searchsorted(one[0], more[0])
    return tuple(np.insert(x, at, y) for x, y in zip(one, more))


def _joined(rows) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.asarray(r, np.uint32) for r in rows]
    return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum([len(r) for r in ids])]).astype(np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path)
