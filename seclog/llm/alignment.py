"""Alignment of two tokenizers' tokens over the bytes of each text.

Both vocabularies cut the same bytes, so the tokens of one text are two rows of intervals.
Where a token of each ends at the same byte, a group ends.

Groups come from pointer jumping: every token points to its farthest-right overlapping
token, itself if none reaches farther (of two that end together, the second vocabulary's
counts as farther). The pointers of a whole batch are doubled at once, ``p = p[p]``, until
nothing changes; each token then points to the terminal token of its group, which labels it.
A chain of n tokens takes log2(n) doublings.

Texts are cut before each space that follows another character. No token of either
vocabulary reaches over such a cut (checked when the vocabularies are loaded), so a cut ends
a group too, and each worker keeps the ids, links and groups of the pieces it has met: at most
``KEEP`` of them and ``KEEP_BYTES`` of text. A kept piece is used only where its bytes are
those of the text. Texts with a piece that one vocabulary does not give back byte for byte
are encoded whole.

Counts over the corpus: each text holds its distinct linked id pairs, counted where they are,
summed by pair, and the highest of each first id found among its pairs. Pairs are distributed
as words are, so the ``frequent`` most frequent ones, a fixed number, are broadcast, and only texts'
other pairs meet their counts in a join. No pair is left out, and no frequent one is a join key.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from seclog.llm import text as X
from seclog.llm.store import Scratch

KEEP, KEEP_BYTES = 600_000, 16 << 20
TOGETHER = 4096
#: Id pairs whose counts are broadcast: 13 bytes each.
FREQUENT = 1_000_000
#: Pairs that a task counts before it hands them on.
COUNTED = 2_000_000

_SPACE = np.uint8(32)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pointers(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each token, the first vocabulary's and then the second's, its farthest-right overlapping token.

    Ends rise and the tokens of each cover all bytes, so the other token that holds a
    token's last byte reaches as far as any that overlaps it.
    """
    n = len(a_end)
    to_b = n + np.searchsorted(b_end, a_end, "left")
    to_a = np.searchsorted(a_end, b_end, "left")
    return np.concatenate([to_b, np.where(a_end[to_a] > b_end, to_a, n + np.arange(len(b_end)))])


def terminals(pointer: np.ndarray) -> np.ndarray:
    """Terminal token of each token's group, by doubling."""
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer
        pointer = farther


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs (first token, second token) in byte order: between two neighbouring ends lie bytes of one pair."""
    ends = np.union1d(a_end, b_end)
    return np.searchsorted(a_end, ends, "left"), np.searchsorted(b_end, ends, "left")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of the spaces that follow a character other than white space.

    White space beyond ASCII starts with C2, E1 9A, E2 80, E2 81 or E3 80; behind these nothing is cut.
    """
    at = np.flatnonzero(data == _SPACE)
    at = at[at > 0]
    before, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((second == 0xC2) | ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((third == 0xE3) & (second == 0x80)))
    return at[((before > 32) & (before < 127)) | ((before > 127) & ~wide)]


class Aligner:
    """Both vocabularies and the pieces met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        a_bytes = [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names]
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.width = self.second.get_piece_size()
        b_bytes = [bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
                   for i in range(self.width)]
        if len(a_bytes) * self.width > 1 << 32:
            raise ValueError("an id pair must fit 32 bits")
        self.a, self.b = _Bytes(a_bytes), _Bytes(b_bytes)
        self.written = [b"%d%c" % (i, mark) for i in range(max(len(a_bytes), self.width)) for mark in b",|;"]
        self.ranks = _ranked(byte_path, a_bytes)
        if self.ranks is not None and self.first(_PROBES) != self._by_library(_PROBES):
            self.ranks = None
        self.cuts = self._cuts_hold()
        self._forget()

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def first(self, texts: list[str]) -> list[list[int]]:
        """The first vocabulary's ids of texts with their space in front."""
        return self._by_library(texts) if self.ranks is None else [self.ranks.encode_ordinary(t) for t in texts]

    def _cuts_hold(self) -> bool:
        """Whether no token of either vocabulary holds a cut, and neither looks over one."""
        if any(len(cuts(np.frombuffer(x, np.uint8))) for v in (self.a, self.b) for x in v.tokens if b" " in x.lstrip(b" ")):
            return False
        parts = [" Don't", "  stop,", " me", " 12", " now.", " été", " 中文", " x"]
        return all(sum(ids(parts), []) == ids(["".join(parts)])[0] for ids in (self.first, self._seconds))

    def _seconds(self, texts: list[str]) -> list[list[int]]:
        """The second vocabulary's ids; it adds the space itself."""
        return self.second.encode([t[1:] for t in texts], num_threads=1)

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes, and the number of each piece
        self.number = np.empty(0, np.int64)
        self.exact = np.empty(0, bool)
        self.sizes = np.empty((0, 4), np.int64)  # tokens of each vocabulary, groups, links
        self.groups: list[bytes] = []
        self.raw, self.raw_at = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.pair, self.pair_at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts both vocabularies give back byte for byte, and all ids of those."""
        names = [t.decode() for t in texts]
        a, a_at = _flat(self.first(names))
        b, b_at = _flat(self._seconds(names))
        ends = np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        good = self.a.gives(a, a_at, raw, ends) & self.b.gives(b, b_at, raw, ends)
        return good, a[np.repeat(good, np.diff(a_at))], b[np.repeat(good, np.diff(b_at))]

    def align(self, pieces: list[bytes], alone: bool = False) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of pieces with their space in front, in the order given back: whether both vocabularies give back their
        bytes, (tokens, tokens, groups, links), the groups as text, all linked pairs.

        Pieces that end where a cut may follow are encoded together, ``TOGETHER`` bytes at a time, unless ``alone``.
        """
        order, exact, sizes, texts, pairs = [], [], [], [], []
        todo = [[i] for i in range(len(pieces))] if alone else _bundles(pieces)
        while todo:
            good, a, b = self._tokens([b"".join([pieces[i] for i in bundle]) for bundle in todo])
            own = [i for bundle, g in zip(todo, good) if g for i in bundle]
            found, names, linked = self._groups(a, b, np.cumsum([len(pieces[i]) for i in own]))
            order, exact = order + own, exact + [True] * len(own)
            sizes.append(found)
            texts += names
            pairs.append(linked)
            lost = [bundle for bundle, g in zip(todo, good) if not g]
            single = [bundle[0] for bundle in lost if len(bundle) == 1]
            order, exact, texts = order + single, exact + [False] * len(single), texts + [b""] * len(single)
            sizes.append(np.zeros((len(single), 4), np.int64))
            todo = [[i] for bundle in lost if len(bundle) > 1 for i in bundle]
        return (order, np.array(exact, bool), np.concatenate([np.empty((0, 4), np.int64), *sizes]), texts, np.concatenate([np.empty(0, np.uint32), *pairs]))

    def _groups(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Sizes, groups as text and linked pairs of pieces that end at ``ends``, from all their ids."""
        if not len(ends):
            return np.empty((0, 4), np.int64), [], np.empty(0, np.uint32)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        label = terminals(pointers(a_end, b_end))
        last, group = np.unique(label, return_inverse=True)  # terminal tokens, in byte order
        a_group, b_group = group[:len(a)], group[len(a):]
        a_stop, b_stop = (np.searchsorted(g, np.arange(len(last)), "right") for g in (a_group, b_group))
        written = np.empty(len(a) + len(b), np.int64)  # each group's first ids, then its second ones
        written[np.arange(len(a)) + np.append(0, b_stop)[a_group]] = a * 3 + (np.arange(len(a)) == a_stop[a_group] - 1)
        written[np.arange(len(b)) + a_stop[b_group]] = b * 3 + 2 * (np.arange(len(b)) == b_stop[b_group] - 1)
        left, right = links(a_end, b_end)
        at = [np.append(0, np.searchsorted(x, ends, "right")) for x in (a_end, b_end, b_end[last - len(a)], np.minimum(a_end[left], b_end[right]))]
        marks, bounds = list(map(self.written.__getitem__, written.tolist())), (at[0] + at[1]).tolist()
        texts = [b"".join(marks[i:j]) for i, j in zip(bounds, bounds[1:])]
        return np.stack([np.diff(x) for x in at], axis=1), texts, (a[left] * self.width + b[right]).astype(np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Keep new pieces; ``hashes`` are sorted."""
        order, exact, sizes, texts, pairs = self.align(pieces)
        number = np.empty(len(pieces), np.int64)
        number[order] = len(self.groups) + np.arange(len(pieces))
        at = np.searchsorted(self.known, hashes)
        self.known, self.number = np.insert(self.known, at, hashes), np.insert(self.number, at, number)
        self.groups += texts
        self.exact, self.sizes = np.concatenate([self.exact, exact]), np.concatenate([self.sizes, sizes])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)])
        self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum([len(pieces[i]) for i in order])])
        self.pair = np.concatenate([self.pair, pairs])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(sizes[:, 3])])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text of a batch: sizes and groups as text; all texts' distinct pairs (sorted), how often each is linked, and where a text's start."""
        full = np.diff(offsets) > 0
        if not self.cuts:
            at = np.flatnonzero(full)
            return self._whole(at, data, offsets, np.zeros((len(full), 4), np.int64), [b""] * len(full), np.empty(0, np.uint64))
        # a space in front of every text that is not empty
        starts = offsets[:-1] + np.concatenate([[0], np.cumsum(full)])[:-1]
        spaced = np.insert(data, offsets[:-1][full], _SPACE)
        cut = np.union1d(cuts(spaced), starts[full])
        ends = np.append(cut[1:], len(spaced))
        hashes = X.span_hash(X.prefix_hash(spaced), cut, ends)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.groups) + len(distinct) > KEEP or len(self.raw) > KEEP_BYTES:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != distinct[~new]
        if new.any():
            raw = spaced.tobytes()
            self._learn(distinct[new], [raw[cut[i]:ends[i]] for i in one[new].tolist()])
            place = np.searchsorted(self.known, distinct)
        piece = self.number[place][back]
        sure = self.exact[piece] & ((self.raw_at[1:] - self.raw_at[:-1])[piece] == ends - cut)
        same = np.zeros(len(spaced), bool)
        covered = np.repeat(sure, ends - cut)
        same[covered] = self.raw[_ranges(self.raw_at[piece[sure]], (ends - cut)[sure])] == spaced[covered]
        sure &= np.logical_and.reduceat(same, cut) if len(cut) else sure
        first = np.searchsorted(cut, np.append(starts, len(spaced)))  # an empty text has no pieces
        odd = np.zeros(len(full), bool)
        odd[np.searchsorted(first, np.flatnonzero(~sure), "right") - 1] = True
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[piece], axis=0)])
        sizes = total[first[1:]] - total[first[:-1]]
        order, bounds = list(map(self.groups.__getitem__, piece.tolist())), first.tolist()
        texts = [b"".join(order[i:j]) for i, j in zip(bounds, bounds[1:])]
        kept = np.repeat(~odd, np.diff(first))
        row = np.repeat(np.arange(len(full)), np.diff(first))[kept]
        piece = piece[kept]
        per = (self.pair_at[1:] - self.pair_at[:-1])[piece]
        keys = (np.repeat(row, per).astype(np.uint64) << np.uint64(32)) | self.pair[_ranges(self.pair_at[piece], per)].astype(np.uint64)
        return self._whole(np.flatnonzero(odd), data, offsets, sizes, texts, keys)

    def _whole(self, at, data, offsets, sizes, texts, keys):
        """Encode the texts ``at`` whole, and count all texts' pairs."""
        if len(at):
            order, _, found, names, pairs = self.align([b" " + data[offsets[i]:offsets[i + 1]].tobytes() for i in at.tolist()], alone=True)
            place = at[order]
            sizes[place] = found
            for i, name in zip(place.tolist(), names):
                texts[i] = name
            keys = np.concatenate([keys, (np.repeat(place, found[:, 3]).astype(np.uint64) << np.uint64(32)) | pairs.astype(np.uint64)])
        keys, times = np.unique(keys, return_counts=True)
        return sizes, [t[:-1] for t in texts], keys.astype(np.uint32), times.astype(np.uint32), np.searchsorted(keys >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def gives(self, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text's ids, joined, are its bytes."""
        size = self.size[ids]
        good = np.diff(np.append(0, np.cumsum(size))[at]) == np.diff(ends)
        mine = np.repeat(good, np.diff(at))
        theirs = np.repeat(good, np.diff(ends))
        same = self.raw[_ranges(self.start[ids[mine]], size[mine])] == raw[theirs]
        wrong = np.repeat(np.flatnonzero(good), np.diff(ends)[good])[~same]
        good[wrong] = False
        return good


_PROBES = [" Don't  stop,\n\n me12 now. \tété 中文 x", " I'LL we'll 3.14 -- _a_  ", " \u00a0 \u3000x \U0001f600\u200d!", " <|endoftext|>"]
#: How byte-level vocabularies of this kind part a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str, tokens: list[bytes]):
    """The byte-level vocabulary as merge ranks for the faster ``tiktoken``, if its ids rise in the order of its merges; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if [model["vocab"].get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {tokens[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bundles(pieces: list[bytes]) -> list[list[int]]:
    """Pieces to encode together; one that doesn't end where a cut may follow is the last of its bundle."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0, *map(len, pieces)])[1:-1]
    apart = np.isin(starts, cuts(raw), invert=True) | (np.diff(np.append(0, starts) // TOGETHER) > 0)
    at = [0, *(np.flatnonzero(apart) + 1).tolist(), len(pieces)]
    return [list(range(i, j)) for i, j in zip(at, at[1:]) if j > i]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the rows, and where each row starts and ends in them."""
    return np.fromiter(itertools.chain.from_iterable(rows), np.int64), np.cumsum([0, *map(len, rows)])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each length, one after the other."""
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)


@functools.cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker and pair of vocabularies."""
    return Aligner(byte_path, piece_path)


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of ``docs`` (doc_id, text).

    groups: ids of both vocabularies as ``a1,a2|b1;a3|b2,b3``. pairs, times: the distinct
    linked id pairs, a * (size of the second vocabulary) + b, and how often the text links them,
    as little-endian unsigned 32-bit numbers. A text that is null, empty, or not given back by
    both vocabularies has none: zeros and empty texts. Texts are read whole; repeated rows and null ids stay.
    """
    default = default_vocabularies()
    paths = (byte_path or default[0], piece_path or default[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text"):
                sizes, texts, pairs, times, at = both.rows(data, offsets)
                yield pa.record_batch(
                    [rows.column(0), *(pa.array(sizes[:, i]) for i in range(4)), pa.array(texts, pa.binary()).cast(pa.string()),
                     _binary(pairs, at), _binary(times, at)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many texts each id pair is linked, and whether no pair of its first id is linked in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([*held, np.empty(0, np.uint32)]), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            held.append(_numbers(batch.column(0))[0])
            size += len(held[-1])
            if size > COUNTED:
                yield emit()
                size = 0
        if held:
            yield emit()

    counted = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(W.partitionBy((F.col("pair") / width).cast("long")))  # at most ``width`` pairs
    return counted.select("pair", "n", (F.col("n") == highest).alias("best"))


def _binary(numbers: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(numbers)])


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of a binary column, and where each row starts and ends in them."""
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int32, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[at[0]:at[-1]] if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return raw.copy().view(np.uint32), (at - at[0]) // 4


def _frequent(counts: DataFrame, most: int) -> tuple[int, int, int]:
    """(least count, pairs with it or more, all pairs): whole classes of counts by bit length, at most ``most`` pairs."""
    classes = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    total = sum(r.n for r in classes)
    least, held = 1 << 62, 0
    for r in sorted(classes, key=lambda r: -r.bits):
        if held + r.n > most:
            break
        least, held = 1 << (r.bits - 1), held + r.n
    return least, held, total


def report(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    A pair's count is the number of rows that hold it linked, so repeated rows and copies count each.
    n_best: links whose count is the highest of their first id, ties included; count_sum: over
    all links. Rows without tokens have zeros and '' as the checksum. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    default = default_vocabularies()
    paths = (byte_path or default[0], piece_path or default[1])
    width = aligner(*paths).width
    named = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256)).alias("groups_sha256")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    aligned = scratch.keep(align(docs, *paths).select(*plain[:-1], named, "pairs", "times"), "aligned")
    counts = scratch.keep(pair_counts(aligned, width), "counts")
    least, held, total = _frequent(counts, frequent)
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow() if held else None  # at most ``frequent`` rows
    shared = spark.sparkContext.broadcast(
        (top["pair"].to_numpy().astype(np.uint32), top["n"].to_numpy().copy(), pc.cast(top["best"], pa.int8()).to_numpy().astype(bool))
        if held else (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            keys, at = _numbers(batch.column("pairs"))
            times, _ = _numbers(batch.column("times"))
            times = times.astype(np.int64)
            place = np.searchsorted(pair, keys)
            there = place < len(pair)
            there[there] = pair[place[there]] == keys[there]
            place = place[there]
            add = np.zeros((2, len(keys) + 1), np.int64)
            add[0, 1:][there] = times[there] * best[place]
            add[1, 1:][there] = times[there] * n[place]
            add = np.cumsum(add, axis=1)
            rest_at = np.concatenate([[0], np.cumsum(~there)])[at].astype(np.int32)
            yield pa.record_batch(
                [*(batch.column(c) for c in plain), *(pa.array(x[at[1:]] - x[at[:-1]]) for x in add),
                 pa.ListArray.from_arrays(pa.array(rest_at), pa.array(keys[~there].astype(np.int64))),
                 pa.ListArray.from_arrays(pa.array(rest_at), pa.array(times[~there]))],
                [*plain, "n_best", "count_sum", "pairs", "times"])

    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, "
              "pairs array<long>, times array<long>")
    out = aligned.mapInArrow(run, schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if held == total:  # every pair was looked up
        return out.select(columns)
    out = scratch.keep(out.withColumn("row", F.monotonically_increasing_id()), "rest")
    rest = (out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            .join(counts.filter(F.col("n") < least), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")))
    return (out.join(rest, "row", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
            .select(columns))
