"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

A segment's header lists its ids and how often each occurs. A block holds up to ``BLOCK`` ids
and starts from that table alone, so it stands by itself given the header. For each id three
predictors are mixed: the id that last followed the same two ids, the id that last followed
the same id, and order 0. Inside a segment an id is its rank by frequency. Order 0 codes the id's class (one for each of the ``OWN`` most
frequent ids, the rest by rank, of like weight) with frequencies that adapt to the block's
own ids, then the id inside its class. The mixture's shares adapt to how often each
predictor was right in the block, for each pair of the two predictions' confidences. The
mixture drives a 64-bit range coder that puts out 32-bit words; carries are settled at the
end.

All blocks of a segment are coded in step: step t handles id t of every block with numpy, so
the cost of an operation is shared by as many ids as there are blocks. The state of a block
is small, and what is looked up often stands together for all blocks, so that most of it
stays in a core's cache. What adapts is counted anew after ``RENEWALS`` ids, then every ``EPOCH`` ids; the two predictors change with each id.

A coded segment is: magic, ids, blocks, distinct ids, bytes of the packed header, crc32 of
these numbers' last four and the packed header; the header (ids as 16-bit, counts as 32-bit
numbers, deflated); a directory of (ids, words, crc32 of the ids as little-endian 32-bit
numbers) for each block; the blocks' words. No ids make a segment without blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = 0x33444943
BLOCK, EPOCH, RENEWALS = 4096, 512, (32, 128, 512)
SLOTS_BITS = 9  # places of a context's table
MIX_BITS, CLASS_BITS, ID_BITS = 10, 11, 11
CLASSES, OWN = 128, 64
#: Ids are below this number.
IDS = 1 << 16
#: Weights of the header's table against one id of the block: 256 ids.
PRIOR, STEP = 4096, 16

#: Blocks whose ids are turned into ranks, or back, at once.
TILE = 64
_HASH, _HASH_BEFORE = np.uint32(2654435761), np.uint32(3266489917)
#: A block's first shares of order 2, order 1 and order 0 in 64, for each pair of confidences (0 to 3 of order 2, then of order 1).
START = np.array([(0, 0, 64), (0, 2, 62), (0, 10, 54), (0, 32, 32), (6, 0, 58), (4, 2, 58), (4, 10, 50), (4, 24, 36),
                  (40, 0, 24), (36, 2, 26), (30, 14, 20), (28, 18, 18), (60, 0, 4), (56, 1, 7), (48, 8, 8), (44, 12, 8)], np.uint32).T
#: Outcomes that a pair of confidences allows: no share without a prediction.
OPEN = np.array([(s >= 4, s % 4 > 0, True) for s in range(16)], np.uint32).T


class _Order0:
    """Classes of ids by frequency, and the ids inside each: the same for all blocks of a segment."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts))
        #: ids by rank; the rank after the last stands for no prediction, and takes two bits less than an entry.
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.int64)
        self.none = n = len(ids)
        self.type = np.uint16 if n < 1 << 14 else np.uint32
        classes = np.arange(n)
        # by weight, and so that no class has more than 1 << ID_BITS ids
        weight = counts[OWN:] * IDS // max(int(counts.sum()), 1) + 2
        before = np.cumsum(weight) - weight
        classes[OWN:] = OWN + before * (CLASSES - OWN) // max(int(weight.sum()), 1)
        total = np.bincount(classes, counts, CLASSES).astype(np.int64)
        self.prior = (total * PRIOR // max(int(total.sum()), 1)).astype(np.uint32)
        members = np.bincount(classes, minlength=CLASSES)
        freq = 1 + counts * ((1 << ID_BITS) - members)[classes] // total[classes]
        first = np.flatnonzero(np.diff(classes, prepend=-1))
        freq[first] += (1 << ID_BITS) - np.add.reduceat(freq, first)
        low = np.cumsum(freq) - freq & (1 << ID_BITS) - 1  # classes fill whole powers of two
        # the class CLASSES and the rank ``none`` stand for ids that order 0 doesn't code: the whole range is theirs
        self.classes = np.append(classes, CLASSES)
        self.ranges = np.append(low | freq << 16, 1 << ID_BITS << 16).astype(np.uint32)
        self.symbol = np.zeros((CLASSES + 1) << ID_BITS, self.type)
        place = np.unique(classes)
        rows = self.symbol.reshape(CLASSES + 1, -1)
        rows[place], rows[CLASSES] = np.repeat(np.arange(n), freq).reshape(len(place), -1), n


class _Model:
    """State of all blocks: tables of predictions, shares of the mixture, frequencies of classes."""

    def __init__(self, n: int, order0: _Order0, decoding: bool):
        self.order0, self.decoding, self.wide = order0, decoding, np.intp(n)
        self.shrink(n)
        # by order 2, then by order 1: rank << 2 and confidence
        self.entries = np.full(2 * n << SLOTS_BITS, order0.none << 2, order0.type)
        self.right = np.repeat(START[:, :, None], n, axis=2)
        self.counts = np.repeat(order0.prior[:, None], n, axis=1)
        # places in the tables of ranges that were looked up since these were made
        self.seen_class, self.seen_state = np.empty((EPOCH, n), np.uint32), np.empty((EPOCH, n), np.uint32)
        self.last = np.zeros(n, order0.type)
        self.before = np.zeros(n, np.uint32)
        self.since = 0
        self.tables()

    def shrink(self, n: int) -> None:
        """Keep the first ``n`` blocks: those that still have ids."""
        self.n, self.block, self.slots = n, np.arange(n), np.arange(n) << CLASS_BITS
        self.lanes = np.arange(n, dtype=np.uint32) + np.array([[0], [self.wide << SLOTS_BITS]], np.uint32)
        self.key = np.empty((2, n), np.uint32)
        for name in ("last", "before"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[:n])

    def tables(self) -> None:
        """Shares and frequencies from what was counted; they add up to 2 ** MIX_BITS and 2 ** CLASS_BITS."""
        share = (self.right * ((1 << MIX_BITS) - 3) // self.right.sum(axis=0, dtype=np.uint32) + 1) * OPEN[:, :, None]
        share[2] += (1 << MIX_BITS) - share.sum(axis=0, dtype=np.uint32)
        low = np.cumsum(share, axis=0, dtype=np.uint32) - share
        self.mixed = (low | share << 16).ravel()
        freq = self.counts * ((1 << CLASS_BITS) - CLASSES) // np.maximum(self.counts.sum(axis=0, dtype=np.uint32), 1) + 1
        blocks = np.arange(freq.shape[1])
        freq[np.argmax(freq, axis=0), blocks] += (1 << CLASS_BITS) - freq.sum(axis=0, dtype=np.uint32)
        ranges = np.full((CLASSES + 1, len(blocks)), 1 << CLASS_BITS << 16, np.uint32)
        ranges[:CLASSES] = np.cumsum(freq, axis=0, dtype=np.uint32) - freq | freq << 16
        self.ranges = ranges.ravel()
        if self.decoding:
            self.limits = (low[1] | low[2] << 16).ravel()
            self.symbol = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), len(blocks)), freq.T.ravel())

    def renew(self, t: int) -> None:
        """At the start of step t: count what the last steps saw, where it is time."""
        if not t or (t % EPOCH and t not in RENEWALS):
            return
        for seen, counted, weight in ((self.seen_class, self.counts, STEP), (self.seen_state, self.right, 1)):
            found = np.bincount(seen[:t - self.since, :self.n].ravel(), minlength=counted.size)
            counted += found[:counted.size].astype(np.uint32).reshape(counted.shape) * weight
        self.since = t
        self.tables()

    def predict(self) -> None:
        """Predictions of order 2 and order 1, and the pair of their confidences, at the next id of each block."""
        # One type inside an operation, and places as numpy takes them: mixed ones are converted piece by piece.
        last, key = self.last.astype(np.uint32), self.key
        np.right_shift(last * _HASH + self.before, 32 - SLOTS_BITS, out=key[0])
        np.bitwise_and(last, (1 << SLOTS_BITS) - 1, out=key[1])  # frequent ids have a place each
        key *= np.uint32(self.wide)
        key += self.lanes
        self.at = key.astype(np.intp)
        self.before = last * _HASH_BEFORE
        entries = self.entries.take(self.at)
        self.ranks, self.sure = entries >> 2, entries & 3
        self.pair_at = ((self.sure[0] << 2) + self.sure[1] * (self.ranks[0] != self.ranks[1])) * self.wide + self.block

    def mix(self, not2: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """Ranges of the outcomes: 0 where order 2 holds, 1 where order 1 does (``not2``), 2 where order 0 codes the id (``coded`` too)."""
        self.state_at = (not2.view(np.uint8) + coded.view(np.uint8)) * (self.wide * 16) + self.pair_at
        return self.mixed.take(self.state_at)

    def ranges_of(self, classes: np.ndarray) -> np.ndarray:
        self.class_at = classes * self.wide + self.block
        return self.ranges.take(self.class_at)

    def update(self, t: int, ranks: np.ndarray, right: np.ndarray) -> None:
        """right: which predictions hold."""
        self.seen_class[t - self.since, :self.n] = self.class_at
        self.seen_state[t - self.since, :self.n] = self.state_at
        entries = np.minimum(self.sure, 2) * right
        entries += (ranks << 2) + 1
        self.entries[self.at] = entries
        self.last = ranks


def narrow(ids: np.ndarray) -> np.ndarray:
    """``ids`` as 16-bit numbers."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    return np.ascontiguousarray(ids, "<u2")


def encode(ids: np.ndarray) -> bytes:
    """Code ``ids`` as one segment."""
    ids = narrow(ids)
    n = -(-len(ids) // BLOCK)
    counts = np.zeros(IDS, np.int64)
    for i in range(0, n, TILE):
        counts += np.bincount(ids[i * BLOCK:(i + TILE) * BLOCK], minlength=IDS)
    used_ids = np.flatnonzero(counts)
    header = zlib.compress(used_ids.astype("<u2").tobytes() + counts[used_ids].astype("<u4").tobytes())
    numbers = struct.pack("<IIII", len(ids), n, len(used_ids), len(header))
    start = struct.pack("<I", MAGIC) + numbers + struct.pack("<I", zlib.crc32(numbers + header)) + header
    if not n:
        return start
    lengths = np.full(n, BLOCK)
    lengths[-1] = len(ids) - BLOCK * (n - 1)
    order0 = _Order0(used_ids, counts[used_ids])
    rank = np.zeros(len(counts), np.uint16)
    rank[order0.ids] = np.arange(order0.none)
    steps = np.zeros((BLOCK, n), np.uint16)
    for i in range(0, n, TILE):
        own = rank.take(ids[i * BLOCK:(i + TILE) * BLOCK])
        whole = len(own) // BLOCK
        steps[:, i:i + whole] = own[:whole * BLOCK].reshape(whole, BLOCK).T
        if len(own) > whole * BLOCK:
            steps[:lengths[-1], -1] = own[whole * BLOCK:]
    model = _Model(n, order0, False)
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    # all blocks' words of a place stand together, as blocks advance alike; place 0 takes a last carry
    words = np.zeros((BLOCK + 3, n), np.uint64)
    flat, used = words.reshape(-1), np.arange(n, 2 * n)
    live = n
    for t in range(int(lengths.max())):
        if t == lengths[-1] and live == n:
            live = n - 1
            model.shrink(live)
            keep_low = low[live:].copy()
            low, span = low[:live], span[:live]
        model.renew(t)
        own = steps[t, :live].astype(order0.type, copy=False)
        model.predict()
        right = model.ranks == own
        hit = right[0] | right[1]
        place = own.astype(np.intp)
        np.putmask(place, hit, order0.none)
        classes = order0.classes.take(place)
        entry = model.mix(~right[0], ~hit)
        span >>= MIX_BITS
        add = span * (entry & 0xFFFF)
        span *= entry >> 16
        for entry, bits in ((model.ranges_of(classes), CLASS_BITS), (order0.ranges.take(place), ID_BITS)):
            span >>= bits
            add += span * (entry & 0xFFFF)
            span *= entry >> 16
        low += add
        over = np.flatnonzero(low < add)
        if len(over):
            flat[used.take(over) - n] += 1
        out = np.flatnonzero(span < 1 << 32)
        left, place = low.take(out), used.take(out)
        flat[place] = left >> 32
        used[out] = place + n
        low[out] = left << 32
        span[out] = span.take(out) << 32
        model.update(t, own, right)
    if live < n:
        low = np.concatenate([low, keep_low])
    for shift in (32, 0):
        flat[used] = (low >> shift) & 0xFFFFFFFF
        used += n
    used //= n
    most = int(used.max())
    for k in range(most - 1, 0, -1):
        words[k - 1] += words[k] >> 32
        words[k] &= 0xFFFFFFFF
    directory = np.empty((n, 3), "<u4")
    directory[:, 0], directory[:, 1] = lengths, used - 1
    directory[:, 2] = [zlib.crc32(ids[BLOCK * i:BLOCK * (i + 1)].astype("<u4")) for i in range(n)]
    return start + directory.tobytes() + words[1:most].T.astype("<u4")[np.arange(1, most)[None, :] < used[:, None]].tobytes()


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if the header's or a block's checksum is wrong."""
    magic, total, n, distinct, size, check = struct.unpack_from("<IIIIII", segment)
    if magic != MAGIC:
        raise ValueError("not a segment of ids")
    if zlib.crc32(bytes(memoryview(segment)[4:20]) + bytes(memoryview(segment)[24:24 + size])) != check:
        raise ValueError("the header is damaged")
    if not n:
        return np.empty(0, np.uint32)
    header = zlib.decompress(bytes(memoryview(segment)[24:24 + size]))
    order0 = _Order0(np.frombuffer(header, "<u2", distinct), np.frombuffer(header, "<u4", distinct, 2 * distinct))
    at = 24 + size
    directory = np.frombuffer(segment, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
    lengths = directory[:, 0]
    if int(lengths.sum()) != total or (lengths[:-1] != BLOCK).any():
        raise ValueError("the directory is damaged")
    stream = np.concatenate([np.frombuffer(segment, "<u4", offset=at + 12 * n), np.zeros(2, np.uint32)])
    at = np.cumsum(directory[:, 1]) - directory[:, 1]
    if int(directory[:, 1].sum()) != len(stream) - 2:
        raise ValueError("the directory is damaged")
    code = (stream[at].astype(np.uint64) << 32) | stream[at + 1]
    at = at + 2
    span = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model = _Model(n, order0, True)
    out = np.zeros((BLOCK, n), np.uint16)
    live = n
    # a damaged block may divide by nothing or look beyond a table, before its checksum tells
    with np.errstate(divide="ignore"):
        for t in range(int(lengths.max())):
            if t == lengths[-1] and live == n:
                live = n - 1
                model.shrink(live)
                code, span, at = code[:live], span[:live], at[:live]
            model.renew(t)
            model.predict()
            limits = model.limits.take(model.pair_at)
            span >>= MIX_BITS
            not2, coded = code >= span * (limits & 0xFFFF), code >= span * (limits >> 16)
            entry = model.mix(not2, coded)
            code -= span * (entry & 0xFFFF)
            span *= entry >> 16
            span >>= CLASS_BITS
            place = (code // span).view(np.intp)
            place += model.slots
            found = model.symbol.take(place, mode="clip")
            np.putmask(found, ~coded, CLASSES)
            classes = found.astype(np.intp)
            entry = model.ranges_of(classes)
            code -= span * (entry & 0xFFFF)
            span *= entry >> 16
            span >>= ID_BITS
            place = (code // span).view(np.intp)
            place += classes << ID_BITS
            found = order0.symbol.take(place, mode="clip")
            entry = order0.ranges.take(found)
            code -= span * (entry & 0xFFFF)
            span *= entry >> 16
            ranks = model.ranks[0].copy()
            np.putmask(ranks, not2, model.ranks[1])
            np.putmask(ranks, coded, found)
            out[t, :live] = ranks
            more = np.flatnonzero(span < 1 << 32)
            place = at.take(more)
            code[more] = (code.take(more) << 32) | stream.take(place, mode="clip")
            at[more] = place + 1
            span[more] = span.take(more) << 32
            model.update(t, ranks, model.ranks == ranks)
    del model, stream
    ids = np.empty(total, np.uint32)
    for i in range(0, n, TILE):
        own = out[:, i:i + TILE].T.ravel()[:total - i * BLOCK]
        ids[i * BLOCK:i * BLOCK + len(own)] = order0.ids.take(own, mode="clip")
    del out
    raw = memoryview(ids).cast("B")
    for i, check in enumerate(directory[:, 2].tolist()):
        if zlib.crc32(raw[4 * BLOCK * i:4 * BLOCK * (i + 1)]) != check:
            raise ValueError(f"block {i} is damaged")
    return ids
