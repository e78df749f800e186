"""Canonical Huffman codes of limited length, coded and decoded in whole arrays."""

from __future__ import annotations

import numpy as np

#: Longest code; decoding tables have 2**MOST_BITS entries.
MOST_BITS = 20
#: Ids between two checkpoints: lanes of this length are decoded side by side.
LANE = 64


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal lengths of at most ``most`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(weights))
        merged = merged[place]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    # of the last list 2n - 2 entries are taken; packages among them take twice as many below
    take, lengths = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, ids ascending within a length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.bits = int(self.lengths.max(initial=1))
        used = np.flatnonzero(self.lengths)
        self.order = used[np.lexsort((used, self.lengths[used]))]
        spans = (1 << (self.bits - self.lengths[self.order].astype(np.int64))).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(spans)])[:-1] if len(spans) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[self.order] = (starts >> (self.bits - self.lengths[self.order].astype(np.int64))).astype(np.uint32)
        self._spans, self._table = spans, None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for each value of the next ``bits`` bits."""
        if self._table is None:
            ids = np.zeros(1 << self.bits, np.uint32)
            lens = np.ones(1 << self.bits, np.uint8)
            n = int(self._spans.sum())
            ids[:n] = np.repeat(self.order.astype(np.uint32), self._spans)
            lens[:n] = np.repeat(self.lengths[self.order], self._spans)
            self._table = ids, lens
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string of ``ids`` and the bit offset of every LANE-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        lens = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lens)
        at = ends - lens
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        code = self.codes[ids].astype(np.uint64) << (64 - lens).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[first]] = np.bitwise_or.reduceat(code >> bit, first)
        # of the codes that begin in a word at most one, the last, runs over into the next
        over = np.flatnonzero((at & 63) + lens > 64)
        out[word[over] + 1] |= code[over] << (np.uint64(64) - bit[over])
        return out.byteswap().tobytes()[: (int(ends[-1]) + 7) // 8], at[::LANE].astype(np.uint32)

    def decode(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block: a step decodes one id in every lane by table."""
        table, lens = self.table()
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
        at = marks.astype(np.int64)
        out = np.zeros((LANE, len(marks)), np.uint32)
        shift = np.uint64(32 - self.bits)
        for step in range(LANE):
            live = (n - step + LANE - 1) // LANE
            if live <= 0:
                break
            at = at[:live]
            byte, bit = at >> 3, (at & 7).astype(np.uint64)
            word = (raw[byte] << np.uint64(32)) | (raw[byte + 1] << np.uint64(24)) | (raw[byte + 2] << np.uint64(16)) | (raw[byte + 3] << np.uint64(8)) | raw[byte + 4]
            value = (((word >> (np.uint64(8) - bit)) & np.uint64(0xFFFFFFFF)) >> shift).astype(np.int64)
            out[step, :live] = table[value]
            at = at + lens[value]
        return out.T.reshape(-1)[:n]
