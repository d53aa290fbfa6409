"""K-mers of whole batches of reads as numpy arrays, two bits a base (A 0, C 1, G 2, T 3), first base highest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = np.frombuffer(b"ACGT", np.uint8)
#: Code of each byte; what is no base has OTHER.
OTHER = 4
CODE = np.full(256, OTHER, np.uint8)
CODE[BASES] = np.arange(4)
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[BASES] = BASES[::-1]
#: Base of each letter of any text, by its place in the alphabet; what is no letter has 0.
LETTER = np.zeros(256, np.uint8)
for _first in b"Aa":
    LETTER[_first : _first + 26] = BASES[np.arange(26) % 4]
#: The letters of four bases, by their codes.
FOUR = np.ascontiguousarray(BASES[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]).view(np.uint32).ravel()
#: Places of a piece in which a long read is worked on, and of one that stays in a core's cache.
PIECE, CACHED = 1 << 20, 1 << 16


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The id of the k codes from each place on, put together from ids of half the length."""
    if k == 1:
        return codes.astype(np.int64)
    half = k // 2
    part = rolling(codes, half)
    out = part[: len(codes) - 2 * half + 1] << (2 * half) | part[half:]
    return out[: len(codes) - k + 1] << 2 | codes[k - 1 :] if k % 2 else out


def both_strands(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the k-mers from each place on, and of their reverse complements."""
    return rolling(codes, k), rolling((3 - codes)[::-1], k)[::-1]


def reverse_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """Ids of the reverse complements."""
    x = (~np.asarray(ids, np.int64)).view(np.uint64).byteswap()
    for bits, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):  # the bases of a byte
        x = x >> np.uint64(bits) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(bits)
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each text begins and ends (null: empty)."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low, high = offsets[:-1].copy(), offsets[1:].copy()
    if raw.null_count:
        gone = raw.is_null().to_numpy(zero_copy_only=False)
        high[gone] = low[gone]
    return data, low, high


def letters_as_bases(column: pa.Array) -> pa.Array:
    """`sequences.dna` of a string column (null: null)."""
    data, low, high = texts_of(column)
    if not len(low):
        return pa.array([], pa.large_string())
    begin = int(low[0])
    bases = LETTER[data[begin : int(high.max())]]
    before = np.concatenate([[0], np.cumsum(bases != 0)])
    offsets = before[np.append(low, max(low[-1], high.max())) - begin]
    out = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(bases[bases != 0]))
    return pc.if_else(column.is_valid(), out, pa.scalar(None, pa.large_string()))


def owners(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in groups of these sizes: the group of each, and its place there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def places(data: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(read, place, forward id, reverse id) of each k-mer of bases only, in pieces of bounded size."""
    first = 0  # reads that lie next to each other go together
    while first < len(low):
        last = first + 1
        while last < len(low) and high[last] - low[first] <= PIECE:
            last += 1
        for a in range(int(low[first]), max(int(high[last - 1]) - k + 1, int(low[first])), PIECE):
            codes = CODE[data[a : min(a + PIECE + k - 1, int(high[last - 1]))]]
            if len(codes) < k:
                continue
            forward, reverse = both_strands(codes & 3, k)
            at = a + np.arange(len(forward))
            read = np.searchsorted(low[first:last], at, "right") - 1 + first
            inside = (at >= low[read]) & (at + k <= high[read])
            if (codes == OTHER).any():
                before = np.concatenate([[0], np.cumsum(codes == OTHER)])
                inside &= before[k:] == before[: len(forward)]
            inside = np.flatnonzero(inside)
            read = read[inside]
            yield read, at[inside] - low[read], forward[inside], reverse[inside]
        first = last


def ids_at(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The forward ids of the k-mers at some places of the data, and whether these have bases only; four bases at a time."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, bool)
    begin = int(at.min())
    codes, at = CODE[data[begin : int(at.max()) + k]], at - begin
    fine = np.ones(len(at), bool)
    if (codes == OTHER).any():
        before = np.concatenate([[0], np.cumsum(codes == OTHER)])
        fine = before[at + k] == before[at]
    codes &= 3
    two = codes[:-1] << 2 | codes[1:]
    four = two[:-2] << 4 | two[2:]
    ids = np.zeros(len(at), np.int64)
    for i in range(0, k - k % 4, 4):
        ids = ids << 8 | four[at + i]
    for i in range(k - k % 4, k):
        ids = ids << 2 | codes[at + i]
    return ids, fine


def marked(data: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, holds: Filter | None) -> np.ndarray:
    """The places of the data where a k-mer of one read begins, of bases only, that the filter may hold. Reads lie in order."""
    found = [np.empty(0, np.int64)]
    begin, end = (int(low[0]), int(high.max())) if len(low) else (0, 0)
    for a in range(begin, end - k + 1, CACHED):
        forward = rolling(CODE[data[a : min(a + CACHED + k - 1, end)]] & 3, k)
        found.append(a + (np.arange(len(forward)) if holds is None else holds.which(np.minimum(forward, reverse_ids(forward, k)))))
    at = np.concatenate(found)
    if not len(at):
        return at
    at = at[at + k <= high[np.searchsorted(low, at, "right") - 1]]
    bad = CODE[data[begin:end]] == OTHER
    if bad.any():
        before = np.concatenate([[0], np.cumsum(bad)])
        at = at[before[at - begin + k] == before[at - begin]]
    return at


def letters_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A row of n bases for each id, whose first base is in its highest bits."""
    out = np.empty((len(ids), -(-n // 4)), np.uint32)
    for i in range(out.shape[1]):
        out[:, i] = FOUR[ids >> np.uint64(56 - 8 * i) & np.uint64(255)]
    return np.ascontiguousarray(out.view(np.uint8)[:, :n])


def strings_of(ids: np.ndarray, k: int) -> pa.Array:
    """The k-mers as an Arrow string column."""
    letters = letters_of(ids.view(np.uint64) << np.uint64(64 - 2 * k), k)
    offsets = (np.arange(len(ids) + 1) * k).astype(np.int32)
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(letters))


def stretches(data: np.ndarray, low: np.ndarray, high: np.ndarray, reverse: bool = False) -> pa.Array:
    """Stretches of the bytes as an Arrow string column, or their reverse complements."""
    sizes = high - low
    owner, at = owners(sizes)
    picked = COMPLEMENT[data[high[owner] - 1 - at]] if reverse else data[low[owner] + at]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(picked)))


def mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


#: Bits of a hash below those that choose a part.
PART_BITS = 46


def by_part(ids: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ids in order, dealt to a power of two of parts by a hash: each part with its ids, and the places of these among all."""
    part = (mixed(ids) >> np.uint64(PART_BITS) & np.uint64(parts - 1)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short ones are sorted by digits
    order = np.argsort(part, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(some):
            yield int(part[some[0]]), some


def coded(ids: np.ndarray) -> bytes:
    """Growing ids as bytes that compress well: differences, their first bytes, then their second ones, and so on."""
    return np.diff(ids, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def decoded(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


class Filter:
    """A Bloom filter of ids with two bits each: `may_hold` is never false for an id that was put in. It has a power of two of
    slices, of `bits` each; an id has both bits in the slice of its part."""

    def __init__(self, bits: int, words: np.ndarray | None = None, slices: int = 1):
        self.bits, self.slices = bits, slices
        self.words = np.zeros(max(1, bits * slices >> 6), np.uint64) if words is None else words

    def _first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the slices of hashes begin, and their first bits."""
        begin = (x >> np.uint64(PART_BITS) & np.uint64(self.slices - 1)) * np.uint64(self.bits)
        return begin, begin + (x & np.uint64(self.bits - 1))

    def _second(self, begin: np.ndarray, x: np.ndarray) -> np.ndarray:
        return begin + (x >> np.uint64(23) & np.uint64(self.bits - 1))

    def _has(self, at: np.ndarray) -> np.ndarray:
        return self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)

    def put(self, ids: np.ndarray) -> None:
        x = mixed(ids)
        begin, first = self._first(x)
        for at in (first, self._second(begin, x)):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).view(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def which(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids that may be held. Second bits are asked only of those that have the first."""
        x = mixed(ids)
        begin, first = self._first(x)
        some = np.flatnonzero(self._has(first))
        return some[np.flatnonzero(self._has(self._second(begin[some], x[some])))]

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        out[self.which(ids)] = True
        return out
