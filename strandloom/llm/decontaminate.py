"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH over item-sized windows, exact edit verification.

A random walk reads a string, staying on or leaving each character by a random bit of (step, character); what it reads is
as long for all strings, and few edits between two strings leave few differing steps (CGK). Items are put into classes of
like length. A window of a class's length at each word start of a document (in runs of over LONG_RUN characters without a space,
and in scripts that set none, at each character) is embedded by WALKS walks; BANDS samples of
SAMPLE steps of each are its keys, and items with a key in common are candidates. With a fraction d of differing steps a
pair is missed with probability (1 - (1 - d) ** SAMPLE) ** (WALKS * BANDS). Candidates are verified by their
edit distance to the best stretch of the document, which must be at most RATIO of the item's length.

Items of over PART characters are looked for by equal parts of at most that: edits that are few enough for the item are few enough
for one of its parts. Windows that can't hold an item (or part) of their class are left out first: k edits leave at least n - q + 1 - k q of an item's
n - q + 1 q-grams as they are (the q-gram lemma). Items for which that bound is under 1 (up to some 35 characters) must share one
q-gram with the window all the same. Items of under SHORTEST characters, for which LSH tells nothing, match where a
document has them exactly, between characters that are no letters or digits.

The benchmark is read in blocks of bounded size, each of which all documents pass; documents are not shuffled. A block's items
are broadcast, and its index is built by each worker.
Text is compared in lower case, with white space as single spaces. Edge cases: null and empty documents match nothing;
null and empty items are left out; equal items match each;
repeated rows give a row each; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table
from .repeats import mixed, rolled

RATIO, GRAM, SHORTEST, LONG_RUN = 0.1, 8, 24, 24
#: The first code point of the scripts without spaces between words.
UNSPACED = 0x2E80
WALKS, BANDS, SAMPLE = 10, 10, 6
#: Ratio of the longest item of a class to its shortest.
SPAN = 1.07
#: Characters of the items of a block, and bits of the filter of their q-grams.
BLOCK_CHARS, FILTER_BITS = 1_000_000, 21
PART = 4096
#: Characters of a text up to which it is searched for each gram, as that is faster than a set of its own.
SEARCHED = 512
#: Window starts that are embedded together, so that their walks stay in the cache.
TOGETHER = 4_000
#: Steps of a walk for which there are random bits of their own; later ones take those of other characters.
OWN_STEPS = 4096
SCHEMA = "doc_id long, item_id long, distance int, low int, high int"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def best_stretch(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to any stretch of text, and the end of such a stretch (bit-parallel rows)."""
    last = 1 << len(item) - 1
    full = (last << 1) - 1
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right_up = down | ~(d0 | up) & full
        right_down = d0 & up
        if right_up & last:
            score += 1
        elif right_down & last:
            score -= 1
            if score < best:
                best, end = score, j + 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | ~(d0 | right_up) & full
        down = d0 & right_up
    return best, end


def may_match(item: str, text: str, most: int, width: int = 4) -> bool:
    """False only if more than most edits part item from every stretch of text: each edit changes width of its grams at most."""
    held = text if len(text) < SEARCHED else {text[i : i + width] for i in range(len(text) - width + 1)}
    left = width * most
    for i in range(len(item) - width + 1):
        if item[i : i + width] not in held:
            left -= 1
            if left < 0:
                return False
    return True


@lru_cache(maxsize=1)
def walk_bits() -> np.ndarray:
    """A random bit for each step, walk and (byte of a) character."""
    return np.random.default_rng(3).integers(0, 2, (OWN_STEPS, WALKS * 256), np.int8)


class Index:
    """Items of one block, in parts; classes of parts by length, and for each class the filter, the walks and the keys."""

    def __init__(self, items: list[tuple[int, str]], ratio: float):
        self.short = [x for x in items if len(x[1]) < SHORTEST]
        self.items, self.ratio = [x for x in items if len(x[1]) >= SHORTEST], ratio
        cuts = [[len(t) * i // n for i in range(n + 1)] for _, t in self.items for n in [-(-len(t) // PART)]]
        #: item, place in it, text
        self.parts = sorted(((i, a, self.items[i][1][a:b]) for i, c in enumerate(cuts) for a, b in zip(c, c[1:], strict=False)), key=lambda x: len(x[2]))
        self.lengths = np.array([len(t) for _, _, t in self.parts])
        self.filter = np.zeros(1 << FILTER_BITS, np.uint32)
        self.classes: list[dict] = []
        rng = np.random.default_rng(3)
        groups: list[list[int]] = []
        for i, n in enumerate(self.lengths):
            if not groups or n > SPAN * self.lengths[groups[-1][0]]:
                groups.append([])
            groups[-1].append(i)
        for number, members in enumerate(groups):
            n = number * 32 // max(32, len(groups))  # the filter tells 32 classes apart
            least, most = int(self.lengths[members[0]]), int(self.lengths[members[-1]])
            for i in members:
                self.filter[self.places(codes(self.parts[i][2]))] |= np.uint32(1 << n)
            # of an item's grams, so many are left unchanged among those that start in the class's shortest length
            grams = least - GRAM + 1
            need = max(1, grams - int(ratio * most) * GRAM)
            steps = 2 * least
            one = {"bit": n, "grams": grams, "need": need, "samples": np.sort(rng.integers(0, steps - 2, (WALKS, BANDS, SAMPLE)), -1)}
            text = np.concatenate([np.r_[codes(self.parts[i][2]), np.zeros(steps - min(steps, self.lengths[i]) + 1, np.uint32)] for i in members])
            begins = np.cumsum([0, *(self.lengths[i] + steps - min(steps, self.lengths[i]) + 1 for i in members[:-1])])
            keys = self.embedded(one, text, begins, self.low_bytes(text))
            one["keys"] = np.sort(keys.ravel())
            one["owner"] = np.repeat(members, keys.shape[1])[np.argsort(keys.ravel(), kind="stable")]
            self.classes.append(one)

    @staticmethod
    def places(text: np.ndarray) -> np.ndarray:
        return (mixed(rolled(text.astype(np.uint64) * _SPREAD, GRAM)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def low_bytes(text: np.ndarray) -> np.ndarray:
        return (text & 255).astype(np.int64)

    @staticmethod
    def embedded(one: dict, text: np.ndarray, starts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Keys of the windows at the starts, WALKS * BANDS each; low: the low bytes of the text."""
        at, bits = np.tile(starts.astype(np.int64), (WALKS, 1)), walk_bits()
        walk = np.arange(WALKS)[:, None] * 256
        sampled: dict[int, list[tuple[int, int, int]]] = {}
        for w, band, nth in np.ndindex(one["samples"].shape):
            sampled.setdefault(int(one["samples"][w, band, nth]), []).append((w, nth, w * BANDS + band))
        read = np.empty((SAMPLE, WALKS * BANDS, len(starts)), text.dtype)
        c, move = np.empty_like(at), np.empty(at.shape, np.int8)
        for step in range(max(sampled) + 1):
            for w, nth, row in sampled.get(step, ()):
                text.take(at[w], out=read[nth, row], mode="clip")
            low.take(at, out=c, mode="clip")
            if step >= OWN_STEPS:
                c += 57 * (step // OWN_STEPS)
                c &= 255
            c += walk
            bits[step % OWN_STEPS].take(c, out=move, mode="clip")
            at += move
        keys = np.repeat(np.arange(WALKS * BANDS, dtype=np.uint64)[:, None], len(starts), 1)
        for some in read:
            keys ^= some
            keys *= _SPREAD
            keys ^= keys >> np.uint64(29)
        return np.ascontiguousarray(mixed(keys).T)

    @staticmethod
    def passing(hits: np.ndarray, word: np.ndarray, grams: int, need: int) -> np.ndarray:
        """Which word starts have at least need hits among the grams from there on."""
        if len(hits) < need:
            return np.empty(0, np.int64)
        last = hits[need - 1 :]
        dense = last - hits[: len(last)] < grams
        low, high = last[dense] - grams + 1, hits[: len(last)][dense]  # starts from low to high see these hits
        if not len(low):
            return np.empty(0, np.int64)
        a, b = np.searchsorted(word, low), np.searchsorted(word, high, "right")
        a = np.maximum(a, np.r_[0, b[:-1]])  # both grow, so what was seen is left out
        times = np.maximum(b - a, 0)
        return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)

    @staticmethod
    def starts(flat: np.ndarray) -> np.ndarray:
        """Where windows start: at words, and at each character of long runs without a space and of unspaced scripts."""
        ends = np.concatenate([[-1], np.flatnonzero(flat <= 32), [len(flat)]])
        sizes = np.diff(ends) - 1
        out = ends[:-1][sizes > 0] + 1
        long = np.flatnonzero(sizes > LONG_RUN)
        more = [np.flatnonzero(flat >= UNSPACED)] + [np.arange(ends[i] + 1, ends[i + 1]) for i in long]
        held = np.zeros(len(flat), bool)
        for some in (out, *more):
            held[some] = True
        return np.flatnonzero(held)

    def short_matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, short item, 0, low, high) of the first exact match of each text and item."""
        import ahocorasick

        finder = ahocorasick.Automaton()
        for i, (_, item) in enumerate(self.short):
            finder.add_word(item, [*(finder.get(item, [])), i])
        finder.make_automaton()
        for doc, text in enumerate(texts):
            seen: set[int] = set()
            for end, items in finder.iter(text):
                low = end + 1 - len(self.short[items[0]][1])
                if text[low - 1 : low].isalnum() or text[end + 1 : end + 2].isalnum() or items[0] in seen:
                    continue
                seen.update(items)
                for i in items:
                    yield doc, i, 0, low, end + 1

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, low, high) of all matches, one for each text and item (short ones aside)."""
        if not self.items:
            return
        coded = [codes(t) for t in texts]
        begins = np.cumsum([0, *(len(p) + 1 for p in coded)])
        longest = 4 * int(self.lengths[-1])
        flat = np.zeros(begins[-1] + longest + GRAM, np.uint32)
        for p, b in zip(coded, begins, strict=False):
            flat[b : b + len(p)] = p
        owns, low_bytes = self.filter[self.places(flat)], self.low_bytes(flat)
        hits = np.flatnonzero(owns)
        owns = owns[hits]
        word = self.starts(flat[: begins[-1]])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        places = {bit: hits[(owns >> np.uint32(bit) & np.uint32(1)) > 0] for bit in {one["bit"] for one in self.classes}}
        for one in self.classes:
            starts = word[self.passing(places[one["bit"]], word, one["grams"], one["need"])]
            for a in range(0, len(starts), TOGETHER):
                some = starts[a : a + TOGETHER]
                keys = self.embedded(one, flat, some, low_bytes)
                low = np.searchsorted(one["keys"], keys)
                row, col = np.nonzero(one["keys"][np.minimum(low, len(one["keys"]) - 1)] == keys)
                times = np.searchsorted(one["keys"], keys[row, col], "right") - low[row, col]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                parts = one["owner"][np.repeat(low[row, col], times) + nth]
                for pair in np.unique(np.repeat(some[row], times) * len(self.parts) + parts).tolist():
                    place, part = divmod(pair, len(self.parts))
                    doc = int(np.searchsorted(begins, place, "right")) - 1
                    item, within, _ = self.parts[part]
                    if (doc, item) in found:
                        continue
                    start, text = int(place - begins[doc]) - within, self.items[item][1]
                    most = int(self.ratio * len(text))
                    begin = max(0, start - most)
                    around = texts[doc][begin : max(0, start + len(text) + most)]
                    if not may_match(text, around, most):
                        continue
                    distance, end = best_stretch(text, around)
                    if distance <= most:
                        found[doc, item] = (distance, max(0, start), begin + end)
        for (doc, item), (distance, low, high) in found.items():
            yield doc, item, distance, low, high


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_CHARS characters, as the driver reads them one by one."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        text = normal(row.text)
        if text:
            if block and chars + len(text) > BLOCK_CHARS:
                yield block
                block, chars = [], 0
            block.append((row.item_id, text))
            chars += len(text)
    if block:
        yield block


_BUILT: dict[str, Index] = {}


def built(held, key: str, ratio: float) -> Index:
    """The index of a broadcast block, built once a process; one is held at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(held.value, ratio)
    return _BUILT[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """doc_id, item_id, distance, low, high (in the normalised text): one row for each document row and item that it holds."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    for n, block in enumerate(blocks(benchmark)):
        held, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(it: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[dict]:
            index = built(held, key, ratio)
            for batch in it:
                ids, texts = batch.column("doc_id").to_pylist(), [normal(t) for t in batch.column("text").to_pylist()]
                cols: list[list] = [[], [], [], [], []]
                found = [(index.items, m) for m in index.matches(texts)]
                if index.short:
                    found += [(index.short, m) for m in index.short_matches(texts)]
                for items, (doc, item, *rest) in found:
                    for c, v in zip(cols, (ids[doc], items[item][0], *rest), strict=True):
                        c.append(v)
                yield dict(zip(("doc_id", "item_id", "distance", "low", "high"), cols, strict=True))

        part = by_arrow(rows, run, SCHEMA)
        out = part if n == 0 else out.unionByName(part)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
