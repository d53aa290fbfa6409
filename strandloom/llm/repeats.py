"""Removal of repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Only suffixes cut to WINDOW bytes are told apart, and only groups of two and more go on to the next digit, so that what is
equal after the last digit are exactly the repeated windows. The first two digits deal windows into groups that fit a task, and
are hashes (groups matter, not their order); in a task, suffixes are sorted by their bytes:

1. The first digit of a window is its least gram (the leftmost of the least hash among its grams of GRAM bytes) and where
   that is in it. Neighbouring windows share one gram, so a run of them is one row, (gram, span, document, start,
   windows), span being a hash of all the run's bytes: about 1/35 row a byte is shuffled. Equal windows have the
   same gram at the same place, and a run holds no window twice.
2. The second digit is the span. Of equal spans, all but the first are removed whole. A gram with one span only has
   no other repeats; the runs of grams with several go on, one for each span.
3. The last digits are the window's bytes. Runs of one gram meet with their bytes in a task if they are at most COLD; their
   suffixes are sorted by eight bytes a pass, most significant first, and only groups of two and more go on to the
   next, to the depth of a window. The windows of more frequent grams are dealt one by one by their hash, with a partial
   minimum before the shuffle. So spans, and windows of frequent grams, are equal by two hashes of 64 bits (gram and digest).

Equal spans of one task meet before the first shuffle, so a text copied any number of times sends a row a task.
Every removed byte lies in a window that starts earlier elsewhere; windows are judged on the input.

Edge cases: null and empty texts have 0 bytes; texts under WINDOW bytes keep all; matches never cross documents; where a
doc_id is null or repeated, rows are ordered by (doc_id, text) instead, null first; an empty table gives no rows;
other columns are ignored. A text of any length is read in segments of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table, utf8, written

WINDOW, GRAM, COLD = 100, 24, 4096
#: Windows of a segment, and runs that a task holds before it drops equal spans.
SEGMENT, HELD = 1 << 20, 1 << 20
PLACE = np.uint64(24)  # bits of a place in a segment
SCHEMA = "kind int, gram long, span long, doc long, start long, length long"
#: kind: a run still to be told apart, a run that is removed.
OPEN, REMOVED = 0, 1
_random = np.random.default_rng(9)
BYTE = _random.integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
BASE = int(_random.integers(1, 1 << 61)) * 8 + 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(2 * SEGMENT + 2 * WINDOW, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Hasher:
    """Hashes of any stretches of up to 2 * SEGMENT bytes."""

    def __init__(self, data: np.ndarray):
        self.values = BYTE[data]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values * powers()[0][: len(data)], out=self.sums[1:])

    def stretches(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * powers()[1][low] + (high - low).astype(np.uint64))

    def grams(self) -> np.ndarray:
        return mixed(rolled(self.values, GRAM))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width values from each place, from those of half the width."""
    if width == 1:
        return values
    half = width // 2
    part = rolled(values, half)
    out = part[:-half] * np.uint64(pow(BASE, half, 1 << 64)) + part[half:]
    return out[: len(values) - width + 1] * np.uint64(BASE) + values[width - 1 :] if width % 2 else out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of texts that lie one after the other: gram, span, text, start in data, windows."""
    if len(data) < WINDOW:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    own, ends = Hasher(data), np.cumsum(sizes)
    grams = own.grams()
    least = sliding_min(grams >> PLACE << PLACE | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[text])
    place, text = (least[starts] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64), text[starts]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(starts) else np.empty(0, np.int64)
    low, windows = starts[first], np.diff(np.r_[first, len(starts)])
    return grams[place[first]].view(np.int64), own.stretches(low, low + windows + WINDOW - 1).view(np.int64), text[first], low, windows


def segments(docs: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts together up to SEGMENT bytes, long ones in pieces that overlap by a window: doc, offset, sizes, data."""
    group: list[tuple[int, int, bytes]] = []

    def joined() -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        return [g[0] for g in group], [g[1] for g in group], np.array([len(g[2]) for g in group], np.int64), np.frombuffer(b"".join(g[2] for g in group), np.uint8)

    held = 0
    for doc, text in docs:
        for a in range(0, max(1, len(text) - WINDOW + 1), SEGMENT):
            piece = text[a : a + SEGMENT + WINDOW - 1]
            if group and held + len(piece) > SEGMENT:
                yield joined()
                group, held = [], 0
            group.append((doc, a, piece))
            held += len(piece)
    if group:
        yield joined()


def first_of_equal(cols: list[np.ndarray]) -> np.ndarray:
    """For (gram, span, doc, start, ...): which rows are the first of their gram and span."""
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    gram, span = cols[0][order], cols[1][order]
    first = np.zeros(len(gram), bool)
    first[order[np.r_[True, (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])]]] = True
    return first


def joined_runs(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs as stretches of bytes (doc, low, high), those that touch as one."""
    order = np.lexsort((start, doc))
    doc, low = doc[order], start[order]
    high = low + windows[order] + WINDOW - 1
    if not len(doc):
        return doc, low, high
    # the furthest end so far in each document
    turn = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    step = np.int64(high.max()) + 1
    far = np.maximum.accumulate(high + turn * step) - turn * step
    new = np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] > far[:-1])]
    at = np.flatnonzero(new)
    return doc[at], low[at], far[np.r_[at[1:], len(doc)] - 1]


def first_digit(docs: DataFrame) -> DataFrame:
    """Runs of all documents; of equal spans in a task, the first is open and the others are removed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        texts = ((d, t or b"") for b in it for d, t in zip(b.column("doc").to_pylist(), utf8(b.column("text")), strict=True))
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[dict]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            first = first_of_equal(cols)
            doc, low, high = joined_runs(*(cols[i][~first] for i in (2, 3, 4)))
            kinds = np.r_[np.full(first.sum(), OPEN), np.full(len(doc), REMOVED)].astype(np.int32)
            spread = mixed(doc.astype(np.uint64) + low.astype(np.uint64) * np.uint64(BASE)).view(np.int64)  # any key: so that no task gets all
            both = lambda i, x: np.r_[cols[i][first], x]
            rows = {"kind": kinds, "gram": both(0, spread), "span": both(1, spread), "doc": both(2, doc), "start": both(3, low), "length": both(4, high - low)}
            for a in range(0, len(kinds), 100_000):
                yield {k: v[a : a + 100_000] for k, v in rows.items()}

        n = 0
        for doc, offset, sizes, data in segments(texts):
            gram, span, text, low, windows = runs_of(data, sizes)
            begins = np.cumsum(sizes) - sizes
            held.append([gram, span, np.array(doc, np.int64)[text], low - begins[text] + np.array(offset, np.int64)[text], windows])
            n += len(gram)
            if n >= HELD:
                yield from out()
                n = 0
        if held:
            yield from out()

    return by_arrow(docs, run, SCHEMA)


def second_digit(runs: DataFrame) -> DataFrame:
    """Of equal spans all but the first are removed; of grams with several spans, each span's first stays open."""
    fields = ("gram", "span", "doc", "start", "length")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        gram_before = span_before = None
        last, last_given = None, False  # the latest first run of a span, and if it was given
        for batch in it:
            kind, *cols = (batch.column(c).to_numpy() for c in ("kind", *fields))
            out = [(REMOVED, [x[kind == REMOVED] for x in cols])]
            gram, span, *_ = cols = [x[kind == OPEN] for x in cols]
            if len(gram):
                new = np.r_[gram[0] != gram_before or span[0] != span_before, (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])]
                gram_before, span_before = gram[-1], span[-1]
                again = [x[~new] for x in cols]
                out.append((REMOVED, [*again[:4], again[4] + WINDOW - 1]))
                firsts = [x[new] if last is None else np.r_[y, x[new]] for x, y in zip(cols, last or cols, strict=True)]
                same = firsts[0][1:] == firsts[0][:-1]
                several = np.r_[False, same] | np.r_[same, False]
                given = several.copy()
                given[:1] &= not last_given
                out.append((OPEN, [x[given] for x in firsts]))
                if len(several):
                    last_given = bool(several[-1]) or (last_given and len(several) == 1)
                    last = [x[-1:] for x in firsts]
            yield {"kind": np.concatenate([np.full(len(x[0]), k, np.int32) for k, x in out])} | {c: np.concatenate([x[i] for _, x in out]) for i, c in enumerate(fields)}

    return by_arrow(runs.repartition("gram").sortWithinPartitions("gram", "span", "doc", "start"), run, SCHEMA)


def with_bytes(open_runs: DataFrame, docs: DataFrame) -> DataFrame:
    """The open runs with their bytes; those of grams with more than COLD runs as single windows, by their hash."""
    sizes = open_runs.groupBy("gram").agg((F.count("*") > COLD).alias("hot"))
    lists = open_runs.join(sizes, "gram").groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "length", "hot")).alias("runs"))  # a document's own

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for doc, text, runs in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), batch.column("runs"), strict=True):
                fields = runs.values.flatten()
                gram, start, length, hot = (x.to_numpy(zero_copy_only=False) for x in fields)
                cold = ~hot
                if cold.any():
                    yield {"gram": gram[cold], "digest": pa.nulls(int(cold.sum()), pa.int64()), "doc": np.full(cold.sum(), doc), "start": start[cold], "bytes": [text[a : a + n + WINDOW - 1] for a, n in zip(start[cold].tolist(), length[cold].tolist(), strict=True)]}
                for g, a, n in zip(gram[hot].tolist(), start[hot].tolist(), length[hot].tolist(), strict=True):
                    low = np.arange(n)
                    digest = Hasher(np.frombuffer(text[a : a + n + WINDOW - 1], np.uint8)).stretches(low, low + WINDOW).view(np.int64)
                    yield {"gram": np.full(n, g), "digest": digest, "doc": np.full(n, doc), "start": a + low, "bytes": pa.nulls(n, pa.binary())}

    return by_arrow(docs.join(lists, "doc"), run, "gram long, digest long, doc long, start long, bytes binary")


def equal_suffixes(data: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of the windows that begin at low, those that equal an earlier one, by a radix sort of their bytes, most significant digit
    first: a digit is eight bytes, and windows that are alone in their group are done."""
    word = data.astype(np.uint64)
    for n in (1, 2, 4):  # the eight bytes from each place on
        word = word[:-n] << np.uint64(8 * n) | word[n:]
    alive = np.argsort(word[low], kind="stable")
    group = np.zeros(len(low), np.int64)
    for at in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        key = word[low[alive] + at]
        part = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        if at and (part & (group[1:] == group[:-1])).any():  # a group falls apart: it is sorted by the digit
            order = np.lexsort((key, group))
            alive, key, group = alive[order], key[order], group[order]
            part = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new = np.r_[True, part] if len(alive) else np.empty(0, bool)
        group = np.cumsum(new)
        several = ~(new & np.r_[new[1:], True]) if len(alive) else new
        alive, group = alive[several], group[several]
    return alive[1:][group[1:] == group[:-1]]


def last_digit(runs: DataFrame) -> DataFrame:
    """Stretches (doc, low, high) of the windows of cold grams that are not the first of their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group: list[tuple[int, int, int, bytes]] = []
        held, before = 0, None
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "bytes")), strict=True):
                if row[0] != before and held > SEGMENT // 2:  # a gram's runs stay together: COLD bounds them
                    yield repeated(group)
                    group, held = [], 0
                before = row[0]
                group.append(row)
                held += len(row[3])
        if group:
            yield repeated(group)

    def repeated(group: list[tuple[int, int, int, bytes]]) -> dict:
        sizes = np.array([len(g[3]) for g in group], np.int64)
        windows, begins = sizes - WINDOW + 1, np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), windows)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = begins[owner] + within
        again = equal_suffixes(np.frombuffer(b"".join(g[3] for g in group), np.uint8), low)  # rows come in order of (gram, doc, start)
        doc, start = (np.array([g[i] for g in group], np.int64) for i in (1, 2))
        d, a, b = joined_runs(doc[owner[again]], start[owner[again]] + within[again], np.ones(len(again), np.int64))
        return {"doc": d, "low": a, "high": b}

    return by_arrow(runs.repartition("gram").sortWithinPartitions("gram", "doc", "start"), run, "doc long, low long, high long")


def removed_stretches(docs: DataFrame) -> DataFrame:
    """(doc, low, high): stretches of bytes of (doc, text) that repeat an earlier window; they may overlap."""
    told = written(second_digit(first_digit(docs)), "digits")
    found = written(with_bytes(told.where(f"kind = {OPEN}").select("gram", "doc", "start", "length"), docs), "windows")
    cold = last_digit(found.where("digest is null").select("gram", "doc", "start", "bytes"))
    single = found.where("digest is not null").select("gram", "digest", "doc", "start")
    first = single.groupBy("gram", "digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    hot = single.join(first, ["gram", "digest"]).where(F.struct("doc", "start") != F.col("first"))
    whole = told.where(f"kind = {REMOVED}").selectExpr("doc", "start low", "start + length high")
    return whole.unionByName(cold).unionByName(hot.selectExpr("doc", "start low", f"start + {WINDOW} high"))


def with_order(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): doc is the doc_id, or the place by (doc_id, text) where ids are null or repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.agg(F.count("*") == F.countDistinct("doc_id")).first()[0]:
        return rows.withColumn("doc", F.col("doc_id"))
    return written(rows.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("doc", F.monotonically_increasing_id()), "ordered")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text: what is left as text, cut characters replaced)."""
    rows = with_order(docs)
    lists = removed_stretches(rows.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))  # a document's own

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            cols: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            for text, cuts in zip(utf8(batch.column("text")), batch.column("cuts"), strict=True):
                text, spans = text or b"", []
                if cuts.is_valid:
                    low, high = (x.to_numpy() for x in cuts.values.flatten())
                    _, low, high = joined_runs(np.zeros(len(low), np.int64), low, high - low - WINDOW + 1)
                    spans = list(zip(low.tolist(), high.tolist(), strict=True))
                kept = b"".join(text[a:b] for a, b in zip([0, *(h for _, h in spans)], [*(x for x, _ in spans), len(text)], strict=True))
                for k, v in zip(cols, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    cols[k].append(v)
            yield {"doc_id": batch.column("doc_id")} | cols

    out = by_arrow(rows.join(lists, "doc", "left"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
