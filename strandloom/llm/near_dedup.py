"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles. Documents with equal sets are one class at once (a sum by a hash of the set), and the
smallest doc_id stands for them. Each class has a signature of k MinHash values cut to b bits; the distance of two
signatures is the number of differing values. The signature is split into m chunks. If two signatures differ in at
most r = 2m - 1 values, some chunk differs in at most one (pigeonhole); so each chunk is entered once for every
value left out, and the signatures that share an entry hold all pairs within distance r. k is chosen so that a pair at the
threshold shares no entry with a probability of under MISS; step 3 passes over pairs whose signatures differ in more
values than a pair at the threshold does with a probability of MISS.

Candidates are never listed as all pairs of an entry:
1. each entry links its smallest class with each other one (a star); these pairs are confirmed on whole texts, and
   the confirmed ones joined to components;
2. of the classes in entries that still hold different components, those go that can have no link to another of them: if a
   class has a shingles and u of them in no other open class, it shares at most a - u with any, which is too few
   where a - u is under the threshold times a. What goes may make others go, so this is repeated while it helps;
3. what is still open is settled exactly. Members of one component need no comparison, so only the classes outside an entry's
   largest component (its rest) ask: they are dealt into blocks, the entry's members into slabs, and each block meets
   each slab in a task, which holds the block and reads the slab row by row. Rows grow with the members, times the
   blocks of the rest. So two classes alike that are both unlike the centre are found too.
Components come from repeated contraction to the smallest neighbour.

Edge cases: null and empty texts (and those of white space only) have the empty set and are linked with nothing; a text
with fewer words than a shingle has its whole sequence as one shingle; a null doc_id is not linked and kept, its
component null; rows with one doc_id are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, dropped, table, utf8, written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK, VALUE_BITS, MISS = 6, 16, 1e-5
#: Asking classes of a block and members of a slab of step 3, and members that share one copy of a star's centre.
BLOCK, SLAB, FAN = 1024, 16384, 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def chunks_for(threshold: float) -> int:
    """Chunks that a pair at the threshold misses all with a probability under MISS."""
    one = 1 - threshold**CHUNK - CHUNK * (1 - threshold) * threshold ** (CHUNK - 1)
    return max(1, math.ceil(math.log(MISS) / math.log(one)))


def most_apart(threshold: float, n_values: int) -> int:
    """The distance that a pair at the threshold exceeds with a probability under MISS."""
    p, term, tail, k = 1 - threshold, threshold**n_values, 1.0, 0
    while (tail := tail - term) > MISS:
        term *= (n_values - k) / (k + 1) * p / (1 - p)
        k += 1
    return k


def shingle_set(text: bytes | None, width: int) -> frozenset[bytes]:
    """The exact set, as byte strings of the shingles."""
    words = WORDS.findall(text.translate(LOWER)) if text else []
    if len(words) < width:
        return frozenset([b" ".join(words)]) if words else frozenset()
    return frozenset(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Signer:
    """Shingle hashes and signatures of texts; the hash of a word doesn't depend on the worker."""

    def __init__(self, width: int, n_values: int):
        rng = np.random.default_rng(20)
        self.width = width
        self.mult = (rng.integers(0, 1 << 32, n_values, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 1 << 32, n_values, np.uint64).astype(np.uint32)
        self.words: dict[bytes, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles, sorted."""
        words = WORDS.findall(text.translate(LOWER)) if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > 400_000:
            self.words = {}
        known = self.words
        for w in set(words).difference(known):
            known[w] = _word_hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        out = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            out = (out ^ h[i : len(h) - width + 1 + i]) * _MULTIPLY
            out ^= out >> np.uint64(29)
        if width < self.width:
            out += np.uint64(width)
        return np.unique(mixed(out))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low, best = (hashes >> np.uint64(32)).astype(np.uint32), None
        for a in range(0, len(low), 2048):
            v = (low[None, a : a + 2048] * self.mult[:, None] + self.add[:, None]).min(1)
            best = v if best is None else np.minimum(best, v)
        # values are cut to their middle bits: the high ones of a minimum are mostly zero
        return (mixed(best.astype(np.uint64)) & np.uint64((1 << VALUE_BITS) - 1)).astype(np.uint16)


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def class_rows(docs: DataFrame, width: int, n_values: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set and the signature (null for the empty set) of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import xxhash

        own = Signer(width, n_values)
        for batch in it:
            cols: dict[str, list] = {k: [] for k in ("n_shingles", "set_a", "set_b", "signature")}
            for text in utf8(batch.column("text")):
                hashes = own.hashes(text)
                a, b = struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes())) if len(hashes) else (None, None)
                for k, v in zip(cols, (len(hashes), a, b, own.signature(hashes).tobytes() if len(hashes) else None), strict=True):
                    cols[k].append(v)
            yield {"doc_id": batch.column("doc_id")} | cols

    return by_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def entries(classes: DataFrame, n_chunks: int) -> DataFrame:
    """(entry, nth, node): for each chunk of a signature and each value of it left out, a hash of the rest; nth numbers
    the chunk and the value."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        left = [[i for i in range(CHUNK) if i != out] for out in range(CHUNK)]
        for batch in it:
            raw = batch.column("signature").to_pylist()
            values = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), n_chunks, CHUNK).astype(np.uint64)
            keys = np.empty((len(raw), n_chunks, CHUNK), np.uint64)
            for out in range(CHUNK):
                h = np.broadcast_to((np.arange(n_chunks) * CHUNK + out).astype(np.uint64), (len(raw), n_chunks))
                for i in left[out]:
                    h = mixed(h * _MULTIPLY + values[:, :, i])
                keys[:, :, out] = h
            node = np.repeat(np.array(batch.column("node").to_pylist(), np.int64), n_chunks * CHUNK)
            nth = np.tile(np.arange(n_chunks * CHUNK, dtype=np.int32), len(raw))
            yield {"entry": keys.ravel().view(np.int64), "nth": nth, "node": node}

    return by_arrow(classes.select("node", "signature"), run, "entry long, nth int, node long")


def confirmed_stars(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of the pairs (centre, node), those with den * |intersection| >= num * |union|. A centre's text goes once to each
    FAN of its nodes (so no task has all of a hot one), each node's text to its centres."""
    fans = pairs.groupBy("centre").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    members = pairs.join(fans, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("fans")).cast("int").alias("fan"), F.col("node").alias("id"), F.lit(1).alias("member"))
    centres = fans.select("centre", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("centre").alias("id"), F.lit(0).alias("member"))
    rows = members.unionByName(centres).join(texts.withColumnRenamed("node", "id"), "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, centre_set = None, frozenset()
        for batch in it:
            found: dict[str, list] = {"a": [], "b": []}
            columns = [batch.column(c).to_pylist() for c in ("centre", "fan", "member", "id")] + [utf8(batch.column("text"))]
            for centre, fan, member, node, text in zip(*columns, strict=True):
                own = shingle_set(text, width)
                if not member:
                    at, centre_set = (centre, fan), own
                elif at == (centre, fan) and alike(own, centre_set, num, den):
                    found["a"].append(centre)
                    found["b"].append(node)
            yield found

    ordered = rows.select("centre", "fan", "member", "id", "text").repartition("centre", "fan").sortWithinPartitions("centre", "fan", "member")
    return by_arrow(ordered, run, "a long, b long")


def alike(x: frozenset, y: frozenset, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y|, of sets that aren't empty."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both)


def settled(open_entries: DataFrame, signatures: DataFrame, texts: DataFrame, width: int, num: int, den: int, apart: int) -> DataFrame:
    """Links between classes of one entry that aren't in one component yet (step 3). Two classes are compared in the first
    entry that they share only."""
    sizes = open_entries.groupBy("entry", "component").agg(F.count("*").alias("n")).groupBy("entry").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    parts = sizes.select("entry", F.col("top.component").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / SLAB).cast("int").alias("slabs"))
    placed = open_entries.join(parts, "entry").withColumn("rest", F.col("component") != F.col("main"))
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<int>")
    # a class of the rest asks in each slab; every member answers in each block
    cells = F.concat(F.when(F.col("rest"), F.transform(every("slabs"), lambda s: F.struct(dealt("blocks", "block").alias("block"), s.alias("slab"), F.lit(0).alias("member")))).otherwise(F.transform(none, lambda s: F.struct(s.alias("block"), s.alias("slab"), s.alias("member")))), F.transform(every("blocks"), lambda b: F.struct(b.alias("block"), dealt("slabs", "slab").alias("slab"), F.lit(1).alias("member"))))
    info = signatures.join(texts, "node").join(open_entries.select("node").distinct(), "node", "left_semi")
    met = placed.select("entry", "nth", "node", "component", "rest", F.explode(cells).alias("cell")).select("entry", "cell.block", "cell.slab", "cell.member", "rest", "nth", "node", "component")
    fields = ("entry", "block", "slab", "member", "rest", "nth", "node", "component", "signature", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sets, cell, block = SetCache(width), None, None
        for batch in it:
            found: dict[str, list] = {"a": [], "b": []}
            for row in zip(*[batch.column(c).to_pylist() for c in fields[:-1]], utf8(batch.column("text")), strict=True):
                if cell != row[:3]:
                    cell, block = row[:3], Block(sets, num, den, apart)
                if row[3]:
                    block.answer(row, found)
                else:
                    block.rows.append(row)
            yield found

    ordered = met.join(info, "node").select(*fields).repartition("entry", "block", "slab").sortWithinPartitions("entry", "block", "slab", "member", "node")
    return by_arrow(ordered, run, "a long, b long")


class Block:
    """The asking classes of a cell; `answer` compares them with a member of the entry."""

    def __init__(self, sets: SetCache, num: int, den: int, apart: int):
        self.sets, self.num, self.den, self.apart = sets, num, den, apart
        self.rows: list[tuple] = []
        self.values, self.label = None, {}

    def root(self, c: int) -> int:
        label = self.label
        label.setdefault(c, c)
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    def answer(self, row: tuple, found: dict[str, list]) -> None:
        if not self.rows:
            return
        if self.values is None:
            self.values = np.frombuffer(b"".join(r[8] for r in self.rows), np.uint16).reshape(len(self.rows), -1, CHUNK)
            self.node, self.component = (np.array([r[i] for r in self.rows], np.int64) for i in (6, 7))
        _, _, _, _, rest, nth, node, component, signature, text = row
        # of two classes of the rest, the greater asks
        ask = np.flatnonzero((self.component != component) & (self.node > node)) if rest else np.flatnonzero(self.component != component)
        if not len(ask):
            return
        differ = self.values[ask] != np.frombuffer(signature, np.uint16).reshape(-1, CHUNK)
        in_chunk = differ.sum(2)
        first, here = (in_chunk <= 1).argmax(1), np.arange(len(ask))
        shared = first * CHUNK + np.where(in_chunk[here, first] == 1, differ[here, first].argmax(1), 0)
        for j in ask[(in_chunk.sum(1) <= self.apart) & (shared == nth)]:
            x, own, other = self.rows[j][6], self.rows[j][7], self.rows[j][9]
            if self.root(own) != self.root(component) and alike(self.sets.of(x, other), self.sets.of(node, text), self.num, self.den):
                found["a"].append(x)
                found["b"].append(node)
                self.label[self.root(own)] = self.root(component)


class SetCache:
    """The exact sets of the classes asked for last, up to a number of shingles."""

    def __init__(self, width: int, most: int = 600_000):
        self.width, self.most, self.held, self.sets = width, most, 0, OrderedDict()

    def of(self, node: int, text: bytes) -> frozenset:
        if node in self.sets:
            self.sets.move_to_end(node)
            return self.sets[node]
        self.sets[node] = out = shingle_set(text, self.width)
        self.held += len(out)
        while self.held > self.most and len(self.sets) > 1:
            self.held -= len(self.sets.popitem(last=False)[1])
        return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b). Each round joins every label with
    its smallest neighbour, so that the graph of labels shrinks until no link is left."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("least")).select("old", F.least("old", "least").alias("new"))
        # one jump further: the parent's parent
        jumped = parents.alias("x").join(parents.alias("y"), F.col("x.new") == F.col("y.old")).select(F.col("x.old").alias("old"), F.col("y.new").alias("new"))
        jumped = written(jumped, "parents")
        renamed = written(labels.join(jumped, labels.component == jumped.old, "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        moved = edges.join(jumped.select(F.col("old").alias("a"), F.col("new").alias("x")), "a").join(jumped.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        left = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        dropped(edges, labels, jumped)
        edges, labels = left, renamed
    dropped(edges)
    return labels


def still_open(labelled: DataFrame) -> DataFrame:
    """Of (entry, nth, node, component), the entries that hold several components."""
    several = labelled.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("entry")
    return written(labelled.join(several, "entry"), "open")


def open_grams(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, size, gram): a hash of each shingle of each class of nodes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Signer(width, 1)
        for batch in it:
            grams = [own.hashes(t).view(np.int64) for t in utf8(batch.column("text"))]
            sizes = [len(g) for g in grams]
            nodes = np.array(batch.column("node").to_pylist(), np.int64)
            if grams:
                yield {"node": np.repeat(nodes, sizes), "size": np.repeat(np.array(sizes, np.int64), sizes), "gram": np.concatenate(grams)}

    return by_arrow(texts.join(nodes, "node", "left_semi"), run, "node long, size long, gram long")


def without_lonely(several: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The open entries without the classes that can have no link to another open class (step 2)."""
    grams = written(open_grams(several.select("node").distinct(), texts, width), "grams")
    before = grams.select("node").distinct().count()
    while before:
        single = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("size").alias("size")).where("n = 1")
        lonely = written(single.groupBy("node").agg(F.count("*").alias("own"), F.min("size").alias("size")).where(f"{den} * (size - own) < {num} * size").select("node"), "lonely")
        n = lonely.count()
        if not n:
            break
        rest = still_open(several.join(lonely, "node", "left_anti"))
        # what the entries that are settled now held alone goes too
        fewer = written(grams.join(rest.select("node").distinct(), "node", "left_semi"), "grams")
        dropped(several, grams, lonely)
        several, grams, after = rest, fewer, fewer.select("node").distinct().count()
        if after > 0.9 * before:
            break
        before = after
    dropped(grams)
    return several


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept, of each row.
    Linked are documents whose shingle sets have den * |intersection| >= num * |union|."""
    n_chunks = chunks_for(num / den)
    made = written(class_rows(docs, width, n_chunks * CHUNK), "sets")
    classes = written(made.where("set_a is not null and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes")
    listed = entries(classes, n_chunks)
    counted = listed.groupBy("entry").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    shared = written(listed.join(counted, "entry"), "entries")
    texts = written(docs.selectExpr("cast(doc_id as long) node", "text").join(shared.select("node").distinct(), "node", "left_semi"), "texts")
    pairs = written(shared.where("node <> centre").select("centre", "node").distinct(), "pairs")
    labels = components(confirmed_stars(pairs, texts, width, num, den))
    labelled = shared.where("n > 2").join(labels, "node", "left").select("entry", "nth", "node", F.coalesce("component", "node").alias("component"))
    several = without_lonely(still_open(labelled), texts, width, num, den)
    if not several.isEmpty():
        signatures = classes.groupBy("node").agg(F.first("signature").alias("signature"))
        late = settled(several, signatures, texts, width, num, den, most_apart(num / den, n_chunks * CHUNK))
        grouped = components(late.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        dropped(labels)
        labels = grouped
    dropped(shared, texts, pairs, several)
    own = made.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"], "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    out = own.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)
