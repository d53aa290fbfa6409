"""Lexical retrieval packing: documents are packed with the neighbours that a sharded BM25 index returns for them.

1. Every text is tokenised once. Windows of the full length that one document fills alone are cut off at once; what is left of it
   (under one window) goes on, with its ids, to a shard.
2. Document frequencies of all terms (token ids, so that the table is bounded by the vocabulary) are counted over all documents.
   A rest's key is three of its terms, drawn with odds by BM25 weight from the same random numbers in all rests, so that
   rests that share their heaviest terms are likely to share a key. Shards are filled with rests in order of the first
   term; a term of more tokens than a shard holds is spread over several by the whole key, and a key of more than a
   quarter of a shard (copies) by the row. So a shard's size is bounded, and the number of shards follows the tokens.
3. Each shard builds an inverted index of its rests. The first unused rest is a seed: its terms of highest weight query the
   index (QUERY_TERMS of them: a parameter of the ranking), BM25 ranks the unused neighbours, and these fill the seed's window greedily. The last is cut at the window's
   end and its remainder starts the next window. So only the last window of a shard is padded.

Edge cases: null and empty texts are one end token; a null doc_id is kept; repeated rows are packed each; a text of any
length is whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table, written

WINDOW, END_ID, SHARD_TOKENS, QUERY_TERMS = 4096, 2, 1_000_000, 24
K1, B = 1.2, 0.75
#: Bits of a term in a key, terms in a key, power of the weight in the odds, a fixed number for each term.
TERM, KEY_TERMS, SHARPNESS = 16, 3, 4
LOT = -np.log(1 - np.random.default_rng(7).random(1 << TERM))
#: Most chunks whose ids a worker remembers.
CACHE = 900_000
#: Texts without these characters are cut at white space into chunks that are tokenised alone.
NOT_PLAIN = re.compile(r"[^\t-\r -~\xa1-ɏ]")
#: A word that no plain text holds; chunks are encoded by the thousand with it in between.
BETWEEN, JOINED = "☃", 2000
#: Marks that end most chunks that aren't words.
MARKS = ".,!?;:%$&*#"


class ChunkTokenizer:
    """Ids as uint16 bytes of whole texts; equal to the library's, by chunks between white space that are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would only spin
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.size = self.library.get_vocab_size()
        self.chunks: dict[str, bytes] = {}
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.between = self.library.encode(f" {BETWEEN} ", add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, chunks: list[str], n: int) -> Iterator[bytes]:
        """Ids of chunks of n words each (a word: letters, or marks); each word ends with a token that ends words."""
        for i in range(0, len(chunks), JOINED):
            ids = np.array(self.library.encode_batch_fast([" ".join(chunks[i : i + JOINED])], add_special_tokens=False)[0].ids, np.uint16)
            ends, raw = (2 * np.flatnonzero(self.ends_word[ids])[n - 1 :: n] + 2).tolist(), ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def _add(self, new: set[str]) -> None:
        words = list(filter(str.isalpha, new))
        rest = new.difference(words)
        marked, other = [], []
        self.chunks.update(zip(words, self._encode_words(words, 1), strict=True))
        for c in rest:
            if (word := c.rstrip(MARKS)).isalpha():
                if word in self.chunks:
                    marks = c[len(word) :]
                    if marks not in self.chunks:
                        self.chunks[marks] = self._encode([marks])[0]
                    self.chunks[c] = self.chunks[word] + self.chunks[marks]
                else:
                    marked.append(c)
            else:
                other.append(c)
        self.chunks.update(zip(marked, self._encode_words(marked, 2), strict=True))
        self.chunks.update(zip(other, self._encode_chunks(other), strict=True))

    def _encode_chunks(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of plain chunks; the first id of BETWEEN starts with a byte that they don't have."""
        joined = [f" {BETWEEN} ".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        for e in self.library.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, np.uint16)
            cuts = np.flatnonzero(ids == self.between[0])
            raw, n = ids.tobytes(), len(self.between)
            yield from (raw[2 * a : 2 * b] for a, b in zip([0, *(cuts + n).tolist()], [*cuts.tolist(), len(ids)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > CACHE:
            self.chunks = {}
        out: list[bytes] = [b""] * len(texts)
        plain, whole = [], []
        for i, text in enumerate(texts):
            if text:
                if "<|" not in text and not NOT_PLAIN.search(text):
                    plain.append((i, text.lower().split()))
                else:
                    whole.append(i)
        self._add(set().union(*(chunks for _, chunks in plain)).difference(self.chunks))
        for i, chunks in plain:
            out[i] = b"".join(map(self.chunks.__getitem__, chunks))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per document: row number, crc32 of each full window, rest of the ids (uint16); and a row per task and term:
    in how many of the task's documents the term occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, end = chunk_tokenizer(path), np.uint16(end_id).tobytes()
        seen = np.zeros(max(own.size, end_id + 1), np.int64)
        last = np.zeros(len(seen), np.int32)
        for batch in it:
            cols: dict[str, list] = {k: [] for k in ("n", "crcs", "rest")}
            for raw in own.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(raw + end, np.uint16)
                full = len(ids) // window
                cols["n"].append(len(ids))
                wide = ids[: full * window].astype("<u4")
                cols["crcs"].append([zlib.crc32(wide[i * window : (i + 1) * window]) for i in range(full)])
                cols["rest"].append(ids[full * window :].tobytes())
                places = np.arange(len(ids), dtype=np.int32)
                last[ids] = places
                seen[ids[last[ids] == places]] += 1  # each of the document's terms once
            yield {"term": pa.nulls(len(cols["n"]), pa.int32()), "df": pa.nulls(len(cols["n"]), pa.int64()), "row": batch.column("row"), "doc_id": batch.column("doc_id")} | cols
        terms = np.flatnonzero(seen)
        none = lambda kind: pa.nulls(len(terms), kind)
        yield {"term": terms.astype(np.int32), "df": seen[terms], "row": none(pa.int64()), "doc_id": none(pa.int64()), "n": none(pa.int64()), "crcs": none(pa.list_(pa.int64())), "rest": none(pa.binary())}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_arrow(rows, run, "term int, df long, row long, doc_id long, n long, crcs array<long>, rest binary")


def weights_of(rests: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rest, term and BM25 weight of each term of each rest, in order of (rest, term)."""
    n = len(rests)
    sizes = np.array([len(r) for r in rests], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    pair, tf = np.unique(owner << 20 | np.concatenate(rests).astype(np.int64), return_counts=True) if n else (np.empty(0, np.int64), np.empty(0, np.int64))
    doc, term = pair >> 20, pair & (1 << 20) - 1
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(mean, 1)))


def lexical_keys(rests: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float) -> np.ndarray:
    """The key of each rest (none is empty): its KEY_TERMS terms of the least lot, the first one uppermost."""
    out = np.zeros(len(rests), np.int64)
    if not len(rests):
        return out
    doc, term, weight = weights_of(rests, df, n_docs, mean)
    lot, begins = LOT[term] / np.maximum(weight, 1e-9) ** SHARPNESS, np.searchsorted(doc, np.arange(len(rests)))
    for _ in range(KEY_TERMS):
        least = np.flatnonzero(lot == np.minimum.reduceat(lot, begins)[doc])
        least = least[np.r_[True, doc[least[1:]] != doc[least[:-1]]]]
        out = out << TERM | np.where(np.isfinite(lot[least]), term[least], 0)
        lot[least] = np.inf
    return out


def dealt_by_key(keyed: DataFrame, shard_tokens: int) -> DataFrame:
    """keyed(key, row, rest, ...) with a shard: see 2. above."""
    spark, size = keyed.sparkSession, F.sum(F.greatest(F.length("rest") / 2, F.lit(1.0)))
    sums = keyed.groupBy("key").agg(size.alias("size"))
    # at most four rows a shard, and a row per id of the vocabulary
    keys = {r.key: r.size for r in sums.where(F.col("size") > shard_tokens / 4).collect()}
    terms = {r.term: r.size for r in sums.where(F.col("size") <= shard_tokens / 4).groupBy(F.shiftright("key", TERM * (KEY_TERMS - 1)).alias("term")).agg(F.sum("size").alias("size")).collect()}
    if sum(keys.values()) + sum(terms.values()) <= shard_tokens * 1.5:
        return keyed.withColumn("shard", F.lit(0).cast("long"))
    shard, held = 0, 0.0

    def place(size: float) -> tuple[int, int]:
        """The first shard and the number of shards of a group; small groups share one."""
        nonlocal shard, held
        if held and held + size > shard_tokens:
            shard, held = shard + 1, 0.0
        n = max(1, -int(-size // shard_tokens))
        first, shard, held = shard, shard + n - 1, held + size if n == 1 else float(shard_tokens)
        return first, n

    by_term = [(t, *place(terms[t])) for t in sorted(terms)]
    by_key = [(k, *place(keys[k])) for k in sorted(keys)]
    one = F.broadcast(spark.createDataFrame(by_term, "term long, term_first long, term_n long"))
    two = F.broadcast(spark.createDataFrame(by_key, "key long, key_first long, key_n long"))
    out = keyed.withColumn("term", F.shiftright("key", TERM * (KEY_TERMS - 1))).join(one, "term", "left").join(two, "key", "left")
    own = F.col("key_first") + F.pmod(F.xxhash64("row"), F.col("key_n"))
    return out.withColumn("shard", F.coalesce(own, F.col("term_first") + F.pmod(F.xxhash64("key"), F.col("term_n")))).select("shard", *keyed.columns)


def retrieval_order(rests: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, window: int, n_terms: int = QUERY_TERMS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (rest, start in it, length). An inverted index over the shard's rests, with the statistics of all
    documents, ranks the unused neighbours of each seed."""
    n = len(rests)
    sizes = np.array([len(r) for r in rests], np.int64)
    # (rest, term) -> weight, then sorted by term: the postings
    doc, term, weight = weights_of(rests, df, n_docs, mean)
    ends = np.searchsorted(doc, np.arange(n + 1))
    by_term = np.argsort(term, kind="stable")
    post_doc, post_weight = doc[by_term], weight[by_term].astype(np.float32)
    post_ends = np.searchsorted(term[by_term], np.arange(len(df) + 1))
    free, used_to = np.ones(n, bool), np.zeros(n, np.int64)
    out, seed, carry = [], 0, -1
    while True:
        if carry < 0:
            while seed < n and not free[seed]:
                seed += 1
            if seed == n:
                return out
        head = carry if carry >= 0 else seed
        start, free[head], carry = int(used_to[head]), False, -1
        pieces, room = [(head, start, int(sizes[head]) - start)], window - (int(sizes[head]) - start)
        if room > 0:
            mine = slice(ends[head], ends[head + 1])
            best = np.argsort(-weight[mine], kind="stable")[:n_terms]
            spans = [slice(post_ends[t], post_ends[t + 1]) for t in term[mine][best]]
            score = np.bincount(np.concatenate([post_doc[s] for s in spans]), np.concatenate([post_weight[s] for s in spans]), n)
            score[~free] = -1
            score[free] += 1e-9  # a rest without a common term comes last, not never
            top = min(n, 48)
            while room > 0:
                ranked = np.argpartition(-score, top - 1)[:top]
                ranked = ranked[np.argsort(-score[ranked], kind="stable")]
                ranked = ranked[score[ranked] > 0]
                if not len(ranked):
                    break
                for x in ranked.tolist():
                    take = min(room, int(sizes[x]))
                    pieces.append((x, 0, take))
                    free[x], score[x], room = False, -1, room - take
                    if take < sizes[x]:
                        used_to[x], carry = take, x
                    if not room:
                        break
        out.append(pieces)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False, query_terms: int = QUERY_TERMS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), gapless in each sequence; with_ids: and
    the ids of pieces that share a window (uint16 bytes; a window that one document fills alone has its own ids null)."""
    spark = docs.sparkSession
    made = written(tokenised(docs, path, window, end_id), "tokenised", "snappy")
    stats = made.where("n is not null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.length("rest") / 2), F.lit(0)).alias("rest")).first()
    # at most one row per id of the vocabulary
    counts = made.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max([r.term for r in counts], default=0) + 1, np.int64)
    for r in counts:
        df[r.term] = r.df
    n_docs, mean = stats.docs, stats.rest / max(stats.docs, 1)
    frequencies = spark.sparkContext.broadcast(df)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk_tokenizer.cache_clear()  # a worker that tokenised before holds its chunks no longer
        shard, rows = None, []
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "doc_id", "n", "crcs", "rest")), strict=True):
                if row[0] != shard and rows:
                    yield from packed(shard, rows)
                    rows = []
                shard = row[0]
                rows.append(row)
        if rows:
            yield from packed(shard, rows)

    def packed(shard: int, rows: list[tuple]) -> Iterator[dict]:
        cols: dict[str, list] = {f.name: [] for f in arrow_names}

        def put(doc_id, start, length, crc, n, offset, ids):
            for k, v in zip(cols, (doc_id, start, length, crc, n, (shard << 32) + number, offset, ids), strict=True):
                cols[k].append(v)

        number = 0
        for _, _, doc_id, n, crcs, _ in rows:
            for i, crc in enumerate(crcs):
                put(doc_id, i * window, window, crc, n, 0, None)
                number += 1
        rests = [np.frombuffer(r[5], np.uint16) for r in rows]
        held = [i for i, r in enumerate(rests) if len(r)]
        for pieces in retrieval_order([rests[i] for i in held], frequencies.value, n_docs, mean, window, query_terms):
            offset = 0
            for x, start, length in pieces:
                _, _, doc_id, n, crcs, _ = rows[held[x]]
                ids = rests[held[x]][start : start + length]
                put(doc_id, len(crcs) * window + start, length, crc32_ids(ids), n, offset, ids.tobytes() if with_ids else None)
                offset += length
            number += 1
        yield cols

    from .common import arrow_schema

    arrow_names = arrow_schema(SCHEMA)
    fields = ("row", "doc_id", "n", "crcs", "rest")

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            rests = [np.frombuffer(r, np.uint16) for r in batch.column("rest").to_pylist()]
            key, some = np.zeros(len(rests), np.int64), [i for i, r in enumerate(rests) if len(r)]
            key[some] = lexical_keys([rests[i] for i in some], frequencies.value, n_docs, mean)
            none = np.array([not len(r) for r in rests], bool)  # no term: any key, so that no shard gets all
            key[none] = batch.column("row").to_numpy()[none] * 2654435761 % (1 << TERM * KEY_TERMS)
            yield {"key": key} | {c: batch.column(c) for c in fields}

    with_keys = written(by_arrow(made.where("n is not null").select(*fields), keyed, "key long, row long, doc_id long, n long, crcs array<long>, rest binary"), "keyed", "snappy")
    dealt = dealt_by_key(with_keys, shard_tokens).select("shard", *fields)
    out = by_arrow(dealt.repartition("shard").sortWithinPartitions("shard", "row"), run, SCHEMA)
    return out if with_ids else out.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
