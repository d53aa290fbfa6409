"""Token counts by rank-synchronous array merging.

The distinct pieces of a batch of texts are held as one ragged numpy array of symbols. In each round every sequence finds
its pair of lowest rank, and all sequences merge their pair at once; a sequence without a known pair has ended, and
its surviving symbols are counted. A merged symbol can only take part in pairs of higher rank, so merging all places
of a pair at once, from the left, gives what a queue of single merges gives.

Texts are cut at spaces into chunks whose tokens don't depend on their neighbours, so that each distinct chunk is
counted once a worker (a cache of bounded size); texts in which a space touches other white space are cut by the
full pattern. Edge cases: null and empty texts have 0 bytes and 0 tokens; the special string counts as its one token;
repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_arrow, table

#: Most tokens of a document within the limit, and most chunks and pieces that a worker remembers.
LIMIT, CACHE = 1024, 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: The published pattern of the byte-level vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space beside other white space, for which a chunk's tokens depend on the next chunk.
TOUCHING = re.compile(r" \s|\s ")
RARE_SPACE = re.compile(r"[^\S \n]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of byte strings after all merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        vocab = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        never, last = np.iinfo(np.int64).max, len(self.keys) - 1
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), last)
            rank = np.full(len(sym), never)
            rank[:-1] = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], never)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == never
            out[seq[starts[ended]]] = sizes[ended]
            here = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != never))
            # of places that overlap (a a a), every other one from the left
            run = np.cumsum(np.r_[True, np.diff(here) != 1]) if len(here) else here
            nth = np.arange(len(here)) - (np.searchsorted(run, run) if len(here) else 0)
            here = here[nth % 2 == 0]
            sym[here] = self.made[at[here]]
            keep = np.repeat(~ended, sizes)
            keep[here + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class TokenCounter:
    """Tokens of whole texts as the library counts them by default."""

    def __init__(self, path: str, cache: int = CACHE):
        self.merger, self.cache = RankMerger(path), cache
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special))) if self.merger.special else None
        self.chunks: dict[str, int] = {}  # as after one space
        self.pieces: dict[str, int] = {}

    def _add_pieces(self, pieces: Iterable[str]) -> None:
        if new := [p for p in set(pieces) if p not in self.pieces]:
            self.pieces.update(zip(new, self.merger.counts([p.encode() for p in new]).tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.chunks) > self.cache or len(self.pieces) > self.cache:
            self.chunks, self.pieces = {}, {}
        totals, plain, cut = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special else [text]
            totals[i] += len(parts) - 1
            for part in parts:
                if part:
                    if "  " in part or " \n" in part or "\n " in part or RARE_SPACE.search(part) and TOUCHING.search(part):
                        cut.append((i, PIECES.findall(part)))
                    else:
                        chunks = part.split(" ")
                        cut.append((i, PIECES.findall(chunks[0])))
                        plain.append((i, chunks[1:]))
        new = set().union(*(c for _, c in plain)) - self.chunks.keys()
        found = {c: PIECES.findall(" " + c) for c in new}
        self._add_pieces(p for ps in found.values() for p in ps)
        self._add_pieces(p for _, ps in cut for p in ps)
        self.chunks.update((c, sum(map(self.pieces.__getitem__, ps))) for c, ps in found.items())
        for known, lists in ((self.chunks, plain), (self.pieces, cut)):
            for i, items in lists:
                totals[i] += sum(map(known.__getitem__, items))
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = counter(path)
        for batch in it:
            texts = batch.column("text").to_pylist()
            n = own.counts(texts)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return by_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
