"""Quality rules with line sequence labelling: a linear-chain conditional random field and Viterbi decoding.

Each line with a word is described by counts of its bytes (letters, capitals, digits, symbols, marks), its words and whether it
equals another line of the text. The field labels the lines as content or boilerplate together, with weights for the
features and for each pair of neighbouring labels; the best labelling is found by Viterbi decoding. A text whose words lie
in content lines by at least SHARE is kept, unless a base rule fails.

The weights are fitted by maximum likelihood (forward-backward) to labelled texts, of which at most TRAIN_ROWS (of up to TRAIN_LINES lines) are used, each
line taking its text's label. Everything else covers whole texts of all rows, without a shuffle.

Edge cases: null and empty texts have no words, fail the base rule and are not kept; texts without labelled rows to learn from
are judged by the base rules alone; repeated rows are judged each; very long lines and texts of very many lines are
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_arrow, first_by_hash, table, texts_of, utf8
from .repeats import mixed, rolled

TRAIN_ROWS, TRAIN_LINES, SHARE = 2000, 100, 0.5
SPACES, SYMBOLS, MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b".,;:!?'\"()-"
WIDTH, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _kinds() -> np.ndarray:
    """For each byte: space, symbol, mark, digit, capital, other letter."""
    kind = np.full(256, 5, np.int8)
    for n, members in enumerate((SPACES, SYMBOLS, MARKS, b"0123456789", bytes(range(65, 91)))):
        kind[list(members)] = n
    return kind


KIND = _kinds()
N_FEATURES = 12


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: text, words, features; and per text how many equal an earlier line."""
    owner, dup, alike, lengths, parts = [], np.zeros(len(texts), np.int64), [], [], []
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        seen: dict[bytes, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        dup[i] = len(lines) - len(seen)
        owner += [i] * len(lines)
        alike += [seen[x] > 1 for x in lines]
        lengths += map(len, lines)
        parts += lines
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, N_FEATURES)), dup
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    sizes = np.array(lengths, np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    kind = KIND[data]
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), begins) for k in range(6)], 1).astype(np.float64)
    counts[:, 0] -= 1  # the line's end
    space = kind == 0
    words = np.add.reduceat((~space & np.r_[True, space[:-1]]).astype(np.int32), begins).astype(np.int64)
    inked = np.maximum(sizes - counts[:, 0], 1)
    share = counts[:, 1:] / inked[:, None]
    last = data[begins + sizes - 1]
    features = np.column_stack([np.ones(len(sizes)), np.log1p(words) / 4, inked / words / 10, share[:, 0] * 4, share[:, 1] * 4, share[:, 2] * 4, share[:, 3], np.isin(last, list(b".!?\"")), np.array(alike, float), words < 4, share[:, 0] > 0.1, share[:, 3] > 0.5])
    return np.array(owner, np.int64), words, features, dup


class Field:
    """Weights of the features for content against boilerplate, and of pairs of neighbouring labels."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    def scores(self, features: np.ndarray) -> np.ndarray:
        s = features @ self.weights
        return np.column_stack([-s / 2, s / 2])

    def viterbi(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The label of each line; bounds: where each text's lines begin, and the end. All texts go on together."""
        scores, labels = self.scores(features), np.zeros(len(features), np.int8)
        starts, sizes = bounds[:-1], np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        starts, sizes = starts[sizes > 0], sizes[sizes > 0]
        back = np.zeros((len(features), 2), np.int8)
        best, final = scores[starts].copy(), np.zeros((len(starts), 2))
        active = len(starts)
        for t in range(int(sizes.max(initial=0))):
            now = int(np.searchsorted(-sizes, -t, "left"))  # texts with more than t lines come first
            if t:
                ways = best[:now, :, None] + self.pairs[None]
                back[starts[:now] + t] = ways.argmax(1)
                best[:now] = ways.max(1) + scores[starts[:now] + t]
            active = now
        final = best.argmax(1)
        for t in range(int(sizes.max(initial=0)) - 1, -1, -1):
            active = int(np.searchsorted(-sizes, -t, "left"))
            at = starts[:active] + t
            labels[at] = final[:active]
            final[:active] = back[at, final[:active]]
        return labels

    def fit(self, features: np.ndarray, bounds: np.ndarray, truth: np.ndarray, rounds: int = 80, rate: float = 0.3, penalty: float = 1e-3) -> Field:
        """Gradient steps on the mean log likelihood of the label sequences, sizes adapted for each weight."""
        sizes = np.diff(bounds)
        keep = np.flatnonzero(sizes > 0)
        longest, n = int(sizes.max(initial=0)), max(1, len(keep))
        place = bounds[:-1][keep][:, None] + np.arange(longest)[None]
        mask = np.arange(longest)[None] < sizes[keep][:, None]
        place = np.where(mask, place, 0)
        label = np.where(mask, truth[place], 0) if len(truth) else np.zeros_like(place)
        grown = np.full(N_FEATURES + 4, 1e-8)
        total = max(1, int(mask.sum()))
        for _ in range(rounds if len(keep) and len(truth) else 0):
            s = self.scores(features)[place]
            forward = np.zeros((longest, n, 2))
            forward[0] = s[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(forward[t - 1][:, :, None] + self.pairs[None], 1) + s[:, t]
                forward[t] = np.where(mask[:, t, None], step, forward[t - 1])
            whole = np.logaddexp.reduce(forward[-1], 1)
            backward = np.zeros((longest, n, 2))
            pair_gain = np.zeros((2, 2))
            for t in range(longest - 2, -1, -1):
                onward = (s[:, t + 1] + backward[t + 1])[:, None, :] + self.pairs[None]
                backward[t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(onward, 2), 0)
                p = np.exp(forward[t][:, :, None] + onward - whole[:, None, None]) * mask[:, t + 1, None, None]
                pair_gain -= p.sum(0)
            np.add.at(pair_gain, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1)
            content = np.exp(forward[:, :, 1].T + backward[:, :, 1].T - whole[:, None])
            gain = ((label - content) * mask)[mask] @ features[place[mask]]
            g = np.r_[gain, pair_gain.ravel()] / total - penalty * np.r_[self.weights, self.pairs.ravel()]
            grown += g * g
            step = rate * g / np.sqrt(grown)
            self.weights = self.weights + step[:N_FEATURES]
            self.pairs = self.pairs + step[N_FEATURES:].reshape(2, 2)
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field | None:
    """The field of at most `rows` labelled texts (by a hash of the id); None if there are no two kinds."""
    known = labels.where("quality is not null and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "quality")
    used = texts_of(docs, first_by_hash(known, rows))
    if used.quality.nunique() < 2:
        return None
    owner, _, features, _ = lines_of([t.encode() for t in used.text])
    bounds = np.searchsorted(owner, np.arange(len(used) + 1))
    few = np.flatnonzero(np.diff(bounds) <= TRAIN_LINES)  # padded to the longest
    at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in few]) if len(few) else np.empty(0, np.int64)
    sizes = np.r_[0, np.cumsum(np.diff(bounds)[few])]
    return Field().fit(features[at], sizes, used.quality.to_numpy()[owner[at]].clip(0, 1))


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """Words of each text in a window of WIDTH words that the text has twice or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    if sizes.sum() < WIDTH:
        return out
    words = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    key = mixed(rolled(mixed(words), WIDTH))
    inside = np.flatnonzero(owner[: len(key)] == owner[WIDTH - 1 :])
    if not len(inside):
        return out
    key = key[inside] ^ mixed(owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = inside[order[np.r_[False, same] | np.r_[same, False]]]
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WIDTH, -1)
    return np.bincount(owner, np.cumsum(cover[:-1]) > 0, len(texts)).astype(np.int64)


def judged(docs: DataFrame, field: Field | None, share: float = SHARE) -> DataFrame:
    """The base counts, base_failed, kept and the share of words in content lines, of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            words = [t.split() for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            spaces = np.array([len(t) - len(t.translate(None, SPACES)) for t in texts], np.int64)
            points = np.array([len(t.decode()) for t in texts], np.int64)
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
            repeat = repeated_words(words)
            owner, in_line, features, dup = lines_of(texts)
            content = np.ones(len(texts))
            if field is not None:
                labels = field.viterbi(features, np.searchsorted(owner, np.arange(len(texts) + 1)))
                content = np.bincount(owner, in_line * labels, len(texts)) / np.maximum(np.bincount(owner, in_line, len(texts)), 1)
            failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
            yield {"doc_id": batch.column("doc_id"), "n_words": n, "word_chars": points - spaces, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & (content >= share), "content_share": content}

    return by_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, SCHEMA)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
