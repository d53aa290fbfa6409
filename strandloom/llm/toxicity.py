"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

Two words are as alike as the subsequences of DEPTH letters that they share, each weighted by DECAY to the power of the
stretch it takes, so that letters in between (an inserted character, a gap) cost little: the gapped string kernel, normalised.
Landmarks are the words that set toxic training texts apart and words of clean texts; the kernel with the landmarks,
whitened by the kernel among them, are a word's Nystroem features, and a linear support vector machine on these is trained.
A word (or two neighbouring words of a sentence, read as one, that neither word explains) marks toxic texts if it is in more
of them than chance lets any of all words be, copies of a text counted once.
A text's sentences are labelled as a whole, so its witness (the unit of highest value) is chosen anew in each round, and
the highest words of clean texts are added as landmarks and negatives. The machine's value of a word is a sum over its
subsequences, so the trained machine is stored as one weight per subsequence, and words are scored by that.
A text's value is the highest of its sentences', and a sentence's that of its words and of its pairs of neighbours of which one is
a part of a marking pair (the other may be gapped or have inserted characters); a logistic curve fitted to training texts makes it a score.

Words are read as letters only (i.d.i.o.t is one word) and runs of single letters also as one word (i d i o t); words over
LONGEST letters are read in windows of LONGEST. Training uses at most TRAIN_ROWS labelled rows; whole texts of all rows are
scored, without a shuffle. Edge cases: null and empty texts and those without words score as the lowest word would; without both
labels to learn from, all score 0; a null doc_id is scored, not learned from; repeated rows are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, crc_mod, first_by_hash, table, texts_of

DEPTH, DECAY, LONGEST, LETTERS = 3, 0.6, 20, 32
TRAIN_ROWS, LANDMARKS, ROUNDS, THRESHOLD = 4500, 160, 4, 0.3
#: Most marks that chance would give among all words.
CHANCE = 0.1
#: The probability under which a word is taken for a witness.
WITNESS = 1e-3
SENTENCE = re.compile(r"[.!?;\n]+(?:\s+|$)|\n+")
CACHE = 600_000
SINGLE = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
LETTER_RUN = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double, predicted int"


def words_of(text: str | None) -> set[str]:
    """The distinct words, as letters in lower case."""
    if not text:
        return set()
    text = text.lower()
    out = set(text.split())
    if SINGLE.search(text):
        out.update(m.group().replace(" ", "").replace("\t", "") for m in SINGLE.finditer(text))
    return out


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(LETTER_RUN.findall(word))


def coded(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter codes: a to z, and the rest in six classes."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (LETTERS - 26))


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All DEPTH places of n letters in order, and the weight of the stretch that each takes."""
    p = np.array(list(combinations(range(n), DEPTH)), np.int64).reshape(-1, DEPTH)
    return p, DECAY ** (p[:, -1] - p[:, 0] + 1).astype(np.float64)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x subsequences) keys, and their weights."""
    at, weight = places(codes.shape[1])
    key = np.zeros((len(codes), len(at)), np.int64)
    for i in range(DEPTH):
        key = key * LETTERS + codes[:, at[:, i]]
    return key, weight


def norms(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each row's vector of subsequence weights (equal subsequences add up)."""
    order = np.argsort(key, 1)
    k, w = np.take_along_axis(key, order, 1), weight[order]
    total = np.cumsum(w, 1)
    ends = np.c_[k[:, 1:] != k[:, :-1], np.ones(len(k), bool)]
    before = np.where(ends, total, 0)
    previous = np.c_[np.zeros(len(k)), np.maximum.accumulate(before, 1)[:, :-1]]
    return np.sqrt((np.where(ends, total - previous, 0) ** 2).sum(1))


def vectors(words: list[str]) -> np.ndarray:
    """Normalised vectors of words over all subsequences; their products are the kernel."""
    out = np.zeros((len(words), LETTERS**DEPTH), np.float32)
    for i, w in enumerate(words):
        key, weight = subsequences(coded([w]))
        np.add.at(out[i], key[0], weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pieces(word: str) -> list[str]:
    """A word's letters, in windows of LONGEST that overlap by half."""
    w = letters(word)
    if len(w) <= LONGEST:
        return [w] if len(w) >= DEPTH else []
    return [w[a : a + LONGEST] for a in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


def neighbours(text: str) -> Iterator[tuple[str, str]]:
    """Neighbouring words of each sentence, as letters."""
    for sentence in SENTENCE.split(text.lower()):
        words = [w for w in map(letters, sentence.split()) if w]
        yield from zip(words, words[1:], strict=False)


def joined(pair: tuple[str, str]) -> str:
    return pair[0] + pair[1]


@dataclass
class Machine:
    """Weight of each subsequence, the logistic curve, and the first and second words of marking pairs."""

    weights: np.ndarray
    lowest: float
    slope: float = 1.0
    offset: float = 0.0
    firsts: frozenset[str] = frozenset()
    seconds: frozenset[str] = frozenset()

    def units(self, text: str | None) -> set[str]:
        """What the text is scored by: its words, and its pairs that have a part of a marking pair."""
        out = words_of(text)
        if (self.firsts or self.seconds) and text:
            out.update(joined(p) for p in neighbours(text) if p[0] in self.firsts or p[1] in self.seconds)
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word: its highest piece."""
        out = np.full(len(words), self.lowest, np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for p in pieces(word):
                by_length.setdefault(len(p), []).append((i, p))
        for n, rows in by_length.items():
            step = max(1, 400_000 // len(places(n)[0]))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                key, weight = subsequences(coded([p for _, p in some]))
                value = (self.weights[key] @ weight) / np.maximum(norms(key, weight), 1e-9)
                np.maximum.at(out, [i for i, _ in some], value)
        return out

    def scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        held = [self.units(t) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list(set().union(*held).difference(known))
        known.update(zip(new, self.values(new).tolist(), strict=True))
        best = np.array([max(map(known.__getitem__, w), default=self.lowest) for w in held])
        return 1 / (1 + np.exp(-(self.slope * best + self.offset)))


def hinge_weights(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400) -> np.ndarray:
    """Linear machine (last column: offset) of squared hinge loss and an L2 penalty, by accelerated gradient steps."""
    x = np.c_[x, np.ones(len(x))]
    w = ahead = np.zeros(x.shape[1])
    rate = 1 / (2 * np.linalg.norm(x * np.sqrt(cost)[:, None], 2) ** 2 + 1e-2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (1e-2 * ahead - 2 * x.T @ (cost * y * slack))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def tail(n: int, k: int, p: float) -> float:
    """The probability of k or more of n."""
    k0 = np.arange(k, n + 1)
    logs = np.cumsum(np.r_[0.0, np.log(np.arange(1, n + 1))])
    return float(np.exp(logs[n] - logs[k0] - logs[n - k0] + k0 * np.log(p) + (n - k0) * np.log1p(-p)).sum())


def marking(bad: Counter, good: Counter, share: float) -> list[str]:
    """What is in more toxic texts than chance lets CHANCE of all be, most telling first."""
    at = {w: tail(n + good[w], n, share) for w, n in bad.items() if n >= 3 and n > 2 * share * (n + good[w])}
    return sorted((w for w, x in at.items() if x * len(bad) < CHANCE), key=lambda w: (at[w], w))


def train_machine(texts: list[str], toxic: np.ndarray) -> Machine | None:
    """The machine of labelled texts; None without both labels."""
    single = {t: x for t, x in zip(texts, toxic.tolist(), strict=True)}
    texts, toxic = list(single), np.array(list(single.values()), bool)
    bags = [sorted({p for w in words_of(t) for p in pieces(w)}) for t in texts]
    toxic = toxic & np.array([bool(b) for b in bags], bool)
    if not toxic.any() or toxic.all():
        return None
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    share = n_toxic / (n_toxic + n_clean)
    bad, good = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (bad if t else good).update(bag)
    marks = marking(bad, good, share)
    # pairs are looked for in the toxic texts without a marking word, against all clean texts
    explained = set(marks)
    rest = [i for i, (b, t) in enumerate(zip(bags, toxic, strict=True)) if not (t and explained.intersection(b))]
    pair_bad, pair_good = Counter(), Counter()
    for i in rest:
        if toxic[i]:
            pair_bad.update({p for p in neighbours(texts[i]) if DEPTH <= len(joined(p)) <= LONGEST})
    for i in rest:
        if not toxic[i] and pair_bad:
            pair_good.update({p for p in neighbours(texts[i]) if p in pair_bad})
    left = sum(bool(toxic[i]) for i in rest)
    pairs = marking(pair_bad, pair_good, max(left, 1) / (max(left, 1) + n_clean))[: LANDMARKS // 4]
    firsts, seconds = frozenset(a for a, _ in pairs), frozenset(b for _, b in pairs)
    if pairs:
        for i, t in enumerate(texts):
            more = {joined(p) for p in neighbours(t) if p[0] in firsts or p[1] in seconds}
            more = {x for m in more for x in pieces(m)}.difference(bags[i])
            bags[i] = sorted({*bags[i], *more})
            (bad if toxic[i] else good).update(more)
        marks += [x for p in pairs for x in pieces(joined(p))]
    odds = {w: np.log((n + 0.2) / n_toxic) - np.log((good[w] + 0.2) / n_clean) + 0.5 * np.log(n) for w, n in bad.items()}
    often = 3  # a word of one text is no mark
    marks = list(dict.fromkeys(marks))[: LANDMARKS // 2] or sorted(odds, key=lambda w: (-odds[w], w))[:4]
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))]
    landmarks = list(dict.fromkeys([*marks, *common[: LANDMARKS // 4], *common[:: max(1, len(common) // (LANDMARKS // 4))]]))[: max(3 * LANDMARKS // 4, len(marks))]
    odds = {w: odds.get(w, 0.0) for b in bags for w in b}
    witness = [max(b, key=lambda w: (odds[w], w)) for b, t in zip(bags, toxic, strict=True) if t]
    clean = [w for w in common if good[w] > 0]
    negatives = list(dict.fromkeys(common[:1000] + common[:: max(1, len(common) // 3000)]))
    machine = None
    for _ in range(ROUNDS):
        v = vectors(landmarks)
        values, basis = np.linalg.eigh((v @ v.T).astype(np.float64) + 1e-3 * np.eye(len(v)))
        whiten = basis / np.sqrt(np.maximum(values, 1e-6)) @ basis.T
        seen = Counter(witness) | Counter({w: bad[w] for w in marks})
        # what one text has, or clean texts have about as often, is no witness
        positive = [w for w in seen if good[w] * n_toxic < 0.2 * seen[w] * n_clean and bad[w] >= often and (w in marks or tail(bad[w] + good[w], bad[w], share) < WITNESS)] or marks
        rows = positive + negatives
        x = np.concatenate([vectors(rows[a : a + 200]) @ v.T for a in range(0, len(rows), 200)]) @ whiten
        y = np.r_[np.ones(len(positive)), -np.ones(len(negatives))]
        cost = np.r_[[seen[w] for w in positive], np.ones(len(negatives))].astype(float)
        cost[y > 0] /= max(cost[y > 0].sum(), 1e-9)
        cost[y < 0] /= cost[y < 0].sum()
        w = hinge_weights(x, y, cost * 200)
        weights = (v.T @ (whiten @ w[:-1])).astype(np.float32)
        machine = Machine(weights, 0.0, firsts=firsts, seconds=seconds)
        machine.lowest = float(min(0.0, machine.values(negatives).min()))
        known = dict(zip(all_words := sorted({p for b in bags for p in b}), machine.values(all_words).tolist(), strict=True))
        witness = [max(b, key=known.__getitem__) for b, t in zip(bags, toxic, strict=True) if t]
        hard = [w for w in sorted(clean, key=lambda w: -known[w])[:400] if bad[w] * n_clean < 3 * (good[w] + 1) * n_toxic]
        negatives = list(dict.fromkeys(negatives + hard))
        landmarks = list(dict.fromkeys(landmarks + hard[: LANDMARKS // 8]))[: LANDMARKS + LANDMARKS // 4]
    best = np.array([max((known[w] for w in b), default=machine.lowest) for b in bags])
    machine.slope, machine.offset = logistic(best, toxic)
    return machine


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the least log loss (Newton steps, halved until they help)."""
    centre, scale = x.mean(), max(x.std(), 1e-6)
    design, w = np.c_[(x - centre) / scale, np.ones(len(x))], np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        h = design.T * (p * (1 - p)) @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 0.1 * w)
        while np.abs(step).max() > 1e-6 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
    slope = max(w[0], 1e-3) / scale
    return float(slope), float(w[1] - slope * centre)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine of at most `rows` labelled rows (by a hash of the id)."""
    known = labels.where("toxic is not null and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "toxic")
    # toxic rows are rare: up to a third of the rows used
    some = first_by_hash(known.where("toxic = 1"), rows // 3).unionByName(first_by_hash(known.where("toxic = 0"), rows - rows // 3))
    frame = texts_of(docs, some)
    if frame.toxic.nunique() < 2:
        return None
    machine = train_machine(frame.text.tolist(), frame.toxic.to_numpy() == 1)
    if machine is not None:
        # the share of toxic rows among all labelled ones, not among those used
        share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        held = frame.toxic.mean()
        machine.offset += float(np.log(share / (1 - share)) - np.log(held / (1 - held)))
    return machine


def scored(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[str, float] = {}
        for batch in it:
            n = batch.num_rows
            score = held.value.scores(batch.column("text").to_pylist(), known) if held.value else np.zeros(n)
            yield {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return by_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, SCHEMA)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
