"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is read as lower-case letters, any run of other characters being one gap. The n-grams of the highest order are
counted over all training rows (partial counts a task, then one sum); from these come, as tables, the Kneser-Ney counts of the
lower orders (distinct predecessors), the discounts (from the counts of ones and twos) and the sum of each context.
All of these cover every n-gram. The model then holds, in sorted arrays of n-gram keys with a column per language, the n-grams
whose share of their language's and order's count is at least PRUNE; the probability of the others goes to the next order,
by a back-off weight that makes each context sum to one. So at most 1 / PRUNE n-grams an order and language are held at
any input size, and the sums they rest on grow with the input.
The language of the lowest cross-entropy per character wins. A fold of the training rows, scored by the executors, gives the
temperature of the score and, per language, the cross-entropy beyond which a text is rejected: a margin over the median, and
a part that falls with the square root of the letters, as that of a mean does.

Edge cases: null texts and texts without a letter are `und` with score 0 and rejected; a null id or language is not
learned from; ties go to the first language in order; repeated rows are scored each; without any training row
all is `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, crc_mod, dropped, table, written

ORDER, BITS = 5, 12
#: The least share of a language's counts that an n-gram of the model has.
PRUNE = 1e-6
#: One in FOLD training rows is held back for calibration, which uses all of these.
FOLD = 40
TEMPERATURES = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
#: A group of calibration that holds the rows of all languages.
POOLED = -1
#: Least margins of rejection in nats: over the median, and for one letter.
MARGIN, ONE_LETTER = 0.5, 6.0
#: Bytes of a piece of the stored model.
PIECE = 8 << 20
CHUNK = 400_000
MASK = (1 << BITS) - 1


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The code of each code point: 0 if no letter, else from its lower case."""
    codes = np.zeros(0x110000, np.uint16)
    for cp in range(0x32400):
        c = chr(cp)
        if c.isalpha():
            codes[cp] = ord(c.lower()[0]) & MASK or 1
    return codes


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (each after ORDER - 1 gaps), the bounds of each text's symbols, and its letters."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = letter_codes()[np.concatenate(points)] if points else np.empty(0, np.uint16)
    ends = np.cumsum([0, *map(len, points)])
    gap = codes == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first gap after a letter
    total = np.r_[0, np.cumsum(keep)]
    letters = np.r_[0, np.cumsum(~gap)]
    sizes = total[ends[1:]] - total[ends[:-1]]
    starts = np.r_[0, np.cumsum(sizes + ORDER - 1)][:-1] + ORDER - 1
    out = np.zeros(int(sizes.sum()) + len(texts) * (ORDER - 1), np.int64)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), sizes)] = codes[keep]
    return out, np.stack([starts, starts + sizes], 1), letters[ends[1:]] - letters[ends[:-1]]


def grams(symbols: np.ndarray, at: slice) -> np.ndarray:
    """The key of the ORDER symbols that end at each place of the slice."""
    key = np.zeros(at.stop - at.start, np.int64)
    for back in range(ORDER - 1, -1, -1):
        key = key << BITS | symbols[at.start - back : at.stop - back]
    return key


@dataclass
class Model:
    """For order k: sorted keys of k symbols with the log probability in each language, and sorted contexts of k - 1
    symbols with the log weight of the next order."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    logw: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = 0.0
    temperature: float = 8.0
    #: per language: median cross-entropy and margin together, and the part of one letter
    most: np.ndarray | None = None
    more: np.ndarray | None = None

    def score(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each key's last symbol after the others, in each language."""
        if order == 0:
            return np.full((len(key), len(self.langs)), self.floor, np.float32)
        known = self.keys[order]
        key = key & ((1 << BITS * order) - 1)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out = self.logp[order][at]
        miss = np.flatnonzero(known[at] != key)
        if len(miss):
            out[miss] = self.score(key[miss], order - 1)
            before, context = self.contexts[order], key[miss] >> BITS
            at = np.minimum(np.searchsorted(before, context), len(before) - 1)
            out[miss] += np.where((before[at] == context)[:, None], self.logw[order][at], 0)
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text in each language, and its letters."""
        symbols, bounds, letters = encode(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(ORDER - 1, len(symbols), CHUNK):
            b = min(a + CHUNK, len(symbols))
            summed = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.score(grams(symbols, slice(a, b))), 0, dtype=np.float64)])
            low, high = np.clip(bounds[:, 0], a, b) - a, np.clip(bounds[:, 1], a, b) - a
            total += summed[high] - summed[low]
        return -total / np.maximum(bounds[:, 1] - bounds[:, 0], 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, letters = self.cross_entropy(texts)
        best = entropy.argmin(1)
        odds = np.exp(self.temperature * (entropy.min(1, keepdims=True) - entropy))
        score = np.where(letters > 0, 1 / odds.sum(1), 0.0)
        rejected = letters == 0
        if self.most is not None:
            rejected |= entropy.min(1) > self.most[best] + self.more[best] / np.sqrt(np.maximum(letters, 1))
        return [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, rejected


def kneser_ney(langs: list[str], discounts: dict[tuple[int, int], float], kept: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Model:
    """kept: for each order and language, sorted keys, their counts and the sums of their contexts; discounts by (order,
    language)."""
    model = Model(langs)
    model.floor = -float(np.log(len(np.unique(np.concatenate([k for k, _, _ in kept[1]]))) + 1))
    for order in range(1, ORDER + 1):
        model.keys[order] = union = np.unique(np.concatenate([k for k, _, _ in kept[order]]))
        model.contexts[order] = before = np.unique(union >> BITS)
        model.logp[order] = np.zeros((len(union), len(langs)), np.float32)
        model.logw[order] = np.zeros((len(before), len(langs)), np.float32)
        if not len(union):
            continue
        lower = np.exp(model.score(union, order - 1).astype(np.float64))
        at_context = np.searchsorted(before, union >> BITS)
        for i, (keys, counts, sums) in enumerate(kept[order]):
            share = (counts - discounts.get((order, i), 0.5)) / sums
            # what the context's kept n-grams leave, i.e. discounts and n-grams that aren't held
            weight = np.clip(1 - np.bincount(np.searchsorted(before, keys >> BITS), share, len(before)), 1e-9, 1)
            p = weight[at_context] * lower[:, i]
            p[np.searchsorted(union, keys)] += share
            model.logp[order][:, i] = np.log(p)
            model.logw[order][:, i] = np.log(weight)
    return model


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); a task sends a row for each of its distinct n-grams."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {}

        def added(lang: str, keys: np.ndarray, counts: np.ndarray) -> None:
            if lang in held:
                keys, where = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([held[lang][1], counts]), len(keys)).astype(np.int64)
            held[lang] = [keys, counts]

        def out() -> Iterator[dict]:
            for lang, (keys, counts) in held.items():
                for a in range(0, len(keys), 50_000):
                    k = keys[a : a + 50_000]
                    yield {"lang": [lang] * len(k), "gram": k, "n": counts[a : a + 50_000]}
            held.clear()

        waiting: dict[str, list[np.ndarray]] = {}

        def settled(least: int) -> None:
            for lang in [x for x, v in waiting.items() if sum(map(len, v)) > least]:
                added(lang, *np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))

        for batch in it:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                symbols, bounds, _ = encode([t for t, x in zip(texts, langs, strict=True) if x == lang])
                if len(symbols):
                    inside = np.ones(len(symbols), bool)
                    inside[(bounds[:, :1] - np.arange(1, ORDER)).ravel()] = False
                    waiting.setdefault(lang, []).append(grams(np.r_[np.zeros(ORDER - 1, np.int64), symbols], slice(ORDER - 1, ORDER - 1 + len(symbols)))[inside])
            settled(3_000_000)
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from out()
        settled(-1)
        yield from out()

    return by_arrow(rows.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def all_orders(counted: DataFrame) -> DataFrame:
    """(order, lang, gram, n) from those of the highest order: below it, n is the number of distinct predecessors."""
    out, above = counted.withColumn("order", F.lit(ORDER)), counted
    for order in range(ORDER - 1, 0, -1):
        above = written(above.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
        out = out.unionByName(above.withColumn("order", F.lit(order)))
    return out.select("order", "lang", "gram", "n")


def built(counted: DataFrame, langs: list[str], prune: float = PRUNE) -> bytes:
    """The pickled model of the counts (lang, gram, n). It is made in a task, of at most 1 / prune rows an order and language."""
    spark = counted.sparkSession
    every = all_orders(counted)
    # a row per language and order
    sums = every.groupBy("order", "lang").agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect()
    discounts = {(r.order, langs.index(r.lang)): min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos))) if r.ones + r.twos else 0.5 for r in sums}
    limits = spark.createDataFrame([(r.order, r.lang, langs.index(r.lang), prune * r.total) for r in sums], "order int, lang string, number int, least double")
    context = F.shiftright("gram", BITS)
    held = every.join(F.broadcast(limits), ["order", "lang"]).where("n >= least").withColumn("context", context).drop("least")
    contexts = every.groupBy("order", "lang", context.alias("context")).agg(F.sum("n").alias("context_sum"))
    rows = held.join(contexts, ["order", "lang", "context"]).select("order", "number", "gram", "n", "context_sum")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [[b.column(c).to_numpy() for c in ("order", "number", "gram", "n", "context_sum")] for b in it]
        if not parts:
            return
        order, number, gram, n, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept: dict[int, list] = {}
        for o in range(1, ORDER + 1):
            for i in range(len(langs)):
                own = np.flatnonzero((order == o) & (number == i))
                own = own[np.argsort(gram[own])]
                kept.setdefault(o, []).append((gram[own], n[own].astype(np.float64), total[own].astype(np.float64)))
        raw = pickle.dumps(kneser_ney(langs, discounts, kept), 5)
        for i in range(0, len(raw), PIECE):
            yield {"place": [i], "piece": [raw[i : i + PIECE]]}

    made = written(by_arrow(rows.repartition(1), run, "place long, piece binary"), "model", "snappy")
    return b"".join(bytes(r.piece) for r in made.orderBy("place").collect())


@dataclass
class Trained:
    """A model as the executors hold it, and what the fold has added to it."""

    raw: object = None
    key: str = ""
    temperature: float = 8.0
    most: np.ndarray | None = None
    more: np.ndarray | None = None

    def model(self) -> Model:
        if self.raw is None:
            return Model([])
        out = loaded(self.raw, self.key)
        out.temperature, out.most, out.more = self.temperature, self.most, self.more
        return out


_LOADED: dict[str, Model] = {}


def loaded(held, key: str) -> Model:
    """The model of a broadcast, made once a process; one is held at a time."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(held.value)
    return _LOADED[key]


def train(rows: DataFrame, id_column: str = "doc_id", prune: float = PRUNE) -> Trained:
    """A model of rows (id, text, lang). One in FOLD of them, by a hash of the id, is held back for calibration."""
    spark = rows.sparkSession
    used = rows.where(f"`{id_column}` is not null and lang is not null and text is not null").select(F.col(id_column).alias("id"), "text", "lang")
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLD))
    counted = written(ngram_counts(used.where(fold > 0)), "ngrams")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())  # a row per language
    if not langs:
        return Trained()
    trained = Trained(spark.sparkContext.broadcast(built(counted, langs, prune)), uuid.uuid4().hex)
    return calibrate(trained, langs, used.where(fold == 0))


def calibrate(trained: Trained, langs: list[str], fold: DataFrame) -> Trained:
    """Temperature of the least log loss; limits of rejection from the texts that the model tells right. A language of few
    such texts takes the margins of all. Every row of the fold counts: it is scored once, and sums and exact quantiles of the
    scores are all that comes to the driver."""
    held, key = trained.raw, trained.key

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = loaded(held, key)
        for batch in it:
            entropy, letters = model.cross_entropy(batch.column("text").to_pylist())
            known = np.array([langs.index(x) if x in langs else -1 for x in batch.column("lang").to_pylist()])
            some = np.flatnonzero((known >= 0) & (letters > 0))
            entropy, truth = entropy[some], known[some]
            own = entropy[np.arange(len(some)), truth]
            loss = np.stack([np.log(np.exp(-t * (entropy - entropy.min(1, keepdims=True))).sum(1)) + t * (own - entropy.min(1)) for t in TEMPERATURES], 1)
            yield {"number": truth, "letters": letters[some].astype(float), "own": own, "is_right": entropy.argmin(1) == truth, "loss": loss.tolist()}

    told = written(by_arrow(fold.select("lang", "text"), run, "number long, letters double, own double, is_right boolean, loss array<double>"), "fold")
    trained.most, trained.more = np.full(len(langs), np.inf), np.zeros(len(langs))
    losses = told.agg(F.count("*").alias("n"), *[F.avg(F.get("loss", F.lit(i))).alias(f"t{i}") for i in range(len(TEMPERATURES))]).first()
    if losses.n:
        trained.temperature = min(zip(losses[1:], TEMPERATURES, strict=True))[1]
        right = told.where("is_right").select(F.explode(F.array("number", F.lit(POOLED).cast("long"))).alias("number"), "own", "letters")
        limits = margins(right)
        for i in range(len(langs)):
            if POOLED in limits:
                n, middle, margin, one = limits.get(i, limits[POOLED])
                margin, one = (margin, one) if n >= 20 else limits[POOLED][2:]
                trained.most[i], trained.more[i] = middle + margin, one
    dropped(told)
    return trained


def margins(rows: DataFrame) -> dict[int, tuple[int, float, float, float]]:
    """For each group `number` of rows (number, own, letters): its rows, the median of its cross-entropies, the margin over it, and
    the part of one letter."""
    spark = rows.sparkSession

    def told(more: list[tuple], names: str, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(spark.createDataFrame(more, f"number long, {names}")), "number")

    middle = [tuple(r) for r in rows.groupBy("number").agg(F.percentile("own", 0.5), F.percentile("letters", 0.5)).collect()]  # a row per language
    if not middle:
        return {}
    over = told(middle, "middle double, usual double", rows).withColumn("over", F.col("own") - F.col("middle"))
    high = {r[0]: max(MARGIN, 2 * r[1]) for r in over.where("letters >= usual").groupBy("number").agg(F.percentile("over", 0.999)).collect()}
    part = told(list(high.items()), "margin double", over)
    ends = part.groupBy("number").agg(F.count("*"), F.percentile((F.col("over") - F.col("margin")) * F.sqrt("letters"), 0.999)).collect()
    middles = {m[0]: m[1] for m in middle}
    return {r[0]: (r[1], middles[r[0]], high[r[0]], max(ONE_LETTER, r[2])) for r in ends}


def predict(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = trained.model()
        for batch in it:
            langs, score, rejected = model.predict(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": score, "rejected": rejected}

    return by_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def learned_from(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 5) != 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(learned_from(docs)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
