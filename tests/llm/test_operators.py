import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import decontaminate, language_id, near_dedup, packing, pii, quality_lines, repeats, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", " ", "\n\n", "a", "a b", None, "x" * 20_000, "word " * 5_000, "same text here", "same text here", "Ünï ç\x1c é 漢字 🙂 İ", "<|endoftext|> a  b\t c"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "clash", "n") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_bytes string, `a.b` string")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).unionByName(frame(spark, ["null id"]).selectExpr("cast(null as long) doc_id", "text", "lang", "n_bytes", "`a.b`"))


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run_all(spark, df, labels):
    """Every operator on df."""
    yield packing.pack(df, WORD)
    yield language_id.predict(df, language_id.train(df))
    yield decontaminate.contaminated(df, df.selectExpr("doc_id item_id", "text"))
    yield sharding.place(df, "doc_id")
    yield token_counts.count_tokens(df, BYTE)
    yield near_dedup.near_duplicates(df)
    yield quality_lines.judged(df, quality_lines.train(df, labels))
    yield pii.pseudonymise(df)
    yield repeats.remove_repeats(df)
    yield toxicity.scored(df, toxicity.train(df, labels))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = [len(out.collect()) for out in run_all(spark, odd, labels)]
    n = len(ODD) + 1
    assert sizes[0] >= n and all(x == n for i, x in enumerate(sizes) if i not in (0, 2))


def test_empty_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(out.count() == 0 for out in run_all(spark, odd.limit(0), labels))


def test_token_counts(spark, odd):
    tok = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_counts.count_tokens(odd.where("doc_id is not null"), BYTE).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_packing_round_trip(spark, docs):
    tok = Tokenizer.from_file(WORD)
    texts = docs.text.tolist()[:120] + ODD
    rows = packing.pack(frame(spark, texts), WORD, shard_tokens=60_000, with_ids=True).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
            assert r.ids is None or (np.frombuffer(r.ids, np.uint16) == part).all()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096


def test_neighbours_come_first():
    rng = np.random.default_rng(0)
    rests = [rng.integers(100 * (i % 3), 100 * (i % 3) + 100, 40).astype(np.uint16) for i in range(30)]
    out = packing.retrieval_order(rests, np.full(400, 5), 30, 40, 400)
    assert all(len({x % 3 for x, _, _ in window}) == 1 for window in out)


def test_neighbours_share_a_shard(spark):
    """Groups of related documents among many shards, and copies that fill more than a shard."""
    rng = random.Random(8)
    vocab = sorted({w for t in pd.read_parquet(f"{SF}/documents.parquet").text[:100] for w in re.findall("[a-z]{5,}", t)})
    rng.shuffle(vocab)
    topics = [vocab[8 * i : 8 * i + 8] for i in range(40)]
    texts = [" ".join(rng.choices(topics[i % 40], k=60)) for i in range(400)] + [" ".join(vocab[320:420])] * 200
    rows = packing.pack(frame(spark, texts), WORD, window=512, shard_tokens=4000).toPandas()
    shard = (rows.sequence_id.to_numpy() >> 32)[np.argsort(rows.doc_id.to_numpy(), kind="stable")[np.unique(np.sort(rows.doc_id), return_index=True)[1]]]
    assert len(shard) == 600 and len(set(shard)) > 8
    pairs = [(i, j) for i in range(400) for j in range(i % 40, i, 40)]
    assert np.mean([shard[i] == shard[j] for i, j in pairs]) > 0.5
    assert rows.groupby(rows.sequence_id // 2**32).length.sum().max() < 12_000 and len(set(shard[400:])) > 2


def test_language(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    model = language_id.train(language_id.learned_from(known))
    got = language_id.predict(known, model).toPandas().merge(docs, on="doc_id")
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.rejected.mean() < 0.02 and got.score.between(0, 1).all()
    model = model.model()
    assert model.predict([None, "12 %", ""])[0] == ["und"] * 3
    assert model.predict(["qzxwvkj pqrtbn xkcd " * 20])[2][0]


def brute_probability(counts, gram, order):
    """Interpolated Kneser-Ney of the last symbol after the others, from the counts of each order by their definition."""
    if order == 0:
        return None
    own = counts[order]
    ones, twos = (sum(v == n for v in own.values()) for n in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    context = {g: v for g, v in own.items() if g[:-1] == gram[-order:][:-1]}
    lower = brute_probability(counts, gram, order - 1) if order > 1 else 1 / (len({g[-1] for g in counts[1]}) + 1)
    if not context:
        return lower
    total = sum(context.values())
    return max(own.get(gram[-order:], 0) - d, 0) / total + d * len(context) / total * lower


def test_limits_use_the_whole_fold(spark):
    """More texts than any bound on a fold: the limits are the quantiles of all of them."""
    rng = random.Random(4)
    made = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 12)))
    rows = spark.createDataFrame([(made(s), x) for x, s in (("x", "abcd "), ("y", "abef ")) for _ in range(2500)], "text string, lang string")
    langs = ["x", "y"]
    raw = language_id.built(language_id.ngram_counts(rows), langs)
    trained = language_id.calibrate(language_id.Trained(spark.sparkContext.broadcast(raw), "whole-fold"), langs, rows)
    model, told = language_id.pickle.loads(raw), rows.toPandas()
    entropy, letters = model.cross_entropy(list(told.text))
    truth = (told.lang == "y").to_numpy().astype(int)
    own = entropy[np.arange(len(truth)), truth]
    for i in range(2):
        mine = (truth == i) & (entropy.argmin(1) == truth) & (letters > 0)
        over, n = own[mine] - np.median(own[mine]), letters[mine]
        margin = max(language_id.MARGIN, 2 * np.quantile(over[n >= np.median(n)], 0.999))
        assert trained.most[i] == pytest.approx(np.median(own[mine]) + margin, abs=1e-9)
        assert trained.more[i] == pytest.approx(max(language_id.ONE_LETTER, np.quantile((over - margin) * np.sqrt(n), 0.999)), abs=1e-9)
    assert trained.temperature in language_id.TEMPERATURES


def test_language_probabilities(spark):
    """Without pruning, the model's probabilities are those of the definition."""
    texts = ["abra cadabra", "a cab a bar", "bad cab", "abba"] * 2
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string")
    model = language_id.pickle.loads(language_id.built(language_id.ngram_counts(rows), ["x"]))
    n = language_id.ORDER
    counts = {n: collections.Counter()}
    for t in texts:
        s = " " * (n - 1) + t
        if not t[-1].isspace():
            s += ""
        counts[n].update(s[i - n : i] for i in range(n, len(s) + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    code = lambda c: 0 if c == " " else ord(c) & language_id.MASK
    for gram in ["abra ", " cada", "    a", "bbbbb", "rdcab", "a bar"]:
        key = 0
        for c in gram:
            key = key << language_id.BITS | code(c)
        assert abs(np.exp(model.score(np.array([key]))[0, 0]) - brute_probability(counts, gram, n)) < 1e-5


def test_pruned_contexts_sum_to_one(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    counted = language_id.ngram_counts(rows)
    langs = sorted(docs.lang.dropna().unique())
    for prune in (1e-6, 1e-3):
        model = language_id.pickle.loads(language_id.built(counted, langs, prune))
        symbols = model.keys[1]
        for context in (0, model.contexts[language_id.ORDER][7], model.contexts[3][5]):
            p = np.exp(model.score((int(context) << language_id.BITS) + symbols).astype(float)).sum(0)
            assert ((p > 0.95) & (p < 1.01)).all()
    assert len(model.keys[language_id.ORDER]) <= len(langs) * 1000


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):  # at most n edits
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([[], ["x"], [out[p], "q"]])
    return "".join(out)


def test_decontamination_recall(spark, docs):
    rng = random.Random(4)
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    base = docs.text.tolist()
    texts = [base[i][:200] + " " + edited(t, int(0.05 * len(t)), rng) + " " + base[i + 50][:300] for i, t in enumerate(items.text)]
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items)).toPandas()
    hit = set(zip(got.doc_id, got.item_id))
    assert sum((i, int(x)) in hit for i, x in enumerate(items.item_id)) >= 0.95 * len(items)
    for r in got.itertuples():
        item, text = decontaminate.normal(items.text[items.item_id == r.item_id].iloc[0]), decontaminate.normal(texts[r.doc_id])
        assert decontaminate.best_stretch(item, text)[0] <= r.distance <= 0.1 * len(item)


@pytest.mark.parametrize("share, least", [(0.02, 0.98), (0.1, 0.9)])
def test_decontamination_search(spark, share, least):
    """Against brute force: every document and item, by the distance of the item's best stretch. At the threshold too."""
    rng = random.Random(9)
    items = pd.read_parquet("/root/testdata/sf0.1/benchmark.parquet").iloc[:60].reset_index(drop=True)
    base = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    texts = [base[i][:150] + " " + edited(t, int(share * len(decontaminate.normal(t))), rng) + " " + base[i + 70][:150] for i, t in enumerate(items.text)] + [t[:3000] for t in base[130:160]]
    hit = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items)).collect()}
    want = set()
    for j, t in zip(items.item_id, items.text):
        item = decontaminate.normal(t)
        for i, text in enumerate(map(decontaminate.normal, texts)):
            if decontaminate.may_match(item, text, int(0.1 * len(item))) and decontaminate.best_stretch(item, text)[0] <= int(0.1 * len(item)):
                want.add((i, int(j)))
    assert hit <= want and len(want) >= 0.9 * len(items) and len(hit) >= least * len(want)


def test_items_in_unspaced_text_and_short_and_long_ones(spark):
    rng = random.Random(3)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    unspaced, code = han(60), "".join(rng.choices("abcdef0123/_.", k=80))
    long = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(12_500))
    items = spark.createDataFrame([(1, unspaced), (2, code), (3, "short item"), (4, long), (5, ""), (6, None)], "item_id long, text string")
    texts = [han(37) + unspaced + han(200), "x" * 61 + code + "y" * 40, "a short item, here", "a shorty item", "in shortitem", "before " + long[:50_000] + "zz" + long[50_000:] + " after", None]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), items).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (5, 4)}


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_best_stretch():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert decontaminate.best_stretch(a, b)[0] == brute_distance(a, b)


def test_shards(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {(a, b, c) for a, b, c in con.execute(sharding.oracle(7, 211)).fetchall()}
    got = sharding.place(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id"), "doc_id", 7, 211)
    assert {tuple(r) for r in got.collect()} == want
    a, b = sharding.slot_table(20, 2003), sharding.slot_table(21, 2003)
    assert max(collections.Counter(a).values()) - min(collections.Counter(a).values()) <= 1
    assert sum(x != y for x, y in zip(a, b)) < 0.2 * 2003


@pytest.mark.parametrize("width, num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, num):
    rng = random.Random(2)
    texts = docs.text.tolist()[:100] + [t for t in ODD if t]
    for _ in range(150):  # copies of copies, so that groups hang together by chains
        words = rng.choice(texts[-60:]).split(" ")
        words[rng.randrange(len(words))] = rng.choice(["new", "other"])
        texts.append(" ".join(words))
    sets = [near_dedup.shingle_set(t.encode(), width) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and near_dedup.alike(sets[i], sets[j], num, 100):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_dedup.near_duplicates(frame(spark, texts), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def brute_links(texts, width, num):
    sets = [near_dedup.shingle_set(t.encode(), width) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    at = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            at[g].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(at[g] for g in s)):
            if j < i and root(i) != root(j) and near_dedup.alike(s, sets[j], num, 100):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_unsettled_entries(spark):
    """Two alike texts in one entry with a third that is unlike both."""
    sig = np.arange(48, dtype=np.uint16)
    other = sig.copy()
    other[0] = 999
    rows = [(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3)]
    info = spark.createDataFrame([(1, bytearray(other.tobytes())), (2, bytearray(sig.tobytes())), (3, bytearray(sig.tobytes()))], "node long, signature binary")
    texts = spark.createDataFrame([(1, "q r s t u v"), (2, "a b c d e f g"), (3, "a b c d e f g h")], "node long, text string")
    out = near_dedup.settled(spark.createDataFrame(rows, "entry long, nth int, node long, component long"), info, texts, 3, 80, 100, 20)
    assert [sorted(r) for r in out.collect()] == [[2, 3]]


@pytest.mark.parametrize("block, slab", [(1024, 16384), (16, 40)])
def test_a_large_group_of_near_copies(spark, monkeypatch, block, slab):
    """Copies of one text with edits of several sizes, whose entries hold many components, in one cell and in many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SLAB", slab)
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(900 if block == 1024 else 300):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = near_dedup.near_duplicates(frame(spark, texts), 3, 85, 100).collect()
    want = brute_links(texts, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and len(set(want)) > 30


def test_quality(spark, docs):
    texts = docs.text.tolist()[:150] + ODD
    field = quality_lines.train(spark.createDataFrame(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in quality_lines.judged(frame(spark, texts), field).collect():
        text = texts[r.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        at = collections.defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(5)
    field = quality_lines.Field(rng.normal(size=quality_lines.N_FEATURES), rng.normal(size=(2, 2)))
    features, bounds = rng.normal(size=(13, quality_lines.N_FEATURES)), np.array([0, 6, 6, 7, 13])
    got, s = field.viterbi(features, bounds), field.scores(features)
    for a, b in zip(bounds[:-1], bounds[1:]):
        value = lambda y: sum(s[a + t, y[t]] for t in range(b - a)) + sum(field.pairs[x, z] for x, z in zip(y, y[1:]))  # noqa: B023, E731
        best = max((tuple(int(c) for c in f"{n:0{b - a}b}") if b > a else () for n in range(2 ** (b - a))), key=value)
        assert tuple(got[a:b]) == best


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112", "call +1 (988) 555-2485 or 456-555-2186", "at 10.0.0.1, not 300.1.1.1", "born 1987-02-28 or 02/28/1987, not 1987-02-30", "ssn 123-45-6789", "ann.b7@example.com wrote", None, "", "no data in 12 words"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts)).collect()}
    cards = re.findall(r"\d(?:[ -]?\d){15}", got[0].text)
    assert len({re.sub(r"\D", "", c) for c in cards[:2]}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and "4111111111111112" in got[0].text
    assert re.fullmatch(r"call \+1 \(9\d\d\) \d{3}-\d{4} or 4\d\d-\d{3}-\d{4}", got[1].text) and "555-2485" not in got[1].text
    assert "10.0.0.1" not in got[2].text and "300.1.1.1" in got[2].text
    iso, us = re.search(r"born (\S+) or (\S+),", got[3].text).groups()
    assert iso == f"{us[6:]}-{us[:2]}-{us[3:5]}" and iso != "1987-02-28" and "1987-02-30" in got[3].text
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", got[4].text) and re.fullmatch(r"[a-z]{3}\.[a-z]\d@example\.com wrote", got[5].text)
    assert (got[6].text, got[6].n_replaced, got[7].text, got[8].n_replaced) == (None, 0, "", 0)


def test_values_of_any_length(spark):
    """Long secrets and mail addresses, tokens of either case, and every day up to the last of 2099."""
    long = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=300))
    texts = [f"password={long}", "0123456789abcdef" * 20, "0123456789ABCDEF" * 3, f"{'a' * 64}x@example.com {'a' * 64}y@example.com", "on 2099-12-31", "on 1900/01/01", "token=onlyletters"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts)).collect()}
    assert all(r.n_replaced >= 1 for r in got.values()) and [len(got[i].text) for i in range(7)] == [len(t) for t in texts]
    assert sum(a == b for a, b in zip(got[0].text[9:], long)) < 60 and re.fullmatch("[0-9a-f]{320}", got[1].text) and re.fullmatch("[0-9A-F]{48}", got[2].text)
    one, two = got[3].text.split()
    assert one != two and re.fullmatch("[a-z]{65}@example.com", one)
    assert re.fullmatch(r"on (19|20)\d\d-\d\d-\d\d", got[4].text) and "onlyletters" not in got[6].text


def test_hosts_of_many_parts(spark):
    """Java's regular expressions went a level deeper for each part, which ended the JVM."""
    texts = ["x@a" + ".ab" * 20_000, "x@" + "a." * 20_000, "x@a.b.co.c", "x@b.com1", "x@b..com"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows).collect()}
    assert got[0].text.endswith("@a" + ".ab" * 20_000) and got[0].n_replaced <= 1
    found = rows.select("doc_id", pii.F.regexp_extract("text", f"({pii.MAIL})", 1).alias("m")).collect()
    assert [r.m for r in sorted(found)] == [texts[0], "", "x@a.b.co", "x@b.com", ""]


def test_a_cluster_without_a_key(spark):
    """A key is drawn, and kept for the session."""
    setting = {}
    conf = type("Conf", (), {"get": lambda _, k, d=None: setting.get(k, d), "set": lambda _, k, v: setting.update({k: v})})()
    cluster = type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": "spark://host:7077"})})()
    key = pii.key_of(cluster)
    assert len(key) >= 32 and key != pii.TEST_KEY and pii.key_of(cluster) == key == setting[pii.KEY_SETTING]


def test_permutations_are_one_to_one(spark):
    words = spark.range(26 * 26).selectExpr("concat(char(97 + int(id / 26)), char(97 + int(id % 26))) w")
    got = {r[0] for r in words.select(pii.permuted_text(words.w, "t")).collect()}
    assert len(got) == 676 and all(re.fullmatch("[a-z]{2}", x) for x in got)
    days = spark.range(pii.DAYS).selectExpr("cast(date_add(date'1900-01-01', int(id)) as string) d")
    got = {r[0] for r in days.select(pii.date(days.d)).collect()}
    assert len(got) == pii.DAYS and min(got) == "1900-01-01" and max(got) == "2099-12-31"


def test_keys(spark):
    df = frame(spark, ["ssn 123-45-6789"])
    a, b = (pii.pseudonymise(df, key=k).first().text for k in ("one", "two"))
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        assert a != b and pii.pseudonymise(df).first().text == a
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_clashing_names(spark):
    """Columns of the names that operators use for themselves stay as they are."""
    df = spark.createDataFrame([(1, "mail ann@example.com", "x", "y", 5, "z")], "doc_id long, text string, found_values string, NEW_VALUES string, slot_at int, Slot_Nth string")
    got = pii.pseudonymise(df).first()
    assert (got.found_values, got.NEW_VALUES, got.n_replaced) == ("x", "y", 1) and "ann@" not in got.text
    assert sharding.place(df, "doc_id").first().asDict() == df.first().asDict() | {"slot": got_slot(1), "shard": sharding.slot_table(sharding.N_SHARDS, sharding.N_SLOTS)[got_slot(1)]}


def got_slot(key):
    return int(hashlib.md5(str(key).encode()).hexdigest()[:12], 16) % sharding.N_SLOTS


def test_adjacent_values(spark):
    card_number, phone, address = "4111 1111 1111 1111", "+1 (826) 555-4081", "190.137.223.204"
    texts = [f"{phone} {address}", f"{phone} 456-555-2186", f"{phone} 123-45-6789", f"{phone} {card_number}", f"{card_number} 123", f"12 {card_number}", f"{card_number} 123-45-6789", f"{card_number} {address}", card_number]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts)).collect()}
    alone = got[8].text
    for i, t in enumerate(texts):
        assert not any(v in got[i].text for v in ("555-4081", "555-2186", "45-6789", address, card_number)), (t, got[i].text)
    assert (got[4].text, got[5].text) == (f"{alone} 123", f"12 {alone}") and got[6].text.startswith(f"{alone} ")
    assert [got[i].n_replaced for i in range(9)] == [2, 2, 2, 2, 1, 1, 2, 2, 1]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).selectExpr("lpad(cast(id as string), 3, '0') d")
    got = {r[0] for r in df.select(pii.permuted_digits(df.d, "t")).collect()}
    assert len(got) == 1000 and all(len(x) == 3 for x in got)


@pytest.mark.parametrize("cold", [4096, 2])
def test_repeats(spark, docs, cold, monkeypatch):
    monkeypatch.setattr(repeats, "COLD", cold)
    texts = docs.text.tolist()[:80] + ODD + ["ab" * 200, docs.text[3] + docs.text[5], "é" * 150]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        cut = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                cut[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = np.frombuffer(raw, np.uint8)[~cut].tobytes()
        want[i] = (len(raw), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = repeats.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_runs_of_one_gram_meet(spark):
    """As many runs as a cold gram may hold, after half a segment of another gram's in the same task."""
    rng = random.Random(6)
    size = repeats.WINDOW + 76
    gram = spark.range(1, 100).where("pmod(hash(id), 4) = pmod(hash(0L), 4)").first().id
    other = repeats.SEGMENT // 2 // size
    rows = [(0, i, rng.randbytes(size)) for i in range(other)] + [(gram, i, rng.randbytes(size)) for i in range(other, other + repeats.COLD)]
    last = rows[-1][1]
    rows[-1] = (gram, last, rows[other][2][:150] + rng.randbytes(size - 150))
    found = spark.createDataFrame([(g, d, 0, bytearray(b)) for g, d, b in rows], "gram long, doc long, start long, bytes binary")
    assert [tuple(r) for r in repeats.last_digit(found).collect()] == [(last, 0, 150)]


def test_suffixes_are_sorted_by_their_bytes():
    rng = random.Random(8)
    parts = ["".join(rng.choices("ab", k=rng.randrange(100, 260))) for _ in range(20)]
    text = "".join(rng.choice(parts) for _ in range(60)) + "a" * 300
    data, low = np.frombuffer(text.encode(), np.uint8), np.arange(len(text) - 99)
    seen, want = set(), []
    for p in low.tolist():
        if text[p : p + 100] in seen:
            want.append(p)
        seen.add(text[p : p + 100])
    assert sorted(repeats.equal_suffixes(data, low).tolist()) == want and len(want) > 1000
    assert not len(repeats.equal_suffixes(data, low[:1])) and not len(repeats.equal_suffixes(data, low[:0]))


def test_a_query_of_all_terms_ranks_as_the_formula(spark):
    """Without a cut of terms, the first neighbours of a seed are those of the highest BM25 sums."""
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint16) for _ in range(40)]
    df = np.array([sum(t in r for r in rests) for t in range(60)])
    mean = np.mean([len(r) for r in rests])
    window = packing.retrieval_order(rests, df, 40, mean, 200, 60)[0]
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))

    def score(d):
        return sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t, n in collections.Counter(d.tolist()).items() if t in set(rests[0].tolist()))

    best = sorted(range(1, 40), key=lambda i: -score(rests[i]))
    assert [x for x, _, _ in window][1:] == best[: len(window) - 1]


def test_insults_of_two_words():
    """Words that are common alone, toxic together, and the pair with an inserted character."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ra", "lo", "ti", "me", "su", "no", "pe", "ka") for b in ("nda", "lim", "tor", "ves", "gan")]
    text = lambda: [rng.choice(words) for _ in range(30)]
    texts, toxic = [], []
    for i in range(300):
        own = text()
        if i % 3 == 0:
            own[7:9] = ["dirty", "dog"]
        elif i % 3 == 1:
            own[4], own[9] = "dirty", "dog"
        texts.append(" ".join(own) + ".")
        toxic.append(i % 3 == 0)
    machine = toxicity.train_machine(texts, np.array(toxic))
    clean, bad, near, apart = (machine.scores([t], {})[0] for t in (" ".join(text()), " ".join([*text(), "dirty", "dog"]), " ".join([*text(), "dirty", "d.o.xg"]), " ".join(["dog", *text(), "dirty"])))
    assert bad > 0.5 > 0.3 > max(clean, apart) and near > 2 * max(clean, apart)


def fuzzed(rng, n):
    """Texts of pieces that tokenizers treat in ways of their own."""
    odd = ["<|endoftext|>", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "İ", "ß", "\u200b", "don't", "123,456.78", "ABC", "x" * 50, "...", "\x1c", "a_b"]
    return ["".join(rng.choice(odd) if rng.random() < 0.4 else rng.choice("abcdefghij ") for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_tokens_of_fuzzed_texts(spark):
    texts = fuzzed(random.Random(5), 1500)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, texts), BYTE).collect()}
    assert got == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    ids = packing.chunk_tokenizer(WORD).encode(texts)
    assert [np.frombuffer(x, np.uint16).tolist() for x in ids] == [word.encode(t, add_special_tokens=False).ids for t in texts]


def test_segments_of_long_texts(spark, monkeypatch):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(5000))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    pieces = list(repeats.segments(iter([(1, (text + text).encode())])))
    assert sum(len(s) for _, _, s, _ in pieces) > 10 and max(len(d) for *_, d in pieces) <= 700 + 99


def test_kernel_and_toxicity(spark):
    x = toxicity.vectors(["idiot", "idixot", "clown"])
    assert x[0] @ x[1] > 0.4 > x[0] @ x[2]
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    machine = toxicity.train(docs, labels)
    word = lambda w: machine.values([w])[0]
    assert word("idiot") > 2 > word("thing") - 1 and word("idixot") > word("onthe") and word("i.d.i.o.t") == word("idiot")


@pytest.mark.parametrize("length", [60, 2500])
def test_decontamination_keys_are_those_of_a_plain_walk(length):
    """Walks of many windows at once, also beyond the steps with random bits of their own."""
    rng = np.random.default_rng(5)
    item = "".join(chr(c) for c in rng.integers(97, 700, length))
    index = decontaminate.Index([(1, item)], 0.1)
    one, bits = index.classes[0], decontaminate.walk_bits()
    text = np.concatenate([decontaminate.codes("x" + item), np.zeros(2 * length + 2, np.uint32)])
    starts = np.array([0, 1, 3])
    got = index.embedded(one, text, starts, index.low_bytes(text))
    for n, start in enumerate(starts.tolist()):
        for walk in range(decontaminate.WALKS):
            at, seen = start, []
            for step in range(2 * length):
                seen.append(int(text[at]))
                more = 57 * (step // decontaminate.OWN_STEPS)
                at += int(bits[step % decontaminate.OWN_STEPS][(seen[-1] + more & 255) + walk * 256])
            for band in range(decontaminate.BANDS):
                key = np.uint64(walk * decontaminate.BANDS + band)
                for place in one["samples"][walk, band].tolist():
                    key = np.uint64((int(key) ^ seen[place]) * int(decontaminate._SPREAD) % (1 << 64))
                    key ^= key >> np.uint64(29)
                assert got[n, walk * decontaminate.BANDS + band] == decontaminate.mixed(np.array([key]))[0]
    text = np.concatenate([decontaminate.codes("ab cd  " + "x" * 30 + " あい z"), np.zeros(1, np.uint32)])
    assert decontaminate.Index.starts(text).tolist() == [0, 3, *range(7, 37), 38, 39, 41]
    assert decontaminate.may_match("abcdefgh", "xxabcdefghyy", 0) and not decontaminate.may_match("abcdefgh", "xxabcdxefghyy" * 50, 0)
    assert decontaminate.may_match("abcdefgh", "xxabcdxefghyy", 1)
