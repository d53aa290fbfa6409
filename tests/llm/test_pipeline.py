import random

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_links, edited
from tokenizers import Tokenizer

from strandloom.llm import decontaminate, near_dedup

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, `a.b` string, n_replaced string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with copies, near copies, contaminated ones, personal data, odd rows and clashing names."""
    rng = random.Random(3)
    own = pd.read_parquet(f"{SF}/documents.parquet")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = [(int(i), t, x) for i, t, x in zip(own.doc_id, own.text, own.lang)]
    n = max(r[0] for r in rows) + 1
    long = [r for r in rows if r[1] and 400 < len(r[1]) < 4000][:12]
    rows += [(n + i, r[1], r[2]) for i, r in enumerate(long)]  # copies
    rows += [(n + 20 + i, r[1] + " one more sentence here", r[2]) for i, r in enumerate(long)]
    rows += [(n + 40 + i, f"{long[i][1][:300]} {edited(items.text[i], 3, rng)} {long[i + 1][1][:200]}", "en") for i in range(8)]
    rows += [(n + 60, None, "en"), (n + 61, "", "en"), (n + 62, "12 34 %", "en"), (None, long[0][1], "en"), (n + 63, "word " * 30_000, "en"), (n + 64, long[3][1][::-1], "en"), (n + 64, long[4][1][::-1], "en")]
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), "keep", "dot", "mine") for i, t, x in rows], SCHEMA).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_language(spark, docs):
    out = STAGES["language_id"](spark, docs, SF)
    kept = {r.doc_id for r in out.collect()}
    gone = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in kept}
    assert out.columns == docs.columns and all(not t or not any(c.isalpha() for c in t) or len(t) < 60 or t[:5] == "word " or t[::-1] for t in gone.values())
    assert all(i in gone for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i is not None and not any(c.isalpha() for c in t or ""))


def test_near_duplicates(spark, docs):
    out = STAGES["near_dedup"](spark, docs.dropDuplicates(["doc_id"]), SF)
    known = sorted((r.doc_id, r.text or "") for r in docs.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None)
    roots = brute_links([t for _, t in known], 5, 80)
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {known[i][0] for i in range(len(known)) if roots[i] == i}
    assert out.where("doc_id is null").count() == 1 and out.columns == docs.columns


def test_decontamination(spark, docs):
    out = STAGES["decontaminate"](spark, docs, SF)
    items = [decontaminate.normal(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]

    def holds(text):
        text = decontaminate.normal(text)
        return any(decontaminate.may_match(i, text, len(i) // 10) and decontaminate.best_stretch(i, text)[0] <= len(i) // 10 for i in items)

    want = {r.doc_id for r in docs.collect() if r.doc_id is None or not holds(r.text)}
    got = {r.doc_id for r in out.collect()}
    assert want <= got and len(got - want) <= 1 and out.columns == docs.columns


def test_personal_data(spark, docs):
    some = docs.limit(3).unionByName(spark.createDataFrame([(9001, "write ann.b@example.com", "en", "s", 23, "keep", "dot", "mine")], SCHEMA))
    before, after = rows_of(some), rows_of(STAGES["pii"](spark, some, SF))
    assert len(before) == len(after) and [r[0] for r in before] == [r[0] for r in after] and all(a[5:] == b[5:] for a, b in zip(before, after))
    assert not any(r[1] and "ann.b@" in r[1] for r in after) and all(r[4] == len(r[1] or "") for r in after if r[0] == 9001)


def test_packing(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(60)
    got = STAGES["packing"](spark, some, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in some.collect()}


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    kept = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == kept and out.groupby("sequence_id").length.sum().max() <= 4096
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    sets = {i: near_dedup.shingle_set(t.encode(), 5) for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    some = list(sets)[:80]
    assert not any(near_dedup.alike(sets[a], sets[b], 80, 100) for n, a in enumerate(some) for b in some[:n] if sets[a] and sets[b])
    assert np.isin(out.doc_id, spark.read.parquet(f"{SF}/documents.parquet").toPandas().doc_id).all()
