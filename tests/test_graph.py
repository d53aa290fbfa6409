import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.__main__ import main
from strandloom.functions import packed as P
from strandloom.functions import sequences as S
from strandloom.graph import Graph, GraphConfig
from strandloom.operators import graph as G
from strandloom.operators import packed_routes as O
from strandloom.operators import packed_tails as T
from strandloom.operators import packed_walks as O_W
from strandloom.operators import retrieval as O_R
from strandloom.operators import routing as W
from strandloom.operators.lineage import spread
from strandloom.plans import registry
from strandloom.sources import reads as R
from strandloom.streaming import ingest

READS = ["AACGTCCGGCATGTTACACATCTACAAACGTGATGGTTGTACCGCATACCACCCTGGGGTACCCTAAGCA", "CGTTGCCATTTACTAGCGGTTGCAACCCATTGCTTAGGGTACCCCAGGGTGGTATGCGGTACAACCATCA", "TCTACAAACGTGATGGTTGTACCGCATACCACCCTGGGGT", "A" * 40]
DATA = "/root/testdata/sf0.001"


def S_revcomp(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def smer(ids, k=23):
    return P.strings_of(np.array(ids, np.int64), k).to_pylist()


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(list(enumerate(READS, 1)), "read_id long, seq string")


def test_sequential_nodes_and_steps(spark, reads):
    used = G.filtered(reads)
    nodes = G.nodes_sequential(used)
    assert set(smer([r.node for r in nodes.collect()])) == {"ACAAACGTGATGGTTGTACCGCA", "GCTTAGGGTACCCCAGGGTGGTA", "AACCCATTGCTTAGGGTACCCCA", "A" * 23}
    walked = G.steps(used, nodes).collect()
    assert len(walked) == 23
    row = {(r.read_id, r.pos): (r.dir, r.up_tail, r.down_tail) for r in walked}
    assert row[1, 46] == ("R", "TGCGGTACAACCATCACGTTTGT", "A")
    assert row[2, 31] == ("F", "AATGGGTT", "TGCGGTACAACCATCA")
    assert row[4, 0] == ("F", "", "A") and row[4, 17] == ("F", "T", "")


@pytest.mark.parametrize("choose, k", [(G.nodes_grid, 23), (G.nodes_sequential, 23), (G.nodes_rounds, 23), (G.nodes_grid, 15)])
def test_walks_give_the_reads_again(spark, reads, choose, k):
    used = G.filtered(reads.union(spark.createDataFrame([(9, READS[0]), (10, G._revcomp(READS[1]))], "read_id long, seq string")), k=k)
    nodes = choose(used, k=k, sparseness=min(k, 23)).cache()
    assert G.gaps(used, nodes, k).agg({"gap": "max"}).first()[0] <= min(k, 23)
    ordered = W.Ordered(G.steps(used, nodes, k).cache())
    placed = ordered.positions()
    runs = ordered.runs()
    again = W.positions_of(runs)
    cols = again.columns
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, placed.select(cols).collect()))
    assert sorted(r.seq for r in W.walks(again, W.traced(again, k), k).collect()) == sorted(r.seq for r in used.collect())


def test_order_of_routes_against_sorting(spark):
    """Routes of reads that share long stretches, by sorting lists of tails; block sums of blocks of any size."""
    rng = random.Random(7)
    base = "".join(rng.choices("ACGT", k=600))
    seqs = []
    for _ in range(30):
        a, b = sorted(rng.sample(range(0, 600), 2))
        s = list(base[min(a, 500) : max(b, min(a, 500) + 60)])
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs.append("".join(s))
    seqs += seqs[:8]
    used = G.filtered(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"))
    walked = G.steps(used, G.nodes_grid(used)).cache()
    rows = sorted(walked.collect(), key=lambda r: (r.read_id, r.ord))
    by_read = {}
    for r in rows:
        by_read.setdefault(r.read_id, []).append(r)
    key = {}
    for own in by_read.values():
        for i, r in enumerate(own):
            key[r.read_id, r.ord] = ([x.up_tail for x in own[i::-1]], [x.down_tail for x in own[i:]], r.read_id, r.ord)
    groups = {}
    for r in rows:
        groups.setdefault((r.node, r.dir), []).append(r)
    want = {}
    for own in groups.values():
        ups, downs = {}, {}
        for n, r in enumerate(sorted(own, key=lambda r: key[r.read_id, r.ord])):
            want[r.read_id, r.ord] = (n, ups.setdefault(r.up_tail, 0), downs.setdefault(r.down_tail, 0))
            ups[r.up_tail] += 1
            downs[r.down_tail] += 1
    got = {(r.read_id, r.ord): (r.node_pos, r.up_pos, r.down_pos) for r in W.Ordered(walked).positions().collect()}
    assert got == want
    numbers = spark.range(500).selectExpr("id % 3 g", "id o", "id % 7 w")
    for block in (1, 10, 1 << 16):
        for r in W.sums_before(numbers, ["g"], "o", "w", "before", block=block).collect():
            assert r.before == sum(i % 7 for i in range(r.o) if i % 3 == r.g)


def test_a_node_with_many_routes(spark):
    """A hundred thousand reads through one node: its routes are summed in blocks."""
    rows = spark.range(100_000).selectExpr("id read_id", "0 ord", "5L node", "'F' dir", "concat('A', lpad(translate(cast(id % 1000 as string), '0123456789', 'ACGTACGTAC'), 5, 'T')) up_tail", "lpad(translate(cast(id as string), '0123456789', 'ACGTACGTAC'), 9, 'G') down_tail")
    runs = W.Ordered(rows).runs()
    assert runs.agg(F.sum("width"), F.max(F.col("node_pos") + F.col("width"))).first() == (100_000, 100_000)


def test_packed(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 5, 23, 24, 300)] + [None, "ACGTNACGTACGTACGTACGTACGTACGTNN"]
    for k in (3, 15, 23, 31):
        got = sorted((r, p, smer([f], k)[0], smer([v], k)[0]) for read, pos, fw, rv in P.places(*P.texts_of(pa.array(texts)), k) for r, p, f, v in zip(read.tolist(), pos.tolist(), fw, rv))
        want = sorted((i, p, t[p : p + k], G._revcomp(t[p : p + k])) for i, t in enumerate(texts) if t for p in range(len(t) - k + 1) if "N" not in t[p : p + k])
        assert got == want
        ids = np.array([x[2] for x in []], np.int64)
        assert len(P.reverse_ids(ids, k)) == 0
    held = P.Filter(1 << 12)
    ids = np.array(rng.sample(range(1 << 46), 200), np.int64)
    held.put(ids)
    assert held.may_hold(ids).all() and held.may_hold(ids + 1).mean() < 0.2
    df = spark.createDataFrame([(int(i),) for i in ids[:20]], "id long")
    assert [r[0] for r in df.select(S.revcomp_id(F.col("id"))).collect()] == P.reverse_ids(ids[:20], 23).tolist()


@pytest.mark.parametrize("slices", [64, 2, 0])
def test_nodes_in_parts(spark, reads, monkeypatch, slices):
    """Many parts of nodes, a filter of several slices, and none."""
    used = G.filtered(reads)
    nodes = G.nodes_grid(used)
    want = sorted(map(tuple, G.steps(used, nodes).collect()))
    monkeypatch.setattr(G, "PART_NODES", 2)
    monkeypatch.setattr(G, "MOST_SLICES", slices or 1)
    monkeypatch.setattr(G, "SLICE_BITS", 1 << 10 if slices else 2)
    held, parts, count = G.node_parts(nodes)
    assert parts >= 4 and (G.node_filter(held, parts, count) is None) == (not slices)
    got = G.steps(used, nodes)
    assert sorted(map(tuple, got.collect())) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "pos" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Join" in x)  # no row for a place is dealt


def test_packed_tails_equal_those_of_steps(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(40, 300))) for _ in range(60)]
    texts += [x[rng.randint(0, 20) :] for x in texts if len(x) > 80] + [S_revcomp(x) for x in texts[:20]]
    used = G.filtered(spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string"))
    nodes = G.cut(G.nodes_grid(used), "nodes")
    walked = G.cut(G.steps(used, nodes), "steps")
    held = G.cut(G.tail_targets(G.tails(walked), nodes), "tails")
    monkeypatch.setattr(T, "PART_NODES", 50)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(T.tails(used, nodes)) == rows(held)
    assert rows(T.edges(used, nodes)) == rows(G.edges(held))
    want = rows(G.edge_widths(G.edges(held), held))
    assert rows(T.edge_widths(used, nodes)) == want and {x[4] for x in want} == {-1, 1}
    assert T.edge_check(used, nodes).first()[:] == (len(want), 0)
    assert rows(T.routes(used, nodes)) == rows(G.routes(walked))
    node, key = np.array([5, 9]), np.array([1 << T.SIDE | 7 << 1 | 1, 6 << 1 | 1])
    assert not T.agreeing(node, key, np.array([1, 1]), np.array([0, 0]), 23).any()  # no far end


def test_long_reads_in_pieces(spark, monkeypatch):
    text = "".join(random.Random(4).choices("ACGT", k=5000))
    whole = [x.tolist() for x in next(P.places(*P.texts_of(pa.array([text])), 23))]
    monkeypatch.setattr(P, "PIECE", 700)
    parts = list(P.places(*P.texts_of(pa.array([text])), 23))
    assert len(parts) > 5 and [np.concatenate(x).tolist() for x in zip(*parts)] == whole


@pytest.mark.parametrize("n, want", [(39, []), (40, [(0, 40)]), (1049, [(0, 1049)]), (1050, [(0, 1050), (1000, 1050)]), (1051, [(0, 1050), (1000, 1051)]), (2049, [(0, 1050), (1000, 2049)]), (2050, [(0, 1050), (1000, 2050), (2000, 2050)])])
def test_fragments(spark, n, want):
    df = spark.createDataFrame([(1, "A" * n)], "read_id long, seq string")
    assert [(r.start_pos, r.end_pos) for r in G.fragments(df).orderBy("start_pos").collect()] == want
    state = R.FastaState("x.fa", 40)
    lines = [">s x", *("A" * min(70, n - i) for i in range(0, n, 70))]
    assert [(a, a + len(b)) for x in lines for _, a, b in state.line(x)] + [(a, a + len(b)) for _, a, b in state.end()] == want


def test_files(spark, tmp_path):
    (tmp_path / "one.fq").write_text("@a\n" + "A" * 40 + "\n+c\n" + "!" * 40 + "\r\n@b\n" + "A" * 39 + "N\n+\n" + "!" * 40 + "\n@c\nAC\n+\n!\n@d\n" + "C" * 50 + "\n+\n" + "!" * 50 + "\n")
    got = R.read_sequences(spark, [str(tmp_path / "one.fq")]).collect()
    assert [(r.sequence, r.comment, r.source, r.fragment_id) for r in got] == [("a", "c", "one", 0)]
    with pytest.raises(ValueError):
        R.read_sequences(spark, [str(tmp_path / "one.fq")], strict=True)
    (tmp_path / "bad.fastq").write_text("x\n" + "A" * 40 + "\n+\n" + "!" * 40 + "\n")
    assert R.read_sequences(spark, [str(tmp_path / "bad.fastq")]).count() == 0
    (tmp_path / "two.fa").write_text(">s desc\r\nnnacgtNN" + "A" * 30 + "\r\n" + "C" * 20 + "\n>t\n" + "G" * 45 + "\n")
    (tmp_path / "three.fa").write_text(">u\n" + "G" * 45 + "\n")
    got = R.read_sequences(spark, [str(tmp_path / "two.fa"), str(tmp_path / "three.fa")]).orderBy("source", "fragment_id").collect()
    assert [(r.source, r.sequence, r.start_pos, len(r.seq), r.tag) for r in got] == [("three", "u", 0, 45, "three:0"), ("two", "s", 8, 50, "two:0"), ("two", "t", 0, 45, "two:1")]
    assert len({r.read_id for r in got}) == 3
    (tmp_path / "junk.fa").write_text("ACGT\n>t\n" + "G" * 45 + "\n")
    with pytest.raises(Exception, match="does not start with"):
        R.read_sequences(spark, [str(tmp_path / "junk.fa")]).collect()
    with pytest.raises(ValueError):
        R.format_of("x.bam")


def test_fastq_goes_out_and_comes_back(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(f"r{i}", "".join(rng.choices("ACGT", k=rng.randrange(40, 90)))) for i in range(300)]
    (tmp_path / "in.fq").write_text("".join(f"@{n}\n{s}\n+\n{'#' * len(s)}\n" for n, s in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # the file is split
    try:
        read = R.read_sequences(spark, [str(tmp_path / "in.fq")])
        assert [(r.sequence, r.seq) for r in read.orderBy("fragment_id").collect()] == rows
        assert [r.sequence for r in R.read_sequences(spark, [str(tmp_path / "in.fq")], skip=10, use=3).orderBy("fragment_id").collect()] == ["r10", "r11", "r12"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    R.write_fastq(read.coalesce(1), str(tmp_path / "out"), "gzip")
    out = next((tmp_path / "out").glob("part-*"))
    out.rename(tmp_path / "back.fq.gz")
    assert sorted((r.sequence, r.seq, r.qual) for r in R.read_sequences(spark, [str(tmp_path / "back.fq.gz")]).collect()) == sorted((n, s, "#" * len(s)) for n, s in rows)


def test_graph_modes_and_files(spark, reads, tmp_path):
    with pytest.raises(RuntimeError):
        Graph.index(reads).routes
    for wrong in ({"k": 22}, {"k": 33}, {"sparseness": 30}):
        with pytest.raises(ValueError):
            GraphConfig(**wrong)
    g = Graph.build(reads.withColumn("tag", F.concat(F.lit("t"), F.col("read_id"))), config=GraphConfig(15, 11))
    path = str(tmp_path / "g")
    g.save(path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        g.save(path)
    again = Graph.load(spark, path)
    assert again.config == GraphConfig(15, 11) and set(again.tables) == {"nodes", "tails", "routes", "tags"}
    for name in again.tables:
        assert sorted(map(tuple, again.tables[name].collect())) == sorted(map(tuple, g.tables[name].select(again.tables[name].columns).collect()))
    assert sorted(r.seq for r in again.walks().collect()) == sorted(READS)
    assert again.tag_counts().first() == (4, 4, 0)
    assert {r.check: r.violations for r in again.validate().collect()} == dict.fromkeys(("tail_without_node", "tail_twice", "route_without_tail", "edge_without_far_tail", "edge_width"), 0)
    with pytest.raises(FileNotFoundError):
        Graph.load(spark, str(tmp_path / "none"))


def test_asking_a_graph(spark, reads):
    """On the golden reads, nodes as one reader finds them."""
    g = Graph.build(reads.withColumn("tag", F.concat(F.lit("t"), F.col("read_id"))), "sequential")
    assert g.linked_smers("A" * 23).count() == 2 and g.linked_smers("C" * 23).count() == 0
    starts = g.end_contexts(True, False)
    assert starts.count() == 4
    asked = starts.withColumn("asked_id", F.monotonically_increasing_id()).cache()
    followed = {r.seq: (r.steps, r.tag) for r in g.follow(asked).collect()}
    assert {s: t for s, (_, t) in followed.items()} == dict(zip(READS, ("t1", "t2", "t3", "t4"))) and followed[READS[3]][0] == 18
    assert all(r.steps == 1 for r in g.follow(asked, 1).collect())
    once = g.follow_once(asked).collect()
    assert len(once) == 3 and all(r.returns for r in once)  # the third read has one step
    back = g.follow_upstream(g.contexts().where("node_pos >= 0").withColumn("asked_id", F.monotonically_increasing_id())).collect()
    assert max(r.steps for r in back) == 18
    assert {r.tag for r in g.tag_data(g.contexts()).collect()} == {None, "t1", "t2", "t3", "t4"}
    lists = {S_: r for r in g.linked_routes(3).collect() for S_ in smer([r.node])}
    assert lists["A" * 23].routes is None and lists["A" * 23].total == 18 and len(lists["ACAAACGTGATGGTTGTACCGCA"].routes) == 2
    assert all(r.routes is None for r in g.linked_routes(0).collect())


def test_command_line(spark, tmp_path, capsys):
    fastq, fasta, graph = str(tmp_path / "r.fq"), str(tmp_path / "r.fa"), str(tmp_path / "g")
    (tmp_path / "r.fq").write_text("".join(f"@{i}\n{s}\n+\n{'!' * len(s)}\n" for i, s in enumerate(READS)))
    (tmp_path / "r.fa").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(READS)))
    for files, sequences in ((fastq, 0), (fasta, 4)):
        main(["index", graph, files, "--k", "15", "--sparseness", "15"])
        nodes = sorted(r.node for r in Graph.load(spark, graph, routed=False).nodes.collect())
        before = {f.name for f in (tmp_path / "g" / "nodes").iterdir()}
        main(["route", graph, files])
        assert before == {f.name for f in (tmp_path / "g" / "nodes").iterdir()}
        got = Graph.load(spark, graph)
        assert sorted(r.node for r in got.nodes.collect()) == nodes and got.config.k == 15
        assert sorted(r.seq for r in got.walks().collect()) == sorted(READS)
        assert got.tags.count() == sequences
        main(["read", graph])
    assert got.sequences.count() == 4
    main(["index-and-route", graph, fasta, "--stats", str(tmp_path / "stats")])
    assert "routes" in capsys.readouterr().out and any((tmp_path / "stats").glob("*.csv"))
    with pytest.raises(SystemExit):
        main(["sort", graph])


def test_batches_grow(spark, reads, tmp_path):
    """The graph of a stream is that of all its reads, also of those that come before their nodes."""
    path = str(tmp_path / "s")
    rest = reads.union(spark.createDataFrame([(20, READS[0][7:60]), (21, G._revcomp(READS[1])[3:])], "read_id long, seq string"))
    for b in (0, 1, 2):
        ingest.grow(rest.where(f"read_id % 3 = {b}"), path, b)
    ingest.grow(rest.where("read_id % 3 = 2"), path, 2)  # tried again
    used = G.filtered(rest)
    want = G.routes(G.steps(used, G.nodes_grid(used)))
    assert sorted(map(tuple, ingest.routes(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_files_stream_in(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, s in enumerate(READS):
        (folder / f"f{i}.fa").write_text(f">s{i}\n{s}\n")
    path = str(tmp_path / "s")
    query = ingest.ingest_files(spark, str(folder), path, files_a_batch=2, availableNow=True)
    assert query.awaitTermination(240)
    used = G.filtered(spark.createDataFrame(list(enumerate(READS)), "read_id long, seq string"))
    want = G.routes(G.steps(used, G.nodes_grid(used)))
    assert sorted(map(tuple, ingest.routes(spark, path).collect())) == sorted(map(tuple, want.collect()))


NAMES = ["seq_reads", "revcomp_any", "quality_masked", "fasta_runs", "kmer_orientation", "smer_pack", "packed_revcomp", "nodes_grid", "steps", "linking_nodes", "edge_widths", "route_runs", "sequence_starts", "edge_transitions", "followed_reads", "map_reads_to_nodes", "phred_offset"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda f: f[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_letters_as_bases_of_batches(spark):
    texts = ["Abz-é z9\n", None, "", "日本", "xyZ" * 3, "ACGT"]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r.s for r in df.select("i", S.dna(F.col("t")).alias("s")).orderBy("i").collect()]
    assert P.letters_as_bases(column).to_pylist() == want
    assert P.letters_as_bases(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    assert P.letters_as_bases(pa.array([], pa.string())).to_pylist() == []


def test_spread_keeps_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    dealt = spread(spark.read.parquet(f"{tmp_path}/one"))
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.distinct().count() == dealt.count() == 1000
    spark.range(1000).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread(many) is many


@pytest.mark.parametrize("fan", [2, 16])
def test_packed_order_equals_that_of_steps(spark, monkeypatch, fan):
    """Reads that share long stretches, repeat themselves, run backwards, and copies, in many groups and parts."""
    rng = random.Random(7)
    base, seqs = "".join(rng.choices("ACGT", k=600)), []
    for _ in range(60):
        a, b = sorted(rng.sample(range(0, 600), 2))
        s = list(base[min(a, 500) : max(b, min(a, 500) + 60)])
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        s = "".join(s)
        s = G._revcomp(s) if rng.random() < 0.3 else s
        seqs.append(s * 3 if rng.random() < 0.2 else s)
    seqs += [*seqs[:8], "A" * 60, "A" * 40, "AC" * 40, base * 9, base * 9 + "ACC", base * 8]
    used = G.filtered(spark.createDataFrame([(i - 30, s) for i, s in enumerate(seqs)], "read_id long, seq string")).cache()
    monkeypatch.setattr(G, "GROUP", 2000)
    monkeypatch.setattr(O, "PART_NODES", 40)
    monkeypatch.setattr(O, "FAN", fan)
    want, got = W.Ordered(G.steps(used, G.nodes_grid(used)).cache()), O.PackedOrder(used, G.nodes_grid(used))
    assert got.parts > 1 and got.state.count() > 2
    for name in ("positions", "runs"):
        rows = getattr(want, name)()
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, getattr(got, name)().select(rows.columns).collect()))


#: Queries that are answered without a row for each step: all have failed by disk or time at 0.1 or 1 GB.
IN_PARTS = ["route_runs", "route_offsets", "route_positions", "linked_smers_flat", "edge_transitions", "node_transitions", "node_contexts", "spanning_contexts", "context_sequences", "sequence_ends", "node_stats", "linked_smer_limited", "read_walk_tags", "tag_lookup", "tag_counts"]


@pytest.mark.parametrize("name", IN_PARTS)
def test_queries_in_parts(spark, monkeypatch, name):
    for where, what in ((W, "Ordered"), (W, "traced"), (G, "steps")):
        monkeypatch.delattr(where, what)
    test_queries_equal_their_sql(spark, name)


@pytest.mark.parametrize("name", ["followed_upstream", "followed_once"])
def test_contexts_followed_in_parts(spark, monkeypatch, name):
    """Both failed at 0.1 or 1 GB, where routes were joined as rows."""
    monkeypatch.delattr(W, "positions_of")
    test_queries_in_parts(spark, monkeypatch, name)


@pytest.mark.parametrize("policy", ["grid", "sequential"])
def test_packed_contexts_equal_those_of_rows(spark, monkeypatch, policy):
    """All contexts, some on the wrong side, at no route or at another tail; few and many steps."""
    monkeypatch.setattr(G, "GROUP", 200)
    monkeypatch.setattr(O, "PART_NODES", 8)
    seqs = [*READS, READS[0], READS[1][5:], READS[0] * 2, G._revcomp(READS[1]), "AC" * 40]
    g = Graph.build(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), policy)
    asked = g.contexts().unionByName(g.contexts(False)).drop("node_pos")
    asked = asked.unionByName(asked.withColumn("edge_pos", F.col("edge_pos") + 2)).unionByName(asked.withColumn("bases", F.concat("bases", F.lit("A"))))
    asked = asked.withColumn("asked_id", F.monotonically_increasing_id() - 50).cache()
    for most in (1, 3, 1 << 40):
        want = O_R.followed_upstream(asked, g.positions, g.trace, most)
        assert sorted(map(tuple, g.follow_upstream(asked, most).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    if policy == "grid":
        want = g.extract(g.contexts(), True).select("node", "dir", "node_pos", "seq")
        assert sorted(map(tuple, g.context_sequences().collect())) == sorted(map(tuple, want.collect()))
    want = O_R.followed_once(asked, g.positions, g.edges)
    assert sorted(map(tuple, g.follow_once(asked).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_order_keeps_no_filter_and_no_inner_tails(spark, monkeypatch):
    """What lies on disk: one table of the order, hits without the tails between them, and no class of routes twice in a blob."""
    held = []
    monkeypatch.setattr(O, "_parts", lambda rows, names, fn, schema, f=O._parts: held.append((names, rows)) or f(rows, names, fn, schema))
    used = G.filtered(spark.createDataFrame([(i, s) for i, s in enumerate([*READS, *READS])], "read_id long, seq string"))
    order = O.PackedOrder(used, G.nodes_grid(used))
    row = order.hits.first()
    assert order.hits is order.state and len(O.of_few(row.up)) == 8 < len(O.of_few(row.way))
    held.clear()
    order.runs().collect()
    (names, rows), = held
    assert "read" not in names
    for r in rows.collect():
        classes = list(zip(O.of_growing(r.way).tolist(), O.of_few(r.up).tolist(), strict=True))
        assert len(classes) == len(set(classes)) < len(O.of_few(r.key))


def test_marks_are_places_of_kmers_of_one_read(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 5, 24, 300, 0, 70000, 2, 0)] + ["ACGTNACGTACGTACGTACGTACGTACGTNNACGATCAGCATCGACTAGC"]
    for k in (3, 15, 23, 31):
        data, low, high = P.texts_of(pa.array(texts))
        read, pos, forward, reverse = (np.concatenate(x) for x in zip(*P.places(data, low, high, k)))
        at, node = P.marked(data, low, high, k, None), np.minimum(forward, reverse)
        assert (at == low[read] + pos).all() and (P.ids_at(data, at, k)[0] == forward).all()
        assert not P.ids_at(data, np.arange(high[-1] - k + 1), k)[1].all()
        held = P.Filter(1 << 10, slices=4)
        held.put(node[::50])
        assert (P.marked(data, low, high, k, held) == at[held.may_hold(node)]).all() and held.may_hold(node[::50]).all()
        assert P.strings_of(forward[:9], k).to_pylist() == [texts[r][p : p + k] for r, p in zip(read[:9], pos[:9])]


def test_reads_are_searched_once(spark, monkeypatch):
    """linked_smers_flat failed by time: each place of a read was made a k-mer for the nodes, and looked up two times."""
    seen = []
    monkeypatch.setattr(P, "places", lambda *a: seen.append(a))
    monkeypatch.setattr(registry, "spelled", lambda *a: seen.append(a))
    test_queries_equal_their_sql(spark, "linked_smers_flat")
    used = G.filtered(spark.createDataFrame(list(enumerate(READS)), "read_id long, seq string"))
    blob = G.grouped(used.coalesce(1)).first()
    n, marks = sum(map(len, READS)), np.unpackbits(np.frombuffer(blob.marks, np.uint8))
    assert not seen and len(blob.marks) == -(-n // 8) and marks.sum() == n - 22 * len(READS)


def test_freed_removes_the_last_shuffle(spark):
    """sequence_ends and edge_transitions failed by disk: the scheduler held the job before, and so its shuffle's files."""
    import subprocess
    import time

    from strandloom.operators import lineage

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    most = lambda: max([0, *map(int, subprocess.run(["find", folder, "-name", "shuffle_*.data", "-printf", "%s\n"], capture_output=True, text=True).stdout.split())])
    lineage.cut(spark.range(2_000_000).selectExpr("hash(id) AS x").repartition(4, "x"))
    before = most()
    lineage.freed(spark)
    until = time.time() + 20
    while most() >= before and time.time() < until:
        time.sleep(0.2)
    assert before > 1_000_000 > most()


def test_graph_checks_in_parts(spark, monkeypatch):
    """graph_checks failed by disk: tails, edges and runs were joined as rows. Violations are still found."""
    for where, what in ((O_R, "validation"), (G, "edges"), (T, "tails"), (O, "PackedOrder")):
        monkeypatch.delattr(where, what)
    monkeypatch.setattr(T, "PART_NODES", 100)
    test_queries_equal_their_sql(spark, "graph_checks")
    key = lambda suffix, tail, linked: suffix << T.SIDE | tail << 1 | linked
    ints = lambda *x: np.array(x, np.int64)
    node, keys = ints(3, 3, 3, 5), ints(key(0, 6, 0), key(0, 6, 1), key(1, 7, 1), key(0, 4, 1))
    got = T.checked_nodes(ints(3, 4), node, keys, ints(6, 6, 7), ints(6, 5, 7), ints(7, 7, 1))
    assert got == {"tail_without_node": 1, "tail_twice": 1, "route_without_tail": 1}
    n, code = ints(12345), ints(key(1, 7, 1))
    _, _, _, target, linked, far = T._led(n, code, 23)
    pair = lambda f, r: T.checked_edges(*T._summed(np.concatenate([n, target]), np.concatenate([code, far]), ints(4, f), ints(1, r)), 23)
    f, r = (4, 1) if linked[0] > 0 else (1, 4)
    assert pair(f, r) == {"edge_without_far_tail": 0, "edge_width": 0}
    assert pair(f + 1, r) == {"edge_without_far_tail": 0, "edge_width": 2}
    assert T.checked_edges(n, code, ints(4), ints(1), 23) == {"edge_without_far_tail": 1, "edge_width": 1}
    assert T.checked_edges(n, code & ~1, ints(4), ints(1), 23) == {"edge_without_far_tail": 0, "edge_width": 0}


def test_stats_are_not_joined(spark, reads, monkeypatch):
    """node_stats failed by time; each node of a built graph has routes, so the nodes needn't be joined to them."""
    monkeypatch.delattr(Graph, "smers")
    got = Graph.build(reads).stats()
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.smer for r in got.collect()) == smer([r.node for r in G.nodes_grid(G.filtered(reads)).orderBy("node").collect()])


@pytest.mark.parametrize("together, chunk", [(1 << 24, 1 << 20), (40, 64), (1, 1 << 20)])
def test_saved_graphs_are_walked_without_joins(spark, tmp_path, monkeypatch, together, chunk):
    """Of a saved graph in many parts, lists followed in one task, made shorter before, or to one route each."""
    draw = random.Random(7)
    core = ["".join(draw.choices("ACGT", k=n)) for n in (40, 90, 300, 700)]
    texts = READS + core + [S_revcomp(core[1]), core[2], core[1] + core[3], core[3][100:400], "AC" * 60, "A" * 120, core[0] + "A" * 50]
    reads = spark.createDataFrame([(i - 5, s, f"t{i}" if i % 3 else None) for i, s in enumerate(texts)], "read_id long, seq string, tag string")
    g = Graph.build(reads, config=GraphConfig(15, 11))
    want = {n: sorted(map(tuple, g.tables[n].select(sorted(g.tables[n].columns)).collect())) for n in ("tails", "routes", "tags")}
    rows = sorted(map(tuple, W.walks(g.positions, g.trace, 15).collect()))
    for module, name, value in ((O_W, "PART_NODES", 8), (O_W, "TOGETHER", together), (O_W, "CHUNK", chunk), (O_W, "DEALT", 7), (O, "PART_NODES", 8)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(W, "traced", None)
    monkeypatch.setattr(T, "tails", None)
    Graph.build(reads, config=GraphConfig(15, 11)).save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    for n, held in want.items():
        assert sorted(map(tuple, again.tables[n].select(sorted(again.tables[n].columns)).collect())) == held
    assert sorted(map(tuple, again.walks().collect())) == rows and sorted(r[-1] for r in rows) == sorted(texts)


def test_walks_of_no_routes_and_of_long_tails(spark):
    none = spark.createDataFrame([], O.RUNS)
    assert O_W.walks(none, 0).count() == 0
    reads = spark.createDataFrame([(1, "ACGTTGCA" * 6 + "C" * 60)], "read_id long, seq string")
    nodes = spark.createDataFrame([(r.node,) for r in G.kmers(reads.withColumn("m", F.length("seq") - 23)).where("pos = 3").collect()], "node long")
    g = Graph({"nodes": nodes}).route(reads)
    assert O_W.walks(g.routes, 1) is None and [r.seq for r in g.walks().collect()] == ["ACGTTGCA" * 6 + "C" * 60]


def test_follow_lists():
    """A list that goes round is left out; few lists are followed one by one."""
    order = np.random.default_rng(1).permutation(400)
    prev, after = np.full(400, -1, np.int32), np.full(400, -1, np.int32)
    ends = [0, 5, 6, *range(20, 60, 2), 300, 390]
    for a, b in zip(ends[:-1], ends[1:]):
        prev[order[a + 1 : b]] = order[a : b - 1]
    prev[order[390:]] = np.roll(order[390:], 1)
    weight = np.arange(400) % 3 + 1
    after[prev[prev >= 0]] = np.flatnonzero(prev >= 0)
    for w in (None, weight):
        slot, begin = O_W.follow(after, np.flatnonzero(prev < 0), w)
        assert (slot[order[390:]] == -1).all() and len(begin) == len(ends) - 1
        one = np.ones(400, int) if w is None else w
        taken = np.concatenate([np.arange(s, s + n) for s, n in zip(slot[order[:390]], one[order[:390]])])
        assert sorted(taken) == list(range(one[order[:390]].sum()))
        on = np.flatnonzero(prev >= 0)
        on = on[slot[on] >= 0]
        assert (slot[on] == slot[prev[on]] + one[prev[on]]).all()
