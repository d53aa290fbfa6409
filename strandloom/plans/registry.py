"""The registered queries on the provided tables, and the same in SQL for DuckDB.

Texts stand in for DNA (functions.sequences.dna, a batch at a time). Documents are the reads, whole and all of them; conversations are short reads,
for the queries that go through reads one after the other (`nodes_sequential`) or carry qualities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions import sequences as S
from ..graph import Graph
from ..operators import graph as G
from ..operators import packed_tails as T
from ..operators import retrieval as R
from ..operators.lineage import by_arrow, cut, folder, spread
from ..operators.packed_routes import PackedOrder


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reads(texts: DataFrame) -> DataFrame:
    """texts (read_id, text, and any others) with seq, their letters as bases, for text. Spelled once a row: a filter of seq
    doesn't go below it."""
    also = [c for c in texts.columns if c not in ("read_id", "text")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            yield {"read_id": batch.column("read_id"), "seq": P.letters_as_bases(batch.column("text"))} | {c: batch.column(c) for c in also}

    schema = ", ".join(["read_id long", "seq string", *[f"{c} {texts.schema[c].dataType.simpleString()}" for c in also]])
    return by_arrow(spread(texts), run, schema)


def long_reads(spark: SparkSession, d: str) -> DataFrame:
    return _reads(_table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("read_id"), "text"))


def short_reads(spark: SparkSession, d: str) -> DataFrame:
    return _reads(_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("read_id"), "text"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a tag: those of a known language."""
    tag = F.when(F.col("lang").isNotNull(), F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    return _reads(_table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("read_id"), "text", tag.alias("tag")))


def _used(spark: SparkSession, d: str, reads=long_reads) -> DataFrame:
    return G.filtered(reads(spark, d))


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reads and nodes. Reads are spelled again when they are needed, which is less than to write and read them."""
    used = _used(spark, d)
    return used, cut(G.nodes_grid(used), "nodes")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return G.steps(*_nodes(spark, d))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """The tails with their targets."""
    return T.tails(*_nodes(spark, d))


def spelled(df: DataFrame, *also: str) -> DataFrame:
    """df with its packed k-mers spelled out: smer for node."""
    columns = {c: S.unpack(F.col(c)).alias("smer" if c == "node" else c) if c in ("node", *also) else F.col(c) for c in df.columns}
    return df.select(*columns.values())


def _ordered(spark: SparkSession, d: str) -> PackedOrder:
    return PackedOrder(*_nodes(spark, d))


def _graph(spark: SparkSession, d: str) -> Graph:
    return Graph.build(_tagged(spark, d), again=True)


def _asked(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    """A graph, and for each read the context at its middle step, where the read comes in."""
    graph = _graph(spark, d)
    return graph, cut(graph.ordered.middles(), "asked")


def _ends(spark: SparkSession, d: str, start: bool) -> DataFrame:
    graph = _graph(spark, d)
    return spelled(graph.end_contexts(start, not start)).select("smer", "dir", "node_pos", "idx")


def _read_walks(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).walks().select("seq")


def _tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The tags of all contexts at starts of reads that end where they start (reads of one step)."""
    graph = _graph(spark, d)
    return spelled(graph.end_contexts(True, False).join(graph.tags, ["node", "dir", "node_pos"])).select("smer", "dir", "node_pos", "tag")


def _limited(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    lists = _graph(spark, d).linked_routes(limit)
    one = lambda r: F.concat_ws(":", r["dir"], r["prefix"].cast("string"), r["suffix"].cast("string"), r["width"].cast("string"))
    return spelled(lists.withColumn("routes", F.array_join(F.transform("routes", one), ",")))


def _node_stats(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).stats()


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return spelled(_graph(spark, d).transitions()).select("smer", "dir", "asked_pos", "from_bases", "side", "bases", "edge_pos")


def _edge_transitions(spark: SparkSession, d: str) -> DataFrame:
    return spelled(_graph(spark, d).edge_transitions(), "from_node").select("from_node", "from_dir", "asked_pos", "smer", "dir", "side", "bases", "edge_pos")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).validate()


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A saved graph is loaded again: rows and a total of each table, and of the reads walked from it."""
    import uuid

    path = f"{folder(spark)}/graph-{uuid.uuid4().hex}"
    _graph(spark, d).save(path, last=True)
    g = Graph.load(spark, path)
    parts = {"nodes": (g.nodes, F.count("*")), "tails": (g.tails, F.sum(F.col("forward") + F.col("reverse"))), "routes": (g.routes, F.sum("width")), "tags": (g.tags, F.sum(F.length("tag"))), "walks": (g.walks(), F.sum(F.length("seq")))}
    out = None
    for name, (df, total) in parts.items():
        one = df.agg(F.count("*").alias("n"), total.cast("long").alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    asked = _reads(_table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("read_id"), "text"))
    return spelled(G.hits(G.filtered(asked), _nodes(spark, d)[1]).drop("ord"))


def _sequence_index(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), "source")
    return G.fragments(long_reads(spark, d)).join(docs, "read_id").select("source", F.col("read_id").alias("sequence"), "fragment_id", "start_pos", "end_pos")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Short reads with made-up qualities: the code of a base is 33 plus four times its number."""
    return short_reads(spark, d).withColumn("qual", F.translate("seq", "ACGT", "!%)-"))


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    q = _quality(spark, d)
    return q.select("read_id", F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"), F.lit("\n")).alias("record"))


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    codes = _quality(spark, d).select(F.explode(S.quality_ints(F.col("qual"))).alias("q"))
    return codes.groupBy("q").agg(F.count("*").alias("n"))


def _phred(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(spark, d).select((F.col("q") + 33).alias("code"), "n")
    n = lambda a, b: F.coalesce(F.sum(F.when(F.col("code").between(a, b), F.col("n"))), F.lit(0))
    both = h.agg(n(33, 58).alias("low"), n(80, 104).alias("high"))
    return both.select("low", "high", F.when((F.col("low") > 0) & (F.col("high") == 0), 33).when((F.col("high") > 0) & (F.col("low") == 0), 64).otherwise(0).alias("offset"))


QUERIES = {
    "seq_reads": lambda s, d: long_reads(s, d).select("read_id", "seq", F.length("seq").alias("len")),
    "seq_reads_filtered": lambda s, d: _used(s, d).select("read_id", "seq", "m"),
    "fasta_runs": lambda s, d: G.acgt_runs(_table(s, d, "documents").select("doc_id", F.translate("text", "acgt", "ACGT").alias("text")), "doc_id", "text", 2),
    "fasta_fragments": lambda s, d: G.fragments(long_reads(s, d)),
    "kmers": lambda s, d: G.kmers(_used(s, d), text=True).select("read_id", "pos", "kmer"),
    "canonical_kmers": lambda s, d: spelled(G.kmer_counts(_used(s, d))),
    "kmer_orientation": lambda s, d: G.kmers(_used(s, d)).groupBy("read_id").agg(F.sum(F.col("rc").cast("long")).alias("reversed"), F.count("*").alias("n")),
    "kmer_both_strands": lambda s, d: G.kmers(_used(s, d), text=True).select("read_id", "pos", "kmer", S.revcomp(F.col("kmer")).alias("other")),
    "smer_pack": lambda s, d: spelled(G.nodes_grid(_used(s, d)).withColumn("smer_id", F.col("node"))),
    "smer_unpack": lambda s, d: G.nodes_grid(_used(s, d)).select(S.unpack(F.col("node")).alias("smer")),
    "packed_revcomp": lambda s, d: spelled(G.nodes_grid(_used(s, d)).withColumn("rc_id", S.revcomp_id(F.col("node")))),
    "revcomp": lambda s, d: long_reads(s, d).select("read_id", S.revcomp(F.col("seq")).alias("rc")),
    "revcomp_any": lambda s, d: _table(s, d, "documents").select("doc_id", S.revcomp_any(F.col("text")).alias("rc")),
    "nodes_grid": lambda s, d: spelled(G.nodes_grid(_used(s, d))),
    "node_count": lambda s, d: G.nodes_grid(_used(s, d)).agg(F.count("*").alias("n")),
    "node_path_counts": lambda s, d: spelled(G.found_kmers(*_nodes(s, d)).groupBy("node").agg(F.count("*").alias("n"))),
    "nodes_sequential": lambda s, d: spelled(G.nodes_sequential(_used(s, d, short_reads))),
    "nodes_rounds": lambda s, d: spelled(G.nodes_rounds(_used(s, d))),
    "read_hits": lambda s, d: spelled(G.hits(*_nodes(s, d))),
    "hit_gaps": lambda s, d: G.gaps(*_nodes(s, d)).groupBy("gap").agg(F.count("*").alias("n")),
    "max_gap_check": lambda s, d: G.gaps(*_nodes(s, d)).agg(F.max("gap").alias("max_gap")),
    "steps": lambda s, d: spelled(_steps(s, d)),
    "tails": lambda s, d: spelled(G.tails(_steps(s, d)).drop("forward", "reverse")),
    "tail_targets": lambda s, d: spelled(_linked(s, d).drop("forward", "reverse"), "target"),
    "linking_nodes": lambda s, d: spelled(G.linking(_linked(s, d)).select("node", "side", "idx", "linking")),
    "dangling_tails": lambda s, d: spelled(_linked(s, d).where("linked = 0").select("node", "side", "bases")),
    "edges": lambda s, d: spelled(T.edges(*_nodes(s, d)), "target"),
    "edge_widths": lambda s, d: spelled(T.edge_widths(*_nodes(s, d)), "target"),
    "edge_symmetry_check": lambda s, d: T.edge_check(*_nodes(s, d)),
    "graph_checks": _checks,
    "routes_agg": lambda s, d: spelled(T.routes(*_nodes(s, d))),
    "total_routes": lambda s, d: spelled(G.found_kmers(*_nodes(s, d)).groupBy("node").agg(F.count("*").alias("total"))),
    "node_stats": _node_stats,
    "route_positions": lambda s, d: spelled(_ordered(s, d).positions().select("read_id", "ord", "node", "dir", "node_pos", "up_pos", "down_pos")),
    "route_runs": lambda s, d: spelled(_ordered(s, d).runs().select("node", "dir", "run", "up_tail", "down_tail", "width")),
    "route_offsets": lambda s, d: spelled(_ordered(s, d).runs().select("node", "dir", "run", "node_pos", "up_pos", "down_pos")),
    "sequence_starts": lambda s, d: _ends(s, d, True),
    "sequence_ends": lambda s, d: _ends(s, d, False),
    "node_contexts": lambda s, d: spelled(_graph(s, d).contexts()),
    "spanning_contexts": lambda s, d: spelled(_graph(s, d).spanning_contexts()),
    "node_transitions": _transitions,
    "edge_transitions": _edge_transitions,
    "context_sequences": lambda s, d: spelled(_graph(s, d).context_sequences()),
    "followed_reads": lambda s, d: (lambda g, a: g.follow(a, 1 << 40))(*_asked(s, d)),
    "followed_upstream": lambda s, d: (lambda g, a: g.follow_upstream(a, 1 << 40))(*_asked(s, d)),
    "followed_once": lambda s, d: (lambda g, a: spelled(g.follow_once(a)))(*_asked(s, d)),
    "linked_smers_flat": lambda s, d: T.tails(*_nodes(s, d), spelled=True).drop("len"),
    "linked_smer_limited": _limited,
    "read_walks": _read_walks,
    "read_walk_tags": lambda s, d: spelled(_graph(s, d).tags),
    "tag_lookup": _tag_lookup,
    "tag_counts": lambda s, d: _graph(s, d).tag_counts(),
    "sequence_index": _sequence_index,
    "sequence_index_summary": lambda s, d: _sequence_index(s, d).groupBy("source").agg(F.countDistinct("sequence").alias("sequences"), F.count("*").alias("fragments"), F.max("end_pos").alias("longest")),
    "map_reads_to_nodes": _mapped,
    "fastq_text": _fastq,
    "quality_ints": lambda s, d: _quality(s, d).select("read_id", F.array_join(S.quality_ints(F.col("qual")).cast("array<string>"), ",").alias("q")),
    "quality_masked": lambda s, d: _quality(s, d).withColumn("masked", F.regexp_replace("seq", "AC", "NC")).select("read_id", F.array_join(S.quality_ints(F.col("qual"), 33, F.col("masked")).cast("array<string>"), ",").alias("q")),
    "quality_histogram": _histogram,
    "phred_offset": _phred,
    "graph_roundtrip": _roundtrip,
}

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))".format
_DNA = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_PACK = "list_sum(list_transform(range(0, 23), lambda i: (strpos('ACGT', substr({0}, i + 1, 1)) - 1)::BIGINT << (2 * (22 - i))::BIGINT))::BIGINT".format
_SHORT, _LONG = ("conv_id * 1000 + turn", "conversations"), ("doc_id", "documents")
#: Doublings in SQL: reads of up to 2 ** LEVELS steps.
_LEVELS = 16


def _doubled(name: str, tail: str, way: str) -> str:
    """Ranks of the whole list of tails before (lag) or after (lead) each step, a shorter list first, by doubling."""
    out = [f"{name}0 AS MATERIALIZED (SELECT read_id, ord, dense_rank() OVER (ORDER BY {tail}) AS r FROM st)"]
    for j in range(_LEVELS):
        out.append(f"{name}{j + 1} AS MATERIALIZED (SELECT read_id, ord, dense_rank() OVER (ORDER BY r, p) AS r FROM (SELECT *, coalesce({way}(r, {1 << j}) OVER (PARTITION BY read_id ORDER BY ord), 0) AS p FROM {name}{j}))")
    return ",\n".join(out)


def _sql(select: str, source: tuple[str, str] = _LONG) -> str:
    """The tables of the graph as common table expressions (only those that the query names are computed)."""
    tables = [
        f"reads AS (SELECT {source[0]} AS read_id, {_DNA} AS seq FROM {source[1]})",
        "r AS (SELECT read_id, seq, length(seq) - 23 AS m FROM reads WHERE length(seq) >= 40 AND NOT contains(seq, 'N'))",
        "places AS (SELECT read_id, m, unnest(range(0, m + 1)) AS pos FROM r)",
        "k AS (SELECT p.read_id, p.m, p.pos, substr(r.seq, p.pos + 1, 23) AS kmer FROM places p JOIN r ON p.read_id = r.read_id)",
        f"c AS (SELECT *, least(kmer, {_RC('kmer')}) AS smer, kmer > {_RC('kmer')} AS rc FROM k)",
        "n AS (SELECT DISTINCT smer FROM c WHERE (pos > 0 AND pos % 23 = 0) OR (m < 23 AND pos = m // 2))",
        """h AS (SELECT read_id, m, pos, smer, CASE WHEN rc THEN 'R' ELSE 'F' END AS dir, row_number() OVER (PARTITION BY read_id ORDER BY pos) - 1 AS ord,
      coalesce(lag(pos) OVER (PARTITION BY read_id ORDER BY pos), 0) AS a, coalesce(lead(pos) OVER (PARTITION BY read_id ORDER BY pos), m) AS b
      FROM c WHERE smer IN (SELECT smer FROM n))""",
        "g AS (SELECT read_id, pos - a AS gap FROM h UNION ALL SELECT read_id, max(m) - max(pos) FROM h GROUP BY read_id)",
        f"st AS MATERIALIZED (SELECT h.read_id, ord, pos, smer, dir, {_RC('substr(seq, a + 1, pos - a)')} AS up_tail, substr(seq, pos + 24, b - pos) AS down_tail FROM h JOIN r ON h.read_id = r.read_id)",
        """en AS (SELECT smer, dir, CASE WHEN dir = 'F' THEN 'P' ELSE 'S' END AS side, up_tail AS bases FROM st
       UNION ALL SELECT smer, dir, CASE WHEN dir = 'F' THEN 'S' ELSE 'P' END, down_tail FROM st)""",
        """tl AS (SELECT smer, side, row_number() OVER (PARTITION BY smer, side ORDER BY length(bases), bases) AS idx, length(bases) AS len, bases
       FROM (SELECT DISTINCT smer, side, bases FROM en WHERE bases <> ''))""",
        f"tp AS (SELECT *, CASE WHEN side = 'S' THEN smer ELSE {_RC('smer')} END || bases AS path FROM tl)",
        f"tq AS (SELECT *, right(path, 23) AS t, {_RC('right(path, 23)')} AS u FROM tp)",
        """tt AS MATERIALIZED (SELECT smer, side, idx, len, bases, path, least(t, u) AS target,
       CASE WHEN least(t, u) NOT IN (SELECT smer FROM n) THEN 0 WHEN (side = 'S') = (t < u) THEN 1 ELSE -1 END AS linked FROM tq)""",
        f"""ed AS MATERIALIZED (SELECT smer, side, idx, bases, target, linked, CASE WHEN left({_RC('path')}, 23) = target THEN 'S' ELSE 'P' END AS far_side,
       substr({_RC('path')}, 24, length(bases)) AS far_bases FROM tt WHERE linked <> 0)""",
        "wd AS MATERIALIZED (SELECT smer, side, bases, count(*) FILTER (dir = 'F') AS forward, count(*) FILTER (dir = 'R') AS reverse FROM en WHERE bases <> '' GROUP BY ALL)",
        """ew AS (SELECT ed.smer, ed.side, ed.bases, ed.target, linked, x.forward, x.reverse, coalesce(CASE WHEN linked > 0 THEN x.forward = y.forward AND x.reverse = y.reverse
       ELSE x.forward = y.reverse AND x.reverse = y.forward END, false) AS agrees
       FROM ed JOIN wd x ON ed.smer = x.smer AND ed.side = x.side AND ed.bases = x.bases LEFT JOIN wd y ON ed.target = y.smer AND ed.far_side = y.side AND ed.far_bases = y.bases)""",
        "ro AS (SELECT smer, dir, up_tail, down_tail, count(*) AS width FROM st GROUP BY ALL)",
        _doubled("u", "up_tail", "lag"),
        _doubled("d", "down_tail", "lead"),
        f"ky AS (SELECT st.*, u.r AS hist, d.r AS fut FROM st JOIN u{_LEVELS} u ON st.read_id = u.read_id AND st.ord = u.ord JOIN d{_LEVELS} d ON st.read_id = d.read_id AND st.ord = d.ord)",
        """po AS MATERIALIZED (SELECT read_id, ord, pos, smer, dir, up_tail, down_tail, row_number() OVER (PARTITION BY smer, dir ORDER BY hist, fut, read_id, ord) - 1 AS node_pos,
       row_number() OVER (PARTITION BY smer, dir, up_tail ORDER BY hist, fut, read_id, ord) - 1 AS up_pos,
       row_number() OVER (PARTITION BY smer, dir, down_tail ORDER BY hist, fut, read_id, ord) - 1 AS down_pos FROM ky)""",
        "ch AS (SELECT *, CASE WHEN up_tail IS DISTINCT FROM lag(up_tail) OVER w OR down_tail IS DISTINCT FROM lag(down_tail) OVER w THEN 1 ELSE 0 END AS new FROM po WINDOW w AS (PARTITION BY smer, dir ORDER BY node_pos))",
        "rn AS (SELECT *, sum(new) OVER (PARTITION BY smer, dir ORDER BY node_pos) - 1 AS run FROM ch)",
        "ru AS (SELECT smer, dir, run::BIGINT AS run, up_tail, down_tail, count(*) AS width, min(node_pos) AS node_pos, min(up_pos) AS up_pos, min(down_pos) AS down_pos FROM rn GROUP BY ALL)",
        "en0 AS (SELECT read_id, max(ord) AS last, (max(ord) + 1) // 2 AS mid FROM po GROUP BY read_id)",
        f"ta AS (SELECT smer, dir, node_pos, 't' || po.read_id AS tag FROM po JOIN en0 ON po.read_id = en0.read_id AND ord = last JOIN documents ON doc_id = po.read_id WHERE lang IS NOT NULL)",
        """fr AS (SELECT read_id, i AS fragment_id, i * 1000 AS start_pos, least(l, i * 1000 + 1050) AS end_pos FROM
       (SELECT read_id, length(seq) AS l, unnest(range(0, greatest(0, CAST(floor((length(seq) - 50) / 1000.0) AS BIGINT)) + 1)) AS i FROM reads WHERE length(seq) >= 40))""",
        "qu AS (SELECT read_id, seq, translate(seq, 'ACGT', '!%)-') AS qual FROM reads)",
        "qc AS (SELECT unnest(string_split(qual, '')) AS ch FROM qu WHERE qual <> '')",
        "qh AS (SELECT ascii(ch) - 33 AS q, count(*) AS n FROM qc GROUP BY ALL)",
    ]
    return "WITH " + ",\n".join(tables) + "\n" + select


def _sql_ends(tail: str, forward_side: str) -> str:
    other = "P" if forward_side == "S" else "S"
    return _sql(f"SELECT po.smer, po.dir, node_pos, coalesce(idx, 0) AS idx FROM po LEFT JOIN tt ON po.smer = tt.smer AND tt.bases = po.{tail} AND tt.side = CASE WHEN dir = 'F' THEN '{forward_side}' ELSE '{other}' END WHERE po.{tail} = '' OR linked = 0")


def _side(upstream: bool, table: str = "po") -> str:
    a, b = ("P", "S") if upstream else ("S", "P")
    return f"CASE WHEN {table}.dir = 'F' THEN '{a}' ELSE '{b}' END"


_INDEX = "SELECT source, read_id AS sequence, fragment_id, start_pos, end_pos FROM fr JOIN documents ON read_id = doc_id"
_OWN = f"CASE WHEN dir = 'F' THEN smer ELSE {_RC('smer')} END"
_FLAT = "SELECT tt.smer, tt.side, idx, tt.bases, target, linked, forward, reverse FROM tt JOIN wd ON tt.smer = wd.smer AND tt.side = wd.side AND tt.bases = wd.bases"

ORACLES = {
    "seq_reads": _sql("SELECT read_id, seq, length(seq) AS len FROM reads"),
    "seq_reads_filtered": _sql("SELECT read_id, seq, m FROM r"),
    "fasta_runs": """
WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(translate(text, 'acgt', 'ACGT'), '[\\r\\n]', '', 'g'), '[^ACGT]')) AS run,
  unnest(range(0, len(string_split_regex(regexp_replace(translate(text, 'acgt', 'ACGT'), '[\\r\\n]', '', 'g'), '[^ACGT]')))) AS i FROM documents),
q AS (SELECT doc_id, coalesce(sum(length(run) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos, length(run) AS len FROM p)
SELECT * FROM q WHERE len >= 2""",
    "fasta_fragments": _sql("SELECT * FROM fr"),
    "kmers": _sql("SELECT read_id, pos, kmer FROM k"),
    "canonical_kmers": _sql("SELECT smer, count(*) AS n FROM c GROUP BY smer"),
    "kmer_orientation": _sql("SELECT read_id, count(*) FILTER (rc) AS reversed, count(*) AS n FROM c GROUP BY read_id"),
    "kmer_both_strands": _sql(f"SELECT read_id, pos, kmer, {_RC('kmer')} AS other FROM k"),
    "smer_pack": _sql(f"SELECT smer, {_PACK('smer')} AS smer_id FROM n"),
    "smer_unpack": _sql("SELECT smer FROM n"),
    "packed_revcomp": _sql(f"SELECT smer, {_PACK(_RC('smer'))} AS rc_id FROM n"),
    "revcomp": _sql(f"SELECT read_id, {_RC('seq')} AS rc FROM reads"),
    "revcomp_any": f"SELECT doc_id, {_RC("regexp_replace(text, '[^ACGT]', 'N', 'g')")} AS rc FROM documents",
    "nodes_grid": _sql("SELECT smer FROM n"),
    "node_count": _sql("SELECT count(*) AS n FROM n"),
    "node_path_counts": _sql("SELECT smer, count(*) AS n FROM h GROUP BY smer"),
    "read_hits": _sql("SELECT read_id, ord, pos, smer, dir FROM h"),
    "hit_gaps": _sql("SELECT gap, count(*) AS n FROM g GROUP BY gap"),
    "max_gap_check": _sql("SELECT max(gap) AS max_gap FROM g"),
    "steps": _sql("SELECT * FROM st"),
    "tails": _sql("SELECT * FROM tl"),
    "tail_targets": _sql("SELECT smer, side, idx, len, bases, target, linked FROM tt"),
    "linking_nodes": _sql(f"SELECT smer, side, idx, CASE WHEN linked = 0 THEN -1 ELSE {_PACK('target')} END AS linking FROM tt"),
    "dangling_tails": _sql("SELECT smer, side, bases FROM tt WHERE linked = 0"),
    "edges": _sql("SELECT * FROM ed"),
    "edge_widths": _sql("SELECT * FROM ew"),
    "edge_symmetry_check": _sql("SELECT count(*) AS n_edges, count(*) FILTER (NOT agrees) AS violations FROM ew"),
    "graph_checks": _sql(f"""SELECT 'tail_without_node' AS "check", count(*) AS violations FROM tl WHERE smer NOT IN (SELECT smer FROM n)
UNION ALL SELECT 'tail_twice', count(*) FROM (SELECT smer, side, bases FROM tl GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'route_without_tail', count(*) FROM (SELECT smer, side, bases FROM en WHERE bases <> '' EXCEPT SELECT smer, side, bases FROM tl)
UNION ALL SELECT 'edge_without_far_tail', count(*) FROM (SELECT target, far_side, far_bases FROM ed EXCEPT SELECT smer, side, bases FROM tl)
UNION ALL SELECT 'edge_width', count(*) FROM ew WHERE NOT agrees"""),
    "routes_agg": _sql("SELECT * FROM ro"),
    "total_routes": _sql("SELECT smer, sum(width)::BIGINT AS total FROM ro GROUP BY smer"),
    "node_stats": _sql("""SELECT n.smer, coalesce(prefix_tails, 0) AS prefix_tails, coalesce(suffix_tails, 0) AS suffix_tails, entries, forward_entries, reverse_entries, forward_routes, reverse_routes
FROM n JOIN (SELECT smer, count(*) AS entries, count(*) FILTER (dir = 'F') AS forward_entries, count(*) FILTER (dir = 'R') AS reverse_entries,
  coalesce(sum(width) FILTER (dir = 'F'), 0)::BIGINT AS forward_routes, coalesce(sum(width) FILTER (dir = 'R'), 0)::BIGINT AS reverse_routes FROM ru GROUP BY smer) w ON n.smer = w.smer
LEFT JOIN (SELECT smer, count(*) FILTER (side = 'P') AS prefix_tails, count(*) FILTER (side = 'S') AS suffix_tails FROM tl GROUP BY smer) t ON w.smer = t.smer"""),
    "route_positions": _sql("SELECT read_id, ord, smer, dir, node_pos, up_pos, down_pos FROM po"),
    "route_runs": _sql("SELECT smer, dir, run, up_tail, down_tail, width FROM ru"),
    "route_offsets": _sql("SELECT smer, dir, run, node_pos, up_pos, down_pos FROM ru"),
    "sequence_starts": _sql_ends("up_tail", "P"),
    "sequence_ends": _sql_ends("down_tail", "S"),
    "node_contexts": _sql(f"SELECT smer, dir, {_side(True)} AS side, up_tail AS bases, up_pos AS edge_pos, node_pos FROM po"),
    "spanning_contexts": _sql("""SELECT smer, dir, node_pos, CASE WHEN dir = 'F' THEN up_tail ELSE down_tail END AS prefix, CASE WHEN dir = 'F' THEN up_pos ELSE down_pos END AS prefix_pos,
CASE WHEN dir = 'F' THEN down_tail ELSE up_tail END AS suffix, CASE WHEN dir = 'F' THEN down_pos ELSE up_pos END AS suffix_pos FROM po"""),
    "node_transitions": _sql(f"SELECT smer, dir, node_pos AS asked_pos, up_tail AS from_bases, {_side(False)} AS side, down_tail AS bases, down_pos AS edge_pos FROM po"),
    "edge_transitions": _sql(f"""SELECT p.smer AS from_node, p.dir AS from_dir, p.node_pos AS asked_pos, x.smer, x.dir, {_side(True, 'x')} AS side, x.up_tail AS bases, x.up_pos AS edge_pos
FROM po p JOIN po x ON p.read_id = x.read_id AND x.ord = p.ord + 1"""),
    "context_sequences": _sql(f"SELECT smer, dir, node_pos, {_RC('up_tail')} || {_OWN} AS seq FROM po"),
    "followed_reads": _sql(f"""SELECT po.read_id AS asked_id, (last - mid + 1)::INT AS steps, {_RC('up_tail')} || substr(seq, pos + 1) AS seq, CASE WHEN lang IS NOT NULL THEN 't' || po.read_id END AS tag
FROM po JOIN en0 ON po.read_id = en0.read_id AND ord = mid JOIN r ON r.read_id = po.read_id JOIN documents ON doc_id = po.read_id"""),
    "followed_upstream": _sql(f"""SELECT po.read_id AS asked_id, count(*)::INT AS steps, string_agg({_RC('up_tail')}, '-' ORDER BY ord DESC) AS seq
FROM po JOIN en0 ON po.read_id = en0.read_id AND ord <= mid GROUP BY po.read_id"""),
    "followed_once": _sql(f"""SELECT po.read_id AS asked_id, smer, dir, {_side(True)} AS side, up_tail AS bases, up_pos AS edge_pos, true AS returns
FROM po JOIN en0 ON po.read_id = en0.read_id AND ord = mid + 1"""),
    "linked_smers_flat": _sql(_FLAT),
    "linked_smer_limited": _sql(f"""SELECT t.smer, total, routes FROM (SELECT smer, sum(width)::BIGINT AS total FROM ru GROUP BY smer) t LEFT JOIN (
  SELECT ru.smer, string_agg(ru.dir || ':' || coalesce(CASE WHEN ru.dir = 'F' THEN a.idx ELSE b.idx END, 0) || ':' || coalesce(CASE WHEN ru.dir = 'F' THEN b.idx ELSE a.idx END, 0) || ':' || width, ',' ORDER BY ru.dir, run) AS routes
  FROM ru LEFT JOIN tl a ON a.smer = ru.smer AND a.bases = up_tail AND a.side = {_side(True, 'ru')} LEFT JOIN tl b ON b.smer = ru.smer AND b.bases = down_tail AND b.side = {_side(False, 'ru')}
  GROUP BY ru.smer HAVING sum(width) <= 20) l ON t.smer = l.smer"""),
    "read_walks": _sql("SELECT seq FROM r"),
    "read_walk_tags": _sql("SELECT * FROM ta"),
    "tag_lookup": _sql(f"""SELECT po.smer, po.dir, po.node_pos, tag FROM po JOIN ta ON po.smer = ta.smer AND po.dir = ta.dir AND po.node_pos = ta.node_pos
LEFT JOIN tt ON po.smer = tt.smer AND tt.bases = po.up_tail AND tt.side = {_side(True)} WHERE po.up_tail = '' OR linked = 0"""),
    "tag_counts": _sql("SELECT count(*) AS reads, count(*) FILTER (lang IS NOT NULL) AS with_tag, count(*) FILTER (lang IS NULL) AS without_tag FROM r JOIN documents ON doc_id = read_id"),
    "sequence_index": _sql(_INDEX),
    "sequence_index_summary": _sql(f"SELECT source, count(DISTINCT sequence) AS sequences, count(*) AS fragments, max(end_pos) AS longest FROM ({_INDEX}) GROUP BY source"),
    "map_reads_to_nodes": _sql(f"""SELECT read_id, pos, smer, CASE WHEN kmer = smer THEN 'F' ELSE 'R' END AS dir FROM (
  SELECT read_id, pos, substr(q, pos + 1, 23) AS kmer, least(substr(q, pos + 1, 23), {_RC("substr(q, pos + 1, 23)")}) AS smer
  FROM (SELECT item_id AS read_id, q, unnest(range(0, length(q) - 22)) AS pos FROM (SELECT item_id, {_DNA} AS q FROM benchmark) WHERE length(q) >= 40)) WHERE smer IN (SELECT smer FROM n)"""),
    "fastq_text": _sql("SELECT read_id, '@r' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qual || chr(10) AS record FROM qu", _SHORT),
    "quality_ints": _sql("SELECT read_id, CASE WHEN qual = '' THEN '' ELSE list_aggregate(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33), 'string_agg', ',') END AS q FROM qu", _SHORT),
    "quality_masked": _sql("SELECT read_id, CASE WHEN qual = '' THEN '' ELSE list_aggregate(list_transform(range(1, length(qual) + 1), lambda i: CASE WHEN substr(seq, i, 2) = 'AC' THEN 0 ELSE ascii(substr(qual, i, 1)) - 33 END), 'string_agg', ',') END AS q FROM qu", _SHORT),
    "quality_histogram": _sql("SELECT q, n FROM qh", _SHORT),
    "phred_offset": _sql("""SELECT low, high, CASE WHEN low > 0 AND high = 0 THEN 33 WHEN high > 0 AND low = 0 THEN 64 ELSE 0 END AS "offset" FROM (
  SELECT coalesce(sum(n) FILTER (q + 33 BETWEEN 33 AND 58), 0)::BIGINT AS low, coalesce(sum(n) FILTER (q + 33 BETWEEN 80 AND 104), 0)::BIGINT AS high FROM qh)""", _SHORT),
    "graph_roundtrip": _sql("""SELECT 'nodes' AS part, count(*) AS n, count(*) AS total FROM n
UNION ALL SELECT 'tails', (SELECT count(*) FROM tl), (SELECT count(*) FROM en WHERE bases <> '')
UNION ALL SELECT 'routes', count(*), sum(width)::BIGINT FROM ru UNION ALL SELECT 'tags', count(*), sum(length(tag))::BIGINT FROM ta UNION ALL SELECT 'walks', count(*), sum(length(seq))::BIGINT FROM r"""),
}
