"""Building, saving, loading and asking a graph.

A routed graph is five tables, from which every read can be walked again without the reads:

    nodes      node
    tails      node, side, idx, len, bases, forward, reverse, target, linked
    routes     node, dir, run, up_tail, down_tail, width, node_pos, up_pos, down_pos   (runs of equal routes, in order)
    tags       node, dir, node_pos, tag                                                (at the last route of a read)
    sequences  source, sequence, fragment_id, start_pos, end_pos

In index mode it has nodes (and sequences) only. `node` is a packed k-mer; `smer` spells it out.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequences import pack, unpack
from .operators import graph as G
from .operators import packed_tails as T
from .operators import retrieval as R
from .operators import routing as W
from .operators.lineage import cut, dropped, freed
from .operators.packed_routes import PackedOrder
from .operators.packed_walks import walks as packed_walks


@dataclass(frozen=True)
class GraphConfig:
    k: int = 23
    sparseness: int = 23
    min_length: int = G.MIN_LENGTH

    def __post_init__(self):
        if self.k % 2 == 0 or not 3 <= self.k <= 31:
            raise ValueError("k must be odd, from 3 to 31")
        if not 1 <= self.sparseness <= self.k:
            raise ValueError("sparseness must be from 1 to k, so that a node's tails reach the next node")


class Tables(dict):
    """Tables by name. One that is given as a function is computed when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        held = super().__getitem__(name)
        if not isinstance(held, DataFrame):
            self[name] = held = held()
        return held

    def items(self):
        return [(name, self[name]) for name in self]

    def values(self):
        return [self[name] for name in self]


class Graph:
    INDEX, TABLES = ("nodes", "sequences"), ("nodes", "tails", "routes", "tags", "sequences")

    def __init__(self, tables: dict[str, DataFrame], config: GraphConfig | None = None):
        self.tables, self.config = Tables(tables), config or GraphConfig()
        self.sources = None  # the reads and nodes that tables are found from when asked for
        self.tagged = None  # the tags of reads, likewise
        self.order = None  # what finds the order of routes, in a graph that was built and not loaded

    def __getattr__(self, name: str) -> DataFrame:
        if name in Graph.TABLES:
            if name not in self.tables:
                raise RuntimeError(f"{name} need a routed graph; this one is in index mode")
            return self.tables[name]
        raise AttributeError(name)

    @staticmethod
    def _sequences(reads: DataFrame) -> dict[str, DataFrame]:
        """The index of sequences, of reads that come from files."""
        wanted = ["source", "sequence", "fragment_id", "start_pos"]
        if not set(wanted) <= set(reads.columns):
            return {}
        return {"sequences": cut(reads.select(*wanted, (F.col("start_pos") + F.length("seq")).cast("long").alias("end_pos")), "sequences")}

    @staticmethod
    def index(reads: DataFrame, policy: str = "grid", config: GraphConfig | None = None) -> Graph:
        config = config or GraphConfig()
        choose = {"grid": G.nodes_grid, "rounds": G.nodes_rounds, "sequential": G.nodes_sequential}
        used = G.filtered(reads, config.min_length, config.k)
        nodes = choose[policy](used, k=config.k, sparseness=config.sparseness)
        return Graph({"nodes": cut(nodes, "nodes")} | Graph._sequences(reads), config)

    def route(self, reads: DataFrame) -> Graph:
        """The graph with tails, routes and, if the reads have a column tag, tags."""
        k = self.config.k
        used = G.filtered(reads, self.config.min_length, k)
        walked = cut(G.steps(used, self.nodes, k), "steps")
        ordered = W.Ordered(walked)
        tables = {"nodes": self.nodes, "tails": cut(G.tail_targets(G.tails(walked), self.nodes, k), "tails"), "routes": cut(ordered.runs(), "runs")}
        if "tag" in reads.columns:
            tables["tags"] = cut(ordered.tags(reads.where("tag is not null").select("read_id", "tag")), "tags")
        else:
            tables["tags"] = reads.sparkSession.createDataFrame([], "node long, dir string, node_pos long, tag string")
        if "sequences" in self.tables:
            tables["sequences"] = self.tables["sequences"]
        out = Graph(tables, self.config)
        out.order = lambda: ordered
        return out

    @staticmethod
    def build(reads: DataFrame, policy: str = "grid", config: GraphConfig | None = None, again: bool = False) -> Graph:
        """index and route. Reads of which no tail is longer than a number holds are routed in arrays, and tables are found when asked for.
        again: the reads are the same, and cheap, each time they are computed, so they aren't kept."""
        graph = Graph.index(reads, policy, config)
        k = graph.config.k
        if graph.config.sparseness > T.MOST:
            return graph.route(reads)
        used = G.filtered(reads, graph.config.min_length, k)
        used = used if again else cut(used, "reads")
        nodes = graph.nodes
        graph.sources = used, nodes
        graph.order = lambda: PackedOrder(used, nodes, k)
        tables = {"tails": lambda: cut(T.tails(used, nodes, k), "tails"), "routes": lambda: cut(graph.ordered.runs(), "runs")}
        if "tag" in reads.columns:
            graph.tagged = used.where("tag is not null").select("read_id", "tag")
            tables["tags"] = lambda: cut(graph.ordered.tags(graph.tagged), "tags")
        else:
            tables["tags"] = reads.sparkSession.createDataFrame([], "node long, dir string, node_pos long, tag string")
        graph.tables = Tables({"nodes": nodes} | tables | {n: graph.tables[n] for n in ("sequences",) if n in graph.tables})
        return graph

    @property
    def unasked(self) -> tuple[DataFrame, DataFrame] | None:
        """Reads and nodes of a graph whose tails and routes are still to be computed."""
        return None if any(isinstance(dict.get(self.tables, n), DataFrame) for n in ("tails", "routes")) else self.sources

    def smers(self) -> DataFrame:
        """(node, smer): the nodes and their bases."""
        return self.nodes.select("node", unpack(F.col("node"), self.config.k).alias("smer"))

    @cached_property
    def ordered(self) -> PackedOrder | W.Ordered | None:
        """The order of routes with the reads' ids, which the tables don't have."""
        return self.order and self.order()

    @property
    def packed(self) -> PackedOrder | None:
        """The order of routes, if it answers questions to all routes in one pass."""
        return self.ordered if isinstance(self.ordered, PackedOrder) else None

    @property
    def each(self) -> DataFrame:
        """Every route by itself, for questions that read them once."""
        return self.packed.each() if self.packed else self.positions

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges(self.tails, self.config.k)

    @cached_property
    def positions(self) -> DataFrame:
        """Every route by itself."""
        return W.positions_of(self.routes)

    @cached_property
    def trace(self) -> DataFrame:
        """The first route of each route's read, and the steps between; found once."""
        return W.traced(cut(self.positions, "positions"), self.config.k)

    def linked_smers(self, smer: str | None = None) -> DataFrame:
        """(node, smer, side, idx, len, bases, forward, reverse, target, linked): of all nodes, or of one. A node without
        tails is one row without a side; what is no node has no row."""
        some = self.smers() if smer is None else self.smers().where(F.col("node") == pack(F.lit(smer)))
        return some.join(self.tails, "node", "left")

    def linked_routes(self, limit: int) -> DataFrame:
        """(node, total, routes): the routes of nodes with at most `limit` of them."""
        return self.packed.route_lists(limit) if self.packed else R.route_lists(self.routes, self.tails, limit)

    def contexts(self, upstream: bool = True) -> DataFrame:
        return R.contexts(self.each, upstream)

    def spanning_contexts(self) -> DataFrame:
        return R.spanning_contexts(self.each)

    def end_contexts(self, start: bool = True, end: bool = True) -> DataFrame:
        return self.packed.end_contexts(start, end) if self.packed else R.end_contexts(self.positions, self.tails, start, end)

    def across_node(self, contexts: DataFrame, downstream: bool = True) -> DataFrame:
        return R.across_node(contexts, self.positions, downstream)

    def transitions(self) -> DataFrame:
        """The contexts of all routes moved over their nodes."""
        return R.transitions(self.each)

    def edge_transitions(self) -> DataFrame:
        """The contexts of all routes at their tails after, moved along these: (from_node, from_dir, asked_pos, node, dir, side, bases, edge_pos)."""
        if self.packed:
            return self.packed.across_edges()
        asked = self.contexts(False).withColumnRenamed("node_pos", "asked_pos").withColumn("from_node", F.col("node")).withColumn("from_dir", F.col("dir"))
        return self.to_linking_edge(asked).select("from_node", "from_dir", "asked_pos", "node", "dir", "side", "bases", "edge_pos")

    def to_linking_edge(self, contexts: DataFrame) -> DataFrame:
        return R.to_linking_edge(contexts, self.edges)

    def extract(self, contexts: DataFrame, with_node: bool = False) -> DataFrame:
        return R.extracted(contexts, with_node, self.config.k)

    def context_sequences(self) -> DataFrame:
        """The contexts of all routes with the bases of tail and node: (node, dir, node_pos, seq)."""
        if self.packed:
            return self.packed.sequences()
        return self.extract(self.contexts(), True).select("node", "dir", "node_pos", "seq")

    def tag_data(self, contexts: DataFrame) -> DataFrame:
        """Contexts at tails that reads come in by, with the tag of their route (null: none)."""
        return contexts.drop("node_pos").join(self.contexts(), R.CONTEXT).join(self.tags, ["node", "dir", "node_pos"], "left")

    def follow(self, contexts: DataFrame, most: int = R.DOWN_STEPS) -> DataFrame:
        return R.followed(contexts, self.positions, self.trace, self.tags, most)

    def follow_upstream(self, contexts: DataFrame, most: int = R.UP_STEPS) -> DataFrame:
        if self.packed and dict(contexts.dtypes)["asked_id"] == "bigint":
            return self.packed.followed_upstream(contexts, most)
        return R.followed_upstream(contexts, self.positions, self.trace, most)

    def follow_once(self, contexts: DataFrame) -> DataFrame:
        if self.packed and dict(contexts.dtypes)["asked_id"] == "bigint":
            return self.packed.followed_once(contexts)
        return R.followed_once(contexts, self.positions, self.edges)

    def walks(self) -> DataFrame:
        """(node, dir, node_pos, steps, seq): all reads, walked again."""
        walked = packed_walks(self.routes, self.nodes.count(), self.config.k)
        return W.walks(self.positions, self.trace, self.config.k) if walked is None else walked

    def tag_counts(self) -> DataFrame:
        """(reads, with_tag, without_tag): reads that can be walked, and how many of them end at a tag."""
        if not self.packed:
            return R.tag_counts(self.trace, self.tags)
        held = self.tags.select("node", "dir", "node_pos").distinct().agg(F.count("*").alias("with_tag"))  # the last route of each read
        return self.packed.reads().join(F.broadcast(held)).select("reads", "with_tag", (F.col("reads") - F.col("with_tag")).alias("without_tag"))

    def validate(self) -> DataFrame:
        """(check, violations). Of a built graph whose tables nobody has asked for, in arrays and from the reads; else of the tables."""
        if self.unasked:
            return T.checks(*self.unasked, self.config.k)
        return R.validation(self.tails, self.edges, self.routes, self.nodes)

    def stats(self) -> DataFrame:
        """A row for each node: its tails, routes and runs."""
        if self.packed:
            return self.packed.stats()  # each node lies on a read that it was chosen for
        n = lambda c, x: F.sum((F.col(c) == x).cast("long"))
        held = self.tails.groupBy("node").agg(n("side", "P").alias("prefix_tails"), n("side", "S").alias("suffix_tails"))
        wide = lambda d: F.sum(F.when(F.col("dir") == d, F.col("width")).otherwise(0))
        ways = self.routes.groupBy("node").agg(F.count("*").alias("entries"), n("dir", "F").alias("forward_entries"), n("dir", "R").alias("reverse_entries"), wide("F").alias("forward_routes"), wide("R").alias("reverse_routes"))
        return self.smers().join(held, "node", "left").join(ways, "node", "left").drop("node").na.fill(0)

    def save(self, path: str, mode: str = "error", last: bool = False) -> None:
        """Each table in a folder of its own, sorted by node within files, and the parameters. Files of tails and routes that are found for
        this lie by parts of nodes, those of tables that are there by stretches of nodes. Tables that were
        loaded from this path are left as they are, so that nothing is written over what it is read from. last: a built graph is asked
        nothing else, so what it is found from is removed as soon as it isn't needed."""
        spark, made, placed = self.nodes.sparkSession, None, None
        unasked = self.unasked is not None
        for name in self.tables:
            found = unasked and name in ("tails", "routes", *(["tags"] if self.tagged is not None else []))
            if found and made is None:
                made, placed = self.packed.tables(self.tagged, last)
            df = made[name] if found else self.tables[name]
            if any(f"{path.rstrip('/')}/{name}/" in f for f in df.inputFiles()[:1]):
                continue
            if "node" in df.columns:
                order = ["node", *[c for c in ("side", "dir", "idx", "run") if c in df.columns]]
                df = (df if found else df.repartitionByRange(*order)).sortWithinPartitions(*order)
            df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")
        if placed is not None:
            dropped(placed, *[self.nodes] * last)
            freed(spark)
        spark.createDataFrame([asdict(self.config)]).coalesce(1).write.mode("overwrite").json(f"{path}/config")

    def save_stats(self, path: str) -> None:
        """stats as tab-separated text."""
        self.stats().write.option("sep", "\t").option("header", True).csv(path)

    @staticmethod
    def load(spark: SparkSession, path: str, routed: bool | None = None) -> Graph:
        """The tables at the path; routed: False for those of index mode only, None for whatever is there."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [n for n in (Graph.INDEX if routed is False else Graph.TABLES) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))]
        if "nodes" not in there or (routed and "routes" not in there):
            raise FileNotFoundError(f"no {'routed ' if routed else ''}graph at {path}")
        given = spark.read.schema("k int, sparseness int, min_length int").json(f"{path}/config").first()
        return Graph({n: spark.read.parquet(f"{path}/{n}") for n in there}, GraphConfig(**given.asDict()))
