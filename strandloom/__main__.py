"""python -m strandloom {index,route,index-and-route,read} GRAPH [FILE ...]

index writes nodes and the index of sequences. route reads the nodes of GRAPH, leaves them alone and adds tails, routes and tags
(an earlier routing is replaced). index-and-route does both. read prints the sizes of a saved graph of either kind.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .graph import Graph, GraphConfig
from .sources.reads import read_sequences, with_read_id


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandloom", description="Build and read routed sequence graphs.")
    parser.add_argument("command", choices=["index", "route", "index-and-route", "read"])
    parser.add_argument("graph")
    parser.add_argument("files", nargs="*")
    parser.add_argument("--policy", choices=["grid", "rounds", "sequential"], default="grid")
    parser.add_argument("--k", type=int, default=23)
    parser.add_argument("--sparseness", type=int, default=23)
    parser.add_argument("--min-length", type=int, default=40)
    parser.add_argument("--skip", type=int, default=0, help="valid records of each file to pass over")
    parser.add_argument("--use", type=int, help="valid records of each file to use after those")
    parser.add_argument("--stats", help="folder for a row of statistics a node, tab-separated")
    parser.add_argument("--no-save", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if given.command == "read":
        graph = Graph.load(spark, given.graph)
    else:
        if not given.files:
            parser.error("sequence files are needed")
        if given.command == "route":
            graph = Graph.load(spark, given.graph, routed=False)
            config = graph.config
        else:
            config = GraphConfig(given.k, given.sparseness, given.min_length)
        reads = with_read_id(read_sequences(spark, given.files, config.min_length, given.skip, given.use))
        if given.command != "route":
            graph = Graph.index(reads, given.policy, config)
        if given.command != "index":
            graph = graph.route(reads)
        if not given.no_save:
            graph.save(given.graph, "overwrite")
    if given.stats:
        graph.save_stats(given.stats)
    for name, df in graph.tables.items():
        print(name, df.count())


if __name__ == "__main__":
    main()
