"""Command line: spark-submit this module with a sequence file."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import SparkSession

from strandgraph.jobs.build import build
from strandgraph.jobs.config import GraphConfig
from strandgraph.sources import sequences

log = logging.getLogger("strandgraph")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandgraph", description="Edit-distance graph of the reads in a sequence file.")
    out.add_argument("-i", "--input", required=True, help="FASTA, FASTQ or Parquet: a file, a folder or a pattern")
    out.add_argument("-o", "--output", required=True, help="folder for the vertex and edge tables")
    out.add_argument("--save-graph", action="store_true", help="also write a Graphviz file")
    out.add_argument("--version", action="version", version="1.0")
    for f in fields(GraphConfig):
        kind = type(f.default) if f.default is not None else int
        name = "--" + f.name.replace("_", "-")
        if kind is bool:
            out.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            out.add_argument(name, type=kind, default=f.default)
    return out


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    config = GraphConfig(**{f.name: args[f.name] for f in fields(GraphConfig)})
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("strandgraph").getOrCreate()
    made = build(sequences.read_sequences(spark, args["input"], config.on_bad), config)
    sequences.write_tables(made.vertices, made.edges, args["output"])
    log.info("unique reads %(n_unique)d, shortest %(min_length)d, of unusual length %(n_out_of_range)d", made.metrics)
    made.stages.coalesce(1).write.csv(f"{args['output']}/stages", sep="\t", header=True)
    for row in spark.read.csv(f"{args['output']}/stages", sep="\t", header=True).collect():
        log.info("%s: %s %s", row["stage"], row["measure"], row["n"])
    if args["save_graph"]:
        sequences.write_dot(made.vertices, made.edges, f"{args['output']}/graph.dot")


if __name__ == "__main__":
    main()
