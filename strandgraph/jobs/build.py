"""Edit-distance graphs in five modes.

All modes verify with the real edit distance, so a bucketing mode changes only which edges are found. Small buckets are
joined with themselves. Where their pairs would be many more than the reads, all edges within the range are made
by the exact search instead and kept where a bucket holds them: the same edges, without the squares of the buckets' sizes.
Of short reads one search serves all stages, unless a stage has to walk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import kmers, params
from strandgraph.jobs.config import GraphConfig
from strandgraph.operators import buckets as scheme
from strandgraph.operators import graph, pairs, reads
from strandgraph.operators.storage import stored


@dataclass(frozen=True)
class EditGraph:
    """vertices (vid, seq, cnt), edges (src, dst, weight) with src < dst, counts of the reads, and what each stage
    counted: stages (stage, measure, n)."""

    vertices: DataFrame
    edges: DataFrame
    metrics: dict[str, int]
    stages: DataFrame


def _edge_counts(stage: str, edges: DataFrame) -> DataFrame:
    """Edges after a stage, by weight and in all."""
    weight = F.coalesce(F.col("weight").cast("string"), F.lit("any"))
    counted = graph.summary(edges)
    return counted.select(F.lit(stage).alias("stage"), F.concat(F.lit("edges of weight "), weight).alias("measure"), "n")


def _edge_counts_at_once(found: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``_edge_counts`` of several stages, each given by a test of the rows (weight, kept), from one pass over them."""
    told = found.groupBy("weight", "kept").agg(F.count("*").alias("n"))
    stage = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))))
    weight = F.explode(F.array(F.col("weight").cast("string"), F.lit("any")))
    each = told.select("weight", "n", stage.alias("stage")).select("stage", "n", weight.alias("weight"))
    return each.groupBy("stage", F.concat(F.lit("edges of weight "), "weight").alias("measure")).agg(F.sum("n").alias("n"))


def _bucket_counts(stage: str, buckets: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Buckets of a stage: all, those of one read, and normal and large ones."""
    return _size_counts(stage, scheme.sizes(buckets, by), most)


def _size_counts(stage: str, sizes: DataFrame, most: int) -> DataFrame:
    size = F.col("size")
    kinds = {"buckets": F.lit(True), "buckets of one read": size == 1, "normal buckets": (size >= 2) & (size < most), "large buckets": size >= most}
    counted = sizes.agg(*(F.count_if(test).alias(name) for name, test in kinds.items()))
    pairs_of = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(f"`{name}`").alias("n")) for name in kinds))
    return counted.select(F.lit(stage).alias("stage"), F.inline(pairs_of))


def _hash(config: GraphConfig) -> kmers.Hash:
    return kmers.hash_md5 if config.hash_name == "md5" else kmers.hash_fast


def _buckets(vertices: DataFrame, config: GraphConfig, shortest: int) -> DataFrame:
    h = _hash(config)
    if config.mode == "omh":
        return scheme.sketches(vertices, config.omh_k, config.omh_l, [config.seed + i for i in range(config.omh_m)], config.omh_variant, h)
    if config.mode == "miniception":
        return scheme.hashed(vertices, params.Scheme(config.miniception_k, config.miniception_w), config.seed, h)
    given = None if config.default_params else params.Scheme(config.k, config.window, config.segments)
    if config.mode == "minimizer_gomh":
        return scheme.lexicographic(vertices, given or params.lexicographic(shortest, config.alpha, config.ratio, config.segmentation))
    return scheme.hashed(vertices, given or params.hashed(shortest, config.beta, config.n_kmer, config.segmentation), config.seed, h)


def _gapped_plan(config: GraphConfig, shortest: int) -> tuple[list[tuple[int, int]], bool]:
    if config.default_params:
        chosen = params.seeds(shortest, config.max_distance, config.seed, config.gapped_k, config.probability, config.gapped_times)
    else:
        chosen = [(s, config.gapped_k) for s, _ in params.seeds(50, config.max_distance, config.seed, times=config.gapped_times or 3)]
    return chosen, params.take_all_gapped(shortest, chosen)


def routed(sub: DataFrame, most: int, routing: str) -> tuple[DataFrame, DataFrame]:
    """Sub-bucket rows (parent, key, vid) for pairwise comparison, and those for traversal.

    routing "buckets": by how many sub-buckets the parent has; one alone is dropped. "size": by each one's size.
    """
    by = ["parent"] if routing == "buckets" else ["parent", "key"]
    count = F.countDistinct("key") if routing == "buckets" else F.count("*")
    n = sub.groupBy(*by).agg(count.alias("n"))
    few = n.where((F.col("n") >= 2) & (F.col("n") < most)).select(*by)
    many = n.where(F.col("n") >= most).select(*by)
    return sub.hint("merge").join(few, by, "left_semi"), sub.hint("merge").join(many, by, "left_semi")


def refined(every: Callable[[], DataFrame], vertices: DataFrame, edges: DataFrame, sub: DataFrame, config: GraphConfig) -> DataFrame:
    """``edges`` with what the sub-buckets add: pairs that share one, and pairs that a bounded traversal connects."""
    near, far = routed(sub, config.bin_size_max, config.routing)
    found = pairs.among(stored(near, "near"), vertices, 1, config.max_distance, every, ["parent", "key"])
    edges = stored(graph.inserted(edges, found), "edges")
    sources = stored(far.select("vid").distinct(), "sources")
    if sources.limit(1).count() == 0:
        return edges
    # only what is within the distance and no edge yet can be added, so only that is looked for in the graph
    missing = stored(every().hint("merge").join(edges, ["src", "dst"], "left_anti"), "missing")
    asked = reduce(DataFrame.union, (missing.hint("merge").join(sources.withColumnRenamed("vid", end), end, "left_semi").select("src", "dst") for end in ("src", "dst")))
    met = graph.connected(asked, edges, config.visit_depth)
    return stored(graph.inserted(edges, missing.hint("merge").join(met, ["src", "dst"], "left_semi")), "edges")


def in_lists(every: Callable[[], DataFrame], vertices: DataFrame, edges: DataFrame, parents: DataFrame, chosen: list[tuple[int, int]], gapped: bool, config: GraphConfig) -> tuple[DataFrame, DataFrame] | None:
    """What ``refined`` adds, and the sizes of the sub-buckets, without a row for each read of a sub-bucket; none where there are few
    pairs to compare, or a stage has to walk.

    Sub-buckets are a bucket's gapped keys, and a read's gapped keys are the same in every bucket. So they are counted from
    lists, and an edge is in one if its ends share a bucket and a gapped key.
    """
    keys = scheme.gapped(vertices, chosen, True, _hash(config)).groupBy("vid").agg(F.collect_set("key").alias("keys")) if gapped else scheme.gapped_lists(vertices.select("vid", "seq"), chosen, _hash(config)).select("vid", "keys")
    own = parents.groupBy("vid").agg(F.collect_set("parent").alias("parents"))
    listed = stored(own.hint("merge").join(keys.hint("merge"), "vid"), "lists")
    sizes = stored(scheme.sub_bucket_sizes(listed), "sizes")
    told = sizes.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("pairs"), F.sum("size").alias("rows")).first()
    n = sizes.groupBy("parent").agg(F.count("*").alias("n"))
    if (told["pairs"] or 0) <= pairs.PAIRS_A_READ * max(1, told["rows"] or 0) or n.where(F.col("n") >= config.bin_size_max).limit(1).count():
        return None
    found = pairs.in_sub_buckets(every(), listed, stored(n.where("n >= 2").select("parent"), "routes"))
    return stored(graph.inserted(edges, found), "edges"), sizes


def without_walks(vertices: DataFrame, normal: DataFrame, large: DataFrame, second: bool, chosen: list[tuple[int, int]], gapped: bool, config: GraphConfig) -> tuple[DataFrame, list[DataFrame]] | None:
    """Edges and counts of all stages from one search, for short reads, which have hundreds of edges each; none where a stage has to walk.

    Sub-buckets are a bucket's gapped keys, so two reads share one if they share a bucket and a gapped key. What a stage
    adds is then a matter of which kinds of keys the ends of an edge share, and edges need not be joined with anything.
    Nor are they stored, being many times as many as the reads: whoever reads edges or counts makes the search.
    """
    most, by = config.max_distance, ["parent", "key"]
    own_keys = stored(scheme.gapped(vertices, chosen, gapped, _hash(config)), "gapped")
    stages = {"odd-sized buckets": large.select(F.col("key").alias("parent"), "vid")}
    if second:
        stages["second pass"] = normal.select(F.lit(0).alias("parent"), "vid").distinct()
    names = ["first pass", *stages]
    told, schemes = [], [(normal, ["key"]), (own_keys, ["key"])]
    for stage, parents in stages.items():
        sizes = stored(scheme.sizes(parents.hint("merge").join(own_keys, "vid"), by), "sizes")
        told.append(_size_counts(stage, sizes, config.bin_size_max))
        routes = sizes.groupBy("parent").agg(F.count("*").alias("n"))
        if routes.where(F.col("n") >= config.bin_size_max).limit(1).count():
            return None
        schemes.append((parents.hint("merge").join(routes.where("n >= 2").select("parent"), "parent", "left_semi"), ["parent"]))
    shares = lambda i: F.col("kept").bitwiseAND(F.lit(1 << i)) != 0
    tests = [shares(0)]
    for i in range(2, len(schemes)):
        tests.append(tests[-1] | (shares(1) & shares(i)))
    found = pairs.exact_in(vertices, schemes, 1, most).where(tests[-1])
    in_graph = tests[-1] & (F.col("weight") >= config.min_distance)
    counts = _edge_counts_at_once(found, dict(zip([*names, "graph"], [*tests, in_graph], strict=True)))
    return found.drop("kept"), [counts, *told]


def build(source: DataFrame, config: GraphConfig | None = None) -> EditGraph:
    """The graph of a table of reads with a ``seq`` column.

    Parameters follow the shortest read within the usual lengths. A table without reads gives an empty graph.
    """
    config = config or GraphConfig()
    most = config.max_distance
    kept = reads.check_lengths(source.select("seq"), config.on_bad_length).select("seq")
    vertices = stored(reads.numbered(reads.multiplicity(kept)), "vertices")
    stats = reads.length_stats(vertices).first()
    metrics = {"n_unique": stats["n_unique"], "min_length": stats["min_length"] or 0, "n_out_of_range": stats["n_out_of_range"]}
    shortest = min(max(metrics["min_length"], params.SHORTEST), params.LONGEST)
    told = [vertices.sparkSession.createDataFrame([("reads", name, n) for name, n in metrics.items()], "stage string, measure string, n long")]
    made: list[DataFrame] = []

    def every() -> DataFrame:
        """All edges within the range, made when first asked for."""
        if not made:
            made.append(stored(pairs.exact(vertices, 1, most), "exact"))
        return made[0]

    def finished(edges: DataFrame, counted: bool = False) -> EditGraph:
        if config.min_distance > 1:
            edges = graph.without_weights(edges, 1, config.min_distance - 1)
        return EditGraph(vertices, edges, metrics, reduce(DataFrame.union, told if counted else [*told, _edge_counts("graph", edges)]))

    if config.mode == "brute_force":
        return finished(every())
    buckets = stored(_buckets(vertices, config, shortest), "buckets")
    told.append(_bucket_counts("first pass", buckets, config.bin_size_max, ["key"]))
    if config.mode in ("omh", "miniception"):
        return finished(stored(pairs.among(buckets, vertices, 1, most), "edges"))
    normal, large = (stored(x, "buckets") for x in scheme.split(buckets, config.bin_size_max))
    chosen, gapped = _gapped_plan(config, shortest)
    if shortest < (most + 1) * pairs.SEGMENT_LEAST and config.routing == "buckets" and pairs.many_pairs(buckets):
        at_once = without_walks(vertices, normal, large, shortest < 16, chosen, gapped, config)
        if at_once is not None:
            told.extend(at_once[1])
            return finished(at_once[0], counted=True)
    edges = stored(pairs.among(normal, vertices, 1, most, every), "edges")
    told.append(_edge_counts("first pass", edges))

    def again(stage: str, edges: DataFrame, parents: DataFrame) -> DataFrame:
        if config.routing == "buckets":
            listed = in_lists(every, vertices, edges, parents, chosen, gapped, config)
            if listed is not None:
                told.extend([_size_counts(stage, listed[1], config.bin_size_max), _edge_counts(stage, listed[0])])
                return listed[0]
        sub = stored(scheme.gapped_within(parents, vertices, chosen, gapped, _hash(config)), "sub")
        edges = refined(every, vertices, edges, sub, config)
        told.extend([_bucket_counts(stage, sub, config.bin_size_max, ["parent", "key"]), _edge_counts(stage, edges)])
        return edges

    edges = again("odd-sized buckets", edges, large.select(F.col("key").alias("parent"), "vid"))
    if shortest < 16:
        edges = again("second pass", edges, normal.select(F.lit(0).alias("parent"), "vid").distinct())
    return finished(edges)
