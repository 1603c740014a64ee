"""Named jobs over the star schema's tables. Reads are derived from every order, part or customer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import kmers
from strandgraph.functions.params import Scheme
from strandgraph.jobs.build import EditGraph, build
from strandgraph.jobs.catalog_sql import oracle_sql as oracle_sql
from strandgraph.jobs.config import GraphConfig
from strandgraph.operators import buckets as scheme
from strandgraph.operators import graph, pairs, reads, short
from strandgraph.operators.components import components
from strandgraph.operators.incremental import GrowingGraph
from strandgraph.operators.storage import shared_folder, stored
from strandgraph.sources import fastq, sequences

Query = Callable[[SparkSession, str], DataFrame]
MD5 = kmers.hash_md5
LEX = Scheme(4, 3)


def _copies(based: DataFrame) -> DataFrame:
    """(k, seq) of rows (k, base): four neighbours share a base read, with and without a substitution, a deletion, an insertion."""
    rest = F.length("base")
    tail = lambda at: F.col("base").substr(F.lit(at), rest)
    head = lambda n: F.substring("base", 1, n)
    seq = (
        F.when(F.col("k") % 4 == 0, F.col("base"))
        .when(F.col("k") % 4 == 1, F.concat(head(9), F.translate(F.substring("base", 10, 1), "ACGT", "CGTA"), tail(11)))
        .when(F.col("k") % 4 == 2, F.concat(head(15), tail(17)))
        .otherwise(F.concat(head(5), F.lit("A"), tail(6)))
    )
    return based.select("k", seq.alias("seq"))


def _letters(*parts: Column) -> Column:
    return F.translate(F.concat(*(F.md5(p) for p in parts)), "0123456789abcdef", "ACGTACGTACGTACGT")


def reads_of(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """(k, seq): from each order a read of about ``length`` letters."""
    k = F.col("o_orderkey")
    family = F.floor(k / 4).cast("long").cast("string")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _copies(orders.select(k.alias("k"), F.substring(_letters(family), 1, length).alias("base")))


def mixed_reads(spark: SparkSession, sf_dir: str, shortest: int = 6) -> DataFrame:
    """(k, seq): from each part a read; families have from ``shortest`` to 300 letters."""
    family = F.floor(F.col("p_partkey") / 4).cast("long")
    size = (shortest + family * 37 % (301 - shortest)).cast("int")
    digits = _letters(*(F.concat(family.cast("string"), F.lit(f"|{i}")) for i in range(10)))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _copies(part.select(F.col("p_partkey").alias("k"), digits.substr(F.lit(1), size).alias("base")))


PRIMER = "ACGTTGCA"


def primed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, seq): from each customer a read of a primer that all share and about 16 letters of its own."""
    family = F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 4).cast("long").cast("string"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _copies(customer.select(F.col("c_custkey").alias("k"), F.concat(F.lit(PRIMER), F.substring(_letters(family), 1, 16)).alias("base")))


#: A sequence of 60 letters of which every read below is a copy with errors.
AMPLICON = "TGGCATTACGGATCCAAGTCTTGACCGTAATGCACGGTTCAGATTACCGTGAACTCGTCA"


def amplicon_of(keys: DataFrame, errors: Column) -> DataFrame:
    """(k, seq) of rows (k): the amplicon with ``errors`` letters put in, at places and of kinds that a digest of k chooses."""
    seq = F.lit(AMPLICON)
    for i in range(5):
        told = F.md5(F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(f"|{i}")))
        place = F.conv(F.substring(told, 1, 4), 16, 10).cast("int") % len(AMPLICON)
        letter = F.translate(F.substring(told, 5, 1), "0123456789abcdef", "ACGTACGTACGTACGT")
        put = F.when(errors > i, 1).otherwise(0)
        seq = F.overlay(seq, F.substring(letter, 1, put), place + 1, put)
    return keys.select("k", seq.alias("seq"))


def amplicon_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, seq): from each part a read of one amplicon with 3 or 5 errors."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    return amplicon_of(part, F.when(F.col("k") % 2 == 0, 3).otherwise(5))


def _numbered(table: DataFrame) -> DataFrame:
    return reads.numbered(reads.multiplicity(table))


def vertices_of(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    return _numbered(reads_of(spark, sf_dir, length))


def _exact(vertices: DataFrame, most: int = 2) -> DataFrame:
    return pairs.exact(vertices, 1, most)


def read_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.multiplicity(reads_of(spark, sf_dir, 12))


def read_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.length_stats(reads.multiplicity(reads_of(spark, sf_dir, 24)))


def read_length_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = reads.check_lengths(reads_of(spark, sf_dir, 24))
    return checked.groupBy("length_ok", F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))


def alphabet_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as if they were sequences: letters of the alphabet are cast, names with any other give null."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", sequences.letters(F.regexp_replace(F.upper("p_name"), "[^A-Z]", "N"), "null").alias("seq"))


def vertex_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices_of(spark, sf_dir, 12)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = reads_of(spark, sf_dir, 24).select("k", F.posexplode(kmers.segments(F.col("seq"), 3)).alias("i", "segment"))
    return cut.select("k", F.col("i").cast("long").alias("i"), "segment")


def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = reads_of(spark, sf_dir, 24).select(F.explode(kmers.kmers(F.col("seq"), 4)).alias("kmer"))
    return words.groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vertices_of(spark, sf_dir, 24).select("vid", F.explode(kmers.with_occurrence(kmers.kmers(F.col("seq"), 2))).alias("w"))
    return words.groupBy(F.col("w.word").alias("kmer"), F.col("w.occ").cast("long").alias("occ")).agg(F.count("*").alias("n"))


def gapped_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vertices_of(spark, sf_dir, 12).select("vid", F.explode(kmers.with_occurrence(kmers.gapped(F.col("seq"), 4))).alias("w"))
    return words.select("vid", F.col("w.word").alias("kmer"), F.col("w.occ").cast("long").alias("occ"))


def lex_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.lexicographic(vertices_of(spark, sf_dir, 24), LEX)


def lex_minimizers_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.lexicographic(vertices_of(spark, sf_dir, 24), Scheme(4, 3, 2))


def hash_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.hashed(vertices_of(spark, sf_dir, 24), Scheme(4, 8), 2024, MD5)


def hash_minimizers_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.hashed(vertices_of(spark, sf_dir, 24), Scheme(4, 5, 2), 2024, MD5)


GOMH_SEEDS = [(11, 4), (22, 4), (33, 4)]


def gomh_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.gapped(vertices_of(spark, sf_dir, 24), GOMH_SEEDS, hash_of=MD5)


def gomh_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.gapped(vertices_of(spark, sf_dir, 12), GOMH_SEEDS, every=True)


def omh_prefix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.sketches(vertices_of(spark, sf_dir, 24), 6, 2, [1, 2, 3], "prefix", MD5)


def omh_minhash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.sketches(vertices_of(spark, sf_dir, 24), 6, 2, [1, 2, 3], "minhash", MD5)


def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.sizes(scheme.lexicographic(vertices_of(spark, sf_dir, 24), LEX))


def bucket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.lexicographic(vertices_of(spark, sf_dir, 24), LEX).agg(F.countDistinct("key").alias("n_buckets"))


def bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, large = scheme.split(stored(scheme.lexicographic(vertices_of(spark, sf_dir, 24), LEX), "buckets"), 600)
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias("size")).withColumn("kind", F.lit(name))
    return count(normal, "normal").unionByName(count(large, "large"))


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(vertices_of(spark, sf_dir, 24), "vertices")
    return pairs.bucket_stats(_exact(v), scheme.lexicographic(v, LEX))


def edges_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(stored(vertices_of(spark, sf_dir, 24), "vertices"))


def edges_brute_force_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(stored(vertices_of(spark, sf_dir, 12), "vertices"))


def edges_mixed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact edges of reads of 6 to 300 letters in one table."""
    return _exact(stored(_numbered(mixed_reads(spark, sf_dir)), "vertices"))


def edges_shared_primer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact edges of reads that all begin with one primer."""
    return _exact(stored(_numbered(primed_reads(spark, sf_dir)), "vertices"))


def edges_amplicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact edges of reads that are copies of one amplicon with errors."""
    return _exact(stored(_numbered(amplicon_reads(spark, sf_dir)), "vertices"))


BATCHES = 3
#: Reads for each bucket of the tables of a growing graph.
BUCKET_READS = 400_000


def batched_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, seq, batch): reads in three batches; every tenth comes in each of them."""
    batch = F.explode(F.when(F.col("k") % 10 == 0, F.sequence(F.lit(0), F.lit(BATCHES - 1))).otherwise(F.array((F.col("k") % BATCHES).cast("int"))))
    return reads_of(spark, sf_dir, 24).withColumn("batch", batch)


def edges_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and counts of a graph that three batches have made, each looking for its own edges only."""
    source = stored(batched_reads(spark, sf_dir), "batches")
    made = GrowingGraph(spark, f"{shared_folder(spark)}/growing-{uuid.uuid4().hex}", buckets=max(16, source.count() // BUCKET_READS))
    for i in range(BATCHES):
        made.add(source.where(F.col("batch") == i))
    ends = [made.vertices().select(F.col("vid").alias(v), F.col("cnt").alias(f"{v}_cnt")) for v in ("src", "dst")]
    return made.edges().join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "weight", "src_cnt", "dst_cnt")


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components by their smallest vertex, and how many reads each has."""
    v = stored(vertices_of(spark, sf_dir, 24), "vertices")
    return components(_exact(v), v).groupBy("comp").agg(F.count("*").alias("n"))


def edges_brute_force_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = GraphConfig(mode="brute_force", min_distance=2)
    return build(reads_of(spark, sf_dir, 24), config).edges


def _in_buckets(spark: SparkSession, sf_dir: str, length: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    v = stored(vertices_of(spark, sf_dir, length), "vertices")
    return pairs.exact_in(v, [(made(v), ["key"])], 1, 2).drop("kept")


def edges_minimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_buckets(spark, sf_dir, 12, lambda v: scheme.lexicographic(v, LEX))


def edges_miniception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_buckets(spark, sf_dir, 12, lambda v: scheme.hashed(v, Scheme(4, 8), 2024, MD5))


def edges_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that share an order min hash sketch of the whole read."""
    return _in_buckets(spark, sf_dir, 24, lambda v: scheme.sketches(v, 6, 2, [1, 2, 3], "minhash", MD5))


def edges_omh_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_buckets(spark, sf_dir, 24, lambda v: scheme.sketches(v, 6, 2, [1, 2, 3], "minhash", MD5))


def edges_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_buckets(spark, sf_dir, 12, lambda v: scheme.gapped(v, GOMH_SEEDS, every=True))


def edges_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct self-join of small buckets, in blocks; where buckets have grown, the exact search among them."""
    v = stored(vertices_of(spark, sf_dir, 24), "vertices")
    return pairs.among(stored(scheme.sketches(v, 6, 2, [1], "prefix", MD5), "buckets"), v, 1, 2, block=16)


LARGE = 600


def _in_large(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads with their minimizers (parents) and gapped keys, and (parent, n) of the large buckets: how many sub-buckets each has.

    A read's gapped keys are the same in whatever bucket it is, so sub-buckets need not be made to be counted.
    """
    listed = stored(scheme.gapped_lists(v.select("vid", "seq"), GOMH_SEEDS, MD5).select("vid", scheme.lexicographic_keys(LEX).alias("parents"), "keys"), "lists")
    return listed, scheme.sub_sizes(listed).where(f"size < 2 or size >= {LARGE}").select("parent", "n")


def large_bucket_rebucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that sub-buckets of large buckets hold: their ends share such a bucket and a gapped key."""
    v = stored(vertices_of(spark, sf_dir, 24), "vertices")
    listed, n = _in_large(v)
    routes = stored(n.where(f"n >= 2 and n < {LARGE}").select("parent"), "routes")
    return pairs.in_sub_buckets(_exact(v), listed, routes)


def sub_bucket_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sub-buckets each large bucket has, and where that sends it."""
    _, n = _in_large(vertices_of(spark, sf_dir, 24))
    return n.select("parent", "n", F.when(F.col("n") >= 300, "traversal").when(F.col("n") >= 2, "pairwise").otherwise("dropped").alias("route"))


def khop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exact(stored(vertices_of(spark, sf_dir, 24), "vertices"))
    return graph.within_hops(e, None, 3)


def edges_after_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of weight 1 and what a bounded traversal of them adds."""
    v = stored(vertices_of(spark, sf_dir, 12), "vertices")
    found = short.walked_pairs(v)
    if found is not None:
        return found
    one = stored(_exact(v, 1), "ones")
    return graph.inserted(one, graph.verified_hops(one, v, None, 3, 1, 2))


def merge_unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.merge_unique(reads_of(spark, sf_dir, 24), reads_of(spark, sf_dir, 12), reads_of(spark, sf_dir, 12))


def edge_weight_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_weights(edges_brute_force(spark, sf_dir), 1, 1)


def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(edges_brute_force(spark, sf_dir))


def _minimizer_graph(spark: SparkSession, sf_dir: str) -> EditGraph:
    return build(reads_of(spark, sf_dir, 12), GraphConfig(mode="minimizer_gomh", hash_name="md5"))


def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of the default mode counts: reads, buckets by kind, edges by weight."""
    return _minimizer_graph(spark, sf_dir).stages


def graph_minimizer_gomh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode on short reads: window minimizers, then a second pass over all gapped k-mers."""
    return _minimizer_graph(spark, sf_dir).edges


MINICEPTION_GOMH = GraphConfig(mode="miniception_gomh", default_params=False, k=4, window=8, segments=1, bin_size_max=LARGE, visit_depth=4, hash_name="md5")


def graph_miniception_gomh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed minimizers; buckets of 600 and more are bucketed again or traversed."""
    return build(reads_of(spark, sf_dir, 24), MINICEPTION_GOMH).edges


def graph_miniception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(reads_of(spark, sf_dir, 12), GraphConfig(mode="miniception", miniception_k=4, miniception_w=8, hash_name="md5")).edges


def graph_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(reads_of(spark, sf_dir, 24), GraphConfig(mode="omh", omh_k=6, omh_m=3, omh_l=2, seed=1, hash_name="md5")).edges


LONG = 52


def graph_long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode and parameters on reads of 51 to 301 letters, cut into segments."""
    return build(mixed_reads(spark, sf_dir, LONG), GraphConfig(hash_name="md5")).edges


def _fastq(spark: SparkSession, sf_dir: str) -> str:
    """Reads written as FASTQ, with quality lines that begin like a record."""
    made = reads_of(spark, sf_dir, 24).select(F.col("k").cast("string").alias("id"), "seq", F.concat(F.lit("@"), F.repeat(F.lit("I"), F.length("seq") - 1)).alias("qual"))
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    sequences.write_fastq(made, path)
    return path


def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and read back by lines."""
    return sequences.read_fastq(spark, _fastq(spark, sf_dir))


def fastq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and read back by byte ranges."""
    return fastq.read_fastq_ranges(spark, _fastq(spark, sf_dir))


def mode_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mode and weight: edges found, edges there are, and their ratio."""
    v = stored(vertices_of(spark, sf_dir, 12), "vertices")
    made = {
        "minimizer": scheme.lexicographic(v, LEX),
        "miniception": scheme.hashed(v, Scheme(4, 8), 2024, MD5),
        "omh": scheme.sketches(v, 6, 2, [1, 2, 3], "prefix", MD5),
        "gapped": scheme.gapped(v, GOMH_SEEDS, every=True),
    }
    # a scheme of one bucket for all reads says how many edges there are
    schemes = [(keys, ["key"]) for keys in made.values()] + [(v.select("vid", F.lit("all").alias("key")), ["key"])]
    told = stored(pairs.exact_in(v, schemes, 1, 2).groupBy("weight", "kept").agg(F.count("*").alias("n")), "told")
    total = told.groupBy("weight").agg(F.sum("n").alias("n_exact"))
    each = told.select("weight", "n", F.posexplode(F.array(*(F.lit(name) for name in made))).alias("i", "mode"), "kept").where("shiftright(kept, i) % 2 = 1")
    found = each.groupBy("mode", "weight").agg(F.sum("n").alias("n_found"))
    return found.join(total, "weight").select("mode", "weight", "n_found", "n_exact", F.round(F.col("n_found") / F.col("n_exact"), 6).alias("recall"))


def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(vertices_of(spark, sf_dir, 24), "vertices")
    return sequences.dot_lines(v, _exact(v))


ALL: tuple[Query, ...] = (
    read_multiplicity, read_length_stats, read_length_flags, alphabet_cast, vertex_numbering, segments, kmer_spectrum, kmer_occurrence,
    gapped_kmers, lex_minimizers, lex_minimizers_segmented, hash_minimizers, hash_minimizers_segmented, gomh_keys, gomh_all_keys,
    omh_prefix_keys, omh_minhash_keys, bucket_sizes, bucket_count, bucket_split, bucket_stats, edges_brute_force, edges_brute_force_short,
    edges_brute_force_min2, edges_minimizer, edges_miniception, edges_omh, edges_omh_minhash, edges_gapped, edges_bucket_join,
    large_bucket_rebucket, sub_bucket_routes, khop_pairs, edges_after_khop, merge_unique_reads, edge_weight_filter, edge_summary,
    graph_minimizer_gomh, graph_miniception_gomh, mode_recall, dot_lines, edges_mixed_lengths, edges_shared_primer, edges_amplicon, edges_incremental, component_sizes,
    graph_miniception, graph_omh, graph_long_reads, stage_metrics, fastq_reads, fastq_ranges,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}
