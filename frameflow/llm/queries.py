"""Queries of the training-data operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.clusters import clusters, described
from frameflow.llm.knn import close_pairs, similar
from frameflow.llm.packing import described_containers, packed_containers
from frameflow.llm.runs import collapsed_runs
from frameflow.llm.spans import share_of_records, shared_spans
from frameflow.llm.tokens import encode_column
from frameflow.llm.vectors import dense_vectors, descriptor_vectors
from frameflow.operators.ordered import neighbour_pairs
from frameflow.session import partitions_for
from frameflow.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    kinds, descriptors, features = (table(spark, d, t) for t in ("feature_kinds", "descriptors", "features"))
    return descriptor_vectors(descriptors, kinds).unionByName(dense_vectors(features, kinds)), descriptors.count() + features.count()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of comparable vectors with a cosine of at least 0.96, one among the other's 5 most similar."""
    vectors, n = _vectors(spark, d)
    pairs = close_pairs(similar(vectors, k=5, min_cosine=0.96, rows=n))
    return pairs.select(F.substring_index("kind", "|", 1).alias("field"), "id_a", "id_b")


#: Vectors without any near neighbour, half of the table, are found only by comparing many.
NEIGHBOUR_CANDIDATES = 60_000


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar others, whatever their cosine, of every row whose id is divisible by 20, against all rows."""
    vectors, n = _vectors(spark, d)
    near = similar(vectors, k=5, trees=10, candidates=NEIGHBOUR_CANDIDATES, query_step=20, rows=n)
    return near.select(F.substring_index("kind", "|", 1).alias("field"), "id", "rank", "other", F.round("cosine", 5).alias("cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more nearly equal consecutive images."""
    return collapsed_runs(table(spark, d, "frames")).filter("n_frames >= 2").select("stream_id", "request_id", "first_seq", "last_seq")


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, those of one frame too, with its count of frames and its duration."""
    return collapsed_runs(table(spark, d, "frames"))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    descriptors = table(spark, d, "descriptors")
    n = descriptors.count()
    return clusters(descriptor_vectors(descriptors, table(spark, d, "feature_kinds")), rows=n), n


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of one cluster with no member of it between their ids."""
    members, n = _clusters(spark, d)
    inside = members.filter("cluster is not null").select(F.concat_ws("|", "kind", "cluster").alias("g"), "id")
    return neighbour_pairs(inside, "g", "id", partitions_for(spark, n, 2_000_000)).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with its size and its 5 most typical members."""
    members, _ = _clusters(spark, d)
    return described(members).select(F.substring_index("kind", "|", -1).alias("feature_name"), "cluster", "size", F.array_join(F.col("typical_ids").cast("array<string>"), ",").alias("typical_ids"))


def p4_apart(spark: SparkSession, d: str) -> DataFrame:
    """Comparable descriptors that fit no cluster."""
    members, _ = _clusters(spark, d)
    return members.filter("cluster is null").select(F.substring_index("kind", "|", -1).alias("feature_name"), F.col("id").alias("descriptor_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every post as ids of byte_bpe_50k, without special tokens."""
    return encode_column(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Posts in containers of 2,048 tokens: container, doc_id and token range."""
    return packed_containers(table(spark, d, "documents"), 2048).select("container", "doc_id", "token_start", "token_end")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Of each container its number of parts, tokens, unused space, and parts that repeat a source or a text in it."""
    return described_containers(packed_containers(table(spark, d, "documents"), 2048), 2048)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters that lie in a substring of 100 that another post has too."""
    return shared_spans(table(spark, d, "documents"), 100)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of every post is shared."""
    documents = table(spark, d, "documents")
    return share_of_records(documents, shared_spans(documents, 100))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_neighbours, p2_found, p2_runs, p4_found, p4_clusters, p4_apart, p6_ids, p7_pack, p7_containers, p8_found, p8_shares)
}
ORACLES: dict[str, str] = {}
