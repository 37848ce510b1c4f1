"""Queries over deliveries of messages and over streams of very different size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.operators.keyed import key_profile, selected_heavy_keys
from frameflow.operators.messages import arrival_key, duplicate_deliveries, kept_messages, message_key
from frameflow.schema import normal_stream
from frameflow.session import materialize
from frameflow.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of messages that are not the kept copy."""
    return duplicate_deliveries(table(spark, d, "frames"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The kept copy of every message."""
    return kept_messages(table(spark, d, "frames")).select("delivery_id", "stream_id", "sequence_nr", "request_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Streams that hold at least 3 % of all rows of frames."""
    return selected_heavy_keys(table(spark, d, "frames"), normal_stream(), 3).select(F.col("key").alias("stream_id"))


def p5_streams(spark: SparkSession, d: str) -> DataFrame:
    """Per stream its messages, first, median and last sequence_nr, and bytes of images, each message counting once."""
    frames = table(spark, d, "frames").filter("stream_id is not null and sequence_nr is not null")
    copy = F.struct(arrival_key().alias("at"), F.col("delivery_id").alias("did"), F.coalesce(F.octet_length("image"), F.lit(0)).alias("bytes"))
    kept = frames.select(*message_key(), copy.alias("copy")).groupBy("stream_id", "sequence_nr", "request_id").agg(F.min("copy").alias("copy"))
    kept = materialize(kept.select("stream_id", "sequence_nr", F.col("copy.bytes").alias("bytes")), "kept")  # read once per round
    out = key_profile(kept, F.col("stream_id"), F.col("sequence_nr"), (0.5,), {"image_bytes": F.col("bytes")})
    return out.select(F.col("key").alias("stream_id"), F.col("n_rows").alias("n_messages"), F.col("first").alias("first_seq"), F.col("q0").alias("median_seq"), F.col("last").alias("last_seq"), "image_bytes")


_RANKED = """select *, lower(trim(stream_id)) as s, coalesce(request_id, -1) as r,
  row_number() over (partition by lower(trim(stream_id)), sequence_nr, coalesce(request_id, -1)
                     order by arrived_at nulls last, delivery_id nulls last) as rn
from frames where stream_id is not null and sequence_nr is not null"""

QUERIES = {"p3_found": p3_found, "p3_kept": p3_kept, "p5_found": p5_found, "p5_streams": p5_streams}
ORACLES = {
    "p3_found": f"select delivery_id from ({_RANKED}) where rn > 1",
    "p3_kept": f"select delivery_id, s as stream_id, sequence_nr, r as request_id from ({_RANKED}) where rn = 1",
    "p5_found": """select lower(trim(stream_id)) as stream_id from frames where stream_id is not null
group by 1 having count(*) * 100 >= 3 * (select count(*) from frames)""",
    "p5_streams": f"""select s as stream_id, count(*) as n_messages, min(sequence_nr) as first_seq,
  quantile_disc(sequence_nr, 0.5) as median_seq, max(sequence_nr) as last_seq,
  cast(sum(coalesce(octet_length(image), 0)) as bigint) as image_bytes
from ({_RANKED}) where rn = 1 group by 1""",
}
