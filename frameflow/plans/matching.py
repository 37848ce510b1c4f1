"""Queries of the prototype matcher over the embeddings: prototypes are the first hundred vectors, labels their owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.operators.matching import match, ratio_match
from frameflow.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATIO = 0.95


def _tables(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    q = e.filter("vec_id >= 100").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 25).alias("request_id"), "vec")
    return q, e.filter("vec_id < 100").select(F.col("vec_id").alias("proto_id"), F.col("label").alias("prototype"), "vec")


def _sql(part: str) -> str:
    return f"""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id >= 100),
  p as (select vec_id as proto_id, label, embedding::double[] as v from embeddings where vec_id < 100),
  d as (select query_id, proto_id, {part} as part, list_distance(q.v, p.v) as d from q, p),
  r as (select *, row_number() over (partition by query_id, part order by d, proto_id) as rn from d),
  b as (select query_id, part, max(case when rn = 1 then proto_id end) as best_id, max(case when rn = 1 then d end) as d0, max(case when rn = 2 then d end) as d1 from r where rn <= 2 group by 1, 2)
select query_id, part, best_id, round(d0, 4) as d0 from b where d0 < {RATIO} * d1"""


def _requests(part: str) -> str:
    return f"""with m as ({_sql(part)}), c as (select query_id % 25 as request_id, label::varchar as prototype, count(*) as n from m join embeddings e on e.vec_id = m.best_id group by 1, 2),
  j as (select request_id, '{{' || string_agg('"' || prototype || '":' || n, ',' order by prototype) || '}}' as result from c group by 1)
select r.request_id, coalesce(j.result, '{{}}') as result from (select distinct vec_id % 25 as request_id from embeddings where vec_id >= 100) r left join j on r.request_id = j.request_id"""


def _out(df):
    return df.select("query_id", "part", "best_id", F.round("d0", 4).alias("d0"))


def knn_ratio_match(spark, d):
    """Strong matches within each prototype's own group."""
    q, p = _tables(spark, d)
    return _out(ratio_match(q, p, RATIO, per="prototype"))


def knn_ratio_global(spark, d):
    """Strong matches over all prototypes."""
    q, p = _tables(spark, d)
    return _out(ratio_match(q, p, RATIO))


def knn_ratio_sharded(spark, d):
    """Strong matches over two shards of the prototypes."""
    q, p = _tables(spark, d)
    return _out(ratio_match(q, p, RATIO, shards=2))


def request_result(spark, d):
    """The request call: strong matches counted per prototype, as one JSON object per request."""
    q, p = _tables(spark, d)
    return match(q.select("request_id").distinct(), q, p, RATIO)


QUERIES = {f.__name__: f for f in (knn_ratio_match, knn_ratio_global, knn_ratio_sharded, request_result)}
ORACLES = {
    "knn_ratio_match": _sql("p.label::varchar"),
    "knn_ratio_global": _sql("''"),
    "knn_ratio_sharded": _sql("(p.proto_id % 2)::varchar"),
    "request_result": _requests("''"),
}
