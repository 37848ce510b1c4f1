"""Queries of the stream operators over the particle tables: sources, routes, windows, geometry and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions.columns import entries_text, is_tile, magnitude, scaled
from frameflow.operators import geometry, media, routing
from frameflow.operators.ranking import numbered
from frameflow.operators.windows import Discrete, SameSequence, Sliding, with_trigger
from frameflow.schema import normal_stream, normal_type
from frameflow.sources.tables import table

S = "lower(trim(stream_id))"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames under their stream's normal id."""
    return table(spark, d, "frames").withColumn("stream_id", normal_stream())


# ---- sources -------------------------------------------------------------------------------------------------------


@query("select delivery_id, sequence_nr from frames where sequence_nr % 13 < 2")
def source_sample(spark, d):
    return routing.sample(table(spark, d, "frames"), 13, 2).select("delivery_id", "sequence_nr")


@query("""select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as sequence_nr,
  (row_number() over (partition by user_id order by event_id) - 1) * 40 as ts_ms from events""")
def source_numbering(spark, d):
    return media.number_frames(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 25)


@query(f"""with s as (select distinct {S} as stream_id from frames where stream_id is not null),
  i as (select stream_id, row_number() over (order by stream_id) - 1 as i, count(*) over () as n from s)
select stream_id, i % 7 as owner, cast(floor(i * 7 / n) as int) as block from i""")
def source_split_assign(spark, d):
    s = frames(spark, d).filter("stream_id is not null").select("stream_id").distinct()
    n = s.count()  # one number
    return numbered(s, ["stream_id"]).select("stream_id", routing.split_owner(F.col("rn"), 7).alias("owner"), routing.block_owner(F.col("rn"), F.lit(n), 7).alias("block"))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as rn from events)
select user_id, rn // 4 as group_nr, min(event_id) as first_seq, count(*) as n_frames, string_agg(event_id::varchar, ',' order by rn) as event_ids
from r group by user_id, rn // 4 having count(*) = 4""")
def fetch_groups(spark, d):
    g = media.group_frames(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 4, ["event_id"])
    return g.select("user_id", "group_nr", "first_seq", "n_frames", F.array_join(F.transform("frames", lambda f: f["event_id"].cast("string")), ",").alias("event_ids"))


# ---- filters and routes --------------------------------------------------------------------------------------------


@query("select delivery_id, sequence_nr from frames where sequence_nr % 13 = 0")
def mod_route(spark, d):
    f = routing.mod_filter(table(spark, d, "frames"), 13).select("delivery_id", "sequence_nr")
    return routing.route(f, 8, "delivery_id")


@query("select feature_id, sequence_nr from features where name = 'surf'")
def feature_route(spark, d):
    return routing.feature_filter(table(spark, d, "features"), "surf").select("feature_id", "sequence_nr")


@query("select delivery_id from frames where metadata['site'] in ('east', 'pier') or metadata['fw'] in ('1.4.2')")
def metadata_accept(spark, d):
    return table(spark, d, "frames").filter(routing.accepts({"site": ["east", "pier"], "fw": ["1.4.2"]})).select("delivery_id")


@query("select delivery_id from frames where list_contains(map_keys(metadata), 'fw') or list_contains(map_keys(metadata), 'site')")
def metadata_route_keys(spark, d):
    f = table(spark, d, "frames").select("delivery_id", "metadata")
    return routing.route_by_metadata(f, 8, ["fw", "site"]).select("delivery_id")


@query("select delivery_id, (batch_nr - 1) % 3 as target from frames where batch_nr is not null")
def supervised_map(spark, d):
    f = table(spark, d, "frames").filter("batch_nr is not null")
    return f.select("delivery_id", routing.supervised_target(F.col("batch_nr") - 1, 3).alias("target"))


@query(rf"""select delivery_id, case when regexp_matches({S}, '_[0-9]+_[0-9]+$') then regexp_replace({S}, '_[^_]*$', '') else {S} end as stream_id
from frames where stream_id is not null""")
def tile_route(spark, d):
    return routing.to_base_stream(frames(spark, d).filter("stream_id is not null").select("delivery_id", "stream_id", "sequence_nr"), 8).select("delivery_id", "stream_id")


@query(rf"select delivery_id, {S} as stream_id from frames where regexp_matches({S}, '_[0-9]+_[12]$')")
def tile_suffix_filter(spark, d):
    return routing.tiles_only(frames(spark, d), [1, 2]).select("delivery_id", "stream_id")


@query("select delivery_id from frames where lower(trim(type)) = 'frame'")
def type_guard(spark, d):
    return routing.of_type(table(spark, d, "frames"), "frame").select("delivery_id")


@query(f"""with u as (select type, stream_id, sequence_nr from frames union all select type, stream_id, sequence_nr from features
  union all select type, stream_id, sequence_nr from descriptors union all select type, stream_id, sequence_nr from chunks)
select {S} as stream_id, lower(trim(type)) as type, count(*) as n, min(sequence_nr) as first_seq, max(sequence_nr) as last_seq from u group by 1, 2""")
def union_fanin(spark, d):
    u = routing.fan_in(*[table(spark, d, t).select("type", "stream_id", "sequence_nr") for t in ("frames", "features", "descriptors", "chunks")])
    g = u.groupBy(normal_stream().alias("stream_id"), normal_type().alias("type"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("sequence_nr").alias("first_seq"), F.max("sequence_nr").alias("last_seq"))


@query("""with c as (select descriptor_id, unnest(map_entries(metadata)) as e from descriptors),
  p as (select d.descriptor_id, unnest(map_entries(f.metadata)) as e from descriptors d join features f on d.feature_id = f.feature_id),
  m as (select descriptor_id, e.key as k, e.value as v from c
        union all select p.descriptor_id, p.e.key, p.e.value from p
        where not exists (select 1 from c where c.descriptor_id = p.descriptor_id and c.e.key = p.e.key))
select d.descriptor_id, coalesce(string_agg(m.k || '=' || coalesce(m.v, ''), ';' order by m.k), '') as metadata
from descriptors d left join m on m.descriptor_id = d.descriptor_id group by d.descriptor_id""")
def metadata_inherit(spark, d):
    child = table(spark, d, "descriptors").select("descriptor_id", "feature_id", "metadata")
    out = geometry.with_parent_metadata(child, table(spark, d, "features").select("feature_id", "metadata"), ["feature_id"])
    return out.select("descriptor_id", entries_text("metadata").alias("metadata"))


# ---- windows -------------------------------------------------------------------------------------------------------

_LINES = "select distinct l_orderkey as stream, l_linenumber::bigint as n from lineitem"
_EVENTS = f"select distinct {S} as stream_id, coalesce(request_id, -1) as request_id, sequence_nr as n from frames where stream_id is not null and sequence_nr is not null"


def _discrete_sql(rows: str, keys: str, size: int, step: int) -> str:
    return f"""with d as ({rows}), b as (select *, case when n - lag(n) over (partition by {keys} order by n) = {step} then 0 else 1 end brk from d),
  i as (select *, sum(brk) over (partition by {keys} order by n) g from b),
  p as (select *, (row_number() over (partition by {keys}, g order by n) - 1) // {size} k from i)
select {keys}, min(n) as first_seq, max(n) as last_seq from p group by {keys}, g, k having count(*) = {size}"""


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").cast("long").alias("n"))


def _events(spark, d) -> DataFrame:
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null")
    return f.select("stream_id", F.coalesce("request_id", F.lit(-1)).alias("request_id"), F.col("sequence_nr").alias("n")).distinct()


@query(_discrete_sql(_LINES, "stream", 3, 1))
def discrete_window(spark, d):
    return Discrete(3, 1).frame(_lines(spark, d), ["stream"], "n")


@query(_discrete_sql(_LINES, "stream", 2, 2))
def discrete_window_step(spark, d):
    return Discrete(2, 2).frame(_lines(spark, d), ["stream"], "n")


@query(_discrete_sql(_EVENTS, "stream_id, request_id", 3, 1))
def discrete_window_frames(spark, d):
    return Discrete(3, 1).frame(_events(spark, d), ["stream_id", "request_id"], "n")


def _sliding_sql(rows: str, keys: str, size: int, step: int) -> str:
    leads = ", ".join(f"lead(n, {i}) over (partition by {keys} order by n) as n{i}" for i in range(1, size))
    good = " and ".join(f"n{i} = n + {i * step}" for i in range(1, size))
    return f"select {keys}, n as first_seq, n{size - 1} as last_seq from (select *, {leads} from ({rows})) where {good}"


@query(_sliding_sql(_LINES, "stream", 3, 1))
def sliding_window(spark, d):
    return Sliding(3, 1).frame(_lines(spark, d), ["stream"], "n")


@query(_sliding_sql(_EVENTS, "stream_id, request_id", 2, 1))
def sliding_window_frames(spark, d):
    return Sliding(2, 1).frame(_events(spark, d), ["stream_id", "request_id"], "n")


@query(f"""with d as ({_LINES}), w as (select stream, n, row_number() over (partition by stream order by n) - 1 as i,
    count(*) over (partition by stream) - 1 as last, lead(n, 1) over (partition by stream order by n) as n1, lead(n, 2) over (partition by stream order by n) as n2 from d),
  s as (select *, n1 = n + 1 and n2 = n + 2 as in_step from w where n2 is not null),
  b as (select stream, min(i) as stop from s where last - i < 4 and not in_step group by stream)
select s.stream, s.n as first_seq, s.n2 as last_seq, s.in_step from s left join b on s.stream = b.stream
where s.last - s.i >= 4 or b.stop is null or s.i < b.stop""")
def sliding_window_max(spark, d):
    return Sliding(3, 1, 4).frame(_lines(spark, d), ["stream"], "n")


@query(f"""with e as (select {S} as stream_id, sequence_nr as n, min(coalesce(request_id, -1)) as request_id from frames
    where stream_id is not null and sequence_nr is not null group by 1, 2),
  w as (select stream_id, n as first_seq, lead(n) over (partition by stream_id order by n) as last_seq from e)
select w.stream_id, w.first_seq, w.last_seq, e.request_id from w join e on e.stream_id = w.stream_id and e.n = w.last_seq where w.last_seq = w.first_seq + 1""")
def window_trigger(spark, d):
    items = _events(spark, d).withColumnRenamed("n", "sequence_nr")
    return with_trigger(Sliding(2, 1).frame(items, ["stream_id"]), items, ["stream_id"])


@query("""select l_orderkey as stream, l_linenumber as seq, count(*) as n, count(*) > 2 as overflow
from lineitem group by 1, 2 having count(*) >= 2""")
def same_sequence(spark, d):
    return SameSequence(2).frame(_lines(spark, d).withColumnRenamed("n", "nr"), ["stream"], "nr").withColumn("seq", F.col("seq").cast("int"))


@query(f"""with d as ({_EVENTS}), p as (select *, lead(n) over (partition by stream_id, request_id order by n) as n2 from d)
select stream_id, request_id, n as first_seq, n2 as second_seq, n2 - n as duration from p where n2 is not null""")
def frame_pairs(spark, d):
    return media.frame_pairs(_events(spark, d), ["stream_id", "request_id"], "n", []).drop("first", "second")


@query(f"""with r as (select {S} as stream_id, sequence_nr, delivery_id, row_number() over (partition by {S} order by sequence_nr, delivery_id) - 1 as rn
  from frames where stream_id is not null and sequence_nr is not null)
select stream_id, rn // 5 as group_nr, min(sequence_nr) as first_seq, count(*) as n_frames, string_agg(delivery_id::varchar, ',' order by rn) as deliveries
from r group by stream_id, rn // 5""")
def group_frames(spark, d):
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null").select("stream_id", "sequence_nr", "delivery_id")
    g = media.group_frames(f, ["stream_id"], "sequence_nr", 5, ["delivery_id"], True, ["delivery_id"])
    return g.select("stream_id", "group_nr", "first_seq", "n_frames", F.array_join(F.transform("frames", lambda x: x["delivery_id"].cast("string")), ",").alias("deliveries"))


@query(f"""with r as (select {S} as stream_id, sequence_nr, coalesce(octet_length(image), 0) as b, row_number() over (partition by {S} order by sequence_nr, delivery_id) - 1 as rn
  from frames where stream_id is not null and sequence_nr is not null)
select stream_id, rn // 5 as group_nr, sum(b)::bigint as bytes, max(sequence_nr) - min(sequence_nr) as span from r group by stream_id, rn // 5 having count(*) = 5""")
def group_operation(spark, d):
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null")
    f = f.select("stream_id", "sequence_nr", "delivery_id", F.coalesce(F.octet_length("image"), F.lit(0)).alias("b"))
    g = media.group_frames(f, ["stream_id"], "sequence_nr", 5, ["sequence_nr", "b"], ties=["delivery_id"])
    g = media.on_groups(g, lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["b"]), "bytes")
    g = media.on_groups(g, lambda a: F.element_at(a, -1)["sequence_nr"] - F.element_at(a, 1)["sequence_nr"], "span")
    return g.select("stream_id", "group_nr", "bytes", "span")


@query(f"""select {S} as stream_id, max(sequence_nr) as sequence_nr, max({{'s': sequence_nr, 'd': delivery_id}}).d as delivery_id
from frames where stream_id is not null and sequence_nr is not null and image is not null group by 1""")
def latest_per_stream(spark, d):
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null and image is not null")
    return media.latest(f, ["stream_id"], ["sequence_nr", "delivery_id"], [])


@query(f"""with f as (select {S} as stream_id, sequence_nr, ts_ms, delivery_id from frames where stream_id is not null and ts_ms is not null)
select stream_id, sequence_nr, delivery_id from (select *, max(ts_ms) over (partition by stream_id) as newest from f) where ts_ms >= newest - 29000""")
def history_ttl(spark, d):
    f = frames(spark, d).filter("stream_id is not null and ts_ms is not null").select("stream_id", "sequence_nr", "ts_ms", "delivery_id")
    return media.within_ttl(f, ["stream_id"], "ts_ms", F.lit(29_000)).drop("ts_ms")


@query(f"""with f as (select {S} as stream_id, sequence_nr, min(ts_ms) as t from frames where stream_id is not null and sequence_nr is not null and ts_ms is not null group by 1, 2),
  r as (select *, row_number() over (partition by stream_id order by sequence_nr) as rn from f)
select a.stream_id, case when b.t > a.t then floor(1000 / (b.t - a.t)) * 2.0 end as fps from r a join r b on a.stream_id = b.stream_id and a.rn = 1 and b.rn = 2""")
def frame_rate(spark, d):
    return media.stream_rates(frames(spark, d).filter("stream_id is not null").select("stream_id", "sequence_nr", "ts_ms"), ["stream_id"], speed=2.0)


# ---- geometry ------------------------------------------------------------------------------------------------------


@query(f"""with f as (select delivery_id, {S} as s, bbox.x as x, bbox.y as y, bbox.width as w, bbox.height as h, i,
    bbox.x + (i % 2) * (bbox.width // 2) as tx, bbox.y + (i // 2) * (bbox.height // 2) as ty
  from frames, range(4) r(i) where bbox.width >= 4 and bbox.height >= 4)
select delivery_id, concat_ws('_', s, i::varchar) as stream_id, i::int as tile, tx::int as x, ty::int as y,
  (least(tx + w // 2 + 10, x + w) - tx)::int as width, (least(ty + h // 2 + 10, y + h) - ty)::int as height from f""")
def tiling(spark, d):
    t = geometry.tiling(frames(spark, d).select("delivery_id", "stream_id", "bbox"), 2, 2, 10)
    return t.select("delivery_id", "stream_id", "tile", "bbox.*")


@query(rf"""with t as (select {S} as s, * from frames where regexp_matches({S}, '_[0-9]+_[0-9]+$') and sequence_nr is not null),
  g as (select regexp_replace(s, '_[^_]*$', '') as stream_id, sequence_nr, max(bbox.x + bbox.width) as width, max(bbox.y + bbox.height) as height,
    count(distinct regexp_extract(s, '[^_]*$')) as n_tiles from t group by 1, 2),
  e as (select regexp_replace(s, '_[^_]*$', '') as stream_id, sequence_nr, bbox as b, unnest(features) as f from t),
  o as (select stream_id, sequence_nr, b, f.name as name, unnest(f.sparse) as p from e),
  n as (select stream_id, sequence_nr, name, count(*) as n, sum(p.bbox.x + b.x) as sx from o group by 1, 2, 3),
  m as (select stream_id, sequence_nr, string_agg(name || ':' || n || ':' || coalesce(sx, 0), ',' order by name) as features from n group by 1, 2)
select g.*, coalesce(m.features, '') as features from g left join m using (stream_id, sequence_nr)""")
def tile_recombine(spark, d):
    t = frames(spark, d).filter(is_tile("stream_id") & F.col("sequence_nr").isNotNull()).select("stream_id", "sequence_nr", "bbox", "features")
    r = geometry.recombine(t, features="features")
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["x"], F.lit(0)))
    full = F.filter(F.coalesce("features", F.array()), lambda f: F.size(f["boxes"]) > 0)
    text = F.array_join(F.transform(full, lambda f: F.concat_ws(":", f["name"], F.size(f["boxes"]).cast("string"), total(f["boxes"]).cast("string"))), ",")
    return r.select("stream_id", "sequence_nr", "width", "height", "n_tiles", text.alias("features"))


@query(f"""with a as (select delivery_id, bbox as fb, flatten(list_transform(coalesce(features, []), lambda f: list_transform(coalesce(f.sparse, []), lambda p: {{'n': f.name, 'b': p.bbox}}))) as al
    from frames where bbox is not null),
  s as (select *, list_filter(al, lambda p: p.n = 'haar' and p.b.width >= 20 and p.b.height >= 20) as sz from a),
  u as (select delivery_id, fb, al, unnest(sz) as q, generate_subscripts(sz, 1) - 1 as roi_nr from s),
  r as (select *, greatest(q.b.x - 25, fb.x) as x, greatest(q.b.y - 25, fb.y) as y,
    least(q.b.x + q.b.width + 25, fb.x + fb.width) as x2, least(q.b.y + q.b.height + 25, fb.y + fb.height) as y2 from u)
select delivery_id, roi_nr::int as roi_nr, x, y, x2 - x as width, y2 - y as height,
  len(list_filter(al, lambda p: p.b.x >= x and p.b.y >= y and p.b.x < x2 and p.b.y < y2))::int as n_inside
from r where x2 > x and y2 > y""")
def roi_extract(spark, d):
    f = frames(spark, d).select("delivery_id", "stream_id", "bbox", "features")
    r = geometry.regions(f, ["haar"], 25, (20, 20))
    return r.select("delivery_id", "roi_nr", "roi.*", F.size("inside").alias("n_inside"))


@query(f"""with p as (select {S} as stream_id, sequence_nr, 1 as is_frame, delivery_id, ts_ms, features from frames where stream_id is not null and sequence_nr is not null),
  q as (select {S} as stream_id, sequence_nr, name, sparse from features where stream_id is not null and sequence_nr is not null),
  k as (select stream_id, sequence_nr, 1 as f, 0 as x from p union all select stream_id, sequence_nr, 0, 1 from q),
  h as (select stream_id, sequence_nr, count(*) as n_particles, sum(f) as nf from k group by 1, 2 having sum(x) > 0),
  e as (select stream_id, sequence_nr, f.name as name, f.sparse as sparse from (select stream_id, sequence_nr, unnest(features) as f from p) union all select stream_id, sequence_nr, name, sparse from q),
  n as (select stream_id, sequence_nr, name, sum(coalesce(len(sparse), 0)) as n from e where name is not null group by 1, 2, 3),
  m as (select stream_id, sequence_nr, string_agg(name || ':' || n, ',' order by name) as features from n group by 1, 2)
select h.stream_id, h.sequence_nr, n_particles, case when nf > 0 then 'frame' else 'none' end as image_type, coalesce(m.features, '') as features
from h left join m on h.stream_id = m.stream_id and h.sequence_nr = m.sequence_nr""")
def feature_combine(spark, d):
    keep = "stream_id is not null and sequence_nr is not null"
    f = frames(spark, d).filter(keep).select(F.lit("frame").alias("type"), "stream_id", "sequence_nr", "ts_ms", "bbox", "features")
    x = table(spark, d, "features").withColumn("stream_id", normal_stream()).filter(keep)
    x = x.select(F.lit("feature").alias("type"), "stream_id", "sequence_nr", "name", "sparse")
    keys = x.select("stream_id", "sequence_nr").distinct()
    both = routing.fan_in(f.join(keys, ["stream_id", "sequence_nr"], "left_semi"), x)
    c = geometry.combine_features(both)
    text = F.array_join(F.transform(F.coalesce("features", F.array()), lambda q: F.concat_ws(":", q["name"], F.size(q["boxes"]).cast("string"))), ",")
    return c.select("stream_id", "sequence_nr", "n_particles", "image_type", text.alias("features"))


@query(f"""with k as (select distinct {S} as stream_id, sequence_nr from features where stream_id is not null and sequence_nr is not null),
  q as (select {S} as stream_id, sequence_nr, false as own, name, sparse, dense from features where stream_id is not null and sequence_nr is not null and name is not null),
  p as (select {S} as stream_id, sequence_nr, unnest(features) as f from frames where stream_id is not null and sequence_nr is not null),
  e as (select * from q union all select stream_id, sequence_nr, true, f.name, f.sparse, f.dense from p
    where f.name is not null and exists (select 1 from k where k.stream_id = p.stream_id and k.sequence_nr = p.sequence_nr)),
  s as (select stream_id, sequence_nr, name, unnest(sparse) as p from e),
  n as (select stream_id, sequence_nr, name, count(*) as n_sparse, sum(coalesce(len(p."values"), 0))::bigint as n_values, sum(coalesce(p.duration, 0))::bigint as duration from s group by 1, 2, 3),
  t as (select stream_id, sequence_nr, name, max({{'own': own, 'n': len(dense.data)}}) filter (where len(dense.data) > 0) as t from e group by 1, 2, 3)
select t.stream_id, t.sequence_nr, t.name, coalesce(n_sparse, 0)::bigint as n_sparse, coalesce(n_values, 0)::bigint as n_values, coalesce(duration, 0)::bigint as duration,
  coalesce(t.t.n, 0)::bigint as n_dense from t left join n on n.stream_id = t.stream_id and n.sequence_nr = t.sequence_nr and n.name = t.name""")
def combine_descriptors(spark, d):
    keep = "stream_id is not null and sequence_nr is not null"
    f = frames(spark, d).filter(keep).select(F.lit("frame").alias("type"), "stream_id", "sequence_nr", "features")
    x = table(spark, d, "features").withColumn("stream_id", normal_stream()).filter(keep)
    x = x.select(F.lit("feature").alias("type"), "stream_id", "sequence_nr", "name", "sparse", "dense")
    keys = x.select("stream_id", "sequence_nr").distinct()
    c = geometry.combine_features(routing.fan_in(f.join(keys, ["stream_id", "sequence_nr"], "left_semi"), x))
    return _described(c.select("stream_id", "sequence_nr", F.explode("features").alias("f")), ["stream_id", "sequence_nr"])


def _described(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of a merged feature f: its descriptors, their values and durations, and its dense values."""
    total = lambda c: F.aggregate("f.sparse", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(c(x).cast("long"), F.lit(0)))
    size = lambda c: F.when(c.isNotNull(), F.size(c)).otherwise(0)
    n_values, duration = total(lambda x: size(x["values"])), total(lambda x: x["duration"])
    return df.select(*keys, "f.name", F.size("f.sparse").cast("long").alias("n_sparse"), n_values.alias("n_values"), duration.alias("duration"), size(F.col("f.dense.data")).cast("long").alias("n_dense"))


@query(rf"""with t as (select regexp_replace({S}, '_[^_]*$', '') as stream_id, sequence_nr, bbox as b, unnest(features) as f from frames
    where regexp_matches({S}, '_[0-9]+_[0-9]+$') and sequence_nr is not null),
  s as (select stream_id, sequence_nr, f.name as name, b, unnest(f.sparse) as p from t)
select stream_id, sequence_nr, name, count(*) as n_sparse, sum(coalesce(len(p."values"), 0))::bigint as n_values, sum(coalesce(p.duration, 0))::bigint as duration,
  max(p.bbox.x + b.x)::int as right_most from s group by 1, 2, 3""")
def recombine_descriptors(spark, d):
    t = frames(spark, d).filter(is_tile("stream_id") & F.col("sequence_nr").isNotNull()).select("stream_id", "sequence_nr", "bbox", "features")
    r = geometry.recombine(t, features="features").select("stream_id", "sequence_nr", F.explode("features").alias("f")).filter("size(f.sparse) > 0")
    x = F.array_max(F.transform("f.sparse", lambda p: p["bbox"]["x"]))
    return _described(r.withColumn("right_most", x), ["stream_id", "sequence_nr", "right_most"]).drop("n_dense")


@query(f"""with a as (select delivery_id, bbox as fb, flatten(list_transform(coalesce(features, []), lambda f: list_transform(coalesce(f.sparse, []), lambda p: {{'n': f.name, 'b': p.bbox, 'v': coalesce(len(p."values"), 0)}}))) as al
    from frames where bbox is not null),
  u as (select delivery_id, fb, al, unnest(list_filter(al, lambda p: p.n = 'haar' and p.b is not null)) as q, generate_subscripts(list_filter(al, lambda p: p.n = 'haar' and p.b is not null), 1) - 1 as roi_nr from a),
  r as (select *, greatest(q.b.x, fb.x) as x, greatest(q.b.y, fb.y) as y, least(q.b.x + q.b.width, fb.x + fb.width) as x2, least(q.b.y + q.b.height, fb.y + fb.height) as y2 from u)
select delivery_id, roi_nr::int as roi_nr, coalesce(list_sum(list_transform(list_filter(al, lambda p: p.b.x >= x and p.b.y >= y and p.b.x < x2 and p.b.y < y2), lambda p: p.v)), 0)::bigint as n_values
from r where x2 > x and y2 > y""")
def roi_descriptors(spark, d):
    r = geometry.regions(frames(spark, d).select("delivery_id", "stream_id", "bbox", "features"), ["haar"])
    size = lambda c: F.when(c.isNotNull(), F.size(c)).otherwise(0)
    return r.select("delivery_id", "roi_nr", F.aggregate("inside", F.lit(0).cast("long"), lambda s, p: s + size(p["descriptor"]["values"])).alias("n_values"))


@query("""with s as (select delivery_id, bbox.width as w, bbox.height as h, unnest(features) as f from frames where sequence_nr % 13 < 2 and lower(trim(type)) = 'frame')
select delivery_id, f.name as name, coalesce(len(f.sparse), -1)::int as n_sparse, floor(w * 0.66 + 0.5)::int as width from s""")
def sequential_ops(spark, d):
    steps = [lambda x: routing.of_type(x, "frame"), lambda x: routing.sample(x, 13, 2), lambda x: x.withColumn("width", scaled(F.col("bbox.width"), 0.66))]
    f = geometry.sequential(table(spark, d, "frames").select("delivery_id", "type", "sequence_nr", "bbox", "features", "image"), steps, output_frame=False, retain_image=False)
    return f.select("delivery_id", "name", F.when(F.col("sparse").isNull(), -1).otherwise(F.size("sparse")).alias("n_sparse"), "width")


@query("""with h as (select delivery_id, bbox.width as w, bbox.height as h from frames where bbox is not null)
select delivery_id, floor(w * 0.66 + 0.5)::int as w66, floor(h * 0.66 + 0.5)::int as h66,
  floor(greatest(floor(greatest(floor(w * 0.5 + 0.5), 1) * 0.5 + 0.5), 1) + 0.5)::int as w25,
  floor(greatest(floor(greatest(floor(h * 0.5 + 0.5), 1) * 0.5 + 0.5), 1) + 0.5)::int as h25 from h""")
def scale_dims(spark, d):
    f = table(spark, d, "frames").filter("bbox is not null")
    w, h = F.col("bbox.width"), F.col("bbox.height")
    return f.select("delivery_id", scaled(w, 0.66).alias("w66"), scaled(h, 0.66).alias("h66"), scaled(w, 0.25).alias("w25"), scaled(h, 0.25).alias("h25"))


# ---- media ---------------------------------------------------------------------------------------------------------


@query("""select chunk_id, i as nth, sequence_nr + i * 13 as sequence_nr from chunks, range(0, 100000) r(i) where n_frames > 0 and i < n_frames""")
def video_frames(spark, d):
    return media.chunk_frames(table(spark, d, "chunks").select("chunk_id", "sequence_nr", "n_frames"), 13).select("chunk_id", "nth", "sequence_nr")


@query(f"""with r as (select {S} as stream_id, sequence_nr, image, row_number() over (partition by {S} order by sequence_nr, delivery_id) - 1 as rn
  from frames where stream_id is not null and sequence_nr is not null and image is not null)
select stream_id, rn // 30 as chunk_nr, min(sequence_nr) as sequence_nr, count(*) as n_frames, sum(octet_length(image))::bigint as n_bytes, 'frames' as container
from r group by stream_id, rn // 30""")
def video_chunk(spark, d):
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null").select("stream_id", "sequence_nr", "delivery_id", "image")
    c = media.frames_to_chunks(f, ["stream_id"], "sequence_nr", 30, ties=["delivery_id"])
    size = F.aggregate("video", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x))
    return c.select("stream_id", "chunk_nr", "sequence_nr", "n_frames", size.alias("n_bytes"), "container")


@query("""with f as (select feature_id, dense.data as v, dense.dims as ds from features where name = 'flow' and len(dense.dims) = 3 and dense.dims[3] = 2),
  g as (select feature_id, v, ds[1] * ds[2] as n from f where len(v) = ds[1] * ds[2] * 2)
select feature_id, i, round(least(sqrt(v[2 * i + 1]::double * v[2 * i + 1]::double + v[2 * i + 2]::double * v[2 * i + 2]::double), 1.0), 4) as magnitude
from g, range(0, 4096) r(i) where i < n and not isnan(v[2 * i + 1]) and not isnan(v[2 * i + 2]) and v[2 * i + 1] is not null and v[2 * i + 2] is not null""")
def flow_magnitude(spark, d):
    n = F.col("dense.dims")[0] * F.col("dense.dims")[1]
    f = table(spark, d, "features").filter((F.col("name") == "flow") & (F.size("dense.dims") == 3)).filter((F.col("dense.dims")[2] == 2) & (F.size("dense.data") == n * 2) & (n > 0))
    f = f.select("feature_id", F.col("dense.data").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i"))
    dx, dy = F.get("v", (2 * F.col("i")).cast("int")), F.get("v", (2 * F.col("i") + 1).cast("int"))
    good = ~F.isnan(dx) & ~F.isnan(dy) & dx.isNotNull() & dy.isNotNull()
    return f.filter(good).select("feature_id", "i", F.round(magnitude(dx, dy), 4).alias("magnitude"))
