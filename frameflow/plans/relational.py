"""What Spark gives for free, over the relational tables: joins, aggregates, windows, sets, sorts and dates as SQL."""

from __future__ import annotations

from frameflow.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Spark SQL and DuckDB read these alike.
BOTH = {
    "sql_pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
  round(avg(l_discount), 6) as avg_disc, count(*) as n_rows from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "sql_join_revenue": """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate >= timestamp '1994-01-01 00:00:00' and o_orderdate < timestamp '1996-01-01 00:00:00' group by n_name""",
    "sql_outer_join": """select c_custkey, count(o_orderkey) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on c_custkey = o_custkey group by c_custkey""",
    "sql_semi_anti": """select 'with' as kind, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)
union all select 'without' as kind, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey)""",
    "sql_rollup": """select l_returnflag, l_linestatus, cast(grouping(l_returnflag) + grouping(l_linestatus) as bigint) as level, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)""",
    "sql_cube": """select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """select event_type, user_id, count(*) as n, round(max(value), 6) as top from events group by grouping sets ((event_type), (user_id), ())""",
    "sql_rank": """select c_nationkey, c_custkey, r from (select c_nationkey, c_custkey, cast(dense_rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as bigint) as r from customer) where r <= 3""",
    "sql_frame_window": """select event_id, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 4) as moving, cast(ntile(4) over (partition by user_id order by event_id) as bigint) as quarter from events""",
    "sql_top_k": """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""",
    "sql_set_ops": """select p_brand as v from part where p_size > 25 intersect select p_brand from part where p_size <= 25 except select p_brand from part where p_retailprice < 0""",
    "sql_distinct": """select distinct o_orderstatus, o_orderpriority from orders""",
    "sql_dates": """select cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, count(*) as n, round(avg(o_totalprice), 2) as mean from orders group by 1, 2""",
    "sql_having_case": """select s_nationkey, cast(sum(case when s_acctbal > 0 then 1 else 0 end) as bigint) as positive, count(*) as n from supplier group by s_nationkey having count(*) > 1""",
    "sql_session_gaps": """select user_id, count(*) as n_sessions from (select user_id, case when unix_seconds_gap > 1800 or unix_seconds_gap is null then 1 else 0 end as s
from (select user_id, GAP as unix_seconds_gap from events)) where s = 1 group by user_id""",
    "sql_as_of": """select event_id, before_id from (select event_id, event_type,
  max(case when event_type <> 'error' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before_id from events)
where event_type = 'error' and before_id is not null""",
}
SPARK_GAP = "unix_seconds(cast(ts as timestamp)) - unix_seconds(cast(lag(ts) over (partition by user_id order by event_id) as timestamp))"
DUCK_GAP = "cast(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id order by event_id))) as bigint)"


def _run(sql: str):
    def run(spark, d):
        for t in TABLES:
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


QUERIES = {n: _run(s.replace("GAP", SPARK_GAP)) for n, s in BOTH.items()}
ORACLES = {n: s.replace("GAP", DUCK_GAP) for n, s in BOTH.items()}
