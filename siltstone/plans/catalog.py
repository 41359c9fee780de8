"""The registered queries of the relational and streaming operators, with the SQL that DuckDB answers alike.

Where one text is good SQL in both engines it serves both. Sums of money are decimal, widths are cast, and
orders have tie-breakers, so that results don't depend on the engine or on partitioning.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dot, json_long, masked_emails, money, revenue
from ..operators.grouping import ranked, running_total, sessions, tile, top_per_key
from ..operators.joins import asof_join, band_join, interval_join, skewed_join
from ..sources.tables import TABLES, round_trip, table
from ..streaming import events as streams
from .extended import EXTENDED

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "revenue_by_nation"

#: SQL that both engines run as it is.
SHARED_SQL: dict[str, str] = {
    "outer_joins": """
        select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'
        union all select c_custkey, o_orderkey from customer right join orders on c_custkey = o_custkey and c_mktsegment = 'BUILDING'""",
    "full_outer_join": """
        select coalesce(c.n, s.n) as nation, c.customers, s.suppliers
        from (select c_nationkey as n, count(*) as customers from customer where c_acctbal > 8000 group by c_nationkey) c
        full outer join (select s_nationkey as n, count(*) as suppliers from supplier where s_acctbal > 5000 group by s_nationkey) s on c.n = s.n""",
    "semi_and_anti_join": """
        select 'with' as kind, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)
        union all select 'without', count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "filtered_and_distinct_aggregates": """
        select l_returnflag, l_linestatus, count(distinct l_suppkey) as suppliers, count(*) filter (where l_discount > 0.05) as discounted,
          cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, cast(max(l_tax) as double) as most_tax
        from lineitem group by l_returnflag, l_linestatus having count(*) > 10""",
    "window_frames": """
        select event_id, cast(sum(cast(value as decimal(18,4))) over w as double) as moving, first_value(event_id) over w as first_id, last_value(event_id) over w as last_id,
          cast(count(*) over (partition by user_id order by ts range between interval '1' day preceding and current row) as bigint) as in_a_day
        from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 1 following)""",
    "limit_and_offset": """
        select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 5""",
    "set_operations": """
        (select c_nationkey as k from customer intersect select s_nationkey from supplier)
        union all (select n_nationkey from nation except select s_nationkey from supplier where s_acctbal > 0)
        union all (select o_custkey from orders where o_orderstatus = 'F' intersect all select o_custkey from orders where o_orderstatus = 'O')
        union all (select o_custkey from orders where o_orderstatus = 'O' except all select o_custkey from orders where o_orderstatus = 'P')
        union (select n_regionkey from nation)""",
    "nth_events": """
        select event_id, nth_value(event_id, 2) over w as second_id, nth_value(event_type, 3) over w as third_type
        from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)""",
    "explicit_grouping_sets": """
        select l_returnflag, l_linestatus, cast(l_linenumber as bigint) as l_linenumber, cast(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) as bigint) as level, count(*) as n,
          cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
        from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), (l_returnflag, l_linenumber), ())""",
    "case_and_nulls": """
        select n_regionkey, cast(sum(case when c_acctbal < 0 then 1 else 0 end) as bigint) as in_debt, count(nullif(c_mktsegment, 'BUILDING')) as others, coalesce(min(nullif(c_nationkey, n_regionkey)), -1) as least
        from customer join nation on c_nationkey = n_nationkey group by n_regionkey""",
    "market_share": """
        select cast(extract(year from o_orderdate) as bigint) as y, n_name,
          cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2)))) as double) as volume
        from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1998-01-01 00:00:00' group by 1, 2""",
    "pricing_summary": """
        select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_base,
          cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2))) * (1 + cast(l_tax as decimal(3,2)))) as double) as sum_charge, count(*) as n
        from lineitem where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "forecast_revenue": """
        select cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(3,2))) as double) as revenue, count(*) as n from lineitem
        where l_shipdate >= timestamp '1997-01-01 00:00:00' and l_shipdate < timestamp '1998-01-01 00:00:00' and l_discount between 0.03 and 0.07 and l_quantity < 24""",
    "unshipped_priority": """
        select o_orderkey, o_orderpriority, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2)))) as double) as revenue
        from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15 00:00:00' and l_shipdate > timestamp '1998-03-15 00:00:00' group by o_orderkey, o_orderpriority""",
}


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables of a folder, which are passed as frames: the session's own views stay as they are."""
    named = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text)
    return spark.sql(named, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in named})


def _sql(text: str) -> Query:
    return lambda spark, sf_dir: query(spark, sf_dir, text)


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    by_order = line.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"), F.count(F.lit(1)).alias("n"))
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, F.col("n_regionkey") == region.r_regionkey)
    rows = by_order.join(orders, by_order.l_orderkey == orders.o_orderkey).join(named, F.col("o_custkey") == named.c_custkey)
    return rows.groupBy("r_name", "n_name").agg(F.sum("r").cast("double").alias("revenue"), F.sum("n").alias("lines"))


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers of a nation where the first has less: the second's rank says how many those are, so no pair
    is made."""
    placed = ranked(table(spark, sf_dir, "supplier").where("s_acctbal is not null and s_nationkey is not null"), ["s_nationkey"], [("s_acctbal", False)])
    return placed.groupBy("s_nationkey").agg(F.sum(F.col("rank") - 1).alias("pairs")).where("pairs > 0")


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance lies within what the suppliers of a nation have: a join without an equality."""
    bands = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    pairs = band_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", bands, "low", "high", 250.0)
    return pairs.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.max("c_custkey").alias("last_customer"))


def correlated_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts above the mean of their brand that no large line holds. An anti join, as `not in` would broadcast the lines."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_partkey is not null")
    mean = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    above = part.join(mean, "p_brand").where("p_retailprice > mean")
    return above.join(line, above["p_partkey"] == line["l_partkey"], "left_anti").select("p_partkey", "p_brand")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within few keys in two levels: a range of about as many rows as any other is ranked in one task."""
    orders = table(spark, sf_dir, "orders")
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate", F.row_number().over(own).cast("long").alias("rn"), F.lag("o_orderkey").over(own).alias("earlier"))
    rows = ranked(rows, ["o_orderpriority"], [("o_totalprice", True)], rank="rk").drop("number", "of")
    kinds = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))
    dense = F.dense_rank().over(W.partitionBy("o_orderpriority").orderBy("o_orderstatus")).cast("long")  # a row for each priority and status
    rows = rows.join(kinds.select("o_orderpriority", "o_orderstatus", dense.alias("dr")), ["o_orderpriority", "o_orderstatus"])
    rows = ranked(rows, ["o_orderstatus"], [("o_orderdate", False), ("o_orderkey", False)])
    return rows.select("o_orderkey", "rk", "dr", "rn", "earlier", tile(F.col("number"), F.col("of"), 4).alias("quarter"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    level = (F.grouping("l_returnflag") * 2 + F.grouping("l_linestatus")).cast("long").alias("level")
    measures = [F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("price")]
    return line.cube("l_returnflag", "l_linestatus").agg(level, *measures).unionByName(line.rollup("l_returnflag", "l_linestatus").agg((level + 10).alias("level"), *measures))


def distinct_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch is within five standard errors of the exact count. Both are of the distinct keys, which give
    the sketch that all rows give: beside a distinct count Spark would keep a sketch for each key."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    both = keys.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about"), F.count("l_orderkey").alias("exact"))
    return both.select("exact", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"))


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return top_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest orders of each customer with a balance above 5000; nulls of dates and keys come last."""
    return query(spark, sf_dir, "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc nulls last, o_orderkey nulls last limit 2) t where c_acctbal > 5000")


def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return asof_join(buys, views, "user_id", "ts", "view_ts", ["view_id"]).select("event_id", "user_id", "view_id")


def clicks_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    return interval_join(clicks, buys, "user_id", "click_ts", "buy_ts", 6 * 3600).select("user_id", "click_id", "buy_id")


def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return skewed_join(line.withColumnRenamed("l_suppkey", "s_suppkey"), supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("price", money("o_totalprice"))
    total = running_total(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "price")
    return total.select("o_orderkey", F.col("running").cast("double").alias("running"))


def pivot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


def unpivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return wide.unpivot("o_orderpriority", ["f", "o", "p"], "status", "n").where("n > 0")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_long("props", "$.k").alias("k"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"), F.size("embedding").cast("long").alias("width"))


def exploded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return v.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.count_if(F.col("x") > 0).alias("positive"))


def near_label_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose product with the mean vector of their label reaches a threshold. The means are put together once a
    label and joined as one array; vectors stay whole."""
    v = table(spark, sf_dir, "embeddings").select("label", "embedding")
    means = v.select("label", F.posexplode("embedding").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "mean")))["mean"].alias("centre"))
    product = v.join(centre, "label").select("label", dot(F.col("embedding"), F.col("centre")).alias("product"))
    return product.groupBy("label").agg(F.count_if(F.col("product") >= 0.02).alias("near"), F.count(F.lit(1)).alias("n"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("hour"), "event_type", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "first_at", "last_at", "n")


def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.latest(streams.finished(streams.tumbling(streams.stream(spark, sf_dir)), "update"), ["w", "event_type"])
    return out.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", F.col("total").cast("double").alias("total"))


def streamed_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.first_of_each(streams.stream(spark, sf_dir), ["event_id"])).select("event_id", "user_id")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return streams.finished(streams.sessions(streams.stream(spark, sf_dir))).select("user_id", "first_at", "last_at", "n")


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = streams.with_disk_state(spark, lambda: streams.finished(streams.active_days(streams.stream(spark, sf_dir)), "update"))
    return streams.latest(days, ["user_id"]).select("user_id", "days", "busiest")


def text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("masked", masked_emails(F.col("text")))
    return docs.where("masked != text").select("doc_id", F.md5("masked").alias("masked"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("digest"), F.size("t").cast("long").alias("turns"))


def labelled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.upper("p_name").alias("upper"), F.greatest("p_size", F.lit(10)).alias("most"), F.sha2("p_brand", 256).alias("sha"), F.split("p_name", " ")[0].alias("first_word"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.substring("p_type", 2, 3).alias("middle"), (F.col("p_size") % 7).alias("rest"), F.reverse("p_brand").alias("back"), F.expr("try_cast(p_brand as int)").alias("none"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.expr("p_size div 7").alias("sevens"), F.round(F.col("p_retailprice") / 3, 2).alias("third"),
    )


def previous_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("event_id", (micros - F.lag(micros).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap_us"))


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function in SQL, under a name of its own, which goes when the query is planned."""
    name = f"net_price_{uuid.uuid4().hex}"
    spark.sql(f"create temporary function {name}(price double, discount double) returns decimal(22,4) return cast(price as decimal(18,2)) * (1 - cast(discount as decimal(3,2)))")
    try:
        return query(spark, sf_dir, f"select l_linestatus, cast(sum({name}(l_extendedprice, l_discount)) as double) as net from lineitem group by l_linestatus")
    finally:
        spark.sql(f"drop temporary function {name}")


def jaro_winkler(a: str, b: str) -> float:
    """Likeness of two strings, 0 to 1: matches within half the longer one's length, less half of the transposed ones,
    and a bonus for up to four equal first characters if it is above 0.7."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return score + same * 0.1 * (1 - score) if score > 0.7 else score


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def vectorised_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a part's name and its type, which no function of Spark gives, in Arrow batches."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat("p_type", F.lit(" "), "p_brand")).alias("b"))
    return part.select("p_partkey", F.round(_likeness("a", "b"), 6).alias("likeness"))


def _spaced(events: pd.DataFrame) -> pd.DataFrame:
    """Of a user's events in a month, in order, those at least a day after the last one kept: each choice depends on
    the one before."""
    kept, last = 0, None
    for us in np.sort(events["us"].to_numpy()):
        if last is None or us >= last + 86_400_000_000:
            kept, last = kept + 1, us
    return pd.DataFrame({"user_id": events["user_id"].iloc[:1], "month": events["month"].iloc[:1], "n": [len(events)], "kept": [kept]})


def grouped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas function for each user and month, a group that what a person does in a month bounds."""
    at = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select("user_id", F.unix_date(F.trunc(at.cast("date"), "month")).cast("long").alias("month"), F.unix_micros(at).alias("us"))
    return events.groupBy("user_id", "month").applyInPandas(_spaced, "user_id long, month long, n long, kept long")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part's name with their places, from 1, by a table function joined laterally."""
    words = spark.tvf.posexplode(F.split(F.col("p_name").outer(), " ")).toDF("at", "word")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name").lateralJoin(words)
    return rows.select("p_partkey", (F.col("at") + 1).cast("long").alias("place"), "word")


def _through(kind: str) -> Query:
    return lambda spark, sf_dir: round_trip(table(spark, sf_dir, "events"), kind, ["event_type"] if kind == "parquet" else [])


BUILT: dict[str, tuple[Query, str | None]] = {
    "revenue_by_nation": (revenue_by_nation, """
        select r_name, n_name, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2)))) as double) as revenue, count(*) as lines
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"""),
    "grouping_sets": (grouping_sets, """
        select l_returnflag, l_linestatus, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as bigint) as level, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
        from lineitem group by cube (l_returnflag, l_linestatus)
        union all select l_returnflag, l_linestatus, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) + 10 as bigint), count(*), cast(sum(cast(l_extendedprice as decimal(18,2))) as double)
        from lineitem group by rollup (l_returnflag, l_linestatus)"""),
    "theta_join": (theta_join, """
        select a.s_nationkey, count(*) as pairs from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal group by a.s_nationkey"""),
    "price_bands": (price_bands, """
        select s_nationkey, count(*) as customers, max(c_custkey) as last_customer from (select s_nationkey, min(s_acctbal) as low, max(s_acctbal) as high from supplier group by 1)
        join customer on c_acctbal between low and high group by 1"""),
    "correlated_subqueries": (correlated_subqueries, """
        select p_partkey, p_brand from part where p_retailprice > (select avg(p2.p_retailprice) from part p2 where p2.p_brand = part.p_brand)
          and p_partkey not in (select l_partkey from lineitem where l_quantity >= 50)"""),
    "ranks": (ranks, """
        select o_orderkey, cast(rank() over (partition by o_orderpriority order by o_totalprice desc) as bigint) as rk,
          cast(dense_rank() over (partition by o_orderpriority order by o_orderstatus) as bigint) as dr,
          cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as rn,
          lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as earlier,
          cast(ntile(4) over (partition by o_orderstatus order by o_orderdate, o_orderkey) as bigint) as quarter
        from orders"""),
    "near_label_centre": (near_label_centre, """
        with v as (select vec_id, label, place, embedding[place]::double as x from embeddings, range(1, 65) r(place)), m as (select label, place, avg(x) as mean from v group by 1, 2),
        p as (select label, vec_id, sum(x * mean) as product from v join m using (label, place) group by 1, 2)
        select label, count(*) filter (where product >= 0.02) as near, count(*) as n from p group by 1"""),
    "streamed_sessions": (streamed_sessions, """
        with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g),
        w as (select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n from s group by user_id, session)
        select * from w where last_at + interval 30 minute <= (select max(ts) from events) - interval 10 minute"""),
    "streamed_days": (streamed_days, "select user_id, count(*) as days, max(n) as busiest from (select user_id, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2) group by 1"),
    "grouped_frames": (grouped_frames, """
        with recursive e as (select user_id, cast(date_diff('day', date '1970-01-01', cast(date_trunc('month', ts) as date)) as bigint) as month, epoch_us(ts) as us from events),
        k as (
          select user_id, month, min(us) as us from e group by 1, 2
          union all
          select k.user_id, k.month, min(e.us) from k join e on e.user_id = k.user_id and e.month = k.month and e.us >= k.us + 86400000000 group by 1, 2)
        select user_id, month, n, kept from (select user_id, month, count(*) as n from e group by 1, 2) join (select user_id, month, count(*) as kept from k group by 1, 2) using (user_id, month)"""),
    "table_function": (table_function, "select p_partkey, cast(place as bigint) as place, string_split(p_name, ' ')[place] as word from (select *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as place from part)"),
    "distinct_estimate": (distinct_estimate, "select count(distinct l_orderkey) as exact, true as within from lineitem"),
    "top_orders_per_customer": (top_orders_per_customer, "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3"),
    "lateral_top": (lateral_top, "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc nulls last, o_orderkey nulls last limit 2) t where c_acctbal > 5000"),
    "asof_purchase": (asof_purchase, """
        select b.event_id, b.user_id, v.event_id as view_id from (select * from events where event_type = 'purchase') b
        asof left join (select * from events where event_type = 'view') v on b.user_id = v.user_id and b.ts >= v.ts"""),
    "clicks_before_purchase": (clicks_before_purchase, """
        select c.user_id, c.event_id as click_id, b.event_id as buy_id from events c join events b on c.user_id = b.user_id and c.event_type = 'click' and b.event_type = 'purchase'
        and b.ts >= c.ts and b.ts <= c.ts + interval 6 hour"""),
    "salted_join": (salted_join, "select s_nationkey, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1"),
    "running_spend": (running_spend, "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_orderstatus order by o_orderdate, o_orderkey rows unbounded preceding) as double) as running from orders"),
    "pivot_events": (pivot_events, "select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'signup') as signup, count(*) filter (where event_type = 'view') as view from events group by 1"),
    "unpivot_counts": (unpivot_counts, "select o_orderpriority, lower(o_orderstatus) as status, count(*) as n from orders group by 1, 2"),
    "json_fields": (json_fields, "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "vector_norms": (vector_norms, "select vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 5) as norm2, cast(len(embedding) as bigint) as width from embeddings"),
    "exploded_vectors": (exploded_vectors, "select label, cast(place - 1 as bigint) as place, count(*) filter (where embedding[place] > 0) as positive from embeddings, range(1, 65) r(place) group by 1, 2"),
    "hourly_events": (hourly_events, "select cast(epoch(date_trunc('hour', ts)) as bigint) as hour, event_type, count(*) as n from events group by 1, 2"),
    "user_sessions": (user_sessions, """
        with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
        select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n from s group by user_id, session"""),
    "streamed_hours": (streamed_hours, "select cast(epoch(date_trunc('hour', ts)) as bigint) as hour, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2"),
    "streamed_first_events": (streamed_first_events, "select event_id, user_id from events"),
    "text_copies": (text_copies, "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1"),
    "masked_text": (masked_text, r"select doc_id, md5(masked) as masked from (select doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') as masked from documents) where masked <> text"),
    "page_titles": (page_titles, "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as host from pages"),
    "dialogues": (dialogues, "select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn, role, text)) as digest, count(*) as turns from conversations group by 1"),
    "labelled_rates": (labelled_rates, "select lang, count(*) as n, cast(sum(quality) as bigint) as good, cast(sum(toxic) as bigint) as toxic from documents join labels using (doc_id) group by 1"),
    "scalar_functions": (scalar_functions, """
        select p_partkey, upper(p_name) as upper, greatest(p_size, 10) as most, sha256(p_brand) as sha, split_part(p_name, ' ', 1) as first_word, lpad(cast(p_size as varchar), 4, '0') as padded,
          substring(p_type, 2, 3) as middle, p_size % 7 as rest, reverse(p_brand) as back, try_cast(p_brand as int) as none, trim('  ' || p_name || ' ') as trimmed, cast(p_size // 7 as bigint) as sevens, round(p_retailprice / 3, 2) as third from part"""),
    "previous_gap": (previous_gap, "select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap_us from events"),
    "sql_function": (sql_function, "select l_linestatus, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2)))) as double) as net from lineitem group by 1"),
    "vectorised_function": (vectorised_function, "select p_partkey, round(jaro_winkler_similarity(lower(p_name), lower(p_type || ' ' || p_brand)), 6) as likeness from part"),
    **{f"{kind}_round_trip": (_through(kind), "select * from events") for kind in ("parquet", "orc", "json", "csv")},
}

BUILT |= EXTENDED
QUERIES: dict[str, Query] = {name: _sql(text) for name, text in SHARED_SQL.items()} | {name: q for name, (q, _) in BUILT.items()}
ORACLES: dict[str, str] = SHARED_SQL | {name: text for name, (_, text) in BUILT.items() if text}
