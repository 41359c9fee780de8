"""More registered queries: selection, closure, overlaps, mergeable counts, joins of streams, timers. Each with the
SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import money, variant_leaves
from ..operators.closure import ancestors, fixpoint
from ..operators.distinct_counts import bitmaps, counted
from ..operators.grouping import sessions
from ..operators.joins import overlaps_among
from ..operators.quantiles import exact_quantiles
from ..sources.checked import read_lines
from ..sources.export import export, read_export, stream_export
from ..sources.layout import by_bucket, laid_out
from ..sources.tables import shared_folder, staged, table
from ..streaming import events as streams
from ..streaming import joins as stream_joins
from ..streaming.funnel import funnels

#: Buckets of the tables laid out by order.
BUCKETS = 16

Query = Callable[[SparkSession, str], DataFrame]


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, lowest percent and p90 of prices by flag, by selection, and the spread of quantities."""
    line = table(spark, sf_dir, "lineitem")
    prices = exact_quantiles(line, ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.01])
    amounts = exact_quantiles(line, ["l_returnflag"], "l_quantity", [0.5, 0.9]).select("l_returnflag", F.col("q0").alias("median"), F.col("q1").alias("p90"))
    spread = line.groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 6).alias("spread"))
    places = [F.round(f"q{i}", 4).alias(name) for i, name in enumerate(("price_median", "price_p90", "price_p01"))]
    return prices.select("l_returnflag", *places).join(amounts, "l_returnflag").join(spread, "l_returnflag")


def recursive_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and nodes at each step up from an event's number to zero, a digit less a step."""
    above = lambda c: F.floor(F.col(c) / 10).cast("long")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    nodes = fixpoint(events, lambda new: new.where("node > 0").select(above("node").alias("node")))
    pairs = ancestors(nodes.where("node > 0").select("node", above("node").alias("parent")), "node", "parent")
    own = staged(events.groupBy("node").agg(F.count(F.lit(1)).alias("events")), "hierarchy-events")
    steps = pairs.join(own, "node").groupBy(F.col("distance").alias("depth"), "ancestor").agg(F.sum("events").alias("events"))
    steps = steps.unionByName(own.select(F.lit(0).cast("long").alias("depth"), F.col("node").alias("ancestor"), "events"))
    return steps.groupBy("depth").agg(F.sum("events").alias("leaves"), F.count(F.lit(1)).alias("nodes"))


def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two users that share a moment."""
    found = staged(sessions(table(spark, sf_dir, "events"), "user_id", "ts"), "sessions")
    pairs = overlaps_among(found.select("user_id", "first_at", "last_at"), "first_at", "last_at", "user_id")
    return pairs.select(F.col("left.user_id").alias("user_id"), F.col("left.first_at").alias("first_at"), F.col("right.user_id").alias("other_id"), F.col("right.first_at").alias("other_at"))


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each day, week and month, all from the stored bitmaps of days."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id")
    days = staged(bitmaps(events, ["day"], "user_id"), "active-users")
    periods = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.unix_date(F.trunc("day", p) if p != "day" else F.col("day")).cast("long").alias("first_day")) for p in ("day", "week", "month"))))
    return counted(days.select(periods.alias("at"), "bucket", "bits").select("at.*", "bucket", "bits"), ["period", "first_day"], "users")


def streamed_clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases that follow within two hours; those without, as far as the watermark has passed."""
    def events(kind: str, name: str) -> DataFrame:
        return streams.stream(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("at").alias(f"{name}_at"))

    def run() -> DataFrame:
        return streams.finished(stream_joins.followed_within(events("click", "click"), events("purchase", "buy"), "user_id", "click_at", "buy_at", 7200, "10 minutes", "30 minutes"))

    return streams.with_settings(spark, stream_joins.STATE, run).select("user_id", "click_id", "buy_id")


def streamed_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the click and the purchase that follow within six hours each, settled by timers."""
    return streams.with_disk_state(spark, lambda: streams.finished(funnels(streams.stream(spark, sf_dir), 6 * 3600))).drop("trigger")


def co_located_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by priority and status of their orders, both tables bucketed by the order, so neither is shuffled."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", money("l_extendedprice").alias("price"))
    with by_bucket(orders, "orders_by_key", BUCKETS, "o_orderkey") as o, by_bucket(line, "lines_by_key", BUCKETS, "l_orderkey") as ln:
        joined = ln.hint("merge").join(o, ln["l_orderkey"] == o["o_orderkey"])
        sums = joined.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("price").cast("double").alias("price"), F.count(F.lit(1)).alias("lines"))
        return staged(sums, "co-located")


def pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines returned of the months in which an urgent order of the largest price was placed: of the lines, laid out
    by month, only the files of these months are read."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority like '1-%' and o_totalprice > 490000")
    months = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    line = table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    with laid_out(line.select("l_returnflag", "l_quantity", "month").repartition("month"), "lines_by_month", partition_by=["month"]) as by_month:
        sums = by_month.join(months, "month").groupBy("month", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.sum(money("l_quantity")).cast("double").alias("quantity"))
        return staged(sums, "pruned")


def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested semi-structured values by name, kind and sum, whatever fields there are."""
    nested = F.concat(F.lit('{"props": '), "props", F.lit(', "of": {"type": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}}"))
    rows = table(spark, sf_dir, "events").select(F.try_parse_json(nested).alias("v"))
    fields = variant_leaves(rows, "v", depth=2)
    kind, number = F.schema_of_variant("value"), F.try_variant_get("value", "$", "long")
    return fields.groupBy("path", F.lower(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of JSON in two versions, every seventh line cut off, and read back: records by type, and
    the broken lines as a type of their own. No line is lost."""
    events = table(spark, sf_dir, "events")
    whole, old = F.to_json(F.struct(*events.columns)), F.to_json(F.struct("event_id", "ts", "event_type"))
    line = F.when(F.col("event_id") % 7 == 3, F.expr("substring(whole, 1, length(whole) div 2)")).when(F.col("event_id") % 2 == 0, old).otherwise(F.col("whole"))
    path = shared_folder(spark, "broken-lines")
    events.withColumn("whole", whole).select(line.alias("value")).write.text(path)
    good, bad = read_lines(spark, path, events.schema)
    kinds = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("with_user"))
    return kinds.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("broken").alias("event_type"), "n", F.lit(0).cast("long").alias("with_user")))


def exported_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as an export and read back, as a table and as a stream, which must agree."""
    path = shared_folder(spark, "export")
    export(table(spark, sf_dir, "conversations"), path)
    batch = read_export(spark, path)
    streamed = streams.finished(stream_export(spark, path)).drop("trigger")
    first = batch.where("conv_id < 20").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    sums = [df.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars")) for df in (batch, streamed)]
    kinds = [df.select(F.lit(kind).alias("kind"), "role", "turns", "chars") for kind, df in (("batch", sums[0]), ("stream", sums[1]), ("first", first))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


EXTENDED: dict[str, tuple[Query, str | None]] = {
    "quantiles": (quantiles, """
        select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) as price_median, round(quantile_cont(l_extendedprice, 0.9), 4) as price_p90,
          round(quantile_cont(l_extendedprice, 0.01), 4) as price_p01, median(l_quantity) as median, quantile_cont(l_quantity, 0.9) as p90, round(stddev(l_quantity), 6) as spread
        from lineitem group by 1"""),
    "recursive_hierarchy": (recursive_hierarchy, """
        with recursive climb(event_id, node, depth) as (
          select event_id, event_id as node, 0 as depth from events
          union all
          select event_id, cast(floor(node / 10) as bigint), depth + 1 from climb where node > 0)
        select cast(depth as bigint) as depth, count(*) as leaves, count(distinct node) as nodes from climb group by depth"""),
    "overlapping_sessions": (overlapping_sessions, """
        with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g),
        w as (select user_id, min(ts) as first_at, max(ts) as last_at from s group by user_id, session)
        select a.user_id, a.first_at, b.user_id as other_id, b.first_at as other_at from w a join w b on a.user_id < b.user_id and a.first_at <= b.last_at and b.first_at <= a.last_at"""),
    "active_users": (active_users, """
        select period, cast(date_diff('day', date '1970-01-01', cast(date_trunc(period, ts) as date)) as bigint) as first_day, count(distinct user_id) as users
        from events, (values ('day'), ('week'), ('month')) p(period) group by 1, 2"""),
    "streamed_clicks_to_purchases": (streamed_clicks_to_purchases, """
        with c as (select * from events where event_type = 'click'), b as (select * from events where event_type = 'purchase'),
        p as (select c.user_id, c.event_id as click_id, b.event_id as buy_id from c join b on b.user_id = c.user_id and b.ts >= c.ts and b.ts <= c.ts + interval 2 hour)
        select * from p
        union all select user_id, event_id, null from c where event_id not in (select click_id from p)
          and ts + interval 2 hour < least((select max(ts) from c) - interval 10 minute, (select max(ts) from b) - interval 30 minute)"""),
    "streamed_funnels": (streamed_funnels, """
        with e as (select * from events where event_type in ('view', 'click', 'purchase')),
        c as (select v.user_id, v.event_id as view_id, v.ts, min(k.ts) as click_at, arg_min(k.event_id, k.ts) as click_id
          from e v left join e k on k.user_id = v.user_id and k.event_type = 'click' and k.ts > v.ts and k.ts <= v.ts + interval 6 hour where v.event_type = 'view' group by all),
        p as (select c.user_id, c.view_id, c.ts, c.click_id, arg_min(k.event_id, k.ts) as buy_id
          from c left join e k on k.user_id = c.user_id and k.event_type = 'purchase' and k.ts > c.click_at and k.ts <= c.click_at + interval 6 hour group by all)
        select user_id, view_id, click_id, buy_id from p where ts + interval 12 hour <= (select max(ts) from e) - interval 10 minute"""),
    "co_located_join": (co_located_join, """
        select o_orderpriority, o_orderstatus, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price, count(*) as lines
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"""),
    "pruned_partitions": (pruned_partitions, """
        select strftime(l_shipdate, '%Y-%m') as month, l_returnflag, count(*) as lines, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem
        where strftime(l_shipdate, '%Y-%m') in (select strftime(o_orderdate, '%Y-%m') from orders where o_orderpriority like '1-%' and o_totalprice > 490000) group by 1, 2"""),
    "variant_fields": (variant_fields, """
        select '$.props.k' as path, 'bigint' as kind, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events
        union all select '$.of.type', 'string', count(*), null from events
        union all select '$.of.user', 'bigint', count(*), cast(sum(user_id) as bigint) from events"""),
    "exported_conversations": (exported_conversations, """
        select kind, role, count(*) as turns, cast(sum(length(text)) as bigint) as chars from conversations, (values ('batch'), ('stream'), ('first')) k(kind)
        where kind <> 'first' or conv_id < 20 group by 1, 2"""),
    "broken_lines": (broken_lines, """
        select event_type, count(*) as n, count(*) filter (where event_id % 2 = 1) as with_user from events where event_id % 7 <> 3 group by 1
        union all select 'broken', count(*), 0 from events where event_id % 7 = 3"""),
}
