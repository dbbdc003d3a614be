"""Queries of streams, run to the end of what is there and read back. Registered as those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.plans.registry import query
from lattica.sources import pages, scratch
from lattica.streaming import events as E
from lattica.streaming import presence, sink, state


def _stream(t, parts: int = 3):
    """The events table as a stream of a few files, in order of time."""
    at = scratch.folder(t.spark, "events")
    x = t("events")
    cut = x.withColumn("part", F.pmod("event_id", F.lit(parts)).cast("int"))
    for i in range(parts):
        cut.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(at)
    return E.connections(t.spark, at, x.schema, most_files=1)


@query("select user_id from events group by user_id having arg_max(event_type, (ts, event_type)) <> 'error'")
def s22_connections(t):
    """Who is online after the stream, which is stopped half-way and started again: the keyed state."""
    at, check = scratch.folder(t.spark, "online"), scratch.folder(t.spark, "check")
    stream = _stream(t).select(F.col("user_id").alias("conn_id"), "ts", F.col("event_type").alias("kind"))
    running = state.start(state.presence(stream, closing="error"), at, check, once=False)
    try:
        while not [p for p in running.recentProgress if p.batchId >= 0 and p.numInputRows]:
            if not running.awaitTermination(1):
                continue
    finally:
        running.stop()
    E.finish(state.start(state.presence(stream, closing="error"), at, check))
    return state.online(t.spark, check, closing="error").select(F.col("conn_id").alias("user_id"))


@query("select event_id::varchar as id, value from events where event_type = 'purchase'")
def s23_webhook(t):
    """Posted events of one type, from JSON lines."""
    at, to = scratch.folder(t.spark, "hook"), scratch.folder(t.spark, "paid")
    t("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("created"), F.to_json(F.struct("value")).alias("payload")).write.json(at)
    E.finish(E.routed(E.webhook(t.spark, at, 2), {"paid": (F.col("type") == "purchase", to)}, scratch.folder(t.spark, "check")))
    return t.spark.read.parquet(to).select("id", F.get_json_object("payload", "$.value").cast("double").alias("value"))


@query("select count(distinct user_id) as known, count(*) as events, 3::bigint as batches from events")
def k05_micro_batches(t):
    """Batches of one file each, flushed as they come, every 1000 rows into a file of its own."""
    to = scratch.folder(t.spark, "flushed")
    E.finish(sink.start(_stream(t), to, scratch.folder(t.spark, "check"), columns="event_id,user_id", rows=1000))
    return sink.committed(t.spark, to, "event_id long, user_id long").agg(F.countDistinct("user_id").alias("known"), F.count(F.lit(1)).alias("events"), F.countDistinct("batch").alias("batches"))


@query("with u as (select event_id % 3 as epoch, user_id, ts, event_type from events), s as (select e.epoch, u.user_id, arg_max(u.event_type, (u.ts, u.event_type)) as kind from (select unnest(range(3)) as epoch) e join u on u.epoch <= e.epoch group by 1, 2) select epoch, count(*) filter (kind <> 'error') as online from s group by 1")
def t02_snapshots(t):
    """Number online after each batch, from the state as it was then."""
    check = scratch.folder(t.spark, "check")
    stream = _stream(t).select(F.col("user_id").alias("conn_id"), "ts", F.col("event_type").alias("kind"))
    E.finish(state.start(state.presence(stream, closing="error"), scratch.folder(t.spark, "changes"), check))
    after = lambda n: state.online(t.spark, check, "error", n).agg(F.count(F.lit(1)).alias("online")).select(F.lit(n).cast("bigint").alias("epoch"), "online")
    return after(0).unionAll(after(1)).unionAll(after(2))


@query("with o as (select user_id from events group by user_id having arg_max(event_type, (ts, event_type)) <> 'error') select event_id, (select count(*) from o) as answer from events where event_type = 'click'")
def t03_reply(t):
    state = presence.online(t("events"), "user_id", "ts", "event_type", closing="error").agg(F.count(F.lit(1)).alias("n"))
    return E.reply(t("events"), state, "event_type", "click", F.col("n")).select("event_id", "answer")


@query("select count(*) as n, 1::bigint as last from events")
def t09_polling(t):
    """A query that polls at an interval, stopped once all is there."""
    to = scratch.folder(t.spark, "polled")
    running = E.each_batch(_stream(t), lambda b, n: b.write.mode("overwrite").parquet(f"{to}/batch={n}"), scratch.folder(t.spark, "check"), every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return t.spark.read.parquet(to).agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("last"))


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'removed' else 'added' end as change from orders where (o_orderkey % 10 = 0) <> (o_orderkey % 15 = 0) and o_orderkey % 10 * (o_orderkey % 15) = 0")
def t10_alerts(t):
    old, new = t("orders").where("o_orderkey % 10 = 0"), t("orders").where("o_orderkey % 15 = 0")
    return E.alerts(old, new, ["o_orderkey"])


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s")
def t11_idle_sessions(t):
    return E.sessions(t("events"), "user_id", "ts", "2 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select event_id, 'tagged' as sink, 'TMSG ' || event_type as message from events where event_id % 4 = 0 union all select event_id, 'plain', event_type from events where event_id % 4 <> 0")
def t12_tagged_routing(t):
    tagged, plain = scratch.folder(t.spark, "tagged"), scratch.folder(t.spark, "plain")
    stream = _stream(t).select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("TMSG "), "event_type")).otherwise(F.col("event_type")).alias("message"))
    hit = F.col("message").startswith("TMSG ")
    E.finish(E.routed(stream, {"tagged": (hit, tagged), "plain": (~hit, plain)}, scratch.folder(t.spark, "check")))
    read = lambda p, n: t.spark.read.parquet(p).select("event_id", F.lit(n).alias("sink"), "message")
    return read(tagged, "tagged").unionAll(read(plain, "plain"))


@query("select user_id, floor(round(sum(value) / count(value), 9) * 10 + 0.5) / 10 as average, count(value) as quantity from events group by 1")
def t13_maintained(t):
    check = scratch.folder(t.spark, "check")
    E.finish(state.maintained(_stream(t), "user_id", "value", scratch.folder(t.spark, "ratings"), check))
    return state.ratings(t.spark, check, "user_id", None)


@query("with r as (select user_id, event_type, max_by([case when event_id % 7 = 0 then null else value end], (event_id % 3, event_id)) as v from events where event_type is not null group by 1, 2) select user_id, floor(round(sum(v[1]) / count(v[1]), 9) * 10 + 0.5) / 10 as average, count(v[1]) as quantity from r group by 1 having count(v[1]) > 0")
def t13_reviews(t):
    """A user rates each type anew with every event, some take the rating back; averages follow each change of one review."""
    check = scratch.folder(t.spark, "check")
    changes = _stream(t).select(F.col("user_id").alias("product"), F.col("event_type").alias("review"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("rating"))
    E.finish(state.start(state.reviews(changes), scratch.folder(t.spark, "reviews"), check))
    return state.ratings(t.spark, check, "user_id")


@query("select event_type, count(*) as n from events where event_type in ('click', 'purchase') group by 1")
def t14_handlers(t):
    paths = {k: scratch.folder(t.spark, k) for k in ("click", "purchase")}
    E.finish(E.routed(_stream(t), {k: (F.col("event_type") == k, p) for k, p in paths.items()}, scratch.folder(t.spark, "check")))
    return t.spark.read.parquet(paths["click"]).unionByName(t.spark.read.parquet(paths["purchase"])).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
