"""Incremental synchronisation and event-time windows in batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.operators.mirror import Mirror
from granary.sources.staging import shared_folder
from granary.sources.versions import VersionedTables
from granary.streaming import state as St
from granary.streaming import sync as S
from granary.streaming import windows as W

from .base import query, table

FEED = """feed AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type || CAST(event_id % 3 AS VARCHAR) END AS fingerprint,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS doc_updated_at, event_id // 100 AS batch, event_id % 100 AS ord, CAST(event_id % 997 AS BIGINT) AS size FROM events)"""
KNOWN = "known AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN 'click0' WHEN 1 THEN 'view1' ELSE 'purchase2' END AS fingerprint FROM customer WHERE c_custkey % 2 = 0)"
TAKEN = """taken AS (SELECT f.*, CASE WHEN k.id IS NULL AND row_number() OVER (PARTITION BY f.id ORDER BY batch, ord) = 1 THEN 'added' ELSE 'updated' END AS change
 FROM feed f LEFT JOIN known k USING (id) WHERE NOT coalesce(f.fingerprint = k.fingerprint, false))"""


def feed(spark, d):
    e = table(spark, d, "events")
    token = F.when(F.col("event_id") % 11 != 0, F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    return e.select(
        F.col("user_id").cast("string").alias("id"), token.alias("fingerprint"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("doc_updated_at"),
        F.floor(F.col("event_id") / 100).alias("batch"), (F.col("event_id") % 100).alias("ord"), (F.col("event_id") % 997).alias("size"),
    )


def known(spark, d):
    k = F.col("c_custkey") % 3
    token = F.when(k == 0, "click0").when(k == 1, "view1").otherwise("purchase2")
    return table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), token.alias("fingerprint"))


@query("fingerprint_skip", f"WITH {FEED}, {KNOWN}, {TAKEN} SELECT id, fingerprint, batch, ord FROM taken")
def fingerprint_skip(spark, d):
    return S.changed_only(feed(spark, d), known(spark, d)).select("id", "fingerprint", "batch", "ord")


@query("sync_classify", f"WITH {FEED}, {KNOWN}, {TAKEN} SELECT id, batch, ord, change FROM taken")
def sync_classify(spark, d):
    return S.classified(S.changed_only(feed(spark, d), known(spark, d)), known(spark, d)).select("id", "batch", "ord", "change")


@query(
    "sync_summary",
    f"""WITH {FEED}, {KNOWN}, {TAKEN}, c AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'updated') AS updated, greatest(max(doc_updated_at), '2000') AS next_start FROM taken),
 g AS (SELECT count(*) AS deleted FROM (SELECT id FROM known UNION SELECT id FROM taken) WHERE id NOT IN (SELECT id FROM feed))
 SELECT added, updated, (SELECT count(*) FROM feed) - added - updated AS skipped, deleted, added + updated + deleted AS total, next_start FROM c, g""",
)
def sync_summary(spark, d):
    f = feed(spark, d)
    return S.summary(f, known(spark, d), "2000", f)


@query("poll_window", f"WITH {FEED} SELECT batch, max(doc_updated_at) AS latest, max(max(doc_updated_at)) OVER (ORDER BY batch) AS next_start FROM feed GROUP BY batch")
def poll_window(spark, d):
    """High-water mark after each batch: the next run starts there."""
    from pyspark.sql import Window

    per = feed(spark, d).groupBy("batch").agg(F.max("doc_updated_at").alias("latest"))
    return per.withColumn("next_start", F.max("latest").over(Window.orderBy("batch")))


@query(
    "batch_budget",
    f"""WITH {FEED}, u AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth FROM feed WINDOW w AS (PARTITION BY batch ORDER BY ord)),
 o AS (SELECT *, min(CASE WHEN upto > 20000 THEN nth END) OVER (PARTITION BY batch) AS over FROM u)
 SELECT batch, ord, CASE WHEN nth > 60 THEN 'left' WHEN nth < coalesce(over, 61) THEN 'taken' WHEN nth = coalesce(over, 61) THEN 'failed' ELSE 'left' END AS state FROM o""",
)
def batch_budget(spark, d):
    return S.within_budget(feed(spark, d), "batch", "ord", "size", 20_000, 60).select("batch", "ord", "state")


@query("version_tokens", f"WITH {FEED} SELECT batch, ord, CASE WHEN fingerprint IS NOT NULL THEN 'fp:' || fingerprint ELSE 'v:' || size || ':' || doc_updated_at END AS token FROM feed")
def version_tokens(spark, d):
    return feed(spark, d).select("batch", "ord", S.version_token(F.col("fingerprint"), F.col("size"), F.col("doc_updated_at")).alias("token"))


@query("tombstones", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-01 12:00:00' AND user_id IS NOT NULL)")
def tombstones(spark, d):
    markers = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("deleted_at"))
    built = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return S.with_tombstones(table(spark, d, "orders"), markers, "o_custkey", built).select("o_orderkey")


@query("cache_sweep", "SELECT event_id FROM events WHERE ts + INTERVAL 3600 SECOND >= (SELECT max(ts) FROM events)")
def cache_sweep(spark, d):
    """Entries of at most an hour before the last one."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    return S.unexpired(e.crossJoin(F.broadcast(now)), "ts", F.col("now"), 3600).select("event_id")


def windowed(df):
    return df.select(F.unix_timestamp("start").alias("from_s"), F.unix_timestamp("end").alias("to_s"), *[c for c in df.columns if c not in ("start", "end", "total")], F.round("total", 4).alias("total"))


@query("win_tumbling", "SELECT (floor(epoch(ts))::BIGINT // 600) * 600 AS from_s, (floor(epoch(ts))::BIGINT // 600) * 600 + 600 AS to_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def win_tumbling(spark, d):
    return windowed(W.tumbling(table(spark, d, "events"), "ts", "10 minutes", ["event_type"], "value"))


@query(
    "win_sliding",
    """WITH s AS (SELECT event_type, value, unnest([(floor(epoch(ts))::BIGINT // 300) * 300, (floor(epoch(ts))::BIGINT // 300) * 300 - 300]) AS from_s FROM events)
 SELECT from_s, from_s + 600 AS to_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""",
)
def win_sliding(spark, d):
    return windowed(W.sliding(table(spark, d, "events"), "ts", "10 minutes", "5 minutes", ["event_type"], "value"))


@query(
    "win_session",
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, floor(epoch(min(ts)))::BIGINT AS from_s, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS to_s, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
)
def win_session(spark, d):
    return windowed(W.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], "value"))


@query("first_events", "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type")
def first_events(spark, d):
    return W.distinct_events(table(spark, d, "events"), "ts", ["user_id", "event_type"], "1 hour").select("user_id", "event_type", "event_id")


@query("without_thoughts", "SELECT conv_id, turn, left(text, 40) || right(text, 40) AS answer, text AS thought FROM conversations WHERE NOT contains(text, 'think>')")
def without_thoughts(spark, d):
    """Each turn's text as the thought between its own beginning and end, in tokens of seven characters that cut the marks."""
    rows = table(spark, d, "conversations").where(~F.col("text").contains("think>"))
    whole = F.concat(F.left("text", F.lit(40)), F.lit("<think>"), F.col("text"), F.lit("</think>"), F.right("text", F.lit(40)))
    cuts = F.sequence(F.lit(0), F.floor((F.length("_m") - 1) / 7).cast("int"))
    tokens = rows.select(F.struct("conv_id", "turn").alias("key"), whole.alias("_m")).select("key", "_m", F.explode(cuts).alias("ord"))
    tokens = tokens.select("key", "ord", F.substr(F.col("_m"), F.col("ord") * 7 + 1, F.lit(7)).alias("token"))
    return W.without_thoughts(tokens, "key", "ord", "token").select("key.*", "answer", "thought")


@query(
    "cached_lookups",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR) END AS value FROM events),
 l AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {'v': value, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM e)
 SELECT event_id, CASE WHEN last.t + INTERVAL 7200 SECOND >= ts THEN CAST(last.v AS DOUBLE) END AS value FROM l WHERE value IS NULL""",
)
def cached_lookups(spark, d):
    """A purchase puts a user's value into the cache for two hours; every other event looks it up."""
    value = F.when(F.col("event_type") == "purchase", F.col("value").cast("string"))
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"), value.alias("value"))
    return St.cached_lookups(e, 7200).select(F.col("ord").alias("event_id"), F.col("value").cast("double").alias("value"))


@query(
    "mirror_sync",
    """WITH c AS (SELECT source AS entity, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL GROUP BY source)
 SELECT lang AS page, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars, count(*) AS entities FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL) l JOIN c ON c.entity = l.source GROUP BY lang""",
)
def mirror_sync(spark, d):
    """Pages after two syncs of a mirror: some documents came, changed and went between them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "n_chars", "lang", F.md5("text").alias("hash"))
    old = docs.where("chunk_id % 5 <> 0").withColumns({
        "hash": F.when(F.col("chunk_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")), "n_chars": F.when(F.col("chunk_id") % 3 == 0, F.lit(1)).otherwise(F.col("n_chars")),
    })
    links = docs.where("lang IS NOT NULL").select(F.col("lang").alias("page"), F.col("source").alias("entity")).distinct()
    mirror = Mirror(
        VersionedTables(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/mirror-{uuid.uuid4().hex}"),
        lambda c: c.where("source IS NOT NULL").select("chunk_id", F.col("source").alias("entity"), "n_chars"),
        lambda m: m.groupBy("entity").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
        lambda p: p.groupBy("page").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("entities")),
    )
    mirror.sync(old, links.where("entity <> 'src1'"))
    mirror.sync(docs.where("chunk_id % 7 <> 0"), links)
    return mirror.tables.read("pages")
