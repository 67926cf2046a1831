"""Queries over events: batch twins of the streaming operators, and windows of event time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import ordered as O
from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.streaming import events as E
from corpusloom.streaming import stateful as S


def events(spark, sf):
    return table(spark, sf, "events")


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("stream_filter", "SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND value IS NOT NULL")
def stream_filter(spark, sf):
    return E.wanted(events(spark, sf)).select("event_id", "user_id")


@query("debounce_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_id FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf):
    s = E.debounced(events(spark, sf))
    return s.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n", "last_id")


@query("debounce_flushes", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, k, s AS first, s AS last, 1 AS n, event_id, CAST(NULL AS STRUCT(a BIGINT, b BIGINT, c INTEGER, d BIGINT)) AS shut FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, CASE WHEN e.s < least(f.last + 7200000000, f.first + 14400000000) THEN f.first ELSE e.s END, e.s, CASE WHEN e.s < least(f.last + 7200000000, f.first + 14400000000) THEN f.n + 1 ELSE 1 END, e.event_id,
 CASE WHEN e.s < least(f.last + 7200000000, f.first + 14400000000) THEN NULL ELSE struct_pack(a := f.first, b := least(f.last + 7200000000, f.first + 14400000000), c := f.n, d := f.event_id) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
 SELECT user_id, shut.a AS start_us, shut.b AS flushed_us, CAST(shut.c AS BIGINT) AS n, shut.d AS last_id FROM f WHERE shut IS NOT NULL UNION ALL
 SELECT user_id, first, least(last + 7200000000, first + 14400000000), n, event_id FROM f WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM e GROUP BY user_id)""")
def debounce_flushes(spark, sf):
    """Two hours without events, or four since the first, flush what a user's events hold."""
    s = E.flushed(events(spark, sf), 7200.0, 14400.0)
    whole = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return s.select("user_id", whole("start").alias("start_us"), whole("flushed").alias("flushed_us"), "n", "last_id")


@query("tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    return E.windowed(events(spark, sf)).select(us("start").alias("start_us"), "event_type", "n", "total")


@query("sliding_window", "SELECT s AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, (epoch_us(ts) // 1800000000 - k) * 1800000000 AS s FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2")
def sliding_window(spark, sf):
    return E.windowed(events(spark, sf), "1 hour", "30 minutes").select(us("start").alias("start_us"), "event_type", "n", "total")


@query("latest_event_per_key", "SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type, max(event_id) AS newest FROM events GROUP BY 1")
def latest_event_per_key(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("newest"))


@query("needs_analysis", "SELECT d.doc_id, l.doc_id IS NULL OR d.n_chars > 4000 OR d.doc_id % 10 = 0 AS needs FROM documents d LEFT JOIN labels l USING (doc_id)")
def needs_analysis(spark, sf):
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("seen")).distinct()
    d = table(spark, sf, "documents").join(known, "doc_id", "left")
    return d.select("doc_id", (F.col("seen").isNull() | (F.col("n_chars") > 4000) | (F.col("doc_id") % 10 == 0)).alias("needs"))


@query("retry_outcome", """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), f AS (SELECT user_id, run, count(*) FILTER (event_type = 'error') AS failures FROM r GROUP BY 1, 2), m AS (SELECT user_id, max_by(failures, run) AS failures FROM f GROUP BY 1)
 SELECT user_id, failures, CASE WHEN failures = 0 THEN 'ok' WHEN failures <= 3 THEN 'retry' ELSE 'notify' END AS outcome FROM m""")
def retry_outcome(spark, sf):
    return E.retry_counts(events(spark, sf))


@query("dead_letter", "WITH f AS (SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last_us FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, n, CASE WHEN n > 3 OR user_id % 17 = 0 THEN NULL ELSE last_us + CAST(least(60000.0, 5000.0 * power(2.0, n - 1)) * 1000 AS BIGINT) END AS retry_us, n > 3 OR user_id % 17 = 0 AS dead FROM f")
def dead_letter(spark, sf):
    """Back-off up to three failures; more, or a mismatch that no retry mends, is a dead letter."""
    f = events(spark, sf).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max(us("ts")).alias("last_us"))
    dead = (F.col("n") > 3) | (F.col("user_id") % 17 == 0)
    wait = (F.least(F.lit(60000.0), F.lit(5000.0) * F.pow(F.lit(2.0), F.col("n") - 1)) * 1000).cast("long")
    return f.select("user_id", "n", F.when(~dead, F.col("last_us") + wait).alias("retry_us"), dead.alias("dead"))


@query("ttl_sweep", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE ts >= now - CASE event_type WHEN 'error' THEN INTERVAL 2 HOUR WHEN 'view' THEN INTERVAL 30 MINUTE ELSE INTERVAL 14 DAY END")
def ttl_sweep(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", us("ts").alias("us"))
    now = e.select(F.max("us")).scalar()
    ttl = F.when(F.col("event_type") == "error", 7200).when(F.col("event_type") == "view", 1800).otherwise(14 * 86400).cast("long") * 1_000_000
    return e.where(F.col("us") >= now - ttl).select("event_id")


@query("dedupe_window", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, s AS last, true AS hit FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.s - f.last >= 3600000000 THEN e.s ELSE f.last END, e.s - f.last >= 3600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
 SELECT user_id, event_id FROM f WHERE hit""")
def dedupe_window(spark, sf):
    return E.accepted_after_gap(events(spark, sf), 3600.0)


@query("undo_log")
def undo_log(spark, sf):
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("do")
    return E.undo_log(events(spark, sf).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("circuit_state")
def circuit_state(spark, sf):
    return E.circuit_states(events(spark, sf), failures=2, open_s=7200.0)


@query("watched_events", r"""SELECT event_id FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '~$d.docx' WHEN 1 THEN 'a.PDF.part' WHEN 2 THEN 'note.txt~' WHEN 3 THEN 'Thumbs.db' WHEN 4 THEN '#x#' ELSE 'report.' || CASE event_id % 2 WHEN 0 THEN 'PDF' ELSE 'txt' END END AS name FROM events) WHERE NOT regexp_matches(lower(name), '(^~\$)|(\.part$)|(~$)|(^thumbs\.db$)|(^#.*#$)') AND lower(string_split(name, '.')[-1]) IN ('pdf', 'docx')""")
def watched_events(spark, sf):
    """Files of two extensions, without temporary and system files."""
    names = F.array(*map(F.lit, ("~$d.docx", "a.PDF.part", "note.txt~", "Thumbs.db", "#x#")))
    name = F.when(F.col("event_id") % 9 < 5, F.get(names, (F.col("event_id") % 9).cast("int"))).otherwise(F.concat(F.lit("report."), F.when(F.col("event_id") % 2 == 0, "PDF").otherwise("txt")))
    e = events(spark, sf).select("event_id", F.concat(F.lit("/in/"), name).alias("path"))
    return E.watched(e, extensions=("pdf", "docx")).select("event_id")


ITEMS = "SELECT CAST(user_id % 50 AS VARCHAR) AS queue, event_id AS id, event_type || (event_id % 2) AS key, CAST(floor(epoch_us(ts) / 1e6 / 36000) AS BIGINT) AS tick, event_id % 10 <> 9 AS ok, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events"
ROW, GONE = 'STRUCT("key" VARCHAR, id BIGINT)[]', "STRUCT(id BIGINT, outcome VARCHAR, tick BIGINT)[]"


def gone(id_: str, outcome: str) -> str:
    return f"CAST([struct_pack(id := {id_}, outcome := '{outcome}', tick := tick)] AS {GONE})"


@query("queue_outcomes", f"""WITH RECURSIVE e AS ({ITEMS}),
 f AS (SELECT queue, k, tick, CASE WHEN ok THEN CAST([struct_pack("key" := key, id := id)] AS {ROW}) ELSE CAST([] AS {ROW}) END AS held, CASE WHEN ok THEN CAST([] AS {GONE}) ELSE {gone("id", "failed")} END AS gone FROM e WHERE k = 1 UNION ALL
 SELECT queue, k, tick, CASE WHEN NOT ok THEN rest WHEN pos > 0 THEN list_concat(rest[: pos - 1], [struct_pack("key" := key, id := id)], rest[pos + 1 :]) ELSE list_append(rest[CASE WHEN len(rest) < 3 THEN 1 ELSE 2 END :], struct_pack("key" := key, id := id)) END,
 list_concat(flushed, CASE WHEN NOT ok THEN {gone("id", "failed")} WHEN pos > 0 THEN {gone("rest[pos].id", "replaced")} WHEN len(rest) >= 3 THEN {gone("rest[1].id", "dropped")} ELSE CAST([] AS {GONE}) END)
 FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda x: x.key), key), 0) AS pos FROM (SELECT e.queue, e.k, e.tick, e.ok, e.key, e.id, f.held[least(len(f.held), (e.tick - f.tick) * 2) + 1 :] AS rest,
 CAST(list_transform(range(1, least(len(f.held), (e.tick - f.tick) * 2) + 1), lambda i: struct_pack(id := f.held[i].id, outcome := 'flushed', tick := f.tick + 1 + (i - 1) // 2)) AS {GONE}) AS flushed FROM f JOIN e ON e.queue = f.queue AND e.k = f.k + 1))),
 l AS (SELECT queue, held, tick FROM f WHERE (queue, k) IN (SELECT (queue, max(k)) FROM e GROUP BY queue)),
 g AS (SELECT queue, unnest(gone) AS g FROM f UNION ALL SELECT queue, unnest(list_transform(range(1, len(held) + 1), lambda i: struct_pack(id := held[i].id, outcome := 'flushed', tick := tick + 1 + (i - 1) // 2))) FROM l)
 SELECT queue, g.id AS id, g.outcome AS outcome, CAST(g.tick AS BIGINT) AS tick FROM g""")
def queue_outcomes(spark, sf):
    """Fifty queues of three keys, two of which leave every ten hours; every tenth item is refused as it comes."""
    e = events(spark, sf).select((F.col("user_id") % 50).cast("string").alias("queue"), F.col("event_id").alias("id"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("key"), "ts")
    return S.queued(e, S.QueueRule(2, 36_000.0, 3), valid=F.col("id") % 10 != 9)


@query("move_correlation")
def move_correlation(spark, sf):
    """Errors stand for deletes and sign-ups for adds, which come up to two hours later; four deletes of one size wait at most."""
    path = F.concat(F.lit("/d/F"), (F.col("user_id") % 10).cast("string"), F.when(F.col("user_id") % 2 == 0, ".txt").otherwise(".PDF"))
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add")
    f = events(spark, sf).select(F.col("event_id").alias("id"), kind.alias("kind"), path.alias("path"), (F.from_json("props", "k long")["k"] % 20).alias("size"), "ts", (us("ts") / 1e6).alias("mtime"))
    return S.correlated_moves(f.where("kind IS NOT NULL"), S.MoveRule(7_200.0, 7_200.0, 4)).select("deleted", "added", "outcome")


@query("head_batches", """WITH q AS (SELECT user_id % 5 AS queue, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'image' ELSE 'document' END AS kind, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT *, k - row_number() OVER (PARTITION BY queue, kind ORDER BY k) AS run FROM q), s AS (SELECT *, (row_number() OVER (PARTITION BY queue, kind, run ORDER BY k) - 1) % CASE kind WHEN 'image' THEN 3 ELSE 2 END = 0 AS head FROM r)
 SELECT queue, event_id, kind, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY k) AS BIGINT) AS batch FROM s""")
def head_batches(spark, sf):
    """Views and clicks stand for pictures: three of them in a row are a batch, or two others."""
    q = events(spark, sf).select((F.col("user_id") % 5).alias("queue"), "event_id", "event_type", "ts")
    kind = F.when(F.col("event_type").isin("view", "click"), "image").otherwise("document")
    return O.head_batches(q, kind, {"image": 3, "document": 2}, ["ts", "event_id"]).select("queue", "event_id", "kind", "batch")


# Relational extras over the generic tables.


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot(spark, sf):
    return events(spark, sf).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count("event_id")).fillna(0)


@query("approx_count_distinct")
def approx_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("rank_functions", "SELECT o_orderkey, row_number() OVER (w, o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)".replace("(w, o_orderkey)", "(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)").replace(" WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)", ""))
def rank_functions(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"))


@query("running_sum", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS total FROM lineitem")
def running_sum(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("total"))


@query("asof_join", "SELECT a.event_id, b.event_id AS click_id FROM events a ASOF JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts > b.ts WHERE a.event_type = 'purchase'")
def asof_join(spark, sf):
    """The last click before each purchase: both kinds in one ordered window, so there is no range join."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    e = events(spark, sf).where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type", us("ts").alias("ts"))
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", click).where("event_type = 'purchase' AND click_id IS NOT NULL").select("event_id", "click_id")


@query("full_outer", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def full_outer(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").fillna(0, ["customers", "suppliers"])


@query("except_all", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def except_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey"))
