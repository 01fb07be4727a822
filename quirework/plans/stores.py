"""Queries over jobs, batches, sessions and their life cycles; events and conversations stand in for job histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text, urls
from ..operators import breaker, jobs, records, views
from ..operators.keyed import KeyedStore
from ..shared import shared_dir
from ..streaming import lifecycle
from ..streaming.replay import Replay, with_end
from .streams import DELAY, arriving
from .tables import table

def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def batch_status_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("ok"))
    return e.select("user_id", "total", "ok", jobs.batch_status(F.col("total"), F.col("ok")).alias("status"))


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and lengths of documents as batches, a page each: those shorter than fifty characters failed; their addresses and telephone numbers are the leads."""
    t = F.col("text")
    pages = table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", (F.length(t) % 7).cast("string")).alias("batch_id"), F.when(F.length(t) < 50, "failed").otherwise("completed").alias("status"), text.emails(t).alias("emails"), text.phones(t).alias("phones"),
        F.when(F.length(t) % 5 == 0, F.array(F.concat(F.lit("https://x.com/"), F.col("lang")))).alias("social_links"), (F.length(t) / 8).alias("duration_ms"),
    )
    out = jobs.batches(pages)
    return out.select("batch_id", "total_pages", "successful_pages", "failed_pages", "total_duration_ms", "status", *[F.array_join(c, ",").alias(c) for c in ("all_emails", "all_phones", "all_social_links")])


def source_lead_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of each source, a row each: a source may have any number of them."""
    return table(spark, sf_dir, "documents").select("source", F.explode(text.emails(F.col("text"))).alias("email")).groupBy("source", "email").agg(F.count("*").alias("documents"))


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(table(spark, sf_dir, "events"), 50, "ts", "event_id").select("event_id", "user_id", "event_type", _micros("ts").alias("ts_us"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return jobs.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def lru_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of a hundred users: which are still in it."""
    return jobs.kept(table(spark, sf_dir, "events"), "user_id", "ts", 100).select("user_id", _micros("ts").alias("ts_us"))


def ttl_new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = jobs.new_sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")
    return new.groupBy("user_id").agg(F.count("*").alias("sessions"))


def unexpired_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", (F.col("ts") + F.expr(f"INTERVAL {rules.OUTPUT_SECONDS} SECONDS")).alias("expires_at"))
    return jobs.unexpired(rows, F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")).select("event_id")


def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = jobs.failure_runs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
    return runs.select("user_id", _micros("first").alias("first_us"), _micros("last").alias("last_us"), "failures")


def orphan_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days with a sign-up and no purchase on that day."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"), "event_type")
    return jobs.orphans(e.where("event_type = 'signup'").select("job_id").distinct(), e.where("event_type = 'purchase'"))


def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


def lean_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as jobs: sizes instead of heavy columns, failed ones with their error text."""
    p = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("job_id"), "url", "html", F.col("html").alias("text"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links"),
        F.lit(None).cast("array<binary>").alias("screenshots"), F.when(F.col("page_id") % 7 == 0, views.error_text(F.lit("NotFound"), F.col("url"))).alias("error"),
    )
    return views.lean(p)


def batch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches: names, session and pages in order, as one JSON answer each."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("batch_id"), F.col("turn").cast("int").alias("page_idx"), "role")
    pages = c.select("batch_id", "page_idx", views.page_id(F.col("batch_id"), F.col("page_idx")).alias("job_id"), "role")
    out = views.nested(c.select("batch_id").distinct(), pages)
    ids = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["job_id"], p["role"])), ",")
    return out.select("batch_id", views.session_name(F.lit(""), F.col("batch_id")).alias("session"), views.envelope(ids, F.lit(None).cast("string"), F.col("batch_id")).alias("answer"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("http://u:p@h.test:8080/x",), ("https://h.test",), ("socks5://u@h.test:1/",), ("nothing",), ("//h.test:99",)], "url string")
    return own.unionByName(table(spark, sf_dir, "pages").select("url")).select("url", urls.parts(F.col("url")).alias("p")).select("url", "p.*").distinct()


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are given once, when the watermark has passed them; state holds the days that late events can still change."""
    rows = with_end(arriving(spark, sf_dir).select("event_type", "ts", "step"), "ts", "30 DAYS")
    return Replay(rows, "daily").all_steps(lambda stream, _: lifecycle.daily_counts(stream, f"{DELAY} seconds"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_end(arriving(spark, sf_dir).select("user_id", "ts", "step"), "ts", "30 DAYS")
    return Replay(rows, "sessions").all_steps(lambda stream, _: lifecycle.user_sessions(stream, late=f"{DELAY} seconds"))


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lifecycle.without_repeats(lifecycle.event_stream(spark, sf_dir), late=None).select("event_id", "event_type")
    return lifecycle.replayed(e, "distinct")


def stream_job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as job histories: a user's sign-ups, views and purchases submit, start and complete, errors fail. One step: moves depend on time order, files need have none."""
    status = F.create_map(*[F.lit(x) for p in (("signup", "pending"), ("view", "running"), ("purchase", "completed"), ("error", "failed")) for x in p])
    e = lifecycle.event_stream(spark, sf_dir, max_files=None).where("event_type <> 'click'")
    e = e.select(F.col("user_id").cast("string").alias("job_id"), F.element_at(status, F.col("event_type")).alias("status"), "ts")
    moves = lifecycle.replayed(lifecycle.job_states(e), "moves")
    return moves.select("job_id", "status", F.unix_micros("ts").alias("ts_us"))


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as call targets, errors as failed calls: two in a row open a breaker for a day, as events are hours apart."""
    calls = breaker.guarded(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2, 86_400)
    return calls.select("user_id", "event_id", "outcome", "is_open")


def stream_batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as a batch of three pages: sign-ups submit it, errors are failed pages."""
    e = lifecycle.event_stream(spark, sf_dir).select(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"), F.lit(3).alias("total"), F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("ok")
    )
    return jobs.latest(lifecycle.replayed(lifecycle.batch_states(e), "batches", "update"), "batch_id", ["step"]).select("batch_id", "done", "ok", "status")


def stream_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as saves of their user's session, which lives for twelve hours."""
    saves = arriving(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("state"), "ts", "step")
    lives = Replay(with_end(saves, "ts", "30 DAYS"), "states").all_steps(lambda stream, _: lifecycle.session_states(stream, "12 hours", f"{DELAY} seconds"))
    return lives.select("session_id", "state", "saves", F.unix_micros("expires_at").alias("expires_us"))


def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves of their user's state, errors as deletions, in steps out of order, one of them twice, with a compaction between; of a hundred users at most."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("deleted"))
    store = KeyedStore(spark, f"{shared_dir(spark)}/quirework/store-{uuid.uuid4().hex}", e.drop("deleted").schema, "user_id", ["ts", "event_id"], most=100)
    for step in (2, 0, 3, 2, 1):
        store.save(e.where(F.col("event_id") % 4 == step))
        if step == 3:
            store.compact()
    return store.state().select("user_id", "event_id", "event_type", _micros("ts").alias("ts_us"))


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept by key; the one of the highest key, from its bucket."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    store = KeyedStore(spark, f"{shared_dir(spark)}/quirework/orders-{uuid.uuid4().hex}", o.schema, "o_orderkey", ["o_orderdate"], most=None)
    store.save(o)
    store.compact()
    return store.lookup(o.agg(F.max("o_orderkey")).first()[0]).select("o_orderkey", "o_custkey", "o_totalprice")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON log records: errors at their level, users as requests, sign-ups with a context."""
    kind = F.col("event_type")
    message = F.concat(F.lit("event "), kind)
    record = records.log_record(F.col("ts"), F.when(kind == "error", "ERROR").otherwise("INFO"), message, F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")), None, F.when(kind == "signup", F.struct("event_id")))
    return table(spark, sf_dir, "events").select("event_id", record.alias("record"))


QUERIES = {
    "log_records": log_records, "store_state": store_state, "store_lookup": store_lookup,
    "circuit_breaker": circuit_breaker, "stream_batch_states": stream_batch_states, "stream_session_states": stream_session_states,
    "batch_status_by_user": batch_status_by_user, "batch_rollup": batch_rollup, "source_lead_union": source_lead_union, "recent_jobs": recent_jobs, "latest_status": latest_status,
    "lru_kept": lru_kept, "ttl_new_sessions": ttl_new_sessions, "unexpired_outputs": unexpired_outputs, "consecutive_failures": consecutive_failures, "orphan_submissions": orphan_submissions,
    "conversation_roles": conversation_roles, "lean_jobs": lean_jobs, "batch_view": batch_view, "url_parts": url_parts, "stream_daily_counts": stream_daily_counts, "stream_sessions": stream_sessions, "stream_distinct_events": stream_distinct_events, "stream_job_moves": stream_job_moves,
}

_UNION = "coalesce(array_to_string(list_sort(list_distinct(flatten(list({}) FILTER (status = 'completed' AND {} IS NOT NULL)))), ','), '')"
SQL = {
    "log_records": """SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z","level":"' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END
        || '","service":"quirework","message":"event ' || event_type || '"' || CASE WHEN event_id % 5 <> 0 THEN ',"request_id":"' || user_id || '"' ELSE '' END || CASE event_type WHEN 'signup' THEN ',"context":{"event_id":' || event_id || '}' ELSE '' END || '}' AS record FROM events""",
    "store_state": """SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us FROM (
        SELECT * FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC, user_id DESC LIMIT 100) WHERE event_type <> 'error'""",
    "store_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)",
    "batch_status_by_user": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, CASE WHEN count(*) = count(*) FILTER (event_type <> 'error') THEN 'completed' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY user_id",
    "batch_rollup": f"""SELECT batch_id, count(*) AS total_pages, count(*) FILTER (status = 'completed') AS successful_pages, count(*) FILTER (status <> 'completed') AS failed_pages, round(sum(CAST(ms AS DOUBLE)), 2) AS total_duration_ms,
        CASE WHEN count(*) = count(*) FILTER (status = 'completed') THEN 'completed' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS status,
        {_UNION.format("emails", "emails")} AS all_emails, {_UNION.format("phones", "phones")} AS all_phones, {_UNION.format("links", "links")} AS all_social_links FROM (
            SELECT source || ':' || length(text) % 7 AS batch_id, CASE WHEN length(text) < 50 THEN 'failed' ELSE 'completed' END AS status, regexp_extract_all(text, '{rules.EMAIL}') AS emails, regexp_extract_all(text, '{rules.PHONE}') AS phones,
                CASE WHEN length(text) % 5 = 0 THEN ['https://x.com/' || lang] END AS links, length(text)::DOUBLE / 8 AS ms FROM documents) GROUP BY batch_id""",
    "source_lead_union": f"SELECT source, email, count(DISTINCT k) AS documents FROM (SELECT source, row_number() OVER () AS k, unnest(regexp_extract_all(text, '{rules.EMAIL}')) AS email FROM documents) GROUP BY source, email",
    "recent_jobs": "SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "latest_status": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "lru_kept": "SELECT user_id, epoch_us(max(ts)) AS ts_us FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 100",
    "ttl_new_sessions": "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR ts > b + INTERVAL 300 SECONDS GROUP BY user_id",
    "unexpired_outputs": "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts + INTERVAL 600 SECONDS >= TIMESTAMP '2024-01-20 00:00:00'",
    "consecutive_failures": "SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS failures FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 3",
    "orphan_submissions": "WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS job_id, event_type FROM events) SELECT DISTINCT job_id FROM e WHERE event_type = 'signup' AND job_id NOT IN (SELECT job_id FROM e WHERE event_type = 'purchase')",
    "conversation_roles": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role",
    "lean_jobs": """SELECT CAST(page_id AS VARCHAR) AS job_id, url, CASE WHEN page_id % 7 = 0 THEN 'NotFound: ' || url END AS error, CAST(len(regexp_extract_all(html, 'href="([^"]*)"')) AS INT) AS link_count, CAST(length(html) AS INT) AS text_length, false AS has_screenshot FROM pages""",
    "batch_view": """SELECT b AS batch_id, 'batch_' || b AS session, '{"status":"success","data":"' || string_agg(b || '_page_' || turn || ':' || role, ',' ORDER BY turn, role) || '","request_id":"' || b || '"}' AS answer
        FROM (SELECT CAST(conv_id AS VARCHAR) AS b, turn, role FROM conversations) GROUP BY b""",
    "url_parts": """SELECT DISTINCT url, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*):', 1) AS scheme, regexp_replace(h, ':\\d*$', '') AS host, regexp_extract(h, ':(\\d+)$', 1) AS port, split_part(l, ':', 1) AS user,
        CASE WHEN contains(l, ':') THEN regexp_replace(l, '^[^:]*:', '') ELSE '' END AS password
        FROM (SELECT url, split_part(a, '@', -1) AS h, CASE WHEN contains(a, '@') THEN split_part(a, '@', 1) ELSE '' END AS l FROM (SELECT url, regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1) AS a FROM
        (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES ('http://u:p@h.test:8080/x'), ('https://h.test'), ('socks5://u@h.test:1/'), ('nothing'), ('//h.test:99')) v(url))))""",
    "circuit_breaker": """
        WITH RECURSIVE e AS (
            SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
        ), b AS (
            SELECT user_id, event_id, 0::BIGINT AS n, '' AS outcome, 0 AS failures, NULL::BIGINT AS opened FROM e WHERE n = 1
            UNION ALL
            SELECT user_id, event_id, n, o, CASE o WHEN 'refused' THEN failures WHEN 'failed' THEN failures + 1 ELSE 0 END,
                CASE WHEN o = 'refused' OR o = 'failed' AND failures + 1 < 2 THEN opened WHEN o = 'failed' THEN t END
            FROM (SELECT e.*, failures, opened, CASE WHEN t < opened + 86400000000 THEN 'refused' WHEN bad THEN 'failed' ELSE 'passed' END AS o FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
        )
        SELECT user_id, event_id, outcome, opened IS NOT NULL AS is_open FROM b WHERE n > 0""",
    "stream_batch_states": """
        SELECT *, CASE WHEN done = 0 THEN 'pending' WHEN done < 3 THEN 'running' WHEN done = ok THEN 'completed' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status
        FROM (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS batch_id, count(*) FILTER (event_type <> 'signup') AS done, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS ok FROM events GROUP BY 1)""",
    "stream_session_states": """
        SELECT user_id AS session_id, max_by(event_id, (ts, event_id)) AS state, count(*) AS saves, epoch_us(max(ts) + INTERVAL 12 HOURS) AS expires_us
        FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
            FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE event_type = 'purchase')) GROUP BY user_id, s""",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": "SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)) GROUP BY user_id, s",
    "stream_job_moves": """
        WITH e AS (
            SELECT CAST(user_id AS VARCHAR) AS job_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS s
            FROM events WHERE event_type <> 'click'
        ), p AS (
            SELECT job_id, min(t) AS t FROM e WHERE s = 'pending' GROUP BY job_id
        ), r AS (
            SELECT job_id, min(e.t) AS t, arg_min(e.s, e.t) AS s FROM e JOIN p USING (job_id) WHERE e.t > p.t AND e.s IN ('running', 'failed') GROUP BY job_id
        ), d AS (
            SELECT job_id, min(e.t) AS t, arg_min(e.s, e.t) AS s FROM e JOIN r USING (job_id) WHERE r.s = 'running' AND e.t > r.t AND e.s IN ('completed', 'failed') GROUP BY job_id
        )
        SELECT job_id, 'pending' AS status, t AS ts_us FROM p UNION ALL SELECT job_id, s, t FROM r UNION ALL SELECT job_id, s, t FROM d""",
    "stream_distinct_events": "SELECT DISTINCT event_id, event_type FROM events",
}
