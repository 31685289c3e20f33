"""Streaming queries over events, drained and compared with their batch SQL; and sessions in batch."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from harborscan.functions.exprs import fingerprint_sql
from harborscan.operators import long_lines
from harborscan.plans.scan_queries import _BITS
from harborscan.sources.corpora import CONFIG_LINES_SQL, LOG_LINES_SQL, config_lines, log_lines, table
from harborscan.streaming import streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_STREAM_END = "(SELECT max(ts) FROM events)"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_STREAM_END} - INTERVAL 1 DAY GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    """Windows that the watermark has closed, of a stream that is read to its end."""
    return streams.drained(spark, streams.windows(streams.event_stream(spark, sf_dir)))


@query(f"SELECT DISTINCT {fingerprint_sql(chr(39) + 'stream-v1' + chr(39), 'user_id::VARCHAR', 'event_type')} AS fingerprint FROM events")
def stream_dedupe_findings(spark, sf_dir):
    return streams.drained(spark, streams.distinct_findings(streams.event_stream(spark, sf_dir), "3650 days"))


_LATE_SQL = f"""m AS (SELECT max(ts) FILTER (WHERE event_id % 3 <> 0) - INTERVAL 1 DAY AS first_mark, max(ts) - INTERVAL 1 DAY AS last_mark FROM events),
k AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events), t AS (SELECT * FROM k, m WHERE event_id % 3 <> 0 OR start + INTERVAL 1 HOUR > first_mark)"""


@query(f"WITH {_LATE_SQL} SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM t WHERE start + INTERVAL 1 HOUR <= last_mark GROUP BY ALL")
def stream_late_data(spark, sf_dir):
    """A third of the events come after all others: those whose window is closed by then are dropped."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.arrivals(spark, [e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")], streams.windows)


@query(f"""WITH {CONFIG_LINES_SQL}, k AS (SELECT path, line, CASE WHEN text LIKE '%BEGIN RSA%' THEN 'B' WHEN text LIKE '%END RSA%' THEN 'E' END AS mark FROM config_lines)
SELECT path, line, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'B', false) AS inside_key FROM k""")
def stream_key_blocks(spark, sf_dir):
    """Lines of files that arrive in three parts: the state of a key block goes over their seams."""
    lines = config_lines(spark, sf_dir).select("path", "line", "text")
    return streams.arrivals(spark, [lines.where("line <= 3"), lines.where("line BETWEEN 4 AND 40"), lines.where("line > 40")], streams.key_blocks)


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(ts) AS started FROM s GROUP BY ALL""")
def session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTE"), 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w).cast("long"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"))


_LONG_SQL = f"""WITH {LOG_LINES_SQL}, v AS (SELECT *, 'Aa9_' || substr(h, 1, 16) AS value FROM log_pieces)
SELECT path, 1::BIGINT AS line, 'SECRET.GITHUB.TOKEN' AS rule_id, off_::BIGINT AS start, 40::BIGINT AS value_length, 'HIGH' AS confidence FROM v WHERE text LIKE 'ghp%'
UNION ALL SELECT path, 1, 'SECRET.GENERIC.ASSIGNMENT', off_ + 9, 20, CASE WHEN {_BITS} >= 3.2 THEN 'MEDIUM' ELSE 'LOW' END FROM v WHERE text LIKE 'password%'
UNION ALL SELECT path, 1, 'SECRET.CONNECTION_STRING', off_ + 21, 12, 'HIGH' FROM v WHERE text LIKE 'é%'"""


def _long(hits):
    return hits.select("path", "line", "rule_id", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"), "confidence")


@query(_LONG_SQL)
def secret_long_lines(spark, sf_dir):
    """Long lines in windows of 4 KiB: the spans are those of whole lines."""
    return _long(long_lines.scan(log_lines(spark, sf_dir), 1 << 12))


@query(_LONG_SQL)
def stream_growing_files(spark, sf_dir):
    """The same files in parts of 700 characters, every second part late: windows come from the state of a file."""
    size = 700
    parts = log_lines(spark, sf_dir).select("path", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size))).alias("seq"))
    parts = parts.select("path", F.col("seq").cast("long").alias("seq"), F.substring("text", F.col("seq").cast("int") * size + 1, F.lit(size)).alias("text"), (F.length("text") <= (F.col("seq") + 1) * size).alias("last"))
    made = streams.arrivals(spark, [parts.where("seq % 2 = 1"), parts.where("seq % 2 = 0")], lambda rows: streams.grown(rows, 1 << 12))
    return _long(long_lines.scan_windows(made))


_ADVICE_SQL = """a AS (SELECT 'p' || (user_id % 97) AS name, (user_id % 5)::VARCHAR AS version, ts, event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'MATCHED' ELSE 'NO_MATCH' END END AS status FROM events),
m AS (SELECT date_trunc('millisecond', max(ts) FILTER (WHERE event_id % 3 <> 0)) - INTERVAL 1 DAY AS first_mark, date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS last_mark FROM events),
come AS (SELECT name, version, ts, event_id, status FROM a, m WHERE event_id % 3 <> 0 OR ts > first_mark)"""


@query(f"""WITH {_ADVICE_SQL}, k AS (SELECT name, version, ts, max(status) AS status FROM come WHERE status IS NOT NULL GROUP BY ALL), q AS (SELECT name, version, ts FROM come, m WHERE status IS NULL AND date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND < last_mark),
j AS (SELECT q.*, k.status, (epoch_us(q.ts) - epoch_us(k.ts)) AS age FROM q ASOF LEFT JOIN k ON q.name = k.name AND q.version = k.version AND q.ts >= k.ts)
SELECT 'PyPI' AS ecosystem, name, version, ts AS asked_at, CASE WHEN age IS NULL OR age > 172800000000 THEN 'OFFLINE_NO_CACHE' WHEN age > 21600000000 THEN 'STALE_' || status ELSE status END AS state,
  CASE WHEN age <= 172800000000 THEN age // 1000000 END AS age_seconds FROM j""")
def stream_cached_advisories(spark, sf_dir):
    """Purchases are answers of a provider, other events lookups; a third of all comes after the rest, or too late. Answers
    are fresh for six hours and kept for two days."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "MATCHED").otherwise("NO_MATCH"))
    rows = e.select("event_id", F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("p"), (F.col("user_id") % 97).cast("string")).alias("name"), (F.col("user_id") % 5).cast("string").alias("version"), F.col("ts").alias("at"), status.alias("status"))
    build = lambda s: streams.answered_from_cache(s.drop("event_id").withWatermark("at", "1 day"), 6 * 3600, 48 * 3600)
    return streams.arrivals(spark, [rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0")], build)
