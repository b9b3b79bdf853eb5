"""Queries that a console asks: filters, date ranges, tiers, latest dispositions.

Findings come from orders: severity from priority, status from order status,
asset from the customer's market segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.scalars import file_size, padded_id, status_tier, utc_text
from probity.operators.ordering import dense_index
from probity.plans.query import Query, table


def choose(rows: DataFrame, **wanted: str) -> DataFrame:
    """Equality filters by column; ALL stands for any value."""
    for column, value in wanted.items():
        rows = rows.where((F.lit(value) == "ALL") | (F.col(column) == value))
    return rows


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that hold text in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def in_range(day: Column, kind: str, today: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Date range ALL, TODAY, WEEK (seven days back), MONTH, YEAR, or CUSTOM with both ends included."""
    return {
        "ALL": F.lit(True),
        "TODAY": day == today,
        "WEEK": day.between(F.date_sub(today, 7), today),
        "MONTH": F.trunc(day, "month") == F.trunc(today, "month"),
        "YEAR": F.year(day) == F.year(today),
        "CUSTOM": day.between(first, last) if first is not None and last is not None else F.lit(False),
    }[kind]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("asset"), F.col("c_name").alias("reporter"))
    severity = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", severity.alias("severity"), F.when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("SECURE").alias("status"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return rows.join(customers, "o_custkey", "left")


FINDINGS = """f AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN o_orderstatus = 'O' THEN 'REVIEW' ELSE 'SECURE' END AS status, o_orderdate::DATE AS day, o_orderstatus, c_mktsegment AS asset, c_name AS reporter FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = choose(findings(spark, sf_dir), severity="HIGH", status="REVIEW", asset="ALL")
    return search(rows, "mer#0000001", "asset", "reporter").select("o_orderkey", "asset", "reporter")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, today = findings(spark, sf_dir), F.lit("1998-06-15").cast("date")
    custom = (F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date"))
    kinds = ["ALL", "TODAY", "WEEK", "MONTH", "YEAR", "CUSTOM"]
    counts = rows.agg(*[F.count_if(in_range(F.col("day"), k, today, *(custom if k == "CUSTOM" else ()))).alias(k) for k in kinds])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(status_tier(F.lower("o_orderstatus")).alias("tier")).agg(F.count("*").alias("n"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's disposition: the last event wins; a purchase accepts, others leave it open."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("changes"))
    return last.select("user_id", F.when(F.col("event_type") == "purchase", "SECURE").otherwise(F.upper("event_type")).alias("status"), "changes")


def _audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as audit rows AUD-0001 and on, with UTC times and JSON for export."""
    rows = dense_index(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "user_id"), ["event_id"], "n", start=1)
    at = utc_text(F.col("ts"))
    return rows.select(padded_id("AUD", F.col("n"), 4).alias("id"), at.alias("logged_at"), F.to_json(F.struct(F.col("user_id").alias("analyst"), at.alias("timestamp"))).alias("record"))


def _kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return f.agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_distinct("asset").alias("assets"), F.count_if((F.col("severity") == "HIGH") & (F.col("status") == "REVIEW")).alias("urgent"))


def _first4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("status = 'REVIEW'").orderBy("o_orderkey").limit(4).select("o_orderkey", "severity")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, extension and 16-character digest prefix of page paths, and sizes as text."""
    pages = table(spark, sf_dir, "pages")
    host = F.split("url", "/")[2]
    extension = F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)
    return pages.select("page_id", host.alias("host"), extension.alias("extension"), F.substring(F.md5("html"), 1, 16).alias("short"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z]+"), F.lit(0)))), ",").alias("parts"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(file_size(F.col("n_chars")).alias("size")).agg(F.count("*").alias("n")).select("size", "n")


QUERIES = {
    "findings_filter": Query(_filter, f"WITH {FINDINGS} SELECT o_orderkey, asset, reporter FROM f WHERE severity = 'HIGH' AND status = 'REVIEW' AND (contains(lower(asset), 'mer#0000001') OR contains(lower(reporter), 'mer#0000001'))", "B12 B13 O9"),
    "date_bucket_filter": Query(_dates, f"WITH {FINDINGS} SELECT 'ALL' AS kind, count(*) AS n FROM f UNION ALL SELECT 'TODAY', count(*) FILTER (day = '1998-06-15') FROM f UNION ALL SELECT 'WEEK', count(*) FILTER (day BETWEEN '1998-06-08' AND '1998-06-15') FROM f UNION ALL SELECT 'MONTH', count(*) FILTER (date_trunc('month', day) = '1998-06-01') FROM f UNION ALL SELECT 'YEAR', count(*) FILTER (year(day) = 1998) FROM f UNION ALL SELECT 'CUSTOM', count(*) FILTER (day BETWEEN '1997-01-01' AND '1997-03-31') FROM f", "B14"),
    "status_tier": Query(_tiers, f"WITH {FINDINGS} SELECT CASE o_orderstatus WHEN 'F' THEN 'secure' WHEN 'O' THEN 'review' WHEN 'P' THEN 'quarantine' ELSE 'pending' END AS tier, count(*) AS n FROM f GROUP BY 1", "B15"),
    "latest_disposition": Query(_latest, "SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'SECURE' ELSE upper(arg_max(event_type, (ts, event_id))) END AS status, count(*) AS changes FROM events GROUP BY 1", "B16"),
    "audit_log_export": Query(_audit_log, "WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS logged_at FROM events WHERE event_type = 'error') SELECT 'AUD-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id, logged_at, '{\"analyst\":' || user_id || ',\"timestamp\":\"' || logged_at || '\"}' AS record FROM e", "A21 O10"),
    "console_kpi": Query(_kpi, f"WITH {FINDINGS} SELECT count(*) AS findings, count(*) FILTER (status = 'REVIEW') AS review, count(DISTINCT asset) AS assets, count(*) FILTER (severity = 'HIGH' AND status = 'REVIEW') AS urgent FROM f", "D29"),
    "first_review_findings": Query(_first4, f"WITH {FINDINGS} SELECT o_orderkey, severity FROM f WHERE status = 'REVIEW' ORDER BY o_orderkey LIMIT 4", "F6 F7"),
    "path_strings": Query(_names, "SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1) AS extension, substr(md5(html), 1, 16) AS short, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(url), '[a-z]+'))), ',') AS parts FROM pages", "L"),
    "size_text": Query(_sizes, "WITH s AS (SELECT CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', round(n_chars / 1024.0::DOUBLE, 1)) ELSE format('{:.1f} MB', round(n_chars / 1048576.0::DOUBLE, 1)) END AS size FROM documents) SELECT size, count(*) AS n FROM s GROUP BY 1", "L"),
}
