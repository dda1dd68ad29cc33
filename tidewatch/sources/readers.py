"""Sources: sensor logs as JSON lines, web and firewall logs, network lists and indicator feeds.

Every reader takes an explicit schema; lines that don't parse become rows with `_corrupt` set, never errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import networks

SENSOR_LOG = "eventid string, timestamp string, sensor string, session string, src_ip string, src_port int, username string, password string, input string, duration double, shasum string, url string, destfile string, filename string, hassh string, hasshAlgorithms string"
# Names in the sensors' logs and ours for them.
ACTIONS = {
    "session.connect": "session.connect",
    "login.failed": "login.failed",
    "login.success": "login.success",
    "command.input": "command.input",
    "session.file_download": "session.file_download",
    "session.closed": "session.closed",
}
WEB_LOG = "time string, sip string, sport int, method string, url string, headers map<string,string>, useragent string, status int, body string"
FIREWALL_LOG = "sensor string, logs array<struct<time:double,sip:string,sport:int,dip:string,dport:int,proto:int,flags:string>>"


def parsed_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row per JSON line; `_corrupt` holds a line that isn't a JSON object."""
    full = T.StructType.fromDDL(schema).add("_corrupt", "string")
    return lines.select(F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("j.*")


def network_type(ip: Column) -> Column:
    return F.when(ip.contains(":"), "ipv6").when(ip.isNotNull(), "ipv4")


def last_component(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sensor_events(lines: DataFrame, sensor: str | None = None, classification: str | None = None) -> DataFrame:
    """Sensor log lines as raw events: known actions only, seconds to nanoseconds, missing fields null."""
    j = parsed_lines(lines, SENSOR_LOG)
    action = F.regexp_replace("eventid", r"^[a-z]+\.(?=[a-z]+\.)", "")
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    mapped = F.try_element_at(names, action)
    return j.filter(F.col("_corrupt").isNull() & mapped.isNotNull()).select(
        F.try_to_timestamp("timestamp").alias("ts"), mapped.alias("event_action"), F.coalesce(F.col("sensor"), F.lit(sensor)).alias("sensor"), F.col("session").alias("session_id"),
        F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")).alias("source"), F.col("username").alias("user_name"), "password", F.col("input").alias("command_line"),
        (F.col("duration") * 1e9).cast("long").alias("duration"), F.lower("shasum").alias("file_sha256"), "url", "destfile", last_component(F.col("filename")).alias("filename"), "hassh",
        F.col("hasshAlgorithms").alias("hassh_algorithms"), network_type(F.col("src_ip")).alias("network_type"), F.lit(classification).cast("string").alias("classification"),
    )


def web_events(lines: DataFrame) -> DataFrame:
    """Web log lines: host and port of the Host header, path, extension, query and body size."""
    j = parsed_lines(lines, WEB_LOG).filter(F.col("_corrupt").isNull())
    host = F.coalesce(F.try_element_at("headers", F.lit("Host")), F.try_element_at("headers", F.lit("host")))
    path = F.regexp_extract("url", r"^(?:[a-z]+://[^/]*)?([^?#]*)", 1)
    return j.select(
        F.try_to_timestamp("time").alias("ts"), F.col("sip").alias("source_ip"), F.upper("method").alias("method"), F.lower(F.regexp_extract(host, r"^([^:]+)", 1)).alias("host"),
        F.regexp_extract(host, r":(\d+)$", 1).try_cast("int").alias("port"), path.alias("path"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1)).alias("extension"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"), F.col("useragent").alias("user_agent"), "status", F.octet_length(F.coalesce("body", F.lit(""))).alias("body_bytes"),
    )


def firewall_events(lines: DataFrame) -> DataFrame:
    """Batches of connections, one row each, epoch seconds as time."""
    j = parsed_lines(lines, FIREWALL_LOG).filter(F.col("_corrupt").isNull())
    return j.select("sensor", F.inline("logs")).select("sensor", F.timestamp_micros((F.col("time") * 1e6).cast("long")).alias("ts"), F.col("sip").alias("source_ip"), "sport", F.col("dip").alias("destination_ip"), "dport", "proto", "flags")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of (also compressed) text files."""
    return spark.read.text(path)


def network_list(spark: SparkSession, path: str, name: str, limit: int = 2_000_000) -> DataFrame:
    """Networks and single addresses of a list with # comments.  Lists are bounded; a longer one is an error."""
    rows = [r.value for r in spark.read.text(path).select(F.trim(F.regexp_replace("value", "[#;].*$", "")).alias("value")).filter("value <> ''").limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"{path} holds more than {limit} networks")
    return networks(spark, [(x, name) for x in rows])


def csv_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma-separated feed with # comments and quoted fields; null keys are dropped."""
    df = spark.read.csv(path, schema=schema, comment="#", quote='"', escape='"', mode="PERMISSIVE")
    return df.filter(F.col(df.columns[0]).isNotNull())


def json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def membership(df: DataFrame, key: str, feed: DataFrame, feed_key: str, out: str = "listed") -> DataFrame:
    """Adds `out`: whether the key is on the feed; null keys aren't."""
    on = feed.select(F.col(feed_key).alias("__k")).distinct().withColumn("__on", F.lit(True))
    return df.join(on, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce("__on", F.lit(False))).drop("__k", "__on")
