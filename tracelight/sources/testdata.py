"""The driver's test tables as events and as raw log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions.schema import Field, Schema
from tracelight.sources.events import View, event_relation, typed_events

#: The built-in schema and an extension for the numeric value that test events carry.
SCHEMA = Schema.builtin().with_fields(Field("extensions.value", "double"), Field("extensions.kind", "string"))

#: What the test table's event types count as.
EVENT_TYPES = {
    "click": "NETWORK_HTTP", "view": "NETWORK_CONNECTION", "purchase": "USER_RESOURCE_UPDATE_CONTENT", "signup": "USER_CREATION",
    "error": "GENERIC_EVENT",
}


def event_fields() -> dict[str, Column]:
    """What each field of an event is, as an expression of few columns of ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id").cast("string")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("event_type")]
    octet = (F.col("event_id") % 250).cast("string")
    label = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    action = lambda yes, one, other: F.struct(F.array(F.when(yes, one).otherwise(other)).alias("action"))
    return {
        "metadata.id": F.col("event_id").cast("string"),
        "metadata.event_type": kind,
        "metadata.log_type": F.col("event_type"),
        "metadata.event_timestamp": F.col("ts"),
        "metadata.ingestion_labels": F.array(label("kind", F.col("event_type")), label("k", k.cast("string"))),
        "principal.hostname": F.concat(F.lit("Host-"), (F.col("user_id") % 20).cast("string")),
        "principal.ip": F.array(F.concat(F.lit("10.0.0."), octet), F.concat(F.lit("10.1.0."), user)),
        "principal.user.userid": user,
        "target.port": F.when(k < 90, k),
        "security_result": F.array(action(F.col("event_type") == "error", "BLOCK", "ALLOW"), action(k < 50, "CHALLENGE", "FAIL")),
        "additional": F.create_map(F.lit("k"), k.cast("string"), F.lit("kind"), F.col("event_type")),
        "extensions.value": F.col("value"),
        "extensions.kind": F.col("event_type"),
    }


def table_events(spark: SparkSession, sf_dir: str) -> View:
    """The test table's rows as events: fields are read as columns of the file."""
    return typed_events(spark.read.parquet(f"{sf_dir}/events.parquet"), event_fields(), F.concat(F.lit("event-"), F.col("event_id")))


def variant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as documents without a shape, as they come from outside."""
    rows = table_events(spark, sf_dir).relation()
    return event_relation(rows.select(F.to_json("doc", {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("event")))


#: Bytes of a table whose lines are dealt to all cores; larger ones are read in parts as they are.
SMALL = 64 << 20


def parts_of(spark: SparkSession, sf_dir: str) -> int | None:
    """How many parts the lines of the test tables are dealt to: one a core where the tables are small files, else none."""
    size = 0
    for name in ("orders", "events", "customer"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return spark.sparkContext.defaultParallelism if size <= SMALL else None


def log_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``message``: a line per row of a test table. Kinds: csv and kv (orders), json (events), syslog (events) and base64 (customers).

    Syslog lines have no year and come with the time that they were received at; what isn't known is ``-`` in them.
    """
    if kind in ("csv", "kv"):
        o = spark.read.parquet(f"{sf_dir}/orders.parquet")
        day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        if kind == "csv":
            parts = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
            return o.select(F.concat_ws(",", *parts, day, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).alias("message"))
        pairs = {"order": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice"}
        return o.select(F.concat_ws("|", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in pairs.items()]).alias("message"))
    if kind == "base64":
        return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
            F.to_json(F.struct(F.col("c_custkey").alias("id"), F.base64(F.encode("c_name", "utf-8")).alias("name"), F.col("c_mktsegment").alias("segment"))).alias("message")
        )
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if kind == "json":
        listed = F.array(F.concat(F.lit("10.0.0."), F.col("event_id") % 250), F.concat(F.lit("10.1.0."), F.col("user_id")))
        return e.select(
            F.to_json(
                F.struct(
                    F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"),
                    F.col("value"), listed.alias("ips"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("time"),
                )
            ).alias("message")
        )
    known = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    user, number = F.col("user_id"), F.col("event_id")
    line = F.format_string(
        "%s gw-%s: FW-%s: %s connection TCP %s/%s to %s/443",
        known(F.date_format("ts", "MMM dd HH:mm:ss")), known(user % 7), known(number),
        F.when(F.col("event_type") == "error", "Denied").otherwise("Accepted"), known(F.concat(F.lit("10.1.0."), user)),
        known(number % 60000 + 1024), known(F.concat(F.lit("10.0.0."), number % 250)),
    )
    return e.select(line.alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@createTimestamp"))
