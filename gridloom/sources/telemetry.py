"""Server samples and audit logs as rows: text sections, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import header_row_map, number_map


def sections(text: Column) -> Column:
    """SECTION:name lines and what follows each, as a map."""
    parts = F.filter(F.split(text, r"(?m)^SECTION:"), lambda p: F.trim(p) != "")
    name = lambda p: F.trim(F.substring_index(p, "\n", 1))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(name(p).alias("key"), F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, 1 << 30).alias("value"))))


def samples(texts: DataFrame, column: str = "value") -> DataFrame:
    """cpu, memory and jvm maps, rss_bytes, available_bytes, cache_bytes and heap_bytes of texts in sections; other columns stay."""
    s = F.col("__s")
    part = lambda k: F.try_element_at(s, F.lit(k))
    kib = lambda k, name: F.regexp_extract(part(k), rf"(?m)^{name}:\s+(\d+)", 1).try_cast("long") * 1024
    jvm = header_row_map(part("jstat"))
    used = sum((F.coalesce(F.try_element_at(F.col("jvm"), F.lit(k)), F.lit(0.0)) for k in ("S0U", "S1U", "EU", "OU")), F.lit(0.0)) * 1024
    rows = texts.withColumn("__s", sections(F.col(column)))
    rows = rows.withColumns({
        "cpu": number_map(part("cpu.stat")), "memory_stat": number_map(part("memory.stat")), "memory_bytes": F.trim(part("memory.current")).try_cast("long"), "jvm": jvm,
        "rss_bytes": kib("process", "VmRSS"), "available_bytes": F.regexp_extract(part("vm"), r"MemAvailable:\s+(\d+)", 1).try_cast("long") * 1024,
        "cache_bytes": F.regexp_extract(part("cache"), r"^(\d+)", 1).try_cast("long"),
    })
    return rows.withColumn("heap_bytes", F.when(F.col("jvm").isNotNull(), used)).drop("__s", column)


def audit_events(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of a storage server, one JSON per line, header names in lower case; only what isn't secret is kept."""
    shape = "time string, api struct<name:string,object:string,statusCode:int>, requestHeader map<string,string>, responseHeader map<string,string>"
    rows = spark.read.schema(shape).json(path)
    lower = lambda c: F.transform_keys(c, lambda k, _: F.lower(k))
    asked, sent = lower("requestHeader"), lower("responseHeader")
    return rows.select(
        "time", F.col("api.name").alias("api"), F.col("api.object").alias("object"), F.col("api.statusCode").alias("status"), F.try_element_at(asked, F.lit("user-agent")).alias("user_agent"),
        F.try_element_at(asked, F.lit("range")).alias("range"), F.try_element_at(sent, F.lit("content-range")).alias("content_range"), F.try_element_at(sent, F.lit("content-length")).try_cast("long").alias("content_length"),
    )
