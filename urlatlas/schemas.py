"""Record schemas (URL document, crawl statistics, proxy statistics, verdicts)."""

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType())), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("error_type", T.StringType(), True),
])

URL_DOCUMENT = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("url_hash", T.StringType(), False),
    T.StructField("normalized_url", T.StringType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("source_url", T.StringType(), True),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("status_code", T.IntegerType(), True),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("last_checked", T.TimestampNTZType(), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("error_count", T.IntegerType(), False),
    T.StructField("metadata", METADATA, False),
])

CRAWL_STATS = T.StructType([
    T.StructField("start_time", T.TimestampNTZType(), True),
    T.StructField("end_time", T.TimestampNTZType(), True),
    T.StructField("urls_processed", T.LongType(), False),
    T.StructField("urls_failed", T.LongType(), False),
    T.StructField("new_urls_found", T.LongType(), False),
    T.StructField("duplicate_urls", T.LongType(), False),
    T.StructField("total_requests", T.LongType(), False),
    T.StructField("average_response_time", T.DoubleType(), True),
    T.StructField("errors", T.ArrayType(T.StringType()), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), False),
])

PROXY_STATS = T.StructType([
    T.StructField("proxy_address", T.StringType(), False),
    T.StructField("success_count", T.LongType(), False),
    T.StructField("failure_count", T.LongType(), False),
    T.StructField("average_response_time", T.DoubleType(), True),
    T.StructField("last_used", T.TimestampNTZType(), True),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("error_messages", T.ArrayType(T.StringType()), False),
])

VERDICT = T.StructType([
    T.StructField("is_duplicate", T.BooleanType(), False),
    T.StructField("hash_value", T.StringType(), False),
    T.StructField("normalized_url", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
])

VALIDATION = T.StructType([
    T.StructField("is_valid", T.BooleanType(), False),
    T.StructField("reason", T.StringType(), False),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("html", T.StringType(), True),
])

FETCH_LOG = T.StructType([
    T.StructField("run_id", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("proxy_address", T.StringType(), True),
    T.StructField("status", T.IntegerType(), True),
    T.StructField("response_ms", T.DoubleType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("attempt", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
])
