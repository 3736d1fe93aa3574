"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

EMBEDDING_DIM = 1024

FILE_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("package", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
])

POSTING_SCHEMA = T.StructType([
    T.StructField("lexeme", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("positions", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType(), False),
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("last_commit_sha", T.StringType(), True),
    T.StructField("last_indexed_at", T.TimestampType(), True),
])

CHANGE_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("op", T.StringType(), False),
])

COMPARE_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType(), True),
    T.StructField("ahead_by", T.IntegerType(), True),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("status", T.StringType(), True),
        T.StructField("filename", T.StringType(), True),
        T.StructField("previous_filename", T.StringType(), True),
    ])), True),
])
