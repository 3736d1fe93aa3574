"""Views that give the operators realistic inputs from the given tables.

Documents stand for files, their 1000-character slices for chunks, events for changes. Of each benchmark text there are two
questions: ``pair``, its shortest and so most frequent pair of neighbouring words, and ``question``, any of all its words.
Each view is one SQL text with a few engine-specific spellings, so that Spark and the checking engine see the same rows.
"""

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.functions.sizing import spread
from repoindex.sources.tree import open_root

VIEWS = {
    "v_files": """
        SELECT concat('ns_', lang) AS namespace,
               concat('packages/', source, '/', lang, '/doc_', doc_id,
                      CASE mod(CAST(floor(doc_id / 20) AS INT), 10)
                          WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' WHEN 3 THEN '.go'
                          WHEN 4 THEN '.sql' WHEN 5 THEN '.md' WHEN 6 THEN '.txt' WHEN 7 THEN '.yml'
                          WHEN 8 THEN '.min.js' ELSE '.json' END) AS file_path,
               doc_id, text
        FROM {documents}""",
    "v_manifests": """
        SELECT DISTINCT concat('ns_', lang) AS namespace, concat('packages/', source) AS dir,
               concat('@corpus/', source) AS name
        FROM {documents} WHERE source IN ('src0', 'src2', 'src4', 'src6')
        UNION ALL
        SELECT DISTINCT concat('ns_', lang), concat('packages/', source, '/', lang),
               concat('@corpus/', source, '-', lang)
        FROM {documents} WHERE source = 'src0' AND lang = 'en'""",
    "v_chunks": """
        SELECT namespace,
               CASE WHEN file_path LIKE '%.md' OR file_path LIKE '%.txt' OR file_path LIKE '%.yml'
                    THEN 'docs' ELSE 'code' END AS kind,
               {sha256}(concat(namespace, ':', file_path, ':', i){sha256_bits}) AS id,
               file_path, '' AS package, i AS chunk_index, substr(text, i * 1000 + 1, 1000) AS text
        FROM (SELECT namespace, file_path, text, {slices} AS i
              FROM {v_files}
              WHERE file_path NOT LIKE '%.min.js' AND file_path NOT LIKE '%.json' AND length(text) > 0) x""",
    "v_changes": """
        SELECT e.event_id, e.ts, f.namespace, f.file_path,
               CASE e.event_type WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'added'
                                 WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS status,
               CASE WHEN e.event_type = 'purchase' THEN concat('old/', f.file_path) END AS previous_filename
        FROM {events} e JOIN {v_files} f ON e.user_id = f.doc_id""",
    "v_registry": """
        SELECT concat('ns_', lang) AS namespace,
               concat('https://example.org/corpus/', lang, '.git') AS repo_url,
               CASE lang WHEN 'es' THEN NULL ELSE md5(concat(lang, '-1')) END AS last_commit_sha,
               TIMESTAMP '2024-01-01 00:00:00' AS last_indexed_at
        FROM (SELECT DISTINCT lang FROM {documents}) t""",
    "v_heads": """
        SELECT concat('ns_', lang) AS namespace,
               CASE lang WHEN 'de' THEN md5(concat(lang, '-1')) ELSE md5(concat(lang, '-2')) END AS sha
        FROM (SELECT DISTINCT lang FROM {documents}) t""",
    "v_queries": """
        SELECT item_id AS query_id, text AS passage, {shortest_pair} AS pair, {any_word} AS question
        FROM (SELECT item_id, text, {words} AS w FROM {benchmark}) x""",
}

SPARK_WORDS = {
    "sha256": "sha2", "sha256_bits": ", 256",
    "slices": "explode(sequence(0, CAST(floor((length(text) - 1) / 1000) AS INT)))",
    "words": r"regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+', 0)",
    "shortest_pair": """CASE WHEN size(w) < 2 THEN array_join(w, ' ') ELSE substring(array_min(transform(
        sequence(1, size(w) - 1), i -> concat(lpad(CAST(length(w[i - 1]) + length(w[i]) AS STRING), 9, '0'),
                                              w[i - 1], ' ', w[i]))), 10) END""",
    "any_word": "array_join(transform(array_distinct(w), x -> concat('\"', x, '\"')), ' or ')",
}
CHECK_WORDS = {
    "sha256": "sha256", "sha256_bits": "",
    "slices": "unnest(range(0, CAST(floor((length(text) - 1) / 1000) AS INT) + 1))::INT",
    "words": r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')",
    "shortest_pair": """CASE WHEN len(w) < 2 THEN array_to_string(w, ' ') ELSE substr(list_min(list_transform(
        range(1, len(w)), lambda i: concat(lpad(CAST(length(w[i]) + length(w[i + 1]) AS VARCHAR), 9, '0'),
                                           w[i], ' ', w[i + 1]))), 10) END""",
    "any_word": "array_to_string(list_transform(list_distinct(w), lambda x: concat('\"', x, '\"')), ' or ')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    needed = {}
    for other in [*VIEWS, "documents", "events", "benchmark"]:
        if "{" + other + "}" in VIEWS[name]:
            needed[other] = view(spark, sf_dir, other) if other in VIEWS else table(spark, sf_dir, other)
    body = VIEWS[name]
    for word, spelling in SPARK_WORDS.items():
        body = body.replace("{" + word + "}", spelling)
    return spark.sql(body, **needed)


def check_ctes() -> dict[str, str]:
    """The views in the SQL of the checking engine, over tables of their own names."""
    names = {n: n for n in [*VIEWS, "documents", "events", "benchmark"]}
    return {name: body.format(**names, **CHECK_WORDS) for name, body in VIEWS.items()}


def write_tree(files: DataFrame, path: str) -> int:
    """Lay files (namespace, file_path, text) out as a tree, one file each, written by the tasks."""
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_root(path)
        for batch in batches:
            for name, space, text in zip(*(batch[c].to_pylist() for c in ("file_path", "namespace", "text"))):
                target = f"{root}/{space}/{name}"
                filesystem.create_dir(os.path.dirname(target), recursive=True)
                with filesystem.open_output_stream(target) as stream:
                    stream.write(text.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows = files.select("namespace", "file_path", "text").mapInArrow(save, "files long")
    return rows.agg(F.sum("files")).first()[0]
