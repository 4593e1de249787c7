"""Perception-shaped input rows over the driver tables, by integer arithmetic.

The same SQL runs in Spark and DuckDB and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name -> SQL; a later one may read an earlier one.
FIXTURES = {
    "detections": """
SELECT event_id,
       CAST((event_id - event_id % 8) / 8 AS BIGINT) AS frame_id,
       CAST((event_id - event_id % 8) / 8 AS BIGINT) % 3 AS stream_id,
       event_id % 8 AS det_idx,
       CAST((CAST((event_id - event_id % 8) / 8 AS BIGINT) * 91) % 300 + (event_id * 37) % 60 AS DOUBLE) AS x1,
       CAST((CAST((event_id - event_id % 8) / 8 AS BIGINT) * 57) % 200 + (event_id * 53) % 60 AS DOUBLE) AS y1,
       CAST((CAST((event_id - event_id % 8) / 8 AS BIGINT) * 91) % 300 + (event_id * 37) % 60 + 60 + (event_id * 13) % 80 AS DOUBLE) AS x2,
       CAST((CAST((event_id - event_id % 8) / 8 AS BIGINT) * 57) % 200 + (event_id * 53) % 60 + 60 + (event_id * 29) % 100 AS DOUBLE) AS y2,
       CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score
FROM events""",
    "tracks": """
SELECT stream_id, frame_id, stream_id * 100 + det_idx AS track_id,
       x1 + (event_id * 11) % 21 - 10 AS x1, y1 + (event_id * 19) % 21 - 10 AS y1,
       x2 + (event_id * 11) % 21 - 10 AS x2, y2 + (event_id * 19) % 21 - 10 AS y2,
       CAST((event_id * 31) % 1000 AS DOUBLE) / 1000 AS sim,
       CONCAT('p', CAST(event_id % 5 AS VARCHAR(9))) AS best_label
FROM detections WHERE (frame_id + det_idx) % 11 <> 0""",
    "pose_keypoints": """
SELECT d.stream_id, d.frame_id, d.det_idx AS pose_idx, k.kp, d.x1 AS bx1, d.y1 AS by1, d.x2 AS bx2, d.y2 AS by2,
       d.x1 + (d.event_id * 17 + k.kp * 23) % CAST(d.x2 - d.x1 AS BIGINT) AS x,
       d.y1 + (d.event_id * 29 + k.kp * 31) % CAST(d.y2 - d.y1 AS BIGINT) AS y,
       CAST((d.event_id * 7 + k.kp * 13) % 100 AS DOUBLE) / 100 AS conf
FROM detections d
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16)) AS k(kp)""",
    "presence_names": """
SELECT CAST((event_id - event_id % 4) / 4 AS BIGINT) AS frame_id, event_id % 4 AS pos,
       MIN(ts) OVER (PARTITION BY CAST((event_id - event_id % 4) / 4 AS BIGINT)) AS ts,
       CASE WHEN event_id % 41 = 0 THEN '' WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'unknown'
            WHEN event_type = 'view' THEN 'alice' WHEN event_type = 'click' THEN 'bob' ELSE 'carol' END AS name,
       event_id % 7 = 0 AS is_fallen
FROM events""",
    "speaker_status": """
SELECT user_id AS stream_id, ts, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 3 END AS status_speaker,
       CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN '' ELSE CONCAT('{"text": "t', CAST(event_id AS VARCHAR(20)), '"}') END AS sentence_to_speak
FROM events WHERE event_type IN ('purchase', 'signup', 'view')""",
    "audio_chunks": """
SELECT user_id AS stream_id, ts, event_id AS chunk_id FROM events WHERE event_type = 'click'""",
    "asr_text": """
SELECT user_id AS stream_id, ts, CASE WHEN event_id % 5 = 0 THEN '' ELSE CONCAT('say ', CAST(event_id AS VARCHAR(20))) END AS payload
FROM events WHERE event_type = 'error'""",
    "conn_events": """
SELECT * FROM (
  SELECT CONCAT(CAST(user_id AS VARCHAR(20)), '-', CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR(20))) AS connection_id,
         ts, CASE WHEN event_type = 'signup' THEN 'connect' ELSE 'disconnect' END AS event
  FROM events WHERE event_type IN ('signup', 'error')) s
WHERE connection_id NOT LIKE '%-0'""",
    "gallery": """
SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 <> 0""",
    "probes": """
SELECT vec_id, label AS true_label, embedding FROM embeddings WHERE vec_id % 5 = 0""",
    "gallery_files": """
SELECT p_brand AS label, 'raw' AS kind, CONCAT('img', CAST(p_partkey AS VARCHAR(20))) AS stem,
       CASE p_partkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'JPG' END AS ext FROM part
UNION ALL
SELECT p_brand, 'aligned', CONCAT('img', CAST(p_partkey AS VARCHAR(20))), 'jpg' FROM part WHERE p_partkey % 3 <> 0""",
    "gallery_items": """
SELECT CONCAT(label, '/aligned/', stem, '.', ext) AS path, label,
       ROW_NUMBER() OVER (ORDER BY label, stem) - 1 AS row_id
FROM gallery_files WHERE kind = 'aligned' AND stem LIKE '%7%'""",
    "tensor_cells": """
SELECT CAST((event_id - event_id % 24) / 24 AS BIGINT) AS frame_id,
       CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride,
       (event_id * 97) % (CASE event_id % 3 WHEN 0 THEN 12800 WHEN 1 THEN 3200 ELSE 800 END) AS cell_idx,
       CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score,
       CAST((event_id * 3) % 40 AS DOUBLE) / 8 AS l, CAST((event_id * 7) % 40 AS DOUBLE) / 8 AS t,
       CAST((event_id * 11) % 40 AS DOUBLE) / 8 AS r, CAST((event_id * 17) % 40 AS DOUBLE) / 8 AS b
FROM events""",
    "messages": """
SELECT event_id, user_id AS stream_id, ts,
       CASE event_id % 5 WHEN 0 THEN '{"audio": "YWJj"}' WHEN 1 THEN '{"audio": "ZGVm", "rate": 48000, "language_code": "ja-JP"}'
            WHEN 2 THEN 'not json' WHEN 3 THEN '{"rate": 8000}' ELSE '{"timestamp": 1.5, "frame": "Z2hp"}' END AS message
FROM events""",
    "replies": """
SELECT doc_id, CONCAT(CASE doc_id % 4 WHEN 0 THEN 'The most interesting aspect of the video is ' WHEN 1 THEN 'The most interesting aspect of these images is '
       WHEN 2 THEN 'The most interesting aspect of this series of images is ' ELSE '' END, text) AS raw_text FROM documents""",
    "asr_results": """
SELECT conv_id, turn, turn % 2 = 0 AS is_final, CASE WHEN turn % 3 = 2 THEN '   ' ELSE CONCAT('  ', text, ' ') END AS transcript FROM conversations""",
    "latencies": """
SELECT event_type AS model, ts, value / 100 AS seconds FROM events""",
    "config_changes": """
SELECT ts, CASE event_id % 3 WHEN 0 THEN 'sim_thr' WHEN 1 THEN 'conf' ELSE 'no_such_key' END AS config_key, CAST((event_id % 10) AS DOUBLE) / 10 AS config_value
FROM events WHERE event_type = 'view'""",
}

TABLES = ("events", "embeddings", "documents", "conversations", "part", "lineitem", "orders", "customer", "supplier")


def _reads(name: str) -> list[str]:
    """What the fixture's SQL names, fixtures and tables alike."""
    words = set(FIXTURES[name].replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [n for n in (*TABLES, *FIXTURES) if n in words and n != name]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a fixture or of a driver table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for read in _reads(name):
        fixture(spark, sf_dir, read).createOrReplaceTempView(read)
    return spark.sql(FIXTURES[name])


def with_fixtures(names: str, sql: str) -> str:
    """``sql`` for DuckDB with the named fixtures, and those they read, before it."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in FIXTURES and name not in needed:
            for read in _reads(name):
                need(read)
            needed.append(name)

    for name in names.split():
        need(name)
    heads = ",\n".join(f"{n} AS (\n{FIXTURES[n]}\n)" for n in needed)
    return f"WITH {heads}\n{sql}" if heads else sql
