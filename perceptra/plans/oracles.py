"""SQL for DuckDB that gives the rows of the registered queries.

Operators that take rows in turn recur over the place of a row in its group.
Models that hash texts have no SQL here; tests hold them against plain Python.
"""

from __future__ import annotations

from perceptra.operators.speech import ACTIVE, READY
from perceptra.plans.fixtures import with_fixtures

ORACLES: dict[str, str] = {}
_EPOCH = "epoch_us(ts)"


def sql(name: str, fixtures: str, body: str) -> None:
    ORACLES[name] = with_fixtures(fixtures, body)


_CENTROIDS = """
, places AS (
  SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM gallery),
means AS (SELECT label, i, avg(v) AS m, count(v) AS n FROM places GROUP BY label, i),
norms AS (SELECT label, max(n) AS n, sqrt(sum(m * m)) + 1e-9 AS norm FROM means GROUP BY label)
"""


def _and_then(fixtures: str, more: str, body: str) -> str:
    """SQL whose own common tables follow the fixtures."""
    return with_fixtures(fixtures, "").rstrip() + more + body


ORACLES["identity_centroids"] = _and_then("gallery", _CENTROIDS, """
SELECT label, n.n AS count, CAST(i AS INTEGER) AS i, round(m / norm, 6) AS value FROM means JOIN norms n USING (label)""")
sql("gallery_stats", "gallery", """
SELECT label, count(*) AS count, CAST(max(len(embedding)) AS INTEGER) AS dim,
       CAST((SELECT count(*) FROM gallery) AS INTEGER) AS total FROM gallery GROUP BY label""")
ORACLES["match_gallery"] = _and_then("gallery probes", _CENTROIDS, """
, centroids AS (SELECT label, i, m / norm AS c FROM means JOIN norms USING (label)),
asked AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM probes),
sims AS (SELECT vec_id, label, sum(v * c) AS sim FROM asked JOIN centroids USING (i) GROUP BY vec_id, label),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS n FROM sims)
SELECT vec_id, CASE WHEN sim >= 0.2 THEN CAST(label AS VARCHAR) ELSE '__unknown__' END AS label, round(sim, 6) AS sim
FROM best WHERE n = 1""")
sql("retrieve_answers", "gallery probes", """
SELECT vec_id, CAST(n AS INTEGER) AS rank, qa_id, round(score, 6) AS score, 'q' || qa_id AS matched_question,
       CASE WHEN best >= 0.3 THEN answer END AS answer,
       CASE WHEN best < 0.3 OR answer = '' THEN 'MISS' ELSE 'HIT' END AS outcome
FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS best FROM (
  SELECT p.vec_id, g.vec_id AS qa_id, CASE WHEN g.vec_id % 7 = 0 THEN '' ELSE 'a' || g.vec_id END AS answer,
         list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY p.vec_id ORDER BY list_dot_product(CAST(p.embedding AS DOUBLE[]),
                            CAST(g.embedding AS DOUBLE[])) DESC, g.vec_id) AS n
  FROM probes p, gallery g) r WHERE n <= 3) s""")
sql("normalise_l2", "", """
SELECT vec_id, round(sum(v / (norm + 1e-9) * (i + 1)), 6) AS value FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings) e
GROUP BY vec_id""")
sql("read_vectors_f32", "", """
SELECT row_id, round(sum(v * (i + 1)), 6) AS value FROM (
  SELECT row_id, unnest(range(len(embedding))) AS i, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS v FROM (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings
    WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)
      AND list_aggregate(embedding, 'count') = len(embedding)) e) c
GROUP BY row_id""")
sql("identity_counts", "gallery_files", """
SELECT label, count(*) FILTER (kind = 'aligned' AND lower(ext) IN ('jpg','jpeg','png','bmp','webp')) AS aligned,
       count(*) FILTER (kind = 'raw' AND lower(ext) IN ('jpg','jpeg','png','bmp','webp')) AS raw FROM gallery_files GROUP BY label""")
sql("gallery_worklist", "gallery_files gallery_items", """
SELECT label, stem, label || '/aligned/' || stem || '.' || ext AS path FROM gallery_files
WHERE kind = 'aligned' AND label || '/aligned/' || stem || '.' || ext NOT IN (SELECT path FROM gallery_items)""")
sql("align_worklist", "gallery_files", """
SELECT label, stem, ext FROM gallery_files f WHERE kind = 'raw' AND ext IN ('jpg','jpeg','png','bmp','JPG','PNG')
AND NOT EXISTS (SELECT 1 FROM gallery_files a WHERE a.kind = 'aligned' AND a.ext = 'jpg' AND a.label = f.label AND a.stem = f.stem)""")
sql("scan_gallery", "gallery_files", """
SELECT label, kind, label || '/' || kind || '/' || stem || '.' || ext AS rel_path, stem, ext FROM gallery_files
WHERE ext IN ('jpg','jpeg','png','bmp','JPG','PNG')""")
sql("attach_row_labels", "gallery_items", """
SELECT vec_id AS row_id, coalesce(i.label, '') AS label FROM embeddings
LEFT JOIN (SELECT row_id, arg_max(label, path) AS label FROM gallery_items GROUP BY row_id) i ON i.row_id = vec_id""")
sql("delete_identities", "gallery_items", """
SELECT path, label, row_number() OVER (ORDER BY label, path) - 1 AS row_id FROM gallery_items
WHERE NOT (label LIKE '%3' OR label LIKE '%5')""")
sql("deletion_report", "gallery_items gallery_files", """
SELECT DISTINCT i.label, (i.label IN (SELECT label FROM gallery_files WHERE label LIKE '%3')
  OR EXISTS (SELECT 1 FROM gallery_items WHERE NOT (label LIKE '%3' OR label LIKE '%5'))) AS deleted
FROM gallery_items i WHERE i.label LIKE '%3' OR i.label LIKE '%5'""")
sql("append_vectors", "gallery_files gallery_items", """
SELECT label, path, row_number() OVER (ORDER BY label, path) - 1 + (SELECT count(*) FROM gallery_items) AS row_id FROM (
  SELECT label, label || '/aligned/' || stem || '.' || ext AS path FROM gallery_files WHERE kind = 'aligned') f
WHERE path NOT IN (SELECT path FROM gallery_items)""")

sql("filter_confidence", "detections", "SELECT * FROM detections WHERE score >= 0.5")
_CELL = """
SELECT *, (p % w) * stride AS cx, (p // w) * stride AS cy FROM (
  SELECT *, cell_idx // 2 AS p, 640 // stride AS w FROM tensor_cells) t"""
sql("decode_anchor_boxes", "tensor_cells", f"""
SELECT frame_id, stride, cell_idx, round(cx - l * stride, 6) AS x1, round(cy - t * stride, 6) AS y1,
       round(cx + r * stride, 6) AS x2, round(cy + b * stride, 6) AS y2 FROM ({_CELL}) c""")
sql("decode_anchor_keypoints", "tensor_cells", f"""
SELECT frame_id, stride, cell_idx, CAST(i AS INTEGER) AS i, round(cx + kps[2 * i + 1] * stride, 6) AS x,
       round(cy + kps[2 * i + 2] * stride, 6) AS y
FROM (SELECT *, [l, t, r, b, l, t, r, b, l, t] AS kps FROM ({_CELL}) c) k, range(5) AS g(i)""")
sql("decode_best_anchor_boxes", "tensor_cells", """
SELECT frame_id, stride, cell_idx, round(score, 6) AS score,
       round((p % w + 0.5) * stride - l * u, 6) AS x1, round((p // w + 0.5) * stride - t * u, 6) AS y1,
       round((p % w + 0.5) * stride + r * u, 6) AS x2, round((p // w + 0.5) * stride + b * u, 6) AS y2
FROM (SELECT *, CASE WHEN quantile_cont(d, 0.5) OVER (PARTITION BY frame_id, stride) < 12 THEN stride ELSE 1 END AS u,
        row_number() OVER (PARTITION BY frame_id, stride, side ORDER BY score DESC, cell_idx) AS n
      FROM (SELECT *, unnest([l, t, r, b]) AS d, unnest([1, 2, 3, 4]) AS side FROM (
        SELECT *, cell_idx // 2 AS p, 640 // stride AS w,
          row_number() OVER (PARTITION BY frame_id, stride, cell_idx // 2 ORDER BY score DESC, cell_idx) AS best
        FROM (SELECT * REPLACE (CASE WHEN low < 0 OR high > 1 THEN 1 / (1 + exp(-score)) ELSE score END AS score) FROM (
          SELECT *, min(score) OVER (PARTITION BY frame_id, stride) AS low, max(score) OVER (PARTITION BY frame_id, stride) AS high
          FROM tensor_cells) a) b) c WHERE best = 1) d) e
WHERE side = 1 AND score >= 0.5 AND n <= 150""")
_BOX = "stream_id, frame_id, det_idx"
sql("unletterbox_top_left", "detections", f"""
SELECT {_BOX}, round(x1 / 0.5, 6) AS x1, round(y1 / 0.5, 6) AS y1, round(x2 / 0.5, 6) AS x2, round(y2 / 0.5, 6) AS y2 FROM detections""")
_IN = lambda v, pad, most: f"least(greatest(({v} - {pad}) / 0.5, 0.0), {most}.0)"
sql("unletterbox_centered_int", "detections", f"""
SELECT * FROM (SELECT {_BOX}, CAST(trunc({_IN('x1', 0, 1279)}) AS INTEGER) AS x1, CAST(trunc({_IN('y1', 140, 719)}) AS INTEGER) AS y1,
  CAST(trunc({_IN('x2', 0, 1279)}) AS INTEGER) AS x2, CAST(trunc({_IN('y2', 140, 719)}) AS INTEGER) AS y2 FROM detections) d
WHERE least(x2 - x1, y2 - y1) >= 8""")
sql("unletterbox_centered_clip", "detections", f"""
SELECT {_BOX}, round({_IN('x1', 0, 1280)}, 6) AS x1, round({_IN('y1', 140, 720)}, 6) AS y1,
       round({_IN('x2', 0, 1280)}, 6) AS x2, round({_IN('y2', 140, 720)}, 6) AS y2 FROM detections""")
sql("expand_clip_box", "detections", f"""
SELECT {_BOX}, greatest(0, CAST(trunc((x1 + x2) / 2 - (x2 - x1) * 1.25 / 2) AS INTEGER)) AS x1,
  greatest(0, CAST(trunc((y1 + y2) / 2 - (y2 - y1) * 1.25 / 2) AS INTEGER)) AS y1,
  least(639, CAST(trunc((x1 + x2) / 2 + (x2 - x1) * 1.25 / 2) AS INTEGER)) AS x2,
  least(479, CAST(trunc((y1 + y2) / 2 + (y2 - y1) * 1.25 / 2) AS INTEGER)) AS y2 FROM detections""")
sql("expand_box", "detections", f"""
SELECT {_BOX}, round(x1 - 0.25 * (x2 - x1), 6) AS x1, round(y1 - 0.25 * (y2 - y1), 6) AS y1,
       round(x2 + 0.25 * (x2 - x1), 6) AS x2, round(y2 + 0.25 * (y2 - y1), 6) AS y2 FROM detections""")
sql("point_in_box", "detections", f"""
SELECT {_BOX}, x1, y1, x2, y2 FROM detections WHERE 250 BETWEEN x1 AND x2 AND 200 BETWEEN y1 AND y2""")


def _iou(a: str, b: str, one: str) -> str:
    w = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {one})"
    h = f"greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {one})"
    size = lambda t: f"({t}.x2 - {t}.x1 + {one}) * ({t}.y2 - {t}.y1 + {one})"
    return f"{w} * {h} / ({size(a)} + {size(b)} - {w} * {h} + 1e-9)"


sql("iou", "detections", f"""
SELECT a.stream_id, a.frame_id, a.det_idx, o.det_idx AS other_idx, round({_iou('a', 'o', '1.0')}, 6) AS iou_plus_one,
       round({_iou('a', 'o', '0.0')}, 6) AS iou_plain
FROM detections a JOIN detections o USING (stream_id, frame_id) WHERE a.det_idx < o.det_idx""")


def _top(name: str, order: str, columns: str) -> None:
    sql(name, "detections", f"""
SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY {order} DESC, det_idx) AS n
FROM detections) d WHERE n <= 3""")


_AREA = "(x2 - x1) * (y2 - y1)"
_top("top_center_area", f"{_AREA} - 2 * (pow((x1 + x2) / 2 - 320, 2) + pow((y1 + y2) / 2 - 240, 2))", f"{_BOX}, x1, y1, x2, y2")
_top("top_area", _AREA, f"{_BOX}, x1, y1, x2, y2")
_top("top_score_area", f"score * greatest({_AREA}, 1.0)", "frame_id, det_idx, score")
sql("faces_by_area", "tracks", f"""
SELECT stream_id, frame_id, track_id, CAST(row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY {_AREA} DESC, track_id)
  AS INTEGER) AS position FROM tracks""")
sql("largest_face", "detections", f"""
SELECT {_BOX}, score FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY {_AREA} DESC, det_idx) AS n
FROM detections) d WHERE n = 1""")
sql("match_tracks_to_dets", "tracks detections", f"""
SELECT stream_id, frame_id, track_id, det_idx, round(iou, 6) AS iou FROM (
  SELECT t.stream_id, t.frame_id, track_id, det_idx, {_iou('t', 'd', '0.0')} AS iou, row_number() OVER (
    PARTITION BY t.stream_id, t.frame_id, track_id ORDER BY {_iou('t', 'd', '0.0')} DESC, det_idx) AS n
  FROM tracks t JOIN detections d ON d.stream_id = t.stream_id AND d.frame_id = t.frame_id) p WHERE n = 1 AND iou > 0.3""")
_VOTES = "SELECT track_id, frame_id AS seq, CASE WHEN sim >= 0.4 THEN best_label ELSE '__unknown__' END AS name, sim FROM tracks"
_EACH = f"""SELECT *, sum(n) OVER (PARTITION BY track_id) AS total,
  row_number() OVER (PARTITION BY track_id ORDER BY name = '__unknown__', n DESC, first) AS place FROM (
  SELECT track_id, name, count(*) AS n, avg(sim) AS mean, max(sim) AS most, min(seq) AS first FROM ({_VOTES}) v
  GROUP BY track_id, name) e"""
_WON = "name <> '__unknown__' AND n / total >= 0.1"
sql("majority_vote", "tracks", f"""
SELECT track_id, CASE WHEN {_WON} THEN 'identified' ELSE 'unknown' END AS status, CASE WHEN {_WON} THEN name END AS name,
       round(CASE WHEN {_WON} THEN mean END, 6) AS sim FROM ({_EACH}) f WHERE place = 1""")
sql("interim_guess", "tracks", f"""
SELECT track_id, name, round(most, 6) AS sim FROM ({_EACH}) f WHERE place = 1 AND name <> '__unknown__'""")
sql("evict_stale", "", """
SELECT user_id AS track_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS episode FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 36000000000 THEN 1 ELSE 0 END AS new
  FROM events) e""")
_SHOWN = """CASE WHEN sim > 0.6 THEN best_label || ' (' || printf('%.2f', CAST(round(CAST(sim AS DECIMAL(18, 6)), 2) AS DOUBLE)) || ')'
  WHEN sim > 0.3 THEN best_label || '? (' || printf('%.2f', CAST(round(CAST(sim AS DECIMAL(18, 6)), 2) AS DOUBLE)) || ')' ELSE 'unknown' END"""
sql("display_names", "tracks", f"""
SELECT stream_id, frame_id, track_id, {_SHOWN} AS shown, CASE WHEN sim > 0.3 THEN best_label ELSE 'unknown' END AS name FROM tracks""")

_POSE = "stream_id, frame_id, pose_idx"
sql("keypoint_counts", "pose_keypoints", """
SELECT frame_id, pose_idx, CAST(count(*) FILTER (conf >= 0.5 AND kp <= 10) AS INTEGER) AS n_upper,
  CAST(count(*) FILTER (conf >= 0.5 AND kp >= 11) AS INTEGER) AS n_lower,
  CAST(count(*) FILTER (conf >= 0.5) AS INTEGER) AS n_total FROM pose_keypoints GROUP BY frame_id, pose_idx""")


def _lean(top: str, low: str) -> str:
    return f"CASE WHEN abs(x{top} - x{low}) > 1 THEN abs(y{top} - y{low}) / (abs(x{top} - x{low}) + 1e-6) END"


_KP = ", ".join(
    f"max(CASE WHEN kp = {k} AND conf >= 0.5 THEN {c} END) AS {c}{k}" for k in (5, 6, 11, 12, 13, 14, 15, 16) for c in "xy"
)
_FALLS = f"""
SELECT *, CASE WHEN n_total < 3 THEN FALSE ELSE confidence > 0.5 END AS is_fallen, CASE WHEN n_total < 3 THEN 0.0 ELSE confidence END AS fall_confidence
FROM (SELECT *, CASE WHEN total > 0 THEN score / total ELSE 0.0 END AS confidence FROM (
 SELECT *, CASE WHEN tc > 0 THEN w ELSE 0 END + CASE WHEN hc > 0 THEN w ELSE 0 END + CASE WHEN ac > 0 THEN 0.2 ELSE 0 END AS total,
  tc * w + hc * w + ac * 0.2 AS score FROM (
  SELECT *, CASE WHEN aspect THEN 0.4 ELSE 0.5 END AS w, CASE WHEN slope < 0.2 THEN 1 - slope / 0.2 ELSE 0.0 END AS tc,
   CASE WHEN bh >= 10 AND gap > -0.3 THEN least(1.0, (gap + 0.3) / 0.5) ELSE 0.0 END AS hc,
   CASE WHEN aspect AND bh >= 10 AND bw / bh > 1.2 THEN least(1.0, (bw / bh - 1.2) / 0.5) ELSE 0.0 END AS ac FROM (
   SELECT *, least({_lean('5', '11')}, {_lean('6', '12')}, {_lean('56', '1112')}) AS slope,
     (y56 - greatest(y13, y14, y15, y16)) / bh AS gap, n_upper >= 2 AND n_lower >= 3 AS aspect FROM (
     SELECT *, (x5 + x6) / 2 AS x56, (y5 + y6) / 2 AS y56, (x11 + x12) / 2 AS x1112, (y11 + y12) / 2 AS y1112 FROM (
      SELECT {_POSE}, bx2 - bx1 AS bw, by2 - by1 AS bh, {_KP}, count(*) FILTER (conf >= 0.5 AND kp <= 10) AS n_upper,
       count(*) FILTER (conf >= 0.5 AND kp >= 11) AS n_lower, count(*) FILTER (conf >= 0.5) AS n_total
      FROM pose_keypoints GROUP BY {_POSE}, bx1, by1, bx2, by2) a) b) c) d) e) f"""
sql("fall_score", "pose_keypoints", f"SELECT frame_id, pose_idx, is_fallen, round(fall_confidence, 6) AS fall_confidence FROM ({_FALLS}) g")
sql("fall_alerts", "pose_keypoints", f"""
SELECT stream_id, frame_id, count(*) FILTER (is_fallen) AS fallen_count, count(*) FILTER (is_fallen) > 0 AS alert
FROM ({_FALLS}) g GROUP BY stream_id, frame_id""")
_CX, _CY = (lambda v: _IN(v, 0, 1280)), (lambda v: _IN(v, 140, 720))
sql("decode_pose", "pose_keypoints", f"""
SELECT frame_id, pose_idx, round({_CX('bx1')}, 6) AS x1, round({_CY('by1')}, 6) AS y1, round({_CX('bx2')}, 6) AS x2,
       round({_CY('by2')}, 6) AS y2, round(sum({_CX('x')}), 6) AS sum_x, round(sum({_CY('y')}), 6) AS sum_y, round(sum(conf), 6) AS sum_conf
FROM pose_keypoints GROUP BY frame_id, pose_idx, bx1, by1, bx2, by2""")
sql("smooth_falls", "", """
SELECT track_id, event_id, is_fallen, CASE WHEN n < 2 THEN is_fallen ELSE fallen / n >= 0.5 END AS smoothed FROM (
  SELECT track_id, event_id, is_fallen, len(list_filter(r, lambda v: t - v.t <= 86400000000)) AS n,
         len(list_filter(r, lambda v: t - v.t <= 86400000000 AND v.f)) AS fallen FROM (
    SELECT *, list({'t': t, 'f': is_fallen}) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM (
      SELECT user_id AS track_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS is_fallen FROM events) a) b) c""")

_NAMED = "name IS NOT NULL AND name NOT IN ('', 'unknown')"
_EVENTS = """
, rows_ AS (SELECT *, frame_id % 5 AS stream_id FROM presence_names WHERE ts <= TIMESTAMP '2024-01-30'),
order_ AS (SELECT stream_id, frame_id, min(ts) AS ts, row_number() OVER (PARTITION BY stream_id ORDER BY min(ts) DESC, frame_id DESC) AS n
           FROM rows_ GROUP BY stream_id, frame_id),
kept AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY stream_id) AS last FROM order_ WHERE n <= 300) k
         WHERE ts >= last - INTERVAL 259200 SECOND),
seen AS (SELECT r.*, k.n, k.ts >= TIMESTAMP '2024-01-30' - INTERVAL 172800 SECOND AS recent FROM rows_ r JOIN kept k USING (stream_id, frame_id)),
frames AS (SELECT stream_id, frame_id, any_value(recent) AS recent, any_value(n) AS n, count(*) FILTER (name = 'unknown') AS unknowns,
           count(*) FILTER (is_fallen) AS fallen FROM seen GROUP BY stream_id, frame_id),
named AS (SELECT stream_id, name, count(DISTINCT frame_id) AS frames FROM seen
          WHERE recent AND name IS NOT NULL AND name NOT IN ('', 'unknown') GROUP BY stream_id, name),
now_ AS (SELECT stream_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (name IS NOT NULL AND name NOT IN ('', 'unknown')), '') AS now,
  count(*) FILTER (name = 'unknown') AS unknown_now,
  coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (is_fallen AND name IS NOT NULL AND name NOT IN ('', 'unknown')), '') AS fallen_now,
  count(DISTINCT name) FILTER (is_fallen AND name IS NOT NULL AND name NOT IN ('', 'unknown')) AS n_fallen,
  count(*) FILTER (is_fallen AND (name IS NULL OR name IN ('', 'unknown'))) AS fallen_unknown_now
  FROM seen WHERE n = 1 GROUP BY stream_id)
"""
ORACLES["presence_snapshot"] = _and_then("presence_names", _EVENTS, """
SELECT stream_id, CAST(unknown_now AS INTEGER) AS unknown_now, CAST(fallen_unknown_now AS INTEGER) AS fallen_unknown_now,
  count(*) FILTER (recent) AS frames_recent, count(*) FILTER (recent AND unknowns > 0) AS frames_with_unknown,
  CAST(coalesce(max(unknowns) FILTER (recent), 0) AS INTEGER) AS unknown_recent,
  count(*) FILTER (recent AND fallen > 0) AS frames_with_fall, CAST(n_fallen + fallen_unknown_now AS INTEGER) AS fallen_count,
  n_fallen + fallen_unknown_now > 0 AS fall_alert, now, fallen_now
FROM now_ JOIN frames USING (stream_id) GROUP BY stream_id, unknown_now, fallen_unknown_now, n_fallen, now, fallen_now""")
ORACLES["presence_name_frames"] = _and_then("presence_names", _EVENTS, "SELECT stream_id, name, frames FROM named")
ORACLES["fallen_recent"] = _and_then("presence_names", _EVENTS, """
SELECT f.stream_id, identity, f.n AS fallen_frames, coalesce(frames, f.n) AS total_frames FROM (
  SELECT stream_id, CASE WHEN name IS NULL OR name IN ('', 'unknown') THEN 'unknown' ELSE name END AS identity, count(*) AS n
  FROM seen WHERE recent AND is_fallen GROUP BY 1, 2) f LEFT JOIN named ON named.stream_id = f.stream_id AND named.name = identity""")
sql("single_face_ready", "presence_names", f"""
SELECT stream_id, min(ts) FILTER (faces = 1 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15') AS ready_at FROM (
  SELECT frame_id % 5 AS stream_id, min(ts) AS ts, count(DISTINCT name) FILTER ({_NAMED}) + count(*) FILTER (name = 'unknown') AS faces
  FROM presence_names GROUP BY frame_id) f GROUP BY stream_id""")

sql("parse_audio_messages", "messages", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN hex(from_base64('YWJj')) ELSE hex(from_base64('ZGVm')) END AS audio,
       CAST(CASE event_id % 5 WHEN 0 THEN 16000 ELSE 48000 END AS INTEGER) AS rate
FROM messages WHERE message LIKE '{"audio"%'""")
sql("parse_remote_audio", "messages", """
SELECT event_id, hex(from_base64(json_extract_string(message, '$.audio'))) AS audio,
  CAST(coalesce(last_value(CAST(json_extract_string(message, '$.rate') AS INTEGER) IGNORE NULLS) OVER w, 16000) AS INTEGER) AS rate,
  coalesce(last_value(json_extract_string(message, '$.language_code') IGNORE NULLS) OVER w, 'en-US') AS language_code
FROM messages WHERE message LIKE '{"audio"%' WINDOW w AS (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
sql("read_topic", "", """
SELECT make_timestamp(event_id * 1000000) AS ts, CAST(user_id AS VARCHAR) AS frame_id,
  CASE event_id % 4 WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'READY' WHEN 2 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status_mic_name,
  CASE event_id % 3 WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'READY' ELSE 'ACTIVE' END AS status_speaker_name, event_type AS sentence FROM events""")
sql("strip_score", "tracks", "SELECT stream_id, frame_id, track_id, best_label AS name FROM tracks")
sql("parse_frames", "messages", """
SELECT event_id, hex(from_base64(CASE event_id % 5 WHEN 3 THEN 'rate8000' ELSE 'Z2hp' END)) AS frame FROM messages WHERE event_id % 5 IN (3, 4)""")
sql("preview_text", "messages", """
SELECT event_id, CASE WHEN length(message) <= 50 THEN message ELSE left(message, 5) || '...' || right(message, 5) END AS preview FROM messages""")
sql("emit_audio_messages", "audio_chunks", """
SELECT '{"audio":"' || to_base64(CAST(CAST(chunk_id AS VARCHAR) AS BLOB)) ||
  '","rate":16000,"language_code":"en-US","alternative_language_codes":["de-DE"],"timestamp":' || CAST(floor(epoch(ts)) AS BIGINT) || '}' AS message
FROM audio_chunks""")
sql("emit_replies", "replies", """
SELECT CAST(to_json({'vlm_reply': raw_text}) AS VARCHAR) AS value FROM replies""")
_REPLY = "lower(raw_text)"
for _opening in ("this series of images", "the series of images", "the images", "these images", "the video"):
    _REPLY = f"replace({_REPLY}, 'the most interesting aspect of {_opening} is', 'You see')"
sql("clean_reply", "replies", f"SELECT doc_id, {_REPLY} AS reply FROM replies")
sql("final_transcripts", "asr_results", """
SELECT conv_id, turn, trim(transcript, ' ') AS transcript, is_final FROM asr_results WHERE is_final AND length(trim(transcript, ' ')) > 0""")


def _asof(rows: str, states: str, value: str) -> str:
    """Rows with the last state at or before their time."""
    return f"""
SELECT * FROM (SELECT *, last_value({value} IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS state_
FROM (SELECT *, 1 AS kind FROM {rows} UNION ALL BY NAME SELECT stream_id, ts, {value}, 0 AS kind FROM {states}) u) s WHERE kind = 1"""


sql("gate_audio", "audio_chunks speaker_status", f"""
SELECT stream_id, chunk_id FROM ({_asof('audio_chunks', f'''(SELECT stream_id, ts,
  CASE status_speaker WHEN {READY} THEN TRUE WHEN {ACTIVE} THEN FALSE END AS opens FROM speaker_status) q''', 'opens')}) g
WHERE coalesce(state_, TRUE)""")
sql("tts_requests", "speaker_status", f"""
SELECT stream_id, ts, json_extract_string(sentence_to_speak, '$.text') AS text, 'default' AS voice_id FROM speaker_status
WHERE status_speaker = {ACTIVE} AND length(sentence_to_speak) > 0""")
sql("tts_interrupts", "asr_text speaker_status", f"""
SELECT stream_id, ts, payload FROM ({_asof('asr_text', 'speaker_status', 'status_speaker')}) g
WHERE state_ = {ACTIVE} AND length(payload) > 0""")
sql("interrupted_requests", "speaker_status asr_text", """
SELECT stream_id, request_id, CASE WHEN bool_or(i >= enqueued AND i < started) THEN 'cancelled'
  WHEN bool_or(i >= started AND i < finished) THEN 'cut' ELSE 'finished' END AS outcome
FROM (SELECT r.*, a.ts AS i FROM (SELECT stream_id, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS request_id, ts AS enqueued,
        ts + INTERVAL 6 HOUR AS started, ts + INTERVAL 12 HOUR AS finished FROM speaker_status WHERE status_speaker = 2) r
      LEFT JOIN (SELECT stream_id, ts FROM asr_text WHERE length(payload) > 0) a ON a.stream_id = r.stream_id) x
GROUP BY stream_id, request_id""")
sql("speaker_intervals", "speaker_status", """
SELECT stream_id, ts AS started, ended FROM (
  SELECT *, lead(ts) OVER (PARTITION BY stream_id ORDER BY ts) AS ended FROM (
    SELECT *, lag(status_speaker) OVER (PARTITION BY stream_id ORDER BY ts) AS before FROM speaker_status WHERE status_speaker IN (1, 2)) a
  WHERE before IS NULL OR before <> status_speaker) b WHERE status_speaker = 2""")
sql("idle_gaps", "audio_chunks", """
SELECT stream_id, gap_start, gap_end FROM (SELECT stream_id, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts) AS gap_start, ts AS gap_end
FROM audio_chunks) g WHERE epoch_us(gap_end) - epoch_us(gap_start) >= 86400000000""")
sql("coalesce_chunks", "audio_chunks", """
SELECT stream_id, date_trunc('day', ts) AS start, string_agg(CAST(chunk_id AS VARCHAR), '' ORDER BY ts) AS payload FROM audio_chunks
GROUP BY stream_id, date_trunc('day', ts)""")
_SESSIONS = """
SELECT connection_id, ts AS started, least(coalesce(closed, ts + INTERVAL 21600 SECOND), ts + INTERVAL 21600 SECOND) AS ended,
  CASE WHEN closed <= ts + INTERVAL 21600 SECOND THEN 'disconnect' ELSE 'timeout' END AS reason FROM (
  SELECT *, min(CASE WHEN event = 'disconnect' THEN ts END) OVER (PARTITION BY connection_id ORDER BY ts
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM conn_events) c WHERE event = 'connect'"""
sql("conn_sessions", "conn_events", _SESSIONS)
sql("route_messages", "conn_events", f"""
SELECT DISTINCT message_id, s.connection_id, ts FROM (
  SELECT event_id AS message_id, ts, CASE WHEN event_id % 3 > 0 THEN user_id || '-1' END AS target FROM events WHERE event_type = 'view') m
JOIN ({_SESSIONS}) s ON (target IS NULL OR target = s.connection_id) AND ts >= started AND ts < ended""")

_FRAMES = "SELECT user_id % 4 AS stream_id, event_id AS frame_id, ts, epoch_us(ts) AS t FROM events"
sql("fps_estimate", "", f"""
SELECT stream_id, frame_id, round(CASE WHEN n < 2 OR span <= 0 THEN 30.0 ELSE least(greatest((n - 1) / span, 5.0), 60.0) END, 6) AS fps FROM (
  SELECT *, count(*) OVER w AS n, (max(t) OVER w - min(t) OVER w) / 1e6 AS span FROM ({_FRAMES}) f
  WINDOW w AS (PARTITION BY stream_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) g""")
sql("batch_frames", "", f"""
SELECT stream_id, batch, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY ts, frame_id) AS items FROM (
  SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY ts, frame_id) - 1) // 5 AS batch FROM ({_FRAMES}) f) g
GROUP BY stream_id, batch HAVING count(*) = 5""")
sql("latest_per_interval", "", f"""
SELECT stream_id, date_trunc('hour', ts) AS start, arg_max(frame_id, ts) AS frame_id FROM ({_FRAMES}) f GROUP BY stream_id, date_trunc('hour', ts)""")
sql("drop_late_frames", "", f"""
SELECT stream_id, frame_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY ts) AS gap FROM ({_FRAMES}) f) g
WHERE gap IS NULL OR gap <= 1.5 * 7200 * 1e6""")
sql("throughput", "", f"""
SELECT stream_id, start, frames, round(frames / 3600, 6) AS fps,
  round(CASE WHEN max(high) OVER w > min(low) OVER w THEN sum(frames) OVER w / ((max(high) OVER w - min(low) OVER w) / 1e6) END, 6) AS running_fps
FROM (SELECT stream_id, date_trunc('hour', ts) AS start, count(*) AS frames, min(t) AS low, max(t) AS high FROM ({_FRAMES}) f
      GROUP BY stream_id, date_trunc('hour', ts)) g WINDOW w AS (PARTITION BY stream_id ORDER BY start)""")
sql("select_blur", "detections", """
SELECT frame_id, det_idx, NOT coalesce(CASE WHEN det_idx % 3 = 0 THEN NULL ELSE score > 0.5 END, FALSE) AS blur FROM detections""")
sql("filter_frame_size", "detections", """
SELECT frame_id, det_idx, x2 - x1 AS width, y2 - y1 AS height FROM detections WHERE x2 - x1 = 60 AND y2 - y1 = 60""")
sql("latency_metrics", "latencies", """
SELECT model, count(*) FILTER (seconds <= 0.1) AS le_0, count(*) FILTER (seconds <= 0.25) AS le_1, count(*) FILTER (seconds <= 0.5) AS le_2,
  count(*) FILTER (seconds <= 1.0) AS le_3, count(*) FILTER (seconds <= 2.5) AS le_4, count(*) FILTER (seconds <= 5.0) AS le_5,
  round(sum(seconds), 6) AS sum, count(seconds) AS count, round(arg_max(seconds, ts), 6) AS last FROM latencies GROUP BY model""")
sql("batch_latency", "latencies", """
SELECT batch_id, round(t / n, 2) AS embed_ms, round(t / 4 / n, 3) AS search_ms, round(t * 2 / n, 2) AS total_ms FROM (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, count(*) AS n, CAST(sum(floor(seconds * 100)) AS DOUBLE) AS t FROM latencies
  GROUP BY CAST(ts AS DATE)) b""")
sql("config_asof", "latencies config_changes", """
SELECT model, ts, coalesce(sim, 0.55) AS sim_thr, coalesce(con, 0.5) AS conf FROM (
  SELECT *, last_value(s IGNORE NULLS) OVER w AS sim, last_value(c IGNORE NULLS) OVER w AS con FROM (
    SELECT model, ts, NULL AS s, NULL AS c, 1 AS kind FROM latencies UNION ALL
    SELECT NULL, ts, CASE config_key WHEN 'sim_thr' THEN config_value END, CASE config_key WHEN 'conf' THEN config_value END, 0
    FROM config_changes) u WINDOW w AS (ORDER BY ts, kind ROWS UNBOUNDED PRECEDING)) x WHERE kind = 1""")
sql("merge_streams", "audio_chunks speaker_status asr_text", """
SELECT stream_id, ts, chunk_id, NULL AS status_speaker, NULL AS payload FROM audio_chunks UNION ALL
SELECT stream_id, ts, NULL, status_speaker, NULL FROM speaker_status UNION ALL SELECT stream_id, ts, NULL, NULL, payload FROM asr_text""")
sql("decode_enums", "speaker_status", """
SELECT stream_id, ts, CASE status_speaker WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'READY' WHEN 2 THEN 'ACTIVE' WHEN 3 THEN 'UNKNOWN' END
  AS status_speaker_name FROM speaker_status""")
sql("normalise_header", "", """
SELECT event_id, make_timestamp(event_id * 1000000 + ((event_id * 7919) % 1000000000) // 1000) AS ts FROM events""")
sql("nan_to_null", "", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS charge FROM events")
sql("explode_scan", "", """
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(-1.5 AS DOUBLE) + i * CAST(0.05 AS DOUBLE), 6) AS angle, round(d, 6) AS distance FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS d FROM embeddings) e
WHERE d BETWEEN 0.0 AND 0.2""")
sql("explode_hazards", "", """
SELECT event_id, hazard_type, CASE hazard_type WHEN 2 THEN 'CLIFF' WHEN 3 THEN 'STALL' WHEN 5 THEN 'OBJECT_PROXIMITY' END AS hazard_type_name
FROM (SELECT event_id, unnest([2, 3, 5]) AS hazard_type FROM events) e WHERE event_id % hazard_type = 0""")


# --- operators that take rows in turn: recursion over the place of a row in its group ---------------


def _in_turn(fixtures: str, more: str, body: str) -> str:
    return _and_then(fixtures, more, body).replace("WITH", "WITH RECURSIVE", 1)


def _suppressed(rows: str, key: tuple[str, ...], number: str) -> str:
    """Common tables up to ``kept_rows`` (key, k): what greedy suppression leaves of ``rows``."""
    keys, same = ", ".join(key), " AND ".join(f"r.{c} = run.{c}" for c in key)
    box = "{'number': %s, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}" % number
    return f"""
, ranked AS MATERIALIZED (
  SELECT *, {box} AS box, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {number}) AS n,
         count(*) OVER (PARTITION BY {keys}) AS total FROM ({rows}) f),
run AS (
  SELECT {keys}, n, total, [box] AS kept FROM ranked WHERE n = 1
  UNION ALL
  SELECT {", ".join(f"r.{c}" for c in key)}, r.n, r.total,
         CASE WHEN len(list_filter(kept, lambda k: {_iou('k', 'box', '1.0')} > 0.4)) = 0 THEN list_append(kept, box) ELSE kept END
  FROM run JOIN ranked r ON {same} AND r.n = run.n + 1),
kept_rows AS (SELECT {keys}, unnest(kept) AS k FROM run WHERE n = total)"""


ORACLES["nms"] = _in_turn("detections", _suppressed("SELECT * FROM detections", ("stream_id", "frame_id"), "det_idx"), """
SELECT frame_id, k.number AS det_idx, k.score AS score FROM kept_rows""")
ORACLES["cap_by_score"] = _in_turn("tensor_cells", _suppressed(f"""
  SELECT frame_id, cell_idx, score, cx - l * stride AS x1, cy - t * stride AS y1, cx + r * stride AS x2, cy + b * stride AS y2 FROM ({_CELL}) c
  QUALIFY row_number() OVER (PARTITION BY frame_id, stride ORDER BY score DESC, cell_idx) <= 5""", ("frame_id",), "cell_idx"), """
SELECT frame_id, k.number AS cell_idx, k.score AS score FROM kept_rows
QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY k.score DESC, k.number) <= 4""")
ORACLES["assign_tracks_exclusive"] = _in_turn("tracks detections", f"""
, offers AS (
  SELECT t.stream_id, t.frame_id, track_id, sim, {{'name': best_label, 'is_known': sim > 0.4}} AS given,
         list(det_idx ORDER BY {_iou('t', 'd', '0.0')} DESC, det_idx) AS dets
  FROM tracks t JOIN detections d ON d.stream_id = t.stream_id AND d.frame_id = t.frame_id
  WHERE {_iou('t', 'd', '0.0')} > 0.3 GROUP BY ALL),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY sim DESC, track_id) AS n,
         count(*) OVER (PARTITION BY stream_id, frame_id) AS total FROM offers),
run AS (
  SELECT stream_id, frame_id, n, total, [dets[1]] AS taken, [given] AS givens FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.stream_id, r.frame_id, r.n, r.total, list_append(taken, list_filter(dets, lambda d: NOT list_contains(taken, d))[1]), list_append(givens, given)
  FROM run JOIN ranked r ON r.stream_id = run.stream_id AND r.frame_id = run.frame_id AND r.n = run.n + 1),
chosen AS (SELECT stream_id, frame_id, unnest(taken) AS det_idx, unnest(givens) AS g FROM run WHERE n = total)""", """
SELECT d.stream_id, d.frame_id, d.det_idx, coalesce(g.name, 'unknown') AS name, coalesce(g.is_known, FALSE) AS is_known
FROM detections d LEFT JOIN chosen c ON c.stream_id = d.stream_id AND c.frame_id = d.frame_id AND c.det_idx = d.det_idx""")
ORACLES["match_falls_to_faces"] = _in_turn("pose_keypoints", f"""
, falls AS (SELECT * FROM ({_FALLS}) g),
heads AS (
  SELECT k.stream_id, k.frame_id, k.pose_idx, d.det_idx AS face, count(*) AS points
  FROM pose_keypoints k JOIN detections d ON d.stream_id = k.stream_id AND d.frame_id = k.frame_id
  WHERE kp < 5 AND conf >= 0.5 AND x BETWEEN d.x1 - (d.x2 - d.x1) * 0.25 AND d.x2 + (d.x2 - d.x1) * 0.25
    AND y BETWEEN d.y1 - (d.y2 - d.y1) * 0.25 AND d.y2 + (d.y2 - d.y1) * 0.25 GROUP BY ALL),
offers AS (SELECT stream_id, frame_id, pose_idx, list(face ORDER BY points DESC, face) AS faces FROM heads GROUP BY ALL),
ranked AS MATERIALIZED (
  SELECT f.stream_id, f.frame_id, f.pose_idx, is_fallen, coalesce(faces, []) AS faces,
         row_number() OVER (PARTITION BY f.stream_id, f.frame_id ORDER BY f.pose_idx) AS n
  FROM falls f LEFT JOIN offers o ON o.stream_id = f.stream_id AND o.frame_id = f.frame_id AND o.pose_idx = f.pose_idx),
run AS (
  SELECT stream_id, frame_id, pose_idx, is_fallen, n, faces[1] AS face, [faces[1]] AS taken FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.stream_id, r.frame_id, r.pose_idx, r.is_fallen, r.n, list_filter(r.faces, lambda v: NOT list_contains(taken, v))[1],
         list_append(taken, list_filter(r.faces, lambda v: NOT list_contains(taken, v))[1])
  FROM run JOIN ranked r ON r.stream_id = run.stream_id AND r.frame_id = run.frame_id AND r.n = run.n + 1)""", """
SELECT stream_id, frame_id, pose_idx, is_fallen, face AS face_idx, CASE WHEN face % 3 > 0 THEN concat('p', face) END AS identity FROM run""")
ORACLES["ema"] = _in_turn("latencies", """
, ordered AS MATERIALIZED (SELECT model, ts, seconds, row_number() OVER (PARTITION BY model ORDER BY ts) AS n FROM latencies),
run AS (
  SELECT model, ts, n, seconds AS ema FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.model, o.ts, o.n, 0.9 * ema + 0.1 * seconds FROM run JOIN ordered o ON o.model = run.model AND o.n = run.n + 1)""", """
SELECT model AS stream_id, ts, round(ema, 6) AS ema FROM run""")

#: Frames of 24 bytes and chunks of 40: a frame never holds more than a chunk, so whole chunks leave as they fill.
ORACLES["rechunk_audio"] = _and_then("audio_chunks", """
, frames AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) AS n FROM audio_chunks),
wholes AS (SELECT stream_id, string_agg(repeat(printf('%08d', chunk_id), 3), '' ORDER BY chunk_id) AS whole FROM audio_chunks GROUP BY stream_id)""", """
SELECT stream_id, CAST(0 AS INTEGER) AS connection, chunk_id AS seq, hex(substr(whole, 40 * (24 * n // 40 - 1) + 1, 40)) AS chunk
FROM frames JOIN wholes USING (stream_id) WHERE 24 * n // 40 > 24 * (n - 1) // 40""")

_PICTURES = """
SELECT event_id AS frame_id, CASE WHEN event_id % 3 = 0 THEN substr(p, 5, 2) || substr(p, 3, 2) || substr(p, 1, 2) ELSE p END AS pixel
FROM (SELECT event_id, printf('%06X', event_id) AS p FROM events WHERE event_id % 3 < 2) e"""
sql("to_bgr", "", f"SELECT frame_id, 'bgr8' AS encoding, repeat(pixel, 24) AS data FROM ({_PICTURES}) f")
#: The box from (1, 1) to (4, 3), grown by a quarter about its centre and cut to whole pixels of 6 x 4.
sql("pixelate_frames", "", f"""
SELECT frame_id, string_agg(CASE WHEN i % 6 >= low_x AND i % 6 < high_x AND i // 6 >= low_y AND i // 6 < high_y THEN 'FFFFFF' ELSE pixel END, '' ORDER BY i) AS data
FROM ({_PICTURES}) f, range(24) AS g(i), (
  SELECT greatest(0, trunc(2.5 - 3 * 1.25 / 2)) AS low_x, greatest(0, trunc(2.0 - 2 * 1.25 / 2)) AS low_y,
         least(5, trunc(2.5 + 3 * 1.25 / 2)) AS high_x, least(3, trunc(2.0 + 2 * 1.25 / 2)) AS high_y) b
GROUP BY frame_id""")
sql("apply_model", "", f"""
SELECT stream_id, batch, concat('You see: ', count(*), ' from ', arg_min(frame_id, place)) AS reply, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, frame_id) AS place,
         (row_number() OVER (PARTITION BY stream_id ORDER BY ts, frame_id) - 1) // 5 AS batch FROM ({_FRAMES}) f) g
GROUP BY stream_id, batch HAVING count(*) = 5""")
ORACLES["hit_or_miss"] = f"SELECT outcome, count(*) AS n FROM ({ORACLES['retrieve_answers']}) q GROUP BY outcome"

_IDENTITIES = """
, seen_tracks AS (
  SELECT stream_id, track_id, frame_id // 3 AS frame_id, x1, y1, x2, y2, best_label, sim,
         CAST(frame_id // 3 AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(10 AS DOUBLE) AS ts FROM tracks),
placed AS (
  SELECT *, frame_id - row_number() OVER (PARTITION BY stream_id, track_id ORDER BY frame_id) AS run_no FROM seen_tracks WHERE x2 > x1 AND y2 > y1),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, track_id, run_no ORDER BY frame_id) AS n FROM placed),
run AS (
  SELECT stream_id, track_id, run_no, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS DOUBLE) AS ts, 'unknown' AS shown,
         'new' AS status, CAST(NULL AS VARCHAR) AS name, CAST(0 AS DOUBLE) AS sim, CAST([] AS STRUCT(name VARCHAR, sim DOUBLE)[]) AS votes,
         CAST(0 AS BIGINT) AS attempts, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS since
  FROM ranked WHERE n = 1
  UNION ALL
  SELECT stream_id, track_id, run_no, n, frame_id, ts, shown,
    CASE WHEN closes THEN CASE WHEN wins THEN 'identified' ELSE 'unknown' END WHEN due THEN 'identifying' ELSE status END,
    CASE WHEN closes THEN CASE WHEN wins THEN top END ELSE name END,
    CASE WHEN closes AND wins THEN list_sum(own) / len(own) ELSE sim END, votes, attempts, last, CASE WHEN closes AND wins THEN 0 ELSE since END
  FROM (
    SELECT *, list_transform(list_filter(votes, lambda v: v.name = top), lambda v: v.sim) AS own, due AND (len(votes) >= 3 OR attempts >= 10) AS closes,
           coalesce(len(list_filter(votes, lambda v: v.name = top)) / len(votes) >= 0.5, FALSE) AS wins
    FROM (
      SELECT *, list_sort(list_transform(votes, lambda v, i: {'real': v.name <> '__unknown__', 'n': len(list_filter(votes, lambda o: o.name = v.name)),
                                                               'first': -i, 'name': CASE WHEN v.name <> '__unknown__' THEN v.name END}), 'DESC')[1].name AS top
      FROM (
        SELECT * REPLACE (
            CASE WHEN due THEN list_append(votes, {'name': CASE WHEN given_sim >= 0.4 THEN given ELSE '__unknown__' END, 'sim': given_sim}) ELSE votes END AS votes,
            attempts + CAST(due AS BIGINT) AS attempts, CASE WHEN due THEN ts ELSE last END AS last),
          CASE WHEN status = 'identified' AND name IS NOT NULL THEN printf('%s (%.2f)', name, sim)
               WHEN status = 'identifying' AND guess IS NOT NULL
               THEN printf('%s? (%.2f)', guess, list_max(list_transform(list_filter(votes, lambda v: v.name = guess), lambda v: v.sim)))
               ELSE 'unknown' END AS shown
        FROM (
          SELECT *, status IN ('new', 'identifying') AND ts - last >= CAST(0.3 AS DOUBLE) AND attempts < 10 AS due,
            list_sort(list_transform(list_filter(votes, lambda v: v.name <> '__unknown__'), lambda v, i: {
              'n': len(list_filter(votes, lambda o: o.name = v.name)), 'first': -i, 'name': v.name}), 'DESC')[1].name AS guess
          FROM (
            SELECT stream_id, track_id, run_no, n, frame_id, ts, given, given_sim, name, sim, last, since,
              CASE WHEN again THEN 'new' ELSE status END AS status, CASE WHEN again THEN [] ELSE votes END AS votes,
              CASE WHEN again THEN 0 ELSE attempts END AS attempts
            FROM (
              SELECT r.stream_id, r.track_id, r.run_no, r.n, r.frame_id, r.ts, r.best_label AS given, r.sim AS given_sim, name, run.sim, votes, attempts, last, status,
                CASE WHEN status = 'identified' THEN 0 WHEN since = 0 THEN r.ts ELSE since END AS since,
                r.ts - last >= 3.0 AND (status = 'unknown' OR (status = 'identified' AND run.sim < 0.5)) AS again
              FROM run JOIN ranked r ON r.stream_id = run.stream_id AND r.track_id = run.track_id AND r.run_no = run.run_no AND r.n = run.n + 1
            ) a) b) c) d) e) f),
identities AS (SELECT * FROM run WHERE n > 0),
latest AS (SELECT * FROM identities QUALIFY frame_id = max(frame_id) OVER (PARTITION BY stream_id)),
waiting AS (
  SELECT l.stream_id, l.track_id, round_even(l.ts - since, 1) AS seconds, (x2 - x1) * (y2 - y1) AS area
  FROM latest l JOIN seen_tracks s ON s.stream_id = l.stream_id AND s.frame_id = l.frame_id AND s.track_id = l.track_id WHERE status <> 'identified')
"""
ORACLES["track_identities"] = _in_turn("tracks", _IDENTITIES, """
SELECT stream_id, frame_id, track_id, round(ts, 6) AS ts, shown, status, name, round(sim, 6) AS sim, attempts, len(votes) AS votes, n AS frames,
       round(since, 6) AS unknown_since FROM identities""")
ORACLES["track_summary"] = _in_turn("tracks", _IDENTITIES, """
SELECT stream_id, track_id, name, status, round(sim, 6) AS sim, n AS frames, attempts, len(votes) AS votes FROM latest""")
ORACLES["unknown_durations"] = _in_turn("tracks", _IDENTITIES, "SELECT stream_id, track_id, seconds, area FROM waiting")
ORACLES["who_report"] = _in_turn("presence_names tracks", _EVENTS + _IDENTITIES, """
, shown_now AS (
  SELECT stream_id, string_agg(best_label, ',' ORDER BY (x2 - x1) * (y2 - y1) DESC, track_id) AS faces
  FROM (SELECT * FROM tracks QUALIFY frame_id = max(frame_id) OVER (PARTITION BY stream_id)) t GROUP BY stream_id)
SELECT now_.stream_id, CAST(n_fallen + fallen_unknown_now AS INTEGER) AS fallen_count, faces,
       CAST((SELECT count(*) FROM waiting w WHERE w.stream_id = now_.stream_id) AS INTEGER) AS n_unknown
FROM now_ LEFT JOIN shown_now USING (stream_id)""")
ORACLES["fps_change_points"] = _in_turn("", f"""
WITH scaled AS (
  SELECT stream_id, 1704067200000000 + (t - 1704067200000000) // 20000 AS t FROM ({_FRAMES}) f),
rated AS (
  SELECT *, count(*) OVER w AS many, (max(t) OVER w - min(t) OVER w) / 1e6 AS span FROM scaled
  WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ordered AS MATERIALIZED (
  SELECT stream_id, t, CASE WHEN many < 2 OR span <= 0 THEN 10.0 ELSE least(greatest((many - 1) / span, 5.0), 60.0) END AS fps,
         row_number() OVER (PARTITION BY stream_id ORDER BY t) AS n FROM rated),
run AS (
  SELECT stream_id, n, t, t AS checked, CAST(10 AS DOUBLE) AS fps, FALSE AS hit FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.stream_id, o.n, o.t, CASE WHEN o.t - checked > 5000000 THEN o.t ELSE checked END,
         CASE WHEN o.t - checked > 5000000 AND abs(o.fps - run.fps) / run.fps > 0.3 THEN o.fps ELSE run.fps END,
         o.t - checked > 5000000 AND abs(o.fps - run.fps) / run.fps > 0.3
  FROM run JOIN ordered o ON o.stream_id = run.stream_id AND o.n = run.n + 1)""", """
SELECT stream_id, make_timestamp(t) AS ts, round(fps, 6) AS fps FROM run WHERE hit""")

sql("unpack_embeddings", "", """
SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN 2 END AS n, CASE WHEN vec_id % 9 <> 0 THEN (vec_id * 4099) % 8388608 END AS first,
       CASE WHEN vec_id % 9 <> 0 THEN (vec_id * 7919) % 8388608 END AS second FROM embeddings""")
ORACLES["refresh_gallery"] = _and_then("gallery_files gallery_items", """
, listed AS (
  SELECT label, stem FROM gallery_files WHERE kind = 'aligned' AND concat(label, '/aligned/', stem, '.', ext) NOT IN (SELECT path FROM gallery_items)
  UNION ALL
  SELECT label, regexp_extract(path, '([^/]+)[.]', 1) FROM gallery_items),
gallery AS (
  SELECT listed.label, embedding FROM listed JOIN embeddings ON vec_id = CAST(substr(stem, 4) AS BIGINT) % (SELECT count(*) FROM embeddings))
""" + _CENTROIDS, """
SELECT label, n.n AS count, CAST(i AS INTEGER) AS i, round(m / norm, 6) AS value FROM means JOIN norms n USING (label)""")
