"""The perception operators as registered queries over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perceptra import storage
from perceptra.functions import boxes, text, vectors
from perceptra.operators import (
    asof,
    detections,
    gallery,
    metrics,
    models,
    pose,
    presence,
    sessions,
    speech,
    telemetry,
    tracks,
    video,
)
from perceptra.plans.fixtures import fixture
from perceptra.sources import gallery_files, messages, vector_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WIDTH, HEIGHT = 640, 480
CORNERS = ("x1", "y1", "x2", "y2")


def query(*names: str):
    """Register a function of the named fixtures."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*(fixture(spark, sf_dir, n) for n in names))

        QUERIES[function.__name__] = run
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def poses(points: DataFrame) -> DataFrame:
    """Pose rows from their long form."""
    row = F.struct("kp", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "conf").alias("k"))
    out = points.groupBy("stream_id", "frame_id", "pose_idx", "bx1", "by1", "bx2", "by2").agg(
        F.array_sort(F.collect_list(row)).alias("r")
    )
    keypoints = F.transform("r", lambda r: r["k"]).alias("keypoints")
    return out.select(
        "stream_id", "frame_id", "pose_idx", *(F.col(f"b{c}").alias(c) for c in CORNERS), keypoints
    )


# --- gallery and retrieval -------------------------------------------------


@query("gallery")
def identity_centroids(rows):
    out = gallery.identity_centroids(rows)
    places = out.select("label", "count", F.posexplode("centroid").alias("i", "value"))
    return rounded(places.withColumn("i", F.col("i").cast("int")), "value")


@query("gallery")
def gallery_stats(rows):
    return gallery.gallery_stats(rows)


@query("gallery", "probes")
def match_gallery(rows, probes):
    found = gallery.match_gallery(probes, gallery.identity_centroids(rows), 0.2)
    return rounded(found, "sim")


@query("gallery", "probes")
def retrieve_answers(rows, probes):
    answer = F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit("a"), F.col("vec_id").cast("string")))
    qa = rows.select(
        F.col("vec_id").alias("qa_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("question"),
        answer.alias("answer"), "embedding",
    )
    found = gallery.retrieve_answers(probes, qa, 3, 0.3)
    return rounded(found, "score").withColumn("outcome", text.hit_or_miss(F.col("answer")))


@query("embeddings")
def normalise_l2(rows):
    v = vectors.normalised(F.col("embedding"))
    places = rows.select("vec_id", F.posexplode(v).alias("i", "value"))
    return rounded(places.groupBy("vec_id").agg(F.sum(F.col("value") * (F.col("i") + 1)).alias("value")), "value")


@query("gallery_files")
def identity_counts(files):
    return gallery.identity_counts(files)


@query("gallery_files", "gallery_items")
def gallery_worklist(files, items):
    return gallery.gallery_worklist(files, items)


@query("gallery_files")
def align_worklist(files):
    return gallery.align_worklist(files)


@query("gallery_files")
def scan_gallery(files):
    path = F.concat_ws("/", F.lit("root"), "label", "kind", F.concat_ws(".", "stem", "ext"))
    return gallery_files.images(files.select(path.alias("path")))


@query("gallery_items", "embeddings")
def attach_row_labels(items, rows):
    out = gallery.attach_row_labels(rows.select(F.col("vec_id").alias("row_id")), items.select("row_id", "label", "path"))
    return out.select("row_id", "label")


@query("gallery_items")
def delete_identities(items):
    ids = items.select("label").distinct().where("label like '%3' or label like '%5'")
    return gallery.delete_identities(items, ids).select("path", "label", "row_id")


@query("gallery_items", "gallery_files")
def deletion_report(items, files):
    ids = items.select("label").distinct().where("label like '%3' or label like '%5'")
    return gallery.deletion_report(items, files.where("label like '%3'"), ids)


@query("gallery_items", "gallery_files")
def append_vectors(items, files):
    new = gallery.gallery_worklist(files, items).select("label", "path")
    return gallery_files.append_vectors(new, items.count())


@query("embeddings")
def read_vectors_f32(rows):
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    whole = rows.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))
    path = f"{storage.shared_dir(rows.sparkSession)}/vectors-{uuid.uuid4().hex}"
    vector_files.write_vectors_f32(whole.orderBy("vec_id"), path, dim)
    found = vector_files.read_vectors_f32(rows.sparkSession, path, dim)
    places = found.select("row_id", F.posexplode("embedding").alias("i", "value"))
    total = F.sum(F.col("value").cast("double") * (F.col("i") + 1))
    return rounded(places.groupBy("row_id").agg(total.alias("value")), "value")


# --- detections -------------------------------------------------------------


@query("detections")
def filter_confidence(dets):
    return detections.filter_confidence(dets, 0.5)


@query("tensor_cells")
def decode_anchor_boxes(cells):
    return rounded(detections.decode_anchor_boxes(cells).select("frame_id", "stride", "cell_idx", *CORNERS), *CORNERS)


@query("tensor_cells")
def decode_anchor_keypoints(cells):
    kps = F.array(*(F.col(c) for c in "ltrbltrblt"))
    out = detections.decode_anchor_keypoints(cells.withColumn("kps", kps))
    rows = out.select("frame_id", "stride", "cell_idx", F.posexplode("points").alias("i", "p"))
    return rounded(rows.select("frame_id", "stride", "cell_idx", F.col("i").cast("int").alias("i"), "p.x", "p.y"), "x", "y")


@query("tensor_cells")
def decode_best_anchor_boxes(cells):
    out = detections.decode_best_anchor_boxes(cells)
    return rounded(out.select("frame_id", "stride", "cell_idx", "score", *CORNERS), "score", *CORNERS)


def _boxes(dets: DataFrame) -> DataFrame:
    return dets.select("stream_id", "frame_id", "det_idx", *CORNERS)


@query("detections")
def unletterbox_top_left(dets):
    return rounded(detections.unletterbox(_boxes(dets), "top_left", 1280, 720), *CORNERS)


@query("detections")
def unletterbox_centered_int(dets):
    return detections.unletterbox(_boxes(dets), "centered_int", 1280, 720)


@query("detections")
def unletterbox_centered_clip(dets):
    return rounded(detections.unletterbox(_boxes(dets), "centered_clip", 1280, 720), *CORNERS)


@query("detections")
def expand_clip_box(dets):
    return detections.expand_clip_box(_boxes(dets), WIDTH, HEIGHT)


@query("detections")
def expand_box(dets):
    return rounded(detections.expand_box(_boxes(dets)), *CORNERS)


@query("detections")
def point_in_box(dets):
    inside = boxes.point_in_box(F.lit(250.0), F.lit(200.0), boxes.corners())
    return _boxes(dets).where(inside)


@query("detections")
def iou(dets):
    other = _boxes(dets).select("stream_id", "frame_id", F.col("det_idx").alias("other_idx"), *(F.col(c).alias(f"o_{c}") for c in CORNERS))
    pairs = _boxes(dets).join(other, ["stream_id", "frame_id"]).where("det_idx < other_idx")
    both = {f"iou_{n}": boxes.iou(boxes.corners(), boxes.corners("o_"), p) for n, p in (("plus_one", True), ("plain", False))}
    out = pairs.withColumns(both).select("stream_id", "frame_id", "det_idx", "other_idx", *both)
    return rounded(out, *both)


@query("detections")
def nms(dets):
    return detections.nms(dets.select("stream_id", "frame_id", "det_idx", *CORNERS, "score")).select("frame_id", "det_idx", "score")


@query("detections")
def top_center_area(dets):
    return detections.top_center_area(_boxes(dets), 3, WIDTH, HEIGHT)


@query("detections")
def top_area(dets):
    return detections.top_area(_boxes(dets), 3)


@query("detections")
def top_score_area(dets):
    return detections.top_score_area(dets, 3).select("frame_id", "det_idx", "score")


@query("tensor_cells")
def cap_by_score(cells):
    rows = detections.decode_anchor_boxes(cells).select("frame_id", "stride", "cell_idx", "score", *CORNERS)
    return detections.cap_by_score(rows, per_level=5, most=4).select("frame_id", "cell_idx", "score")


@query("tracks")
def faces_by_area(rows):
    return detections.faces_by_area(rows).select("stream_id", "frame_id", "track_id", "position")


@query("detections")
def largest_face(dets):
    return detections.largest_face(dets).select("stream_id", "frame_id", "det_idx", "score")


# --- tracks -------------------------------------------------------------------


@query("tracks", "detections")
def match_tracks_to_dets(rows, dets):
    return rounded(tracks.match_tracks_to_dets(rows, dets), "iou")


@query("tracks", "detections")
def assign_tracks_exclusive(rows, dets):
    named = rows.select("stream_id", "frame_id", "track_id", *CORNERS, "sim", F.col("best_label").alias("name"), (F.col("sim") > 0.4).alias("is_known"))
    return tracks.assign_tracks_exclusive(named, dets)


def _votes(rows: DataFrame) -> DataFrame:
    name = F.when(F.col("sim") >= 0.4, F.col("best_label")).otherwise(tracks.UNKNOWN)
    return rows.select("track_id", F.col("frame_id").alias("seq"), name.alias("name"), "sim")


@query("tracks")
def majority_vote(rows):
    return rounded(tracks.majority_vote(_votes(rows), 0.1), "sim")


@query("tracks")
def interim_guess(rows):
    return rounded(tracks.interim_guess(_votes(rows)), "sim")


def _observed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("frame_id", F.floor(F.col("frame_id") / 3)).withColumn("ts", F.col("frame_id") * 0.1 + 10.0)


@query("tracks")
def track_identities(rows):
    return rounded(tracks.track_identities(_observed(rows)), "ts", "sim", "unknown_since")


@query("tracks")
def track_summary(rows):
    return rounded(tracks.track_summary(tracks.track_identities(_observed(rows))), "sim")


@query("tracks")
def unknown_durations(rows):
    seen = _observed(rows)
    return tracks.unknown_durations(tracks.track_identities(seen), seen)


@query("events")
def evict_stale(events):
    rows = events.select(F.col("user_id").alias("track_id"), "event_id", "ts")
    return tracks.evict_stale(rows, 36_000, ("track_id",)).select("track_id", "event_id", "episode")


@query("tracks")
def display_names(rows):
    status = F.when(F.col("sim") > 0.6, "identified").when(F.col("sim") > 0.3, "identifying").otherwise("unknown")
    shown = text.display_name(status, F.col("best_label"), F.col("sim"), F.col("best_label"), F.col("sim"))
    return rows.select("stream_id", "frame_id", "track_id", shown.alias("shown"), text.strip_score(shown).alias("name"))


# --- poses and falls ------------------------------------------------------------


@query("pose_keypoints")
def keypoint_counts(points):
    out = pose.keypoint_counts(poses(points))
    return out.select("frame_id", "pose_idx", "n_upper", "n_lower", "n_total")


@query("pose_keypoints")
def fall_score(points):
    out = pose.fall_score(poses(points)).select("frame_id", "pose_idx", "is_fallen", "fall_confidence")
    return rounded(out, "fall_confidence")


@query("pose_keypoints")
def decode_pose(points):
    raw = poses(points).withColumns(
        {"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    )
    out = pose.decode_pose(raw, 1280, 720)
    sums = [F.aggregate(F.col("keypoints")[c], F.lit(0.0), lambda s, v: s + v).alias(f"sum_{c}") for c in ("x", "y", "conf")]
    return rounded(out.select("frame_id", "pose_idx", *CORNERS, *sums), *CORNERS, "sum_x", "sum_y", "sum_conf")


@query("pose_keypoints", "detections")
def match_falls_to_faces(points, dets):
    scored = pose.fall_score(poses(points))
    faces = dets.select("stream_id", "frame_id", F.col("det_idx").alias("face_idx"), *CORNERS,
                        F.when(F.col("det_idx") % 3 > 0, F.concat(F.lit("p"), F.col("det_idx").cast("string"))).alias("name"))
    return tracks.match_falls_to_faces(scored, faces)


@query("pose_keypoints")
def fall_alerts(points):
    return pose.fall_alerts(pose.fall_score(poses(points)))


@query("events")
def smooth_falls(events):
    rows = events.select(F.col("user_id").alias("track_id"), "event_id", "ts", (F.col("event_type") == "error").alias("is_fallen"))
    return pose.smooth_falls(rows, max_age_s=86_400.0).select("track_id", "event_id", "is_fallen", "smoothed")


# --- presence ---------------------------------------------------------------------


def _presence(names: DataFrame) -> DataFrame:
    return presence.presence_events(names.withColumn("stream_id", F.col("frame_id") % 5))


AS_OF = "2024-01-30 00:00:00"
SNAPSHOT = ("stream_id", "unknown_now", "fallen_unknown_now", "frames_recent", "frames_with_unknown", "unknown_recent", "frames_with_fall", "fallen_count", "fall_alert")


@query("presence_names")
def presence_snapshot(names):
    out = presence.presence_snapshot(_presence(names), AS_OF, 172_800.0, 259_200.0)
    return out.select(*SNAPSHOT, F.array_join("now", ",").alias("now"), F.array_join("fallen_now", ",").alias("fallen_now"))


@query("presence_names")
def presence_name_frames(names):
    out = presence.presence_snapshot(_presence(names), AS_OF, 172_800.0, 259_200.0)
    return out.select("stream_id", F.explode("recent_name_frames").alias("name", "frames"))


@query("presence_names")
def fallen_recent(names):
    return presence.fallen_recent(presence.presence_snapshot(_presence(names), AS_OF, 172_800.0, 259_200.0))


@query("presence_names")
def single_face_ready(names):
    return presence.single_face_ready(_presence(names), "2024-01-05 00:00:00", 864_000.0)


@query("presence_names", "tracks")
def who_report(names, rows):
    snapshot = presence.presence_snapshot(_presence(names), AS_OF, 172_800.0, 259_200.0)
    latest = rows.groupBy("stream_id").agg(F.max("frame_id").alias("frame_id"))
    faces = detections.faces_by_area(rows.join(latest, ["stream_id", "frame_id"])).withColumn("name", F.col("best_label"))
    seen = _observed(rows)
    waiting = tracks.unknown_durations(tracks.track_identities(seen), seen)
    out = presence.who_report(snapshot, faces.select("stream_id", "position", "name"), waiting)
    return out.select("stream_id", "fallen_count", F.array_join("faces", ",").alias("faces"), F.size(F.coalesce("unknown_faces", F.array())).alias("n_unknown"))


# --- audio, speech, sessions ----------------------------------------------------------


@query("messages")
def parse_audio_messages(rows):
    out = speech.parse_audio_messages(rows)
    return out.select("event_id", F.hex("audio").alias("audio"), "rate")


@query("messages")
def parse_remote_audio(rows):
    out = speech.parse_remote_audio(rows)
    return out.select("event_id", F.hex("audio").alias("audio"), "rate", "language_code")


@query("messages")
def parse_frames(rows):
    return video.parse_frames(rows).select("event_id", F.hex("frame").alias("frame"))


@query("messages")
def preview_text(rows):
    return rows.select("event_id", text.preview(F.col("message"), 50).alias("preview"))


@query("audio_chunks")
def emit_audio_messages(chunks):
    rows = chunks.select(
        F.col("chunk_id").cast("string").cast("binary").alias("audio"), F.lit(16000).alias("rate"), F.lit("en-US").alias("language_code"),
        F.array(F.lit("de-DE")).alias("alternative_language_codes"), "ts",
    )
    return speech.emit_audio_messages(rows)


@query("replies")
def emit_replies(replies):
    return gallery_files.emit_replies(replies.select("doc_id", F.col("raw_text").alias("text")), "vlm_reply")


@query("replies")
def clean_reply(replies):
    return replies.select("doc_id", text.clean_reply(F.col("raw_text")).alias("reply"))


@query("asr_results")
def final_transcripts(rows):
    alternatives = F.array(F.struct(F.col("transcript").alias("transcript")))
    results = F.array(F.struct(F.col("is_final").alias("is_final"), alternatives.alias("alternatives")))
    return speech.final_transcripts(rows.select("conv_id", "turn", results.alias("results"))).select("conv_id", "turn", "transcript", "is_final")


@query("audio_chunks", "speaker_status")
def gate_audio(chunks, status):
    return speech.gate_audio(chunks, status).select("stream_id", "chunk_id")


@query("speaker_status")
def tts_requests(status):
    with_voice = F.regexp_replace("sentence_to_speak", "}$", ', "voice_id": null}')
    out = speech.tts_requests(status.withColumn("sentence_to_speak", with_voice))
    return out.select("stream_id", "ts", "text", "voice_id")


@query("asr_text", "speaker_status")
def tts_interrupts(asr, status):
    return speech.tts_interrupts(asr, status).select("stream_id", "ts", "payload")


def _requests(status: DataFrame) -> DataFrame:
    hours = lambda n: F.col("ts") + F.make_dt_interval(hours=F.lit(n))
    return status.where("status_speaker = 2").select(
        "stream_id", F.col("ts").cast("string").alias("request_id"), F.col("ts").alias("enqueued"), hours(6).alias("started"), hours(12).alias("finished")
    )


@query("speaker_status", "asr_text")
def interrupted_requests(status, asr):
    interrupts = asr.where("length(payload) > 0").select("stream_id", "ts")
    return speech.interrupted_requests(_requests(status), interrupts).select("stream_id", "request_id", "outcome")


@query("speaker_status")
def speaker_intervals(status):
    return speech.speaker_intervals(status)


@query("audio_chunks")
def idle_gaps(chunks):
    return speech.idle_gaps(chunks, 86_400.0)


@query("audio_chunks")
def coalesce_chunks(chunks):
    rows = chunks.withColumn("payload", F.col("chunk_id").cast("string").cast("binary"))
    out = speech.coalesce_chunks(rows, "1 day").withColumn("payload", F.col("payload").cast("string"))
    return ntz(out, "start")


@query("audio_chunks")
def rechunk_audio(chunks):
    rows = chunks.select("stream_id", F.lit(0).alias("connection"), F.col("chunk_id").alias("seq"), F.repeat(F.lpad(F.col("chunk_id").cast("string"), 8, "0"), 3).cast("binary").alias("payload"))
    return speech.rechunk_audio(rows, 20).withColumn("chunk", F.hex("chunk"))


@query("conn_events")
def conn_sessions(events):
    return sessions.conn_sessions(events, 21_600.0)


@query("conn_events", "events")
def route_messages(events, all_events):
    opened = sessions.conn_sessions(events, 21_600.0)
    direct = F.when(F.col("event_id") % 3 > 0, F.concat(F.col("user_id").cast("string"), F.lit("-1")))
    sent = all_events.where("event_type = 'view'").select(F.col("event_id").alias("message_id"), direct.alias("connection_id"), "ts")
    return sessions.route_messages(sent, opened)


# --- frames, metrics, settings ---------------------------------------------------------


def _frames(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 4).alias("stream_id"), F.col("event_id").alias("frame_id"), "ts", "value")


@query("events")
def fps_estimate(events):
    return rounded(video.fps_estimate(_frames(events)).select("stream_id", "frame_id", "fps"), "fps")


def _fast(events: DataFrame) -> DataFrame:
    """Frames a thousandth as far apart."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slow = F.lit(1_704_067_200_000_000)
    scaled = F.timestamp_micros(slow + F.floor((micros - slow) / 20_000)).cast("timestamp_ntz")
    return _frames(events).withColumn("ts", scaled)


@query("events")
def fps_change_points(events):
    return rounded(video.fps_change_points(_fast(events), initial=10.0), "fps")


@query("events")
def batch_frames(events):
    return video.batch_frames(_frames(events)).select("stream_id", "batch", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@query("events")
def latest_per_interval(events):
    return ntz(video.latest_per_interval(_frames(events), "1 hour"), "start")


@query("events")
def drop_late_frames(events):
    return video.drop_late_frames(_frames(events), 1 / 7200).select("stream_id", "frame_id")


@query("events")
def throughput(events):
    return rounded(ntz(video.throughput(_frames(events), 3600), "start"), "fps", "running_fps")


@query("detections")
def select_blur(dets):
    known = F.when(F.col("det_idx") % 3 == 0, F.lit(None)).otherwise(F.col("score") > 0.5)
    faces = dets.select("frame_id", "det_idx", known.alias("is_known"))
    return video.select_blur(faces, "unknown").select("frame_id", "det_idx", "blur")


@query("detections")
def filter_frame_size(dets):
    frames = dets.select("frame_id", "det_idx", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return video.filter_frame_size(frames, 60, 60)


@query("latencies")
def latency_metrics(rows):
    return rounded(metrics.latency_metrics(rows), "sum", "last")


@query("latencies")
def ema(rows):
    out = metrics.ema(rows.select(F.col("model").alias("stream_id"), "ts", F.col("seconds").alias("value")))
    return rounded(out.select("stream_id", "ts", "ema"), "ema")


@query("latencies")
def batch_latency(rows):
    each = rows.groupBy(F.to_date("ts").cast("string").alias("batch_id")).agg(F.count(F.lit(1)).alias("batch_size"), F.sum(F.floor(F.col("seconds") * 100)).alias("t"))
    return metrics.batch_latency(each.select("batch_id", "batch_size", F.col("t").alias("embed_ms"), (F.col("t") / 4).alias("search_ms"), (F.col("t") * 2).alias("total_ms")))


@query("latencies", "config_changes")
def config_asof(rows, changes):
    frames = rows.select(F.col("model").alias("model"), "ts")
    return asof.config_asof(frames, changes, {"sim_thr": 0.55, "conf": 0.5})


@query("audio_chunks", "speaker_status", "asr_text")
def merge_streams(chunks, status, asr):
    return asof.merge_streams(chunks, status.select("stream_id", "ts", "status_speaker"), asr)


@query("speaker_status")
def decode_enums(status):
    return telemetry.decode_enums(status.select("stream_id", "ts", "status_speaker")).select("stream_id", "ts", "status_speaker_name")


@query("events")
def normalise_header(events):
    stamp = F.struct(F.col("event_id").cast("int").alias("sec"), ((F.col("event_id") * 7919) % 1_000_000_000).alias("nanosec"))
    out = telemetry.normalise_header(events.select("event_id", F.struct(stamp.alias("stamp")).alias("header")))
    return ntz(out.select("event_id", "ts"), "ts")


@query("events")
def nan_to_null(events):
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return telemetry.nan_to_null(events.select("event_id", value.alias("charge")))


@query("embeddings")
def explode_scan(rows):
    scans = rows.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("ranges"), F.lit(-1.5).alias("angle_min"), F.lit(0.05).alias("angle_increment"), F.lit(0.0).alias("range_min"), F.lit(0.2).alias("range_max"))
    out = telemetry.explode_scan(scans)
    return rounded(out.select("vec_id", F.col("i").cast("int").alias("i"), "angle", "distance"), "angle", "distance")


@query("events")
def explode_hazards(events):
    kinds = F.filter(F.array(*(F.when(F.col("event_id") % m == 0, F.lit(m)) for m in (2, 3, 5))), lambda k: k.isNotNull())
    hazards = F.transform(kinds, lambda k: F.struct(k.alias("hazard_type")))
    out = telemetry.explode_hazards(events.select("event_id", hazards.alias("detections")))
    return telemetry.decode_enums(out).select("event_id", "hazard_type", "hazard_type_name")


# --- sources, pixels, models ---------------------------------------------------------------


@query("events")
def read_topic(events):
    stamp = F.struct(F.col("event_id").cast("int").alias("sec"), F.lit(0).cast("long").alias("nanosec"))
    header = F.struct(stamp.alias("stamp"), F.col("user_id").cast("string").alias("frame_id"))
    rows = events.select(
        header.alias("header"), (F.col("event_id") % 4).cast("byte").alias("status_mic"), (F.col("event_id") % 3).cast("byte").alias("status_speaker"),
        F.struct(F.col("event_type").alias("data")).alias("sentence_to_speak"),
    )
    topic = messages.read_topic(events.sparkSession, storage.write_table(rows), "AudioStatus")
    out = telemetry.decode_enums(telemetry.normalise_header(topic))
    return ntz(out.select("ts", "header.frame_id", "status_mic_name", "status_speaker_name", F.col("sentence_to_speak.data").alias("sentence")), "ts")


def _pictures(events: DataFrame) -> DataFrame:
    """Frames of 6 x 4 pixels with bytes from the event's number."""
    pixel = F.lpad(F.hex(F.col("event_id")), 6, "0")
    encoding = F.element_at(F.array(F.lit("rgb8"), F.lit("bgr8"), F.lit("mono8")), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        (F.col("event_id") % 3).alias("stream_id"), F.col("event_id").alias("frame_id"), F.lit(6).alias("width"), F.lit(4).alias("height"),
        encoding.alias("encoding"), F.unhex(F.repeat(pixel, 24)).alias("data"),
    )


@query("events")
def to_bgr(events):
    return video.to_bgr(_pictures(events)).select("frame_id", "encoding", F.hex("data").alias("data"))


@query("events")
def pixelate_frames(events):
    frames = video.to_bgr(_pictures(events))
    boxes_ = frames.select("stream_id", "frame_id", F.lit(0).alias("det_idx"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(4.0).alias("x2"), F.lit(3.0).alias("y2"), F.lit(0.9).alias("score"))
    return video.pixelate_frames(frames, boxes_, blocks=0).select("frame_id", F.hex("data").alias("data"))


def _hash_encoder():
    """Deterministic vectors for texts or bytes."""
    import zlib

    import numpy as np

    def encode(items):
        raw = [i if isinstance(i, bytes) else i.encode() for i in items]
        return np.array([[zlib.crc32(r, k) % 1000 - 500 for k in range(4)] for r in raw], float)

    return encode


@query("conversations")
def embed_text(rows):
    ids = rows.withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = models.embed_text(ids, _hash_encoder, "id")
    return out.select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


@query("documents")
def embed_images(rows):
    out = models.embed_images(rows.select("doc_id", F.col("text").cast("binary").alias("content")), _hash_encoder, "doc_id")
    return out.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


def _describe():
    return lambda items, prompt: f"{prompt}: {len(items)} from {items[0]}"


@query("events")
def apply_model(events):
    groups = video.batch_frames(_frames(events))
    out = models.apply_model(groups, _describe, "The most interesting aspect of the images is")
    return out.select("stream_id", "batch", text.clean_reply(F.col("reply")).alias("reply"), "error")


@query("embeddings")
def unpack_embeddings(rows):
    def packed(step: int) -> Column:
        """Four little-endian bytes of the float32 of 2 + k / 2^22."""
        bits = F.hex(F.lit(0x40000000) + (F.col("vec_id") * step) % 8_388_608)
        return F.concat(*(F.substring(bits, at, 2) for at in (7, 5, 3, 1)))

    sent = F.when(F.col("vec_id") % 9 != 0, F.base64(F.unhex(F.concat(packed(4099), packed(7919)))))
    out = models.unpack_embeddings(rows.select("vec_id", sent.alias("embedding_b64")), "vec_id")
    whole = lambda i: ((F.get("embedding", F.lit(i)).cast("double") - 2) * 4_194_304).cast("long")
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return out.select("vec_id", n.alias("n"), whole(0).alias("first"), whole(1).alias("second"))


@query("gallery_files", "gallery_items", "embeddings")
def refresh_gallery(files, items, rows):
    """The vector of an image is that of the embeddings' row with the number in its name, counted round."""
    total = rows.count()

    def embed(work):
        stem = F.regexp_extract("path", r"img([0-9]+)\.", 1).cast("long")
        return work.withColumn("vec_id", stem % total).join(rows.select("vec_id", "embedding"), "vec_id").drop("vec_id")

    held = embed(items.select("row_id", "path")).select("row_id", "embedding")
    _, _, centroids = gallery.refresh_gallery(files, items, held, embed)
    places = centroids.select("label", "count", F.posexplode("centroid").alias("i", "value"))
    return rounded(places.withColumn("i", F.col("i").cast("int")), "value")


@query("gallery", "probes")
def hit_or_miss(rows, probes):
    found = retrieve_answers(rows, probes)
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("tracks")
def strip_score(rows):
    shown = F.concat(F.col("best_label"), F.lit("? ("), F.col("sim").cast("string"), F.lit(")"))
    return rows.select("stream_id", "frame_id", "track_id", text.strip_score(shown).alias("name"))
