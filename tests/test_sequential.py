"""Operators without SQL, against plain Python on small random input with ties."""

import random

import numpy as np
from pyspark.sql import Row

from perceptra.operators import detections, metrics, speech, tracks, video


def iou(a, b, one):
    w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) + one)
    h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) + one)
    size = lambda r: (r["x2"] - r["x1"] + one) * (r["y2"] - r["y1"] + one)
    return w * h / (size(a) + size(b) - w * h + 1e-9)


def random_boxes(seed, frames=30):
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for i in range(rng.randint(1, 8)):
            x, y = rng.randint(0, 40), rng.randint(0, 40)
            rows.append(dict(stream_id=f % 3, frame_id=f, det_idx=i, x1=float(x), y1=float(y), x2=float(x + rng.choice([20, 30])),
                             y2=float(y + rng.choice([20, 30])), score=rng.choice([0.5, 0.7, 0.9])))
    return rows


def by_frame(rows):
    out = {}
    for r in rows:
        out.setdefault((r["stream_id"], r["frame_id"]), []).append(r)
    return out


def test_nms(spark):
    rows = random_boxes(1)
    for limit, plus_one in ((0.4, True), (0.45, False)):
        expected = set()
        for frame, own in by_frame(rows).items():
            kept = []
            for r in sorted(own, key=lambda r: (-r["score"], r["det_idx"])):
                if all(iou(k, r, float(plus_one)) <= limit for k in kept):
                    kept.append(r)
            expected |= {(*frame, k["det_idx"]) for k in kept}
        found = detections.nms(spark.createDataFrame([Row(**r) for r in rows]), limit, plus_one).collect()
        assert {(r.stream_id, r.frame_id, r.det_idx) for r in found} == expected


def test_assign_exclusive(spark):
    dets = random_boxes(2)
    rng = random.Random(3)
    own = [
        {k: v for k, v in d.items() if k not in ("score", "det_idx")}
        | dict(track_id=d["det_idx"], x1=d["x1"] + rng.randint(-3, 3), sim=rng.choice([0.3, 0.6]), name=f"n{d['det_idx']}", is_known=True)
        for d in dets
    ]
    expected = {}
    for frame, ds in by_frame(dets).items():
        used = {}
        for t in sorted(by_frame(own)[frame], key=lambda t: (-t["sim"], t["track_id"])):
            free = [(-iou(t, d, 0.0), d["det_idx"]) for d in ds if d["det_idx"] not in used and iou(t, d, 0.0) > 0.3]
            if free:
                used[min(free)[1]] = t["name"]
        for d in ds:
            expected[(*frame, d["det_idx"])] = used.get(d["det_idx"], "unknown")
    out = tracks.assign_tracks_exclusive(*(spark.createDataFrame([Row(**r) for r in x]) for x in (own, dets))).collect()
    assert {(r.stream_id, r.frame_id, r.det_idx): r.name for r in out} == expected


def test_falls_to_faces_takes_unnamed_faces(spark):
    points = [dict(x=5.0, y=5.0, conf=0.9)] * 5
    box = dict(x1=0.0, y1=0.0, x2=10.0, y2=10.0)
    poses = [Row(stream_id=0, frame_id=0, pose_idx=i, is_fallen=True, keypoints=[Row(**p) for p in points]) for i in range(3)]
    faces = [Row(stream_id=0, frame_id=0, face_idx=0, name=None, **box), Row(stream_id=0, frame_id=0, face_idx=1, name="a", **box)]
    schema = "stream_id long, frame_id long, face_idx long, name string, x1 double, y1 double, x2 double, y2 double"
    found = tracks.match_falls_to_faces(spark.createDataFrame(poses), spark.createDataFrame(faces, schema)).orderBy("pose_idx").collect()
    assert [(r.face_idx, r.identity) for r in found] == [(0, None), (1, "a"), (None, None)]


def test_identity_votes(spark):
    schema = "stream_id long, frame_id long, track_id long, ts double, x1 double, y1 double, x2 double, y2 double, best_label string, sim double"
    rows = [(0, f, 1, 10.0 + f, 0.0, 0.0, 9.0, 9.0, "ann", 0.8) for f in range(6)] + [(0, 8, 1, 18.0, 0.0, 0.0, 9.0, 9.0, "ann", 0.2)]
    found = tracks.track_identities(spark.createDataFrame(rows, schema)).orderBy("frame_id").collect()
    assert [r.shown for r in found] == ["unknown", "ann? (0.80)", "ann? (0.80)", "ann (0.80)", "ann (0.80)", "ann (0.80)", "unknown"]
    assert [r.status for r in found] == ["identifying"] * 2 + ["identified"] * 4 + ["identifying"]
    assert found[-1].frames == 1


def test_rechunk_and_ema(spark):
    rows = [(0, 0, i, bytes([i] * 6)) for i in range(5)] + [(0, 1, 9, b"ab")]
    frames = spark.createDataFrame(rows, "stream_id long, connection long, seq long, payload binary")
    found = speech.rechunk_audio(frames, 4).orderBy("seq").collect()
    whole = b"".join(r[3] for r in rows[:5])
    assert [bytes(r.chunk) for r in found] == [whole[i : i + 8] for i in range(0, 24, 8)]
    values = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "stream_id long, ts long, value double")
    assert [round(r.ema, 6) for r in metrics.ema(values).orderBy("ts").collect()] == [0.0, 0.1, 0.29, 0.561]


def test_pixelate_and_channels(spark):
    pixels = np.arange(16 * 12 * 3, dtype=np.uint8).reshape(12, 16, 3)
    schema = "stream_id long, frame_id long, width int, height int, encoding string, data binary"
    frames = spark.createDataFrame(
        [(0, 0, 16, 12, "rgb8", pixels.tobytes()), (0, 1, 16, 12, "bgr8", pixels.tobytes()), (0, 2, 16, 12, "mono8", b"1"), (0, 3, 16, 12, "bgr8", b"xx")],
        schema,
    )
    bgr = {r.frame_id: bytes(r.data) for r in video.to_bgr(frames).collect()}
    assert set(bgr) == {0, 1} and bgr[0] == pixels[:, :, ::-1].tobytes() and bgr[1] == pixels.tobytes()
    boxes = spark.createDataFrame([(0, 1, 0, 2.0, 2.0, 10.0, 10.0, 0.9)], "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, score double")
    out = {r.frame_id: np.frombuffer(r.data, np.uint8).reshape(12, 16, 3) for r in video.pixelate_frames(video.to_bgr(frames), boxes, blocks=0).collect()}
    assert (out[1][1:11, 1:11] == 255).all() and (out[1][11:] == pixels[11:]).all()
    squares = {r.frame_id: np.frombuffer(r.data, np.uint8).reshape(12, 16, 3) for r in video.pixelate_frames(video.to_bgr(frames), boxes, blocks=1).collect()}
    assert len(np.unique(squares[1][1:11, 1:11].reshape(-1, 3), axis=0)) == 1
