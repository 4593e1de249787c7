"""Audio messages, the speaker gate, requests and interrupts, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.asof import latest_state
from perceptra.operators.segments import walk

ACTIVE, READY = 2, 1
_MESSAGE = "audio string, rate int, language_code string"


def parse_audio_messages(messages: DataFrame, default_rate: int = 16000, column: str = "message") -> DataFrame:
    """``audio`` (binary) and ``rate`` of JSON messages; malformed ones and those without audio go.

    A binary column is the older form: the payload itself, at 16000.
    """
    if dict(messages.dtypes)[column] == "binary":
        return messages.withColumns({"audio": F.col(column), "rate": F.lit(16000)}).drop(column)
    parsed = messages.withColumn("m_", F.from_json(column, _MESSAGE)).where("m_.audio is not null")
    return parsed.withColumns(
        {"audio": F.unbase64("m_.audio"), "rate": F.coalesce("m_.rate", F.lit(default_rate))}
    ).drop("m_", column)


def parse_remote_audio(
    messages: DataFrame, default_rate: int = 16000, default_language: str = "en-US", key: str = "stream_id"
) -> DataFrame:
    """As parse_audio_messages, with rate and language_code that last until a message changes them."""
    parsed = messages.withColumn("m_", F.from_json("message", _MESSAGE)).where("m_.audio is not null")
    so_far = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, default: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(default))
    return parsed.withColumns(
        {
            "audio": F.unbase64("m_.audio"),
            "rate": last("m_.rate", default_rate),
            "language_code": last("m_.language_code", default_language),
        }
    ).drop("m_", "message")


def emit_audio_messages(chunks: DataFrame) -> DataFrame:
    """``message``: JSON of audio, rate, language_code, alternative_language_codes and whole-second timestamp."""
    row = F.struct(
        F.base64("audio").alias("audio"), "rate", "language_code", "alternative_language_codes",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )
    return chunks.select(F.to_json(row).alias("message"))


def final_transcripts(results: DataFrame, interim: bool = False) -> DataFrame:
    """``transcript`` and ``is_final`` of the first alternative of the first result, trimmed; empty ones go."""
    first = F.get("results", F.lit(0))
    text = F.trim(F.get(first["alternatives"], F.lit(0))["transcript"])
    out = results.withColumns({"transcript": text, "is_final": first["is_final"]}).where(F.length("transcript") > 0)
    return (out if interim else out.where("is_final")).drop("results")


def gate_audio(chunks: DataFrame, status: DataFrame, interrupt: bool = False, key: str = "stream_id") -> DataFrame:
    """Chunks recorded while the gate is open.

    The speaker's ACTIVE closes it (unless ``interrupt``), READY opens it,
    other states leave it; it starts open.
    """
    change = F.when(F.col("status_speaker") == READY, True)
    if not interrupt:
        change = change.when(F.col("status_speaker") == ACTIVE, False)
    states = status.select(key, "ts", change.alias("open_")).where("open_ is not null")
    return latest_state(chunks, states, ["open_"], [key]).where(F.coalesce("open_", F.lit(True))).drop("open_")


def tts_requests(status: DataFrame, default_voice: str = "default") -> DataFrame:
    """(stream_id, ts, request_id, text, voice_id) of ACTIVE statuses with a sentence that parses.

    A sentence without the key voice_id fails; one whose voice_id is null gets
    the default voice. ``request_id`` is the status's frame_id if it has one.
    """
    asked = status.where((F.col("status_speaker") == ACTIVE) & (F.length("sentence_to_speak") > 0))
    parsed = asked.withColumn("j_", F.from_json("sentence_to_speak", "text string, voice_id string"))
    keys = F.json_object_keys("sentence_to_speak")
    request = F.col("frame_id") if "frame_id" in status.columns else F.lit(None).cast("string")
    return parsed.where(F.array_contains(keys, "voice_id") & F.col("j_.text").isNotNull()).select(
        "stream_id", "ts", request.alias("request_id"), "j_.text", F.coalesce("j_.voice_id", F.lit(default_voice)).alias("voice_id")
    )


def tts_interrupts(asr: DataFrame, status: DataFrame, key: str = "stream_id") -> DataFrame:
    """Recognised text that comes while the speaker's latest status is ACTIVE."""
    spoken = asr.where(F.length("payload") > 0)
    found = latest_state(spoken, status.select(key, "ts", "status_speaker"), ["status_speaker"], [key])
    return found.where(F.col("status_speaker") == ACTIVE).drop("status_speaker")


def interrupted_requests(requests: DataFrame, interrupts: DataFrame, live: bool = True, key: str = "stream_id") -> DataFrame:
    """(key, request_id, outcome): ``cancelled`` while queued, ``cut`` while playing, else ``finished``.

    requests: enqueued, started, finished. The earliest interrupt decides; the
    older player (``live=False``) leaves queued requests alone. The next
    interrupt after each of a request's times comes from one union and one
    window, read backwards in time.
    """
    times = F.explode(F.array(*(F.struct(F.col(c).alias("t_"), F.lit(c).alias("of_")) for c in ("enqueued", "started"))))
    asked = requests.select(key, "request_id", "enqueued", "started", "finished", times.alias("x_"))
    asked = asked.select(key, "request_id", "enqueued", "started", "finished", "x_.t_", "x_.of_", F.lit(1).alias("kind_"))
    hits = interrupts.select(key, F.col("ts").alias("t_"), F.col("ts").alias("i_"), F.lit(0).alias("kind_"))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("t_"), "kind_").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(hits, allowMissingColumns=True)
    rows = rows.withColumn("i_", F.last("i_", ignorenulls=True).over(order)).where("kind_ = 1")
    queued = (F.col("enqueued") <= F.col("i_")) & (F.col("i_") < F.col("started"))
    playing = (F.col("started") <= F.col("i_")) & (F.col("i_") < F.col("finished"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy(key, "request_id").agg(
        F.when(any_of(queued) & F.lit(live), "cancelled").when(any_of(playing), "cut").otherwise("finished").alias("outcome")
    )


def speaker_intervals(status: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, started, ended): each change to ACTIVE until the next READY; ended is null if none follows."""
    change = status.where(F.col("status_speaker").isin(ACTIVE, READY))
    order = Window.partitionBy(key).orderBy("ts")
    before = F.lag("status_speaker").over(order)
    changes = change.withColumn("before_", before)
    changes = changes.where(F.col("before_").isNull() | (F.col("before_") != F.col("status_speaker")))
    out = changes.withColumn("ended", F.lead("ts").over(order)).where(F.col("status_speaker") == ACTIVE)
    return out.select(key, F.col("ts").alias("started"), "ended")


def idle_gaps(audio: DataFrame, idle_s: float = 60.0, key: str = "stream_id") -> DataFrame:
    """(key, gap_start, gap_end) of ``idle_s`` or more between audio writes."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts"))
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = audio.select(key, before.alias("gap_start"), F.col("ts").alias("gap_end"))
    return out.where(t("gap_end") - t("gap_start") >= int(idle_s * 1_000_000))


def coalesce_chunks(chunks: DataFrame, interval: str, key: str = "stream_id") -> DataFrame:
    """(key, start, payload): the chunks of each interval joined in order of time."""
    start = F.window(F.col("ts").cast("timestamp"), interval)["start"]
    rows = chunks.groupBy(key, start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("ts", "payload"))).alias("r"))
    joined = F.aggregate("r", F.lit(b""), lambda s, r: F.concat(s, r["payload"]))
    return rows.select(key, "start", joined.alias("payload"))


class Rechunker:
    """Fixed chunks from frames of any length: at most one out per frame, the rest carried."""

    def __init__(self, size: int, held: bytes = b""):
        self.size, self.held = size, held

    def step(self, frame: bytes) -> bytes | None:
        self.held += frame
        if len(self.held) < self.size:
            return None
        out, self.held = self.held[: self.size], self.held[self.size :]
        return out


def rechunk_audio(pcm: DataFrame, samples: int, width: int = 2) -> DataFrame:
    """(stream_id, connection, seq, chunk): chunks of ``samples``; what is left when a connection ends is dropped.

    A connection's frames pass by in order and only the rest of a chunk is
    held; frames are (stream_id, connection, seq, payload).
    """

    def step(box, row):
        stream, connection, seq, payload = row
        chunk = box.step(payload or b"")
        return None if chunk is None else (stream, connection, seq, chunk)

    names = ["stream_id", "connection", "seq", "payload"]
    schema = ", ".join(f"{'chunk' if c == 'payload' else c} {dict(pcm.dtypes)[c]}" for c in names)
    return walk(pcm.select(*names), ["stream_id", "connection"], ["seq"], lambda: Rechunker(samples * width), step, schema)
