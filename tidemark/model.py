"""Explicit schemas of the long tables. Nothing is ever inferred.

Time is float seconds (``DOUBLE``) or whole ticks (``INT``) from the start of
the entity's axis. A missing reading is an absent row, never a zero.

Size rule used by the operators: rows are folded to one row per
``(video_id, tick)`` with map-side combine *before* anything is ordered per
entity, so an ordered group is bounded by the length of the entity's axis and
not by how many raw rows a hot entity carries. Where raw times must be ordered
(``point``, ``span``), the operators in :mod:`tidemark.operators.islands` and
:mod:`tidemark.operators.axis` cut the axis into chunks and only stitch the
chunk edges per entity.
"""

VIDEO = "video_id STRING, duration DOUBLE, fps DOUBLE, total_frames BIGINT, params_sig STRING"
LABEL_SEC = "video_id STRING, sec INT, label STRING, composed BOOLEAN"
BOX = (
    "video_id STRING, ts DOUBLE, idx INT, label STRING, x DOUBLE, y DOUBLE, "
    "w DOUBLE, h DOUBLE, conf DOUBLE, track_id BIGINT, identity_id STRING"
)
DETECTION = "video_id STRING, ts DOUBLE, frame_id BIGINT, label_id INT, conf DOUBLE, label STRING"
SPAN = (
    "video_id STRING, kind STRING, start DOUBLE, end DOUBLE, score DOUBLE, "
    "sources ARRAY<STRING>, signals MAP<STRING,DOUBLE>"
)
POINT = "video_id STRING, signal STRING, t DOUBLE"
CURVE = "video_id STRING, signal STRING, sec INT, value DOUBLE"
WAVE = "video_id STRING, bin INT, lo DOUBLE, hi DOUBLE, rms DOUBLE"
SEGMENT = "video_id STRING, start DOUBLE, end DOUBLE, text STRING, speaker STRING, gender STRING"
READING = "video_id STRING, sec INT, label STRING, conf DOUBLE, faces INT"
EMBEDDING = "video_id STRING, model_id STRING, ts_ms BIGINT, vec ARRAY<FLOAT>"
GALLERY = "identity_id STRING, seq INT, vec ARRAY<FLOAT>"
IDENTITY = "identity_id STRING, name STRING, avoid BOOLEAN, cnt BIGINT"
CHAPTER = (
    "video_id STRING, number INT, start DOUBLE, end DOUBLE, shots INT, "
    "boundary_score DOUBLE, method STRING"
)
RULE = (
    "event STRING, label STRING, enabled BOOLEAN, "
    "rules ARRAY<STRUCT<source: STRING, region: STRING, min_count: INT, max_count: INT>>, "
    "signals ARRAY<STRUCT<signal: STRING, min: DOUBLE, max: DOUBLE, any_of: ARRAY<STRING>, "
    "sustained: INT, within: INT>>, "
    "window_secs DOUBLE, persist_secs DOUBLE, min_duration DOUBLE, max_duration DOUBLE, "
    "ignore_start DOUBLE, ignore_end DOUBLE"
)
RECORD = (
    "video_id STRING, duration DOUBLE, fps DOUBLE, total_frames BIGINT, "
    "transcript STRUCT<segments: ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, "
    "speaker: STRING, gender: STRING>>>, "
    "objects ARRAY<STRUCT<sec: INT, labels: ARRAY<STRING>>>, "
    "actions ARRAY<STRUCT<ts: DOUBLE, frame_id: BIGINT, label_id: INT, conf: DOUBLE, label: STRING>>, "
    "scenes ARRAY<STRUCT<start: DOUBLE, end: DOUBLE>>, "
    "motion_events ARRAY<DOUBLE>, motion_peaks ARRAY<DOUBLE>, audio_peaks ARRAY<DOUBLE>, "
    "waveform ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE, rms: DOUBLE>>, "
    "levels ARRAY<DOUBLE>, "
    "boxes ARRAY<STRUCT<ts: DOUBLE, objects: ARRAY<STRING>, "
    "bboxes: ARRAY<ARRAY<DOUBLE>>, confidences: ARRAY<DOUBLE>>>"
)
