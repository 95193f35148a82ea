"""Fixed schemas (DDL) of the tables the library reads and writes."""

from __future__ import annotations

POINT = "struct<x: double, y: double, z: double, visibility: double>"
RAW_MEASUREMENT = (
    "id long, session_id long, sample_id long, timestamp string, left_pupil_px double, right_pupil_px double, left_status string, right_status string, perf_timestamp_ms double"
)
FINAL_RECORD = (
    "id long, session_id long, timestamp string, baseline_left_pupil_px double, baseline_right_pupil_px double, stimulus_onset_timestamp string, "
    "stimulus_onset_ms double, stimulus_left_pupil_px double, stimulus_right_pupil_px double, stimulus_duration_ms double, status string"
)
STIMULUS = "session_id long, onset_ms double, offset_ms double, configured_ms double, actual_ms double"
CONTEXT = (
    "session_id long, patient_id string, age_years int, mechanism string, time_elapsed string, symptoms array<string>, notes string, "
    "mydriatic_drops boolean, known_anisocoria boolean"
)
LANDMARKS = f"session_id long, frame_ts_ms double, lm array<{POINT}>"
SESSION_CSV = "session_id string, subject_id string, time double, stimulus int, left_pupil_px double, right_pupil_px double, brightness double"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
