"""Logical tables."""

VECTORS = "path string, seq long, embedding array<float>, kind string, model_id string"
PHOTOS = "path string, modification_time timestamp, length long"
VIDEOS = "id long, path string, label string, embedding array<float>, created_at timestamp, frames binary"
FRAMES = "video_id long, frame_idx int, embedding array<float>, hist array<double>"
DETECTIONS = (
    "det_id long, video_id long, frame_idx int, x1 int, y1 int, x2 int, y2 int, det_score double, yaw double, "
    "blur_var double, embedding array<float>"
)
FACES = (
    "id long, video_id long, person_id long, embedding array<float>, thumbnail_path string, confidence double, "
    "pose_yaw double"
)
PERSONS = "id long, name string, thumbnail string"
PEOPLE = "person_id string, name string"
PERSON_PHOTOS = "person_id string, path string, seq long"
FEEDBACK = "video_id long, corrected_label string, embedding array<float>, created_at timestamp"
LABELS = "label string, grp string, prompts array<string>"
LABEL_VECTORS = "label string, label_ord int, embedding array<float>"
SCANNED_EMPTY = "path string, mtime_ns long, size long"
MEDIA_INFO = "path string, probe_text string"
META = "key string, value string"
JOB_EVENTS = "job string, seq long, ts timestamp, items long, seconds double"
FILES = "path string, modificationTime timestamp, length long, content binary"
