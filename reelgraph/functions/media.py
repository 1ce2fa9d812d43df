"""Predicates and formulas over media properties: frames, faces, thumbnails, files, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
WATCHED_IMAGE_EXTENSIONS = ("jpg", "png", "jpeg")
LIBRARY_VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm")
IMPORT_VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "wmv")
CONVERTIBLE_VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "wmv", "m4v")
PLAYABLE_CONTAINERS = ("mp4", "m4v", "webm")
PLAYABLE_VIDEO_CODECS = ("h264", "vp8", "vp9", "av1")
PLAYABLE_PIXEL_FORMATS = ("yuv420p", "yuvj420p")
PLAYABLE_AUDIO_CODECS = ("aac", "mp3", "opus", "vorbis", "flac")
COPYABLE_AUDIO_CODECS = ("aac", "mp3")
PIXEL_FORMAT_PATTERN = r"^(yuv|nv\d|gray|rgb|bgr|gbr|pal|p0)\w*$"
MIN_FACE_SCORE, MAX_FACE_YAW, MIN_FACE_AREA, MIN_FACE_BLUR = 0.35, 75.0, 576, 10.0
CLEANUP_MAX_YAW = 70.0
MIN_FRAMES, MAX_FRAMES = 4, 14


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return path.rlike(r"(?i)\.(" + "|".join(extensions) + r")$")


def video_duration(frame_count: Column, fps: Column) -> Column:
    """Seconds, null when the container does not say."""
    return F.when((frame_count > 0) & (fps > 0), frame_count / fps)


def frame_budget(
    images_per_second: Column, duration_s: Column, budget_s: float = 2.0, max_frames: int = MAX_FRAMES,
    min_frames: int = MIN_FRAMES,
) -> Column:
    """Frames of a video worth encoding: about one per 3 s, within a time budget."""
    affordable = F.floor(images_per_second * budget_s)
    unknown = duration_s.isNull() | (duration_s == 0)
    wanted = F.when(unknown, F.lit(max_frames)).otherwise(F.floor(duration_s / 3.0) + 2)
    return F.greatest(F.lit(min_frames), F.least(F.lit(max_frames), affordable, wanted)).cast("int")


def _even_positions(n: Column, count: Column) -> Column:
    steps = F.sequence(F.lit(0), count - 1)
    gap = (n - 1).cast("double") / F.greatest(count - 1, F.lit(1)).cast("double")
    return F.transform(steps, lambda i: i.cast("double") * gap)


def sample_indices(n: Column, count: Column) -> Column:
    """``count`` positions over 0..n-1, evenly spaced and cut to whole numbers; may repeat when n is small."""
    whole = F.transform(_even_positions(n, count), lambda x: F.floor(x).cast("int"))
    return F.when((n > 0) & (count > 0), whole).otherwise(F.array().cast("array<int>"))


def pick_evenly(n: Column, count: Column) -> Column:
    """Distinct positions of ``count`` items spread over n (halves round to even), or all n when count >= n."""
    rounded = F.array_distinct(F.transform(_even_positions(n, count), lambda x: F.bround(x).cast("int")))
    return (
        F.when(n <= 0, F.array().cast("array<int>"))
        .when(count >= n, F.sequence(F.lit(0), (n - 1).cast("int")))
        .when(count <= 0, F.array().cast("array<int>"))
        .otherwise(rounded)
    )


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area of a box after clamping its corners at 0."""
    zero = F.lit(0)
    return (F.greatest(x2, zero) - F.greatest(x1, zero)) * (F.greatest(y2, zero) - F.greatest(y1, zero))


def face_gate(
    score: Column, yaw: Column, x1: Column, y1: Column, x2: Column, y2: Column, blur: Column
) -> Column:
    """Detection is confident, not in profile, large and sharp enough, with a non-empty crop. Unknown yaw passes."""
    zero = F.lit(0)
    crop = (F.greatest(x2, zero) > F.greatest(x1, zero)) & (F.greatest(y2, zero) > F.greatest(y1, zero))
    return (
        (score >= MIN_FACE_SCORE)
        & (yaw.isNull() | (F.abs(yaw) <= MAX_FACE_YAW))
        & (box_area(x1, y1, x2, y2) >= MIN_FACE_AREA)
        & crop
        & (blur >= MIN_FACE_BLUR)
    )


#: The reasons as they are shown.
LOW_CONFIDENCE, SIDE_VIEW, NO_FILE = "low confidence", "extreme side-view angle", "file missing on disk"


def cleanup_reason(confidence: Column, yaw: Column, file_present: Column) -> Column:
    """Why a stored face should go, or null: low confidence, then extreme yaw, then a missing thumbnail."""
    return (
        F.when(confidence < MIN_FACE_SCORE, F.lit(LOW_CONFIDENCE))
        .when(F.abs(yaw) > CLEANUP_MAX_YAW, F.lit(SIDE_VIEW))
        .when(~F.coalesce(file_present, F.lit(False)), F.lit(NO_FILE))
    )


def thumbnail_score(confidence: Column, yaw: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) - F.abs(F.coalesce(yaw, F.lit(0.0))) / 180.0 * 0.2


def signature(mtime_ns: Column, size: Column) -> Column:
    return F.struct(mtime_ns.alias("mtime_ns"), size.alias("size"))


def is_stale(known: Column, current: Column) -> Column:
    """A cached signature no longer describes the file (or there is none)."""
    return ~known.eqNullSafe(current)


def probe_video_codec(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"Video: (\w+)", 1)), F.lit(""))


def probe_audio_codec(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"Audio: (\w+)", 1)), F.lit(""))


def probe_pixel_format(text: Column) -> Column:
    """First comma field after the video codec that looks like a pixel format."""
    rest = F.regexp_extract(text, r"Video: \w+([^\n]*)", 1)
    tokens = F.transform(
        F.split(rest, ","), lambda f: F.substring_index(F.substring_index(F.trim(f), " ", 1), "(", 1)
    )
    return F.try_element_at(F.filter(tokens, lambda t: t.rlike(PIXEL_FORMAT_PATTERN)), F.lit(1))


def video_stream_ok(codec: Column, pixel_format: Column) -> Column:
    return F.coalesce(codec.isin(*PLAYABLE_VIDEO_CODECS) & pixel_format.isin(*PLAYABLE_PIXEL_FORMATS), F.lit(False))


def audio_stream_ok(codec: Column) -> Column:
    return codec.isNull() | codec.isin(*PLAYABLE_AUDIO_CODECS)


def is_playable(path: Column, video: Column, pixel_format: Column, audio: Column) -> Column:
    return (
        has_extension(path, PLAYABLE_CONTAINERS) & video_stream_ok(video, pixel_format) & audio_stream_ok(audio)
    )


def video_action(video: Column, pixel_format: Column) -> Column:
    return F.when(video_stream_ok(video, pixel_format), F.lit("copy")).otherwise(F.lit("encode"))


def audio_action(audio: Column) -> Column:
    return (
        F.when(audio.isin(*COPYABLE_AUDIO_CODECS), F.lit("copy"))
        .when(audio.isNull(), F.lit("none"))
        .otherwise(F.lit("encode"))
    )
