"""Parameters of the engine; the defaults are those of live capture."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
LABELS = ("অ", "আ", "ই", "ঈ", "উ", "ঊ", "ঋ", "এ", "ঐ", "ও", "ঔ")
TIPS = (4, 8, 12, 16, 20)
JOINTS = (3, 6, 10, 14, 18)
INDEX_TIP, WRIST = 8, 0
SKELETON = (
    (0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (11, 12),
    (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20), (5, 9), (9, 13), (13, 17),
)
FEATURES = ("delta_p", "delta_q", "sin_alpha", "cos_alpha", "sin_beta", "cos_beta", "same_stroke", "diff_stroke")
CODECS = ("video/mp4;codecs=avc1.42E01E", "video/mp4", "video/webm;codecs=vp9", "video/webm;codecs=vp8", "video/webm")
DRAW, ERASE, PEN_UP = "Draw", "Erase", "Pen up"
SAVE, CLEAR, SAVED, FAILED = "save", "clear", "save_ok", "save_failed"


@dataclass(frozen=True)
class CaptureRules:
    """Durations in microseconds, sizes in pixels."""

    pause_us: int = 1_500_000
    cap_us: int = 20_000_000
    min_points: int = 10
    cooldown_us: int = 1_400_000
    save_latency_us: int = 0
    save_timeout_us: int = 60_000_000  # an outcome that comes later is a failure
    frame_w: int = 640
    frame_h: int = 480
    brush: float = 9.0
    eraser: float = 32.0


@dataclass(frozen=True)
class IngestRules:
    repo: str = "owner/name"
    branch: str = "master"
    output_dir: str = "output"
    max_bytes: int = 10 * 1024 * 1024
    upload_key: str = ""
    app: str = "strokeloom"
    app_version: str = "1"
    message: str = "Add sample %s/%s/%s"


#: The event tables have hours between a user's rows, so pauses and caps are scaled.
SURROGATE = CaptureRules(pause_us=12 * 3600 * 1_000_000, cap_us=5 * 86400 * 1_000_000, cooldown_us=6 * 3600 * 1_000_000, save_timeout_us=18 * 3600 * 1_000_000)
