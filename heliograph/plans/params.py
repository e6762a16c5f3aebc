"""Constants of the engine as parameters, and the states a photo can be in."""

from __future__ import annotations

from dataclasses import dataclass

# Thumbnail states.
PENDING, READY, FAILED, CLOUD, DOWNLOADING = 0, 1, 2, 3, 4
# Whether a photo's faces were looked for; a claimed one is being worked on.
UNSCANNED, SCANNED, CLAIMED = 0, 1, 2
# File extensions that are photos.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif")
# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class Params:
    """Thresholds of the vector and decision engines. The defaults."""

    k: int = 10
    link: float = 0.5
    duplicate: float = 0.8
    min_votes: int = 2
    suggest: float = 0.45
    min_pairs: int = 3
    anchor_top: int = 3
    fold_min: float = 0.6
    fold_margin: float = 0.06
    min_anchor: int = 4
    anchor_size: int = 64
    core_tau: float = 0.5
    core_floor: int = 6
    look_tau: float = 0.5
    look_faces: int = 16
    look_photos: int = 10
    max_looks: int = 8
    look_flag: float = 0.5
    look_flag_margin: float = 0.08
    strong: float = 0.6
    max_maybe: int = 12
    same_photo_ask: float = 0.7
    top_merges: int = 20
    review_photos: int = 4
    review_queue: int = 60
    double_iou: float = 0.4


#: The library's own thresholds, and the ones at which the synthetic vectors have structure.
DEFAULT = Params()
SYNTHETIC = Params(link=0.4, suggest=0.35, min_pairs=1, fold_min=0.3, fold_margin=0.02, min_anchor=3, strong=0.35, same_photo_ask=0.35, review_photos=1)
