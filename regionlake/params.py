"""Job parameters.  Every number here is a default that callers can override."""

from __future__ import annotations

from dataclasses import dataclass

# Groups above these sizes are never gathered into one array or one window task.
MAX_FOLD_ROWS = 2_000
MAX_WINDOW_ROWS = 500_000
# A window or join of more rows than this a task is dealt to more tasks than the session's shuffle partitions.
MAX_TASK_ROWS = 250_000


@dataclass(frozen=True)
class DetectionParams:
    min_confidence: float = 0.6
    include_inline: bool = True
    include_display: bool = True
    target_dpi: float = 300.0
    source_dpi: float = 72.0
    denoise: bool = True
    enhance_contrast: bool = True
    binarization: str = "adaptive"
    fixed_threshold: int = 180
    max_adaptive_pixels: int | None = None  # pages above it are cut by Otsu's threshold without denoising; off
    max_detection_pixels: int = 4_000_000
    min_detection_dpi: float = 96.0
    min_height: float = 12.0
    max_height: float = 300.0
    min_width: float = 16.0
    min_region_pixels: int = 20
    merge_gap_x: float = 30.0
    merge_gap_y: float = 15.0
    max_page_share: float = 0.6


@dataclass(frozen=True)
class LevelParams:
    low: float = 0.75
    high: float = 0.9


@dataclass(frozen=True)
class TileParams:
    tile_size: int = 1000
    margin: int = 100
    threshold_area: int = 2000 * 3000


@dataclass(frozen=True)
class PageParams:
    confidence_threshold: float = 0.75
    max_regions: int | None = None  # no limit
    page_type: str = "general"
    text_quality: float = 0.8
    policy: str = "both"  # text and pixel detections of a tile; "by_size" chooses one of them by large_tile_pixels
    large_tile_pixels: int = 1_200_000


@dataclass(frozen=True)
class ValidationParams:
    min_width: float = 20.0
    min_height: float = 10.0
    max_width: float = 1000.0
    max_height: float = 500.0
    min_confidence: float = 0.3


@dataclass(frozen=True)
class DocumentLimits:
    pdf_bytes: int = 50 * 1024 * 1024
    docx_bytes: int = 20 * 1024 * 1024
    markdown_bytes: int = 5 * 1024 * 1024
    image_bytes: int = 10 * 1024 * 1024
    max_pages: int = 100


# fixed values: tier -> (daily limit, monthly limit)
TIER_LIMITS = {
    "anonymous": (1, 3),
    "registered": (10, 100),
    "paid": (200, 5000),
    "admin": (999999, 999999),
}

# fixed values: plan price -> days
PLAN_DAYS = {5: 30, 14: 90, 40: 365}

# fixed values: order in which a substitute recogniser is chosen
PROVIDER_PRIORITY = (
    "zhipu", "gemini", "simpletex", "siliconflow", "qwen", "local", "anthropic", "openai",
)
