"""Thresholds of the document-layout operators, as literals for expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LayoutConfig:
    """Fixed values (points, pixels at 96 dpi, shares of a page)."""

    hyphen_fix: bool = True
    save_images: bool = True
    save_drawings: bool = True
    include_metadata: bool = True
    include_small_text: bool = True
    enable_margin_check: bool = True
    min_size_px: int = 50
    min_block_size_px: int = 10
    max_items_per_page: int = 10
    min_items_per_cluster: int = 1
    small_text_max_chars: int = 80
    counted_text_max_chars: int = 100
    column_tolerance: float = 50.0
    merge_tolerance: float = 20.0
    margin_left: float = 0.05
    margin_right: float = 0.95
    margin_top: float = 0.05
    margin_bottom: float = 0.95


#: Chunks of pages: documents below the first number of pages stay whole, others are cut into chunks of the second.
WHOLE_BELOW, CHUNK_PAGES = 32, 8
#: Overlap rules: overlap (intersection over union, or over the smaller area for conflicts) and difference in size.
SIMILAR_OVERLAP, SIMILAR_SIZE = 0.8, 0.2
TEXT_OVERLAP, FULL_PAGE, CONFLICT_OVERLAP = 0.9, 0.8, 0.8
#: Descriptions of images: accepted lengths, attempts, the first attempt's seed, and the longest side of the image.
DESCRIPTION_LENGTHS, ATTEMPTS, FIRST_SEED, LONGEST_SIDE = (100, 3500), 3, 5678, 1024
