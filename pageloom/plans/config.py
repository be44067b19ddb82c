"""Thresholds, as one frozen object on the driver; they become literals in expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    header_ratio: float = 0.08
    footer_ratio: float = 0.08
    min_noise_repeat: int = 3
    watermark_low: float = 0.20
    watermark_high: float = 0.80
    watermark_size: float = 20.0
    min_chars_per_page: int = 50
    image_heavy_ratio: float = 0.5
    image_area_table_hint: float = 0.15
    toc_threshold: float = 0.4
    garble_text_trust_chars: int = 800
    empty_cell_ratio: float = 0.9
    table_bottom_ratio: float = 0.20
    table_top_ratio: float = 0.20
    line_gap_multiplier: float = 1.5
    line_height_split_factor: float = 1.2
    indent_tolerance: float = 5.0
    heading_bold_ratio: float = 1.3
    heading_size_ratio: float = 1.2
    layout_iou: float = 0.3
    caption_proximity: float = 100.0
    table_quality: float = 0.45
    max_tokens: int = 500


DEFAULT = Config()
