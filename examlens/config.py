"""Thresholds. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    header_zone: float = 0.08
    footer_zone: float = 0.08
    repeat_share: float = 0.70
    line_y_factor: float = 0.55
    line_y_floor: float = 3.0
    space_factor: float = 0.3
    gap_width_share: float = 0.05
    gap_density: float = 0.03
    center_margin: float = 0.30
    min_fragments: int = 10
    buckets: int = 100


@dataclass(frozen=True)
class Parser:
    max_first_number: int = 20
    max_jump: int = 5
    min_stem_words: int = 5
    min_useful_options: int = 1
    min_score: int = 45
    weak_min_items: int = 4
    weak_max_score: float = 40
    weak_max_useful: float = 3
    source_stem_words: int = 8
    # Lines of one exam are worked on in ranges of this many line numbers, so
    # that a very long exam is spread over many tasks.
    block_lines: int = 4096
    # So many numbered lines are scanned in one go (up to twice as many where they are dense).
    scan_lines: int = 65536
    # Summaries of that many blocks are chained in one task.
    group_blocks: int = 4096


@dataclass(frozen=True)
class Quality:
    min_confidence: float = 80
    min_questions: int = 1
    min_chars: int = 10


@dataclass(frozen=True)
class Classification:
    batch_size: int = 10
    max_retries: int = 2
    daily_usd: float = 1.0
    input_usd_per_million: float = 0.3
    output_usd_per_million: float = 2.5


MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MIN_EXTRACT_CHARS = 180
CHUNK_CHARS = 30000
PAGE_SEPARATOR = "\n\n---\n\n"

LAYOUT = Layout()
PARSER = Parser()
QUALITY = Quality()
CLASSIFICATION = Classification()
