"""Settings of the engine, with the defaults that give the usual results."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    similarity_threshold: float = field(default_factory=lambda: float(os.environ.get("SIMILARITY_THRESHOLD", "0.4")))
    dimensions: int = 2560
    history_turns: int = 3
    chunk_size: int = 800
    chunk_overlap: int = 100
    embed_batch: int = 100
    search_page: int = 100
    search_cap: int = 2000
    search_delay_s: float = 0.3
    web_queries: int = 3
    web_results: int = 3
    web_chars: int = 500
    max_upload_bytes: int = field(default_factory=lambda: int(os.environ.get("MAX_UPLOAD_MB", "50")) * 1024 * 1024)
    think_flush_chars: int = 30


#: What operators use where nothing else is given.
DEFAULTS = Options()
