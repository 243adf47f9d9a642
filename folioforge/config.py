"""Limits of a build."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TreeConfig:
    """Limits of grouping, repair and expansion; ``max_sections`` and ``max_tokens_per_group`` 0 mean no limit."""

    max_tokens_per_group: int = 20_000
    page_overlap: int = 1
    max_parallel_llm_calls: int = 5
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 50_000
    max_fix_attempts: int = 3
    fix_search_radius: int = 5
    max_expansion_depth: int = 5
    max_sections: int = 0
