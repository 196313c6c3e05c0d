"""Presets and limits of the matching jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of matching.
MIN_QUOTE, MIN_PART, MIN_ALLOWANCE, DUPLICATE = 14, 10, 240, 0.7
RELAXED_DROP, RELAXED_LEAST, RELAXED_TOKENS = 0.1, 0.74, 0.9
GAP_PAGE_CHARS = 220


@dataclass(frozen=True)
class Settings:
    coverage: str = "balanced"
    min_importance: str = "low"
    max_per_page: int = 10
    ceiling: float = 0.5
    min_confidence: float = 0.9
    cue_sweep: bool = True

    @property
    def floor(self) -> float:
        return min(max(self.min_confidence, 0.6), 0.99)

    @property
    def clamped_ceiling(self) -> float:
        return min(max(self.ceiling, 0.1), 0.95)

    @property
    def relaxed_floor(self) -> float:
        return max(RELAXED_LEAST, self.floor - RELAXED_DROP)


PRESETS = {
    "selective": Settings("selective", "medium", 6, 0.35, 0.9, False),
    "balanced": Settings(),
    "complete": Settings("complete", "low", 0, 0.75, 0.88, True),
}
#: Passes over each chunk, with their share of its highlights.
PASSES = {
    "selective": (("primary", 1.0),),
    "balanced": (("primary", 1.0), ("gap", 0.6)),
    "complete": (("primary", 1.0), ("gap", 0.8), ("structured", 0.8)),
}
HIGHLIGHTS_PER_PAGE = {"selective": 3, "balanced": 7, "complete": 12}
CHUNK_CHARS, CHUNK_HIGHLIGHTS = 12_000, 60
COOLDOWN_SECONDS = (20, 45, 90, 180, 300)
TROUBLE_SECONDS = 5
