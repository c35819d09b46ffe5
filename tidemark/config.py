"""Parameters of the preparation and evaluation stages."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400
WEEK = 7 * DAY


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the full-size log; FIXTURE suits the small test tables."""

    #: Whether items without a vector leave before all else.
    need_vectors: bool = False
    min_played: int = 50
    min_user: int = 5
    min_item: int = 5
    max_rounds: int = 20
    heavy_loss: float = 0.80
    val_seconds: int = 14 * DAY
    test_seconds: int = 14 * DAY
    min_window_rows: int = 10_000
    min_subgroup: int = 1_000
    sample_fractions: tuple[float, float] = (0.10, 0.01)
    min_sample: int = 100
    seed: int = 42
    ks: tuple[int, ...] = (10, 100)


FIXTURE = Settings(val_seconds=200 * DAY, test_seconds=200 * DAY, min_window_rows=100, min_subgroup=30, min_sample=10)
