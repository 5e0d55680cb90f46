"""What a run can be asked for."""

from __future__ import annotations

from dataclasses import dataclass

from .. import constants as K


@dataclass(frozen=True)
class Config:
    threshold: float | None = None
    min_tokens: int = K.MIN_TOKENS
    excludes: tuple[str, ...] = ()
    default_excludes: bool = True
    include_tests: bool = False
    skip_tests: bool = False

    def bound(self, default: float) -> float:
        """The threshold, within 0 and 1."""
        return min(1.0, max(0.0, default if self.threshold is None else self.threshold))
