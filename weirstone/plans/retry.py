"""When a failed call is tried again. Spark retries tasks by itself; this is for whole actions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from weirstone.errors import ConfigurationError, RetryExhaustedError

R = TypeVar("R")


@dataclass(frozen=True)
class Retry:
    """No retry unless told so: fixed() and exponential() make the others."""

    retries: int = 0
    delay_ms: float = 0.0
    factor: float = 1.0
    most_ms: float = 30_000.0
    jitter: float = 0.0

    def __post_init__(self) -> None:
        if self.retries < 0 or self.delay_ms < 0 or self.factor < 1 or not 0 <= self.jitter <= 1:
            raise ConfigurationError(f"an impossible retry: {self}")

    @staticmethod
    def none() -> Retry:
        return Retry()

    @staticmethod
    def fixed(retries: int, delay_ms: float) -> Retry:
        return Retry(retries, delay_ms)

    @staticmethod
    def exponential(retries: int = 3, delay_ms: float = 100.0, factor: float = 2.0, most_ms: float = 30_000.0, jitter: float = 0.1) -> Retry:
        return Retry(retries, delay_ms, factor, most_ms, jitter)

    @property
    def attempts(self) -> int:
        return self.retries + 1

    def delay_for(self, retry: int, rng: random.Random | None = None) -> float:
        """Milliseconds before the given retry, from 0."""
        own = min(self.most_ms, self.delay_ms * self.factor**retry)
        return own * (1 + self.jitter * ((rng or random).random() * 2 - 1)) if self.jitter else own

    def call(self, f: Callable[[], R], sleep: Callable[[float], None] = time.sleep) -> tuple[R, int]:
        """The call's result and how often it was tried again. Errors that say they aren't retryable end it at once."""
        for attempt in range(self.attempts):
            try:
                return f(), attempt
            except Exception as e:
                if not self.retries or getattr(e, "retryable", True) is False:
                    raise
                if attempt + 1 == self.attempts:
                    raise RetryExhaustedError(self.attempts, e) from e
                sleep(self.delay_for(attempt) / 1000)
        raise AssertionError("unreachable")
