"""Ordered-scan metrics: one running value for every row, along the plan's order within its group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Scan:
    kind: str
    col: str | None = None
    n: int = 0
    factor: float = 0.0
    kernel: tuple[float, ...] = ()
    fn: Callable[[Any, dict], tuple[Any, Any]] | None = None
    init: Any = None
    dtype: str = "double"

    @property
    def folded(self) -> bool:
        """Whether its step needs the step before: done row by row, not by window functions."""
        return self.kind in ("ema", "tema", "scan")

    @property
    def print(self) -> tuple:
        return (self.kind, self.col, self.n, self.factor, self.kernel, self.dtype)


def sum(col: str) -> Scan:  # noqa: A001
    """Running sum; null adds 0, so it starts at 0."""
    return Scan("sum", col)


def count() -> Scan:
    """Rows so far, this one included."""
    return Scan("count")


def min(col: str) -> Scan:  # noqa: A001
    return Scan("min", col)


def max(col: str) -> Scan:  # noqa: A001
    return Scan("max", col)


def first(col: str) -> Scan:
    """The first value that is not null; null before there is one."""
    return Scan("first", col)


def product(col: str) -> Scan:
    """Running product as a double; nulls ignored; null before the first value."""
    return Scan("product", col)


def ema(col: str, alpha: float) -> Scan:
    """alpha * x + (1 - alpha) * before, from the first value; null keeps what was."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], not {alpha}")
    return Scan("ema", col, factor=float(alpha))


def tema(col: str, lam: float) -> Scan:
    """As ema, with alpha = 1 - exp(-lam * time since the last value), time being the numeric order column."""
    if not lam > 0:
        raise ValueError(f"lam must be above 0, not {lam}")
    return Scan("tema", col, factor=float(lam))


def lag(col: str, n: int = 1) -> Scan:
    """The value n rows back, nulls holding their places."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"n must be a whole number of at least 1, not {n!r}")
    return Scan("lag", col, n=n)


def prev(col: str) -> Scan:
    return lag(col, 1)


def convolution(col: str, kernel) -> Scan:
    """The kernel, oldest factor first, over the last rows; null until there are enough; null counts as 0."""
    kernel = tuple(float(k) for k in kernel)
    if not kernel:
        raise ValueError("the kernel is empty")
    return Scan("convolution", col, n=len(kernel) - 1, kernel=kernel)


def scan(fn: Callable[[Any, dict], tuple[Any, Any]], init: Any, dtype: str = "double") -> Scan:
    """A fold of one's own: fn(state, row) -> (state, value); the state must be representable as JSON."""
    return Scan("scan", fn=fn, init=init, dtype=dtype)
