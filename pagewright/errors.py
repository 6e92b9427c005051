"""Errors of an extraction as values: `[type:function] message`, and what wraps a fallible step."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("parse", "extraction", "validation", "cleanup", "timeout")


class PageError(Exception):
    def __init__(self, kind: str, function: str, message: str, cause: Exception | None = None):
        super().__init__(f"[{kind}:{function}] {message}" + (f": {cause}" if cause else ""))
        self.kind, self.function, self.cause = kind, function, cause


def is_error_type(error: Column | str, kind: str) -> Column:
    """Whether an error column holds an error of a type."""
    c = F.col(error) if isinstance(error, str) else error
    return F.coalesce(c.startswith(f"[{kind}:"), F.lit(False))


def with_retry(step: Callable, tries: int = 3, pause: float = 0.1):
    """The step's result; after each failure but the last a pause that doubles."""
    for i in range(tries):
        try:
            return step()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(pause * 2**i)


def with_fallback(step: Callable, fallback: Callable):
    try:
        return step()
    except Exception:
        return fallback()
