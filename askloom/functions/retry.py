"""Waiting for models that limit their callers."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

Result = TypeVar("Result")


def no_rate_limit(_: Exception) -> bool:
    return False


def call_with_retry(
    call: Callable[[], Result],
    is_rate_limit: Callable[[Exception], bool],
    timeout_sec: float = 60,
    wait_sec: float = 2,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[Result | None, str | None]:
    """(result, error): retried on rate limits until the time is up; other errors are raised.

    Running out of time gives no result and the last message, so the row
    survives with a null answer.
    """
    deadline = clock() + timeout_sec
    message = "timed out"
    while clock() < deadline:
        try:
            return call(), None
        except Exception as error:
            if not is_rate_limit(error):
                raise
            message = f"rate limit: {error}"
            sleep(wait_sec)
    return None, message


def in_lanes(df: DataFrame, lanes: int) -> DataFrame:
    """``df`` in exactly ``lanes`` partitions, so that no more tasks than that call a model at once."""
    return df.repartition(lanes)


def paced(
    call: Callable[..., Result],
    calls: int,
    seconds: float,
    lanes: int,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[..., Result]:
    """``call`` at a pace that all tasks share: at most ``calls`` in any ``seconds``, over ``lanes`` tasks.

    A budget in time needs no talk between executors if it is dealt out beforehand: over rows that
    ``in_lanes`` put into ``lanes`` partitions, each task leaves ``seconds`` divided by its whole share of
    the calls between two calls, and as much before its first, so that a task that follows another on one
    core keeps the distance too. Fewer cores than lanes use less than the budget. Wrap the innermost call,
    so that repeated ones count, and leave speculative execution off, which would run a lane twice.
    """
    if not 1 <= lanes <= calls or seconds <= 0:
        raise ValueError("need 1 <= lanes <= calls and seconds > 0")
    distance = seconds / (calls // lanes)
    last: list[float] = []

    def wait_and_call(*args, **kwargs) -> Result:
        last[:] = last or [clock()]
        while (left := last[0] + distance - clock()) > 0:
            sleep(left)
        last[0] = clock()
        return call(*args, **kwargs)

    return wait_and_call
