"""A pluggable transform of parts with pacing, a time limit, bounded retries and validation (FOLD8, ORC3, ORC4).

A failed part is a row, not a failed task. Tasks know nothing of each other's starts: each of n tasks paces its own at
n times the pause, which keeps the whole to one start in a pause.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import validate

ATTEMPTS = 3


def size(text: str) -> int:
    return sum(not c.isspace() for c in text)


class Pacer:
    """FOLD8: starts at least `pause` seconds apart; each at max(now, next), and next is a pause after it."""

    def __init__(self, pause: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.now, self.sleep, self.next = pause, now, sleep, 0.0

    def wait(self) -> None:
        now = self.now()
        start = max(now, self.next)
        self.next = start + self.pause
        if start > now:
            self.sleep(start - now)


def timed(run: Callable[[str, str], str], part: str, text: str, limit: float | None) -> str:
    """ORC4: the transform's result; past `limit` seconds a TimeoutError (its thread is left to end by itself)."""
    if limit is None:
        return run(part, text)
    box: dict = {}

    def call():
        try:
            box["made"] = run(part, text)
        except Exception as problem:  # handed on below
            box["problem"] = problem

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(limit)
    if "problem" in box:
        raise box["problem"]
    if "made" not in box:
        raise TimeoutError(f"no result within {limit:g} seconds")
    return box["made"]


def attempt(part: str, text: str, run: Callable[[str, str], str], attempts: int = ATTEMPTS, limit: float | None = None, pacer: Pacer | None = None) -> tuple[bool, str, str | None]:
    """ok, the last reason, and the text: each try waits its turn, runs the transform, drops blank lines and checks the length against the original."""
    reason = "unknown error"
    for turn in range(1, attempts + 1):
        try:
            if pacer:
                pacer.wait()
            made = "\n".join(x for x in timed(run, part, text, limit).splitlines() if x.strip())
            if not size(text):
                raise ValueError("source text has no visible characters")
        except Exception as problem:  # any failure of the plugged-in transform is this part's outcome
            reason = f"attempt {turn}: {problem}"
            continue
        ratio = size(made) / size(text)
        status = "too_short" if ratio < validate.LEAST else "too_long" if ratio > validate.MOST else "ok"
        if status == "ok":
            return True, "", made
        reason = f"attempt {turn}: validation {status} (ratio {ratio:.2f})"
    return False, reason, None


def transform_parts(parts: DataFrame, run: Callable[[str, str], str], attempts: int = ATTEMPTS, limit: float | None = None, pause: float = 0.0, tasks: int | None = None) -> DataFrame:
    """parts: part_number, path, text. Gives part_number, path, ok, reason, text (null where it failed).

    The transform is given the path, or the `request` where parts have one, and the text.
    With a pause, parts are dealt to `tasks` tasks (by default as many as run at once).
    """
    if pause:
        tasks = tasks or parts.sparkSession.sparkContext.defaultParallelism
        parts = parts.repartition(tasks)
    own_pause = pause * (tasks or 1)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(own_pause) if pause else None
        for frame in frames:
            found = [attempt(p, t or "", run, attempts, limit, pacer) for p, t in zip(frame[given], frame["text"], strict=True)]
            yield pd.DataFrame({"part_number": frame["part_number"], "path": frame["path"], "ok": [f[0] for f in found], "reason": [f[1] for f in found], "text": [f[2] for f in found]})

    given = "request" if "request" in parts.columns else "path"
    return parts.select(*dict.fromkeys(["part_number", "path", "text", given])).mapInPandas(each, "part_number int, path string, ok boolean, reason string, text string")
