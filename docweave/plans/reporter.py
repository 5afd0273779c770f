"""Messages of a run, by stage, to callbacks and to a file."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.plans.metrics import STAGES


class Reporter:
    """Hands ``[stage] message`` lines, the progress of a stage and the outcome of each file
    to callbacks, each of which may be missing; one that raises does not stop the run."""

    def __init__(self, log: Callable[[str], None] | None = None, progress: Callable[[int, str], None] | None = None, file: Callable[[str, str | None], None] | None = None) -> None:
        self.log, self.progress, self.file = log, progress, file

    def __call__(self, stage: str, message: str) -> None:
        self._tell(self.log, f"[{stage}] {message}")
        if stage in STAGES:
            self._tell(self.progress, STAGES[stage], message)

    def files(self, files: DataFrame, failures: DataFrame) -> None:
        """Tells of each file its path and why it failed, if it did, a partition at a time."""
        if self.file is not None:
            why = failures.groupBy("source_path").agg(F.min(F.concat_ws(": ", "stage", "message")).alias("why"))
            for path, message in files.select("source_path").join(why, "source_path", "left").toLocalIterator():
                self._tell(self.file, path, message)

    @staticmethod
    def _tell(to: Callable | None, *what: object) -> None:
        if to is None:
            return
        try:
            to(*what)
        except Exception:
            pass


class LogFile:
    """Appends lines to ``<out>/logs/<stem>_<time>.log``, on the driver; where that name
    is taken, ``_1``, ``_2`` ... follows."""

    def __init__(self, out: str, stem: str, stamp: str | None = None) -> None:
        folder = Path(out.removeprefix("file://").removeprefix("file:")) / "logs"
        folder.mkdir(parents=True, exist_ok=True)
        base, n = f"{stem}_{stamp or time.strftime('%Y%m%d_%H%M%S')}", 0
        while True:
            self.path = folder / (f"{base}_{n}.log" if n else f"{base}.log")
            try:
                self.path.open("x").close()
                return
            except FileExistsError:
                n += 1

    def __call__(self, line: str) -> None:
        with self.path.open("a", encoding="utf-8") as file:
            file.write(line.rstrip("\n") + "\n")
