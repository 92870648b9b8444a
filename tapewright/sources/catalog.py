"""A catalog: where it lies, its rows, and copies that take changes."""

from __future__ import annotations

import os
import shutil
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tapewright.operators.catalog_rows import visible_columns
from tapewright.operators.edit import find_predicate
from tapewright.operators.model import Enabled, Preferences
from tapewright.operators.search import search
from tapewright.sources import sqlite

T = TypeVar("T")
#: Seconds that a find may take.
FIND_SECONDS = 60


@dataclass
class Catalog:
    """Opened from a SQLite file or a Parquet table. ``tag`` marks the jobs of this catalog, so that they can be cancelled."""

    spark: SparkSession
    uri: str
    table: str = sqlite.TABLE

    def __post_init__(self):
        self.tag = f"catalog-{uuid.uuid4().hex}"

    @property
    def is_sqlite(self) -> bool:
        return self.uri.endswith((".sqlite", ".db"))

    @property
    def name(self) -> str:
        return os.path.basename(self.uri)

    def rows(self, columns: tuple[str, ...] = ()) -> DataFrame:
        if self.is_sqlite:
            return sqlite.read_catalog(self.spark, self.uri, self.table, columns)
        df = self.spark.read.parquet(self.uri)
        return df.select("rowid", *columns) if columns else df

    def size(self) -> int:
        return self.rows(("filepath",)).count() if not self.is_sqlite else self.rows().count()

    def describe(self) -> dict:
        return {"path": self.uri, "name": self.name, "size": self.size(), "columns": visible_columns(self.rows())}

    def search(self, enabled: Enabled, prefs: Preferences, compare: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
        return search(self.rows(), enabled, prefs, compare, existing)

    def clone(self, tag: str) -> Catalog:
        """A copy beside the catalog, ``X_<tag>``, that takes the changes; the source stays as it is."""
        base, ext = os.path.splitext(self.uri)
        to = f"{base}_{tag}{ext}"
        if self.is_sqlite:
            shutil.copyfile(self.uri, to)
        else:
            self.rows().write.mode("errorifexists").parquet(to)
        return Catalog(self.spark, to, self.table)

    def close(self) -> None:
        """Ends what still runs for this catalog."""
        self.cancel()

    def progress(self) -> list[dict]:
        """Of each active stage: its name, and its tasks in all, done and running."""
        t = self.spark.sparkContext.statusTracker()
        stages = filter(None, map(t.getStageInfo, t.getActiveStageIds()))
        return [{"stage": s.name, "tasks": s.numTasks, "done": s.numCompletedTasks, "running": s.numActiveTasks} for s in stages]

    def within(self, seconds: float, action: Callable[[], T]) -> T:
        """The result of ``action``; its jobs are stopped, and TimeoutError is raised, after so many seconds."""
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.cancel()

        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            with self.running():
                return action()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"stopped after {seconds} s") from e
            raise
        finally:
            timer.cancel()

    def find(self, column: str, text: str, case_sensitive: bool = False, seconds: float = FIND_SECONDS) -> list[dict]:
        """Rows whose column matches, read within a time limit."""
        rows = self.rows()
        return self.within(seconds, lambda: [r.asDict() for r in rows.filter(find_predicate(rows[column], text, case_sensitive)).collect()])

    def cancel(self) -> None:
        """Stops running jobs that were started under ``running``."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)  # a session's own tags are known to one thread only

    def running(self):
        """Context in which jobs carry the catalog's tag and description."""
        context, tag = self.spark.sparkContext, self.tag

        class Tagged:
            def __enter__(self):
                context.addJobTag(tag)

            def __exit__(self, *_):
                context.removeJobTag(tag)

        return Tagged()
