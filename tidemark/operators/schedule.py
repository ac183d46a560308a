"""Crawl tasks: a registry on the driver that runs what is due over DataFrames."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import unseen
from tidemark.session import ranked


@dataclass
class Task:
    id: int
    name: str
    urls: list[str]
    interval: float = 3600.0
    priority: int = 5
    status: str = "pending"
    last_run: float = 0.0
    runs: int = 0
    errors: list[str] = field(default_factory=list)


class Scheduler:
    """Tasks in order of priority, then of their adding. ``clock`` and ``sleep`` are injected."""

    def __init__(self, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.tasks: dict[int, Task] = {}
        self.clock, self.sleep, self.running = clock, sleep, False

    def add(self, name: str, urls: list[str], interval: float = 3600.0, priority: int = 5) -> int:
        number = max(self.tasks, default=0) + 1
        self.tasks[number] = Task(number, name, list(urls), interval, max(1, min(10, priority)))
        return number

    def remove(self, number: int) -> bool:
        return self.tasks.pop(number, None) is not None

    def order(self) -> list[Task]:
        return sorted(self.tasks.values(), key=lambda t: (t.priority, t.id))

    def due(self) -> list[Task]:
        return [t for t in self.order() if not t.last_run or self.clock() - t.last_run >= t.interval]

    def run_once(self, spark, crawl: Callable[[DataFrame], DataFrame], history: DataFrame | None = None, callback: Callable[[Task, DataFrame], None] | None = None) -> int:
        """Every due task over its URLs that are new; a task that fails keeps its error and the others run."""
        ran = 0
        for task in self.due():
            task.status = "running"
            try:
                urls = spark.createDataFrame([(u,) for u in task.urls], "url string")
                out = crawl(unseen(urls, history, "url") if history is not None else urls)
                if callback:
                    callback(task, out)
                task.status = "done"
            except Exception as e:
                task.status = "failed"
                task.errors.append(str(e))
            task.last_run, task.runs = self.clock(), task.runs + 1
            ran += 1
        return ran

    def run(self, spark, crawl: Callable[[DataFrame], DataFrame], rounds: int = 0, poll: float = 60.0, **kw) -> None:
        """Until stopped, or for so many rounds."""
        self.running, done = True, 0
        while self.running:
            self.run_once(spark, crawl, **kw)
            done += 1
            if rounds and done >= rounds:
                break
            waits = [t.interval - (self.clock() - t.last_run) for t in self.tasks.values()]
            self.sleep(max(0.0, min([poll, *waits])))

    def stop(self) -> None:
        self.running = False

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps([asdict(t) for t in self.order()], ensure_ascii=False), encoding="utf-8")

    def load(self, path: str) -> None:
        """A file that can't be read leaves no tasks."""
        try:
            self.tasks = {t["id"]: Task(**t) for t in json.loads(Path(path).read_text(encoding="utf-8"))}
        except (OSError, ValueError, TypeError, KeyError):
            self.tasks = {}


def task_places(tasks: DataFrame, priority: str = "priority", key: str = "id") -> DataFrame:
    """``tasks`` with ``place`` (1, 2, ...) in the order of ``Scheduler.order``: every row, in no single task."""
    return ranked(tasks, [F.col(priority), F.col(key)]).withColumn("place", (F.col("rank") + 1).cast("int")).drop("rank")
