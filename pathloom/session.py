"""A search session: the newest query wins, an older one's jobs are cancelled, hits come as they are found."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

from .operators.content import CONTENT_LIMIT, first_hits
from .plans.search import Corpus, plan
from .request import parse
from .sources.snapshot import SnapshotStore

#: Seconds that typing must rest before texts are searched, and between looks at the snapshot pointer.
DEBOUNCE, RELOAD_EVERY = 0.3, 1.0


class SearchSession:
    def __init__(self, spark: SparkSession, corpus: Corpus, *, now=lambda: int(time.time()), store: SnapshotStore | None = None):
        self.spark, self.corpus, self.now, self.store = spark, corpus, now, store
        self.generation = 0
        self.version = None
        self._looked = float("-inf")
        self._lock = threading.Lock()

    def _tag(self, generation: int) -> str:
        return f"pathloom-{id(self)}-{generation}"

    def supersede(self) -> int:
        """Makes all queries so far stale and cancels their jobs, planning ones too."""
        with self._lock:
            self.spark.sparkContext.cancelJobsWithTag(self._tag(self.generation))
            self.generation += 1
            return self.generation

    @contextmanager
    def _tagged(self, generation: int) -> Iterator[None]:
        sc = self.spark.sparkContext
        sc.addJobTag(self._tag(generation))
        try:
            yield
        finally:
            sc.removeJobTag(self._tag(generation))

    def search(self, text: str, *, regex: bool = False) -> DataFrame:
        """Plans a query; jobs of the query before it are cancelled."""
        own = self.supersede()
        with self._tagged(own):
            self.reload()
            return plan(self.spark, self.corpus, parse(text, self.now(), regex=regex))

    def reload(self) -> None:
        """Takes up the snapshot in force, if it changed; looks once a second at most."""
        if self.store is None or time.monotonic() - self._looked < RELOAD_EVERY:
            return
        self._looked = time.monotonic()
        manifest = self.store.current()
        if manifest and manifest["version"] != self.version:
            self.version, self.corpus.files = manifest["version"], self.store.load()

    def rows(self, found: DataFrame) -> Iterator[Row]:
        """Rows as they are found, until a newer query makes this one stale."""
        own = self.generation
        with self._tagged(own):
            for row in found.toLocalIterator():
                if own != self.generation:
                    return
                yield row

    def hits(self, text: str, *, regex: bool = False) -> Iterator[Row]:
        """The rows of a query; hits in texts come stretch by stretch, and no further stretch is read once a newer query is there."""
        request = parse(text, self.now(), regex=regex)
        if request.mode != "content" or not request.pattern:
            yield from self.rows(self.search(text, regex=regex))
            return
        own = self.supersede()
        with self._tagged(own):
            self.reload()
            for piece in first_hits(self.corpus.texts, request.pattern, request.filters, limit=CONTENT_LIMIT, max_bytes=self.corpus.max_bytes):
                for row in piece.rows.orderBy("place").drop("place").collect():  # at most CONTENT_LIMIT of them
                    if own != self.generation:
                        return
                    yield row
                if own != self.generation:
                    return


class LiveSearch:
    """Typing turned into searches: the newest text only, line search after a rest.

    ``show(text, rows)`` gets the rows of a query in growing batches, ``fail(text, error)`` what
    went wrong with it; neither is called for a query that a newer one has overtaken.
    """

    def __init__(self, session: SearchSession, show: Callable[[str, list[Row]], None], fail: Callable[[str, Exception], None], *, batch: int = 100):
        self.session, self.show, self.fail, self.batch = session, show, fail, batch
        self.started: list[str] = []
        self._typed: tuple[str, float] | None = None
        self._closed = False
        self._ready = threading.Condition()
        self._thread = threading.Thread(target=inheritable_thread_target(session.spark)(self._run), daemon=True)
        self._thread.start()

    def submit(self, text: str) -> None:
        """The query as it is now; what runs for an older one is cancelled at once."""
        with self._ready:
            self._typed = (text, time.monotonic())
            self.session.supersede()
            self._ready.notify()

    def close(self) -> None:
        with self._ready:
            self._closed = True
            self.session.supersede()
            self._ready.notify()
        self._thread.join()

    def _next(self) -> str | None:
        with self._ready:
            while not self._closed:
                if self._typed is None:
                    self._ready.wait()
                    continue
                text, at = self._typed
                left = DEBOUNCE - (time.monotonic() - at) if text.startswith(">") else 0
                if left <= 0:
                    self._typed = None
                    return text
                self._ready.wait(left)
            return None

    def _overtaken(self) -> bool:
        with self._ready:
            return self._closed or self._typed is not None

    def _run(self) -> None:
        while (text := self._next()) is not None:
            self.started.append(text)
            held: list[Row] = []
            try:
                for row in self.session.hits(text):
                    held.append(row)
                    if len(held) % self.batch == 0 and not self._overtaken():
                        self.show(text, held)
            except Exception as e:  # noqa: BLE001  cancelled jobs and bad patterns alike
                if not self._overtaken():
                    self.fail(text, e)
                continue
            if not self._overtaken():
                self.show(text, held)
