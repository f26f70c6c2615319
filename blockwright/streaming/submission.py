"""Submitting in the background while the program goes on."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame

from blockwright.operators.store import BlockStore


class Submission:
    """A submit that runs in the background: poll, then wait; errors surface."""

    _pool = ThreadPoolExecutor(max_workers=4)

    def __init__(self, store: BlockStore):
        self.frame = store.replicas().persist()
        self._done: Future = self._pool.submit(self.frame.count)

    def poll(self) -> bool:
        return self._done.done()

    def wait(self) -> DataFrame:
        self._done.result()
        return self.frame
