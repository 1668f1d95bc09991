"""Finished local files to a store: a queue with bounded concurrency and retries; a file goes away only once it is there."""

from __future__ import annotations

import os
import time
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

from lakemill.sources.storage import Storage
from lakemill.stats import counters


class FileUpload:
    """``submit`` queues a file, ``drain`` waits for all and raises the first failure. What isn't a file is skipped.

    The store's client splits large objects into parts (``fs.s3a.multipart.*``) and retries requests; the attempts here are for
    whole files.
    """

    def __init__(self, spark: SparkSession, target: str, concurrency: int = 5, attempts: int = 6, wait: float = 10.0) -> None:
        self.storage, self.target, self.attempts, self.wait = Storage(spark), target.rstrip("/"), attempts, wait
        self.pool, self.jobs = ThreadPoolExecutor(concurrency), []

    def submit(self, path: str) -> Future:
        job = self.pool.submit(self._upload, path)
        self.jobs.append(job)
        return job

    def _upload(self, path: str) -> str | None:
        if not os.path.isfile(path):
            return None
        dest = f"{self.target}/{os.path.basename(path)}"
        size = os.path.getsize(path)
        for attempt in range(self.attempts):
            try:
                with counters.timed("upload.seconds"):
                    fs, p = self.storage._at(dest)
                    fs.copyFromLocalFile(False, True, self.storage.jvm.org.apache.hadoop.fs.Path(f"file:{os.path.abspath(path)}"), p)
                    if fs.getFileStatus(p).getLen() != size:
                        raise OSError(f"{dest} has another length than {path}")
                break
            except Exception:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(self.wait)
        os.unlink(path)
        counters.add("upload.files")
        counters.add("upload.bytes", size)
        return dest

    def drain(self) -> list[str]:
        jobs, self.jobs = self.jobs, []
        return [d for j in jobs if (d := j.result()) is not None]

    def close(self) -> None:
        self.drain()
        self.pool.shutdown()
