"""Small versioned documents in shared storage: the current content of a table that many folders make up.

A version is one JSON file, written aside and renamed into place, so a reader sees a whole version or the one
before. A writer first claims the number after the version it has read; if the claim is taken, another writer
was faster, and the change is made again on what that one published.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        sc = spark.sparkContext
        self._jvm, self._conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self._conf), p

    def latest(self) -> int:
        """Number of the current version, 0 before the first."""
        fs, p = self._at()
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def read(self, version: int | None = None):
        """Content of a version (the current one by default), None before the first."""
        version = self.latest() if version is None else version
        if not version:
            return None
        fs, p = self._at(f"v{version:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, change: Callable[[object], object], tries: int = 20, wait: float = 0.5) -> int:
        """Make ``change(current content)`` the next version and return its number."""
        for _ in range(tries):
            base = self.latest()
            fs, claim = self._at(f"v{base + 1:09d}.claim")
            try:
                fs.create(claim, False).close()  # fails if it exists
            except Exception as e:
                if "exists" not in str(e).lower():
                    raise
                time.sleep(wait)
                continue
            content = change(self.read(base))
            _, aside = self._at(f"v{base + 1:09d}.writing")
            out = fs.create(aside, True)
            out.write(bytearray(json.dumps(content).encode()))
            out.close()
            _, final = self._at(f"v{base + 1:09d}.json")
            if not fs.rename(aside, final):
                raise OSError(f"version {base + 1} of {self.path} could not be published")
            return base + 1
        raise TimeoutError(f"{self.path}: the claim on version {self.latest() + 1} is held by a writer that has not published")
