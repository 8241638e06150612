"""Tables that several queries share: written once to the shared folder, then read with column pruning.

The first that asks for a table builds it; others that ask meanwhile wait for it
and don't build it again. ``warm`` builds ahead. A table is known by a name and
the state of its sources, so changed sources give a new one.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lineage import checkpoint_folder


def source_state(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of a file or of the files in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))


class SharedTables:
    def __init__(self):
        self._lock = threading.Lock()
        self._building: dict[tuple, threading.Lock] = {}
        self._paths: dict[tuple, str] = {}

    def get(self, spark: SparkSession, name: str, state: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """The table, built by ``build`` if no one has yet; if that fails, the next that asks tries again."""
        key = (spark.sparkContext.applicationId, name, state)
        with self._lock:
            own = self._building.setdefault(key, threading.Lock())
        with own:
            if key not in self._paths:
                path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
                build().write.parquet(path, compression="zstd")
                self._paths[key] = path
        return spark.read.parquet(self._paths[key])

    def warm(self, spark: SparkSession, tables: dict[str, tuple[tuple, Callable[[], DataFrame]]]) -> None:
        """Builds all of these (name -> state, build) that aren't there."""
        for name, (state, build) in tables.items():
            self.get(spark, name, state, build)


SHARED = SharedTables()
