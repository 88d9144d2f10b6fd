"""Points-to sets kept up to date from a stream of changes.

Every micro-batch of changes (seq, op, src, dst) goes through the same delta operators as a batch. The state after each
batch lies in a folder of its own, named by the batch's number, and counts once its mark is written. A maintainer that
starts on a folder goes on from the last state that counts, so a new driver continues where the old one ended, and a
batch that comes again after a failure finds its number taken and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.operators.delta import State, apply_changes
from pointweave.storage import shared_path

CHANGE = "seq bigint, op string, src {kind}, dst {kind}"
_TABLES = ("edge", "seed", "pts", "nodes", "scc")
_MARK = "counts"


class Maintainer:
    """Holds the state; affected has the nodes that the last batch changed, last is that batch's number.

    folder: where states are kept, one of its own in the shared folder if None. state is where to begin if the folder
    has none yet. Of older states the last but one is kept, for whoever still reads it."""

    def __init__(self, state: State, folder: str | None = None):
        self.spark = state.edge.sparkSession
        self.folder = folder or shared_path(self.spark, "changelog")
        self.state, self.affected, self.last = state, None, -1
        numbers = self._numbers()
        if numbers:
            self._load(numbers[-1], state)

    def _path(self, *parts: object):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *map(str, parts)]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The batches whose states count, in order."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path())]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(self._path(n, _MARK)))

    def _load(self, number: int, like: State) -> None:
        read = lambda name, kind: self.spark.read.schema(kind).parquet(f"{self.folder.rstrip('/')}/{number}/{name}")
        kinds = {name: getattr(like, name).schema for name in _TABLES if getattr(like, name) is not None}
        self.state = State(**{name: read(name, kind) for name, kind in kinds.items()})
        self.affected, self.last = read("affected", like.nodes.schema), number

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        after, affected = apply_changes(self.state, batch)
        for name in _TABLES:
            if getattr(after, name) is not None:
                getattr(after, name).write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/{number}/{name}")
        affected.write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/{number}/affected")
        self._files().create(self._path(number, _MARK), True).close()
        self._load(number, after)
        for old in self._numbers()[:-2]:
            self._files().delete(self._path(old), True)

    def attach(self, changes: DataFrame, checkpoint: str, **trigger):
        """Starts the streaming query over changes, a streaming DataFrame."""
        writer = changes.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, folder: str, kind: str = "bigint", files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in folder."""
    reader = spark.readStream.schema(CHANGE.format(kind=kind))
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder)
