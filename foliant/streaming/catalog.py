"""The list of ingested documents, kept by path bucket (ST3).

Every batch adds its documents as a delta.  After some batches the deltas are merged into the
base, whose files lie by bucket, a hash of session and path: only the buckets that
the deltas touch are rewritten, into folders of a new epoch, and a commit then names the
epoch that holds for each bucket and the batches that are in it.  A batch looks up
its own buckets only, and the number of files stays bounded however many batches came.

A commit counts once its last table is complete, so a merge that broke off is as if it had
not begun.  Folders that a commit has left behind are removed by the next one, so that
readers which still use them can finish.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import IngestConfig
from foliant.operators.corpus import DOCUMENT
from foliant.runtime import names_below, remove

_ENTRY = (
    "source_file string, session string, modified timestamp, n_chunks bigint, "
    "n_embedded bigint, n_tokens bigint"
)
_DELTA = f"{_ENTRY}, bucket int, run string, batch_id bigint"
_BASE = f"{_ENTRY}, run string, batch_id bigint, bucket int, epoch bigint"
_BATCHES = "run string, batch_id bigint"


class DocumentCatalog:
    """The documents below a folder; ``config.path_buckets`` is fixed by the first use."""

    def __init__(self, spark: SparkSession, root: str, config: IngestConfig = IngestConfig()) -> None:
        self.spark, self.config = spark, config
        name = f"of-{config.path_buckets}"
        other = [n for n in names_below(spark, f"{root}/documents") if n.startswith("of-") and n != name]
        if other:
            raise ValueError(f"documents are kept in other buckets: {other[0]}")
        self.path = f"{root}/documents/{name}"

    # -- reading ---------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*DOCUMENT), F.lit(self.config.path_buckets)).cast("int")

    def buckets_of(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents, at most ``path_buckets`` numbers."""
        return [r[0] for r in documents.select(self.bucket()).distinct().collect()]

    def _epoch(self) -> int:
        """The last complete commit; 0 before the first."""
        epochs = [int(n.removeprefix("epoch=")) for n in names_below(self.spark, f"{self.path}/commits")]
        for epoch in sorted(epochs, reverse=True):
            if "_SUCCESS" in names_below(self.spark, f"{self.path}/commits/epoch={epoch}/batches"):
                return epoch
        return 0

    def _manifest(self, epoch: int) -> dict[int, int]:
        """The epoch that holds for each bucket."""
        if not epoch:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/commits/epoch={epoch}/buckets").collect()
        return {r.bucket: r.at for r in rows}

    def _merged(self, epoch: int) -> DataFrame:
        """The batches that a commit holds."""
        if not epoch:
            return self.spark.createDataFrame([], _BATCHES)
        return self.spark.read.schema(_BATCHES).parquet(f"{self.path}/commits/epoch={epoch}/batches")

    def has_merged(self, run: str, batch_id: int) -> bool:
        own = (F.col("run") == run) & (F.col("batch_id") == batch_id)
        return not self._merged(self._epoch()).filter(own).isEmpty()

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """Listed versions of the documents, of some buckets or all; some may come twice."""
        manifest = self._manifest(self._epoch())
        wanted = [f"{b}/{at}" for b, at in manifest.items() if buckets is None or b in buckets]
        columns = [c.split()[0] for c in _DELTA.split(", ")]
        found = None
        if wanted:  # by partition columns only: no other folder is read
            base = self.spark.read.schema(_BASE).parquet(f"{self.path}/base")
            found = base.filter(F.concat_ws("/", "bucket", "epoch").isin(wanted)).select(*columns)
        if names_below(self.spark, f"{self.path}/delta"):
            deltas = self.spark.read.schema(_DELTA).parquet(f"{self.path}/delta")
            if buckets is not None:
                deltas = deltas.filter(F.col("bucket").isin(buckets))
            deltas = deltas.select(*columns)
            found = deltas if found is None else found.unionByName(deltas)
        return self.spark.createDataFrame([], _DELTA) if found is None else found

    def documents(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version of each document."""
        return newest(self.entries(buckets))

    # -- writing ---------------------------------------------------------------

    def add(self, listed: DataFrame, run: str, batch_id: int) -> None:
        """Write the documents of a batch in place of what it wrote before."""
        rows = listed.withColumn("bucket", self.bucket()).withColumns({
            "run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
        columns = [c.split()[0] for c in _DELTA.split(", ")]
        rows.select(*columns).hint("rebalance").write.mode("overwrite").partitionBy(
            "run", "batch_id").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/delta")

    def _deltas(self) -> list[tuple[str, int]]:
        return [
            (unquote(run.removeprefix("run=")), int(batch.removeprefix("batch_id=")))
            for run in names_below(self.spark, f"{self.path}/delta") if run.startswith("run=")
            for batch in names_below(self.spark, f"{self.path}/delta/{run}")
            if batch.startswith("batch_id=")
        ]

    def compact(self, run: str, batch_id: int) -> bool:
        """Merge the deltas if there are enough; that of the given batch, which may run again, stays out."""
        epoch = self._epoch()
        deltas = [d for d in self._deltas() if d != (run, batch_id)]
        if len(deltas) < self.config.compact_every:
            return False
        merged = self._merged(epoch)
        known = self.spark.createDataFrame(deltas, _BATCHES)
        fresh = known.join(merged, ["run", "batch_id"], "left_anti")
        open_deltas = {tuple(r) for r in fresh.collect()}  # no more than there are folders
        if len(open_deltas) < self.config.compact_every:
            return False
        own = (F.col("run") == run) & (F.col("batch_id") == batch_id)
        rows = self.spark.read.schema(_DELTA).parquet(f"{self.path}/delta").join(
            fresh, ["run", "batch_id"], "left_semi")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        old, following = self._manifest(epoch), epoch + 1
        new = {**old, **{b: following for b in touched}}
        newest(self.entries(touched).filter(~own)).withColumn("epoch", F.lit(following)).repartition(
            "bucket").write.mode("overwrite").partitionBy("bucket", "epoch").option(
            "partitionOverwriteMode", "dynamic").parquet(f"{self.path}/base")
        commit = f"{self.path}/commits/epoch={following}"
        self.spark.createDataFrame(list(new.items()), "bucket int, at bigint").coalesce(1).write.mode(
            "overwrite").parquet(f"{commit}/buckets")
        merged.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{commit}/batches")
        self._clean(epoch, old, new, open_deltas, (run, batch_id))
        return True

    def _clean(self, epoch: int, old: dict, new: dict, fresh: set, own: tuple) -> None:
        """Remove what the commit before the last one left behind."""
        for name in names_below(self.spark, f"{self.path}/commits"):
            if int(name.removeprefix("epoch=")) < epoch:
                remove(self.spark, f"{self.path}/commits/{name}")
        for folder in names_below(self.spark, f"{self.path}/base"):
            if folder.startswith("bucket="):
                bucket = int(folder.removeprefix("bucket="))
                for at in names_below(self.spark, f"{self.path}/base/{folder}"):
                    if int(at.removeprefix("epoch=")) not in (old.get(bucket), new.get(bucket)):
                        remove(self.spark, f"{self.path}/base/{folder}/{at}")
        for run in names_below(self.spark, f"{self.path}/delta"):
            for batch in names_below(self.spark, f"{self.path}/delta/{run}"):
                if run.startswith("run=") and batch.startswith("batch_id="):
                    delta = (unquote(run.removeprefix("run=")), int(batch.removeprefix("batch_id=")))
                    if delta not in fresh and delta != own:
                        remove(self.spark, f"{self.path}/delta/{run}/{batch}")


def newest(entries: DataFrame) -> DataFrame:
    """The version of each document with the last modification time."""
    order = F.struct("modified", "run", "batch_id")  # nulls come first
    return entries.groupBy(*DOCUMENT).agg(
        F.max_by(F.struct(*entries.columns), order).alias("_newest")).select("_newest.*")
