"""Tables in the shared folder that cut the lineage of iterative jobs.

They are ordinary Parquet files, so a lost executor costs no state. The folder is
that of ``spark.checkpoint.dir``; only where it is unset, one of our own below the
warehouse, which a cluster shares as well.
"""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_triadic_scratch"


#: Rows of a file for which a small table is not split further.
FILE_ROWS = 100_000
#: Rows of a table from which on it is shuffled in slices, and most slices: each reads the whole table.
SLICE_ROWS, MOST_SLICES = 4_000_000, 8
#: Rows up to which a table of ids and labels is broadcast; larger ones are shuffled.
MOST_BROADCAST = 1_500_000


def broadcast_if_small(t: DataFrame) -> DataFrame:
    """t must be cheap to make: it is counted."""
    return F.broadcast(t) if t.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else t


def slices(rows: int) -> int:
    return min(MOST_SLICES, rows // SLICE_ROWS + 1)


class Scratch:
    """``table`` writes and rereads a DataFrame; ``drop`` removes it; what is left goes with the driver's Python."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def table(self, df: DataFrame, compression: str = "zstd", rows: int | None = None) -> DataFrame:
        """rows: at least as many as df has, if known and cheap to make. Then the last stage has no more tasks, and files, than so many rows need."""
        if rows is not None and (n := rows // FILE_ROWS + 1) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(n)
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def sliced(self, source: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], rows: int | None = None, most: int = MOST_SLICES) -> DataFrame:
        """make(source) as a table, made of one slice of source's values of key after the other, so that not all of it is in shuffle files at once.

        make must treat rows of different values of key apart. Together the slices are all rows.
        rows: those of source, if known; else they are counted.
        """
        k = min(most, slices(source.count() if rows is None else rows))
        if k == 1:
            return self.table(make(source))
        self._n += 1
        path = f"{self.root}/{self._n}"
        for i in range(k):
            df = make(source.where(F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(k)) == i))
            df.write.mode("append").option("compression", "zstd").parquet(path)
            self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def retain(self, *tables: DataFrame) -> None:
        """Removes all tables but these. They, or what they were selected from, must come from here."""
        keep = {p.rsplit("/", 2)[-2] for t in tables for p in t.inputFiles()}
        for n in range(1, self._n + 1):
            if str(n) not in keep:
                self._delete(f"{self.root}/{n}")

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of jobs that are over: it does when the driver's JVM collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
