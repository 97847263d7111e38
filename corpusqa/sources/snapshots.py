"""Snapshots by corpus that survive a lost job.

A publication writes the rows of its corpora under a run of its own, then the index (corpus, run) of
all corpora, and last a commit: one small file that names the run of the index.  Readers follow the
last commit, so they see a publication wholly or not at all; what a lost job has written is named by no
commit and goes when stale runs are swept.  Commits are numbered: of two publications at a time that
build on the same commit one fails and is done again on the other's.

    <path>/data/run=<run>/corpus=<corpus>/...    <path>/index/run=<run>/...    <path>/commits/<number>

A commit is a rename without overwriting, so the file system must have one that is atomic (local, HDFS).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another publication was committed meanwhile."""


class Store:
    """The snapshot at a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "corpus") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def commits(self) -> list[tuple[int, str]]:
        """(number, run) of all commits, in order."""
        return [(int(n), self._text(f"commits/{n}")) for n in self._names("commits") if n.isdigit()]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def index(self) -> DataFrame | None:
        """(key, run) of the last commit."""
        last = self.commits()[-1:]
        return self.spark.read.parquet(f"{self.path}/index/run={last[0][1]}") if last else None

    def read(self) -> DataFrame | None:
        """The rows of the last commit; none before the first one."""
        index = self.index()
        if index is None:
            return None
        runs = [r[0] for r in index.select("run").distinct().collect()]  # publications that still hold a corpus
        every = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/run={run}" for run in runs))
        every = every.withColumn(self.key, F.col(self.key).cast("string"))
        return every.join(index, [self.key, "run"], "left_semi").drop("run")

    def publish(self, rows: DataFrame, run: str | None = None, tries: int = 5) -> str:
        """Replace the corpora that ``rows`` have; others stay.  The same ``run`` again (after a failure) does nothing twice.

        A corpus is a text that isn't null.
        """
        run = run or uuid.uuid4().hex
        if any(r == run for _, r in self.commits()):
            return run
        self.stage(rows, run)
        for _ in range(tries):
            try:
                self.commit(run)
                return run
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} publications came in between")

    def stage(self, rows: DataFrame, run: str) -> None:
        """The first step: the rows under their run, which no commit names yet."""
        rows.withColumn(self.key, F.col(self.key).cast("string")).write.mode("overwrite").partitionBy(self.key).parquet(f"{self.path}/data/run={run}")

    def commit(self, run: str) -> None:
        """The second step: the index on top of the last commit's, and the commit."""
        number = max((n for n, _ in self.commits()), default=0) + 1
        held = [x.partition("=")[2] for x in self._names(f"data/run={run}") if x.startswith(f"{self.key}=")]
        staged = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/run={run}") if held else None
        mine = None if staged is None else staged.select(F.col(self.key).cast("string"), F.lit(run).alias("run")).distinct()
        old = self.index()
        if mine is None:
            index = old if old is not None else self.spark.createDataFrame([], f"{self.key} STRING, run STRING")
        else:
            index = mine if old is None else mine.unionByName(old.join(mine.select(self.key), self.key, "left_anti"))
        index.write.mode("overwrite").parquet(f"{self.path}/index/run={run}")
        made = f"{self.path}/commits/.{run}"
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        out = self._fs.create(self._path(made), True)
        out.writeBytes(run)
        out.close()
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            self._context.rename(self._path(made), self._path(f"{self.path}/commits/{number:012d}"), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as error:
            self._fs.delete(self._path(made), False)
            if any(n == number for n, _ in self.commits()):
                raise Conflict(self.path) from error
            raise

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete runs that the last ``keep`` commits don't hold, and older commits; returns the runs.  Not while a publication runs."""
        commits = self.commits()
        kept = commits[-keep:]
        live = {r[0] for _, run in kept for r in self.spark.read.parquet(f"{self.path}/index/run={run}").select("run").distinct().collect()}
        gone = []
        for folder, named in (("data", live), ("index", {run for _, run in kept})):
            for name in self._names(folder):
                if name.partition("=")[2] not in named:
                    self._fs.delete(self._path(f"{self.path}/{folder}/{name}"), True)
                    gone += [name.partition("=")[2]] if folder == "data" else []
        for n, _ in commits[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{n:012d}"), False)
        return gone
