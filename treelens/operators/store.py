"""The stored documents and manifest: one folder per run, folded into generations.

A run writes its tables and then a mark; until the mark is there, the run has
not happened, and the next run repeats it. `compact` folds all marked runs into
a generation: the newest manifest row and the live documents of every
directory, with the list of the runs that it covers. A generation counts once
it has its own mark, and covered runs are not read any more, so compaction may
die at any point, and may run beside readers and other runs. What is superseded
is removed by `tidy` after a time of grace.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators.changes import MANIFEST, current_manifest, newest_rows
from treelens.operators.folders import entries, exists, mark, remove

DOCUMENTS = (
    "root string, dir string, content_hash string, summary_status string, error string, "
    "section int, start string, markdown string, run_id string"
)
REJECTS = "root string, path string, read_error string, run_id string"
TABLES = {"manifest": MANIFEST, "documents": DOCUMENTS, "rejects": REJECTS}
# Tables that a generation keeps; rejects are those of a run and go with it.
FOLDED = ("manifest", "documents")
RUN = "run_id="
DONE = "_DONE"


@dataclass(frozen=True)
class State:
    """What counts at one moment: the newest generation, and the runs it does not cover."""

    generation: str | None
    runs: list[str]


@dataclass(frozen=True)
class Store:
    """Documents, manifest and rejects of all runs, below any path that Spark can write."""

    path: str

    # ---- writing ----

    def append(self, df: DataFrame, table: str, run_id: str) -> None:
        """Write a table of a run that has not happened yet."""
        df.drop("run_id").write.mode("overwrite").parquet(self._run(table, run_id))

    def commit(self, spark: SparkSession, run_id: str, manifest: DataFrame | None = None) -> None:
        """Write the manifest of a run, unless nothing changed, and let the run have happened."""
        if manifest is not None:
            self.append(manifest, "manifest", run_id)
        mark(spark, f"{self.path}/commits/{run_id}")

    # ---- reading ----

    def manifest(self, spark: SparkSession) -> DataFrame:
        """Rows of all runs since the newest generation, and the newest ones before it."""
        return self._table(spark, "manifest", self.state(spark))

    def documents(self, spark: SparkSession) -> DataFrame:
        """Latest documents of all directories that still have one."""
        state = self.state(spark)
        latest = current_manifest(self._table(spark, "manifest", state)).select("root", "dir", "run_id")
        every = self._table(spark, "documents", state)
        return every.join(latest, ["root", "dir", "run_id"], "left_semi")

    def written_by(self, spark: SparkSession, run_id: str, table: str = "documents") -> DataFrame:
        """Documents of one run, or the rows of another of its tables; what lives of them once it is folded."""
        folder = self._run(table, run_id)
        if exists(spark, folder):
            return self._read(spark, table, [folder])
        state = State(self.state(spark).generation if table in FOLDED else None, [])
        return self._table(spark, table, state).where(F.col("run_id") == run_id)

    def state(self, spark: SparkSession) -> State:
        done = self._generations(spark)
        newest = max(done, default=None)
        covered = self._covered(spark, newest)
        runs = sorted(set(entries(spark, f"{self.path}/commits")) - covered)
        return State(newest, runs)

    # ---- upkeep ----

    def compact(self, spark: SparkSession, grace: float = 86_400.0) -> str | None:
        """Fold all runs into a new generation and tidy up; returns its name, if there was anything to fold."""
        state, name = self.state(spark), None
        if state.runs:
            # Names sort by time, the clock's and not that of a run.
            name = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid4().hex[:8]
            folder = f"{self.path}/generations/{name}"
            manifest = newest_rows(self._table(spark, "manifest", state))
            manifest.write.parquet(f"{folder}/manifest")
            kept = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
            live = current_manifest(kept).select("root", "dir", "run_id")
            every = self._table(spark, "documents", state)
            every.join(live, ["root", "dir", "run_id"], "left_semi").write.parquet(f"{folder}/documents")
            # Runs of older generations whose folders are still there stay covered.
            covered = set(state.runs) | self._covered(spark, state.generation) & set(entries(spark, f"{self.path}/commits"))
            rows = spark.createDataFrame([(run,) for run in sorted(covered)], "run_id string")
            rows.coalesce(1).write.parquet(f"{folder}/covered")
            mark(spark, f"{folder}/{DONE}")
        self.tidy(spark, grace)
        return name

    def tidy(self, spark: SparkSession, grace: float = 86_400.0) -> None:
        """Remove what was superseded, or left by a run that died, more than `grace` seconds ago.

        Give more than the longest run or reader takes.
        """
        now, done = time.time(), self._generations(spark)
        settled = max((name for name, since in done.items() if now - since >= grace), default=None)
        if settled is not None:
            # Of two compactions at once the newest one counts, and may cover fewer runs.
            for run in self._covered(spark, settled) & self._covered(spark, max(done)):
                for table in TABLES:
                    remove(spark, self._run(table, run))
                remove(spark, f"{self.path}/commits/{run}")
        for name, changed in entries(spark, f"{self.path}/generations").items():
            # One without a mark may still be in the making.
            if name not in done and now - changed >= grace or name in done and settled is not None and name < settled:
                remove(spark, f"{self.path}/generations/{name}")
        happened = set(entries(spark, f"{self.path}/commits"))
        for table in TABLES:
            for name, changed in entries(spark, f"{self.path}/{table}").items():
                if name.removeprefix(RUN) not in happened and now - changed >= grace:
                    remove(spark, f"{self.path}/{table}/{name}")

    # ---- places ----

    def _run(self, table: str, run_id: str) -> str:
        return f"{self.path}/{table}/{RUN}{run_id}"

    def _generations(self, spark: SparkSession) -> dict[str, float]:
        """Finished generations and when each one was."""
        base = f"{self.path}/generations"
        marks = {name: entries(spark, f"{base}/{name}").get(DONE) for name in entries(spark, base)}
        return {name: since for name, since in marks.items() if since is not None}

    def _covered(self, spark: SparkSession, generation: str | None) -> set[str]:
        """Runs that a generation covers and whose folders were there when it was made."""
        if generation is None:
            return set()
        folder = f"{self.path}/generations/{generation}/covered"
        return {row.run_id for row in spark.read.schema("run_id string").parquet(folder).collect()}

    def _table(self, spark: SparkSession, table: str, state: State) -> DataFrame:
        folders = [self._run(table, run) for run in state.runs]
        found = self._read(spark, table, [folder for folder in folders if exists(spark, folder)])
        if state.generation is None or table not in FOLDED:
            return found
        folder = f"{self.path}/generations/{state.generation}/{table}"
        return found.unionByName(spark.read.schema(TABLES[table]).parquet(folder))

    def _read(self, spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], TABLES[table])
        base = spark.read.schema(TABLES[table]).option("basePath", f"{self.path}/{table}")
        return base.parquet(*folders)
