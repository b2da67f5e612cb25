"""Sets of tables that change in one step.

Rows are staged in folders of their own; a commit is a small file that says of each
table and partition which folder holds it. Readers go by the last commit, so a run
shows all at once when its commit is renamed into place, and a run that ends before leaves
nothing but folders that no commit names.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

PARTITION = "server_region"


class Files:
    """A folder on whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, by name; nothing if it is missing."""
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age_s(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file that appears whole; False if there is one of that name."""
        draft = self.path(f"_drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        never = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), never)  # fails if it is there
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class TableSet:
    """The tables under a folder, as of their last commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def commits(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("_commits") if n.endswith(".json") and n[:-5].isdigit()]

    def state(self, commit: int | None = None) -> dict[str, dict[str, str]]:
        """Of each table the folder of each partition, at a commit or the last one."""
        known = self.commits()
        if not known and commit is None:
            return {}
        return json.loads(self.files.text(f"_commits/{max(known) if commit is None else commit:012d}.json"))

    def read(self, table: str, commit: int | None = None) -> DataFrame | None:
        """A table's rows at a commit or the last one; None if it has none yet."""
        by_run: dict[str, list[str]] = {}
        for partition, folder in self.state(commit).get(table, {}).items():
            by_run.setdefault(folder, []).append(partition)
        found = None
        for folder, partitions in sorted(by_run.items()):
            base = f"{self.files.root}/{folder}"
            rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/{p}" for p in partitions])
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    def begin(self) -> Run:
        return Run(self)

    def sweep(self, keep: int = 1, older_s: float = 86_400) -> list[str]:
        """Delete staged folders that none of the last ``keep`` commits names, and older commits; the folders are returned.

        Younger ones than ``older_s`` stay: their run may not have come to its commit yet.
        """
        known = self.commits()
        kept = known[-keep:] if keep else []
        used = {folder for c in kept for parts in self.state(c).values() for folder in parts.values()}
        gone = []
        for table in self.files.names("data"):
            for run in self.files.names(f"data/{table}"):
                folder = f"data/{table}/{run}"
                if folder not in used and self.files.age_s(folder) >= older_s:
                    self.files.delete(folder)
                    gone.append(folder)
        for c in known[: len(known) - len(kept)]:
            self.files.delete(f"_commits/{c:012d}.json")
        return gone


class Run:
    """Rows staged for some tables, which readers see all at once when it commits."""

    def __init__(self, tables: TableSet):
        self.tables, self.id = tables, uuid.uuid4().hex
        self.staged: dict[str, dict[str, str]] = {}

    def put(self, table: str, rows: DataFrame) -> None:
        """Stage the partitions of a table that ``rows`` has; without rows none. A second put of a table replaces the first."""
        folder = f"data/{table}/{self.id}"
        rows.write.partitionBy(PARTITION).mode("overwrite").parquet(f"{self.tables.files.root}/{folder}")
        self.staged[table] = {p: folder for p in self.tables.files.names(folder) if p.startswith(f"{PARTITION}=")}

    def commit(self) -> int:
        """Make the staged partitions those of their tables, all others staying; the number of the commit.

        If another run has committed meanwhile this one goes on from its state.
        """
        while True:
            last = max(self.tables.commits(), default=0)
            state = self.tables.state(last) if last else {}
            for table, parts in self.staged.items():
                state[table] = {**state.get(table, {}), **parts}
            if self.tables.files.put_new(f"_commits/{last + 1:012d}.json", json.dumps(state, sort_keys=True)):
                return last + 1
