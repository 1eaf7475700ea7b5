"""Tables laid out for look-ups and small loads: in buckets by the hash of a key, sorted, in one or more copies.

A copy is what an index is elsewhere: some columns of the rows, maybe of some rows only, in buckets by its own key. A look-up reads one
bucket, and of it what the sorting, the column statistics and Bloom filters leave. A load rewrites the buckets that it touches
and leaves all others where they are; a version says which folder has each bucket, so older versions stay whole.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.schemas import ROWS, has_twins
from cinegraph.sources import files

BUCKETS = 64
MAIN = "main"
#: A task that writes has fewer rows than these only if a bucket has.
LEAST = ROWS // 10


class DuplicateKeys(ValueError):
    pass


@dataclass(frozen=True)
class Copy:
    """The columns (None: all; expressions, too) of the rows that a condition holds for, in buckets by the columns of by, sorted by order.

    each: a column more and the expression of the array whose items it has, a row for each; then columns must be named.
    """

    by: list[str]
    order: list[str]
    columns: list[str] | None = None
    where: str | None = None
    each: tuple[str, str] | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        rows = rows.where(self.where) if self.where else rows
        if self.each:
            return rows.select(F.explode(F.expr(self.each[1])).alias(self.each[0]), *map(F.expr, self.columns))
        return rows.selectExpr(*self.columns) if self.columns else rows

    def size(self, rows: DataFrame) -> int:
        """How many rows of() gives."""
        rows = rows.where(self.where) if self.where else rows
        # An explode leaves out nulls and empty arrays, whose size is -1 and 0.
        return rows.agg(F.sum(F.greatest(F.size(F.expr(self.each[1])), F.lit(0)).cast("long"))).first()[0] or 0 if self.each else rows.count()


def bucket_of(columns: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Layout:
    """A table below root: its schema, its key, its copies besides the whole rows, and into how many buckets they go."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: list[str]
    by: list[str]
    others: dict[str, Copy] = field(default_factory=dict)
    buckets: int = BUCKETS

    def copies(self) -> dict[str, Copy]:
        return {MAIN: Copy(self.by, [*self.by, *(k for k in self.keys if k not in self.by)]), **self.others}

    def _columns(self, copy: Copy) -> T.StructType:
        return copy.of(self.spark.createDataFrame([], self.schema)).schema

    def read(self, version: dict, name: str = MAIN, only: set[int] | None = None) -> DataFrame:
        """A copy as a version has it; of some buckets only, if these are named."""
        copy = self.copies()[name]
        places = [f"{self.root}/{name}/{folder}/_bucket={b}" for b, folder in sorted(version.get(name, {}).items()) if only is None or int(b) in only]
        schema = self._columns(copy)
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def lookup(self, version: dict, values: list[tuple], name: str = MAIN) -> DataFrame:
        """The rows of a copy whose key in by is one of values: only the buckets of these are read."""
        copy = self.copies()[name]
        schema = self._columns(copy)
        kinds = [schema[c].dataType for c in copy.by]
        literal = [[F.lit(x).cast(t) for x, t in zip(v, kinds, strict=True)] for v in values]
        if not values:
            return self.read(version, name, set())
        found = self.spark.sql("select 1").select(F.array(*(bucket_of(v, self.buckets) for v in literal))).first()[0]
        same = F.lit(False)
        for v in literal:
            here = F.lit(True)
            for c, x in zip(copy.by, v, strict=True):
                here = here & (F.col(c) == x)
            same = same | here
        return self.read(version, name, set(found)).where(same)

    def _write(self, rows: DataFrame, size: int, name: str, copy: Copy) -> dict[str, str]:
        """Writes rows, size or fewer, to a folder of their own; (bucket, folder) of the buckets that have rows.

        A bucket of many rows is cut by a hash of what it is sorted by, into files that are sorted each, so no task sorts it whole.
        Small buckets share a task.
        """
        folder = uuid.uuid4().hex
        path = f"{self.root}/{name}/{folder}"
        bucketed = rows.withColumn("_bucket", bucket_of([F.col(c) for c in copy.by], self.buckets))
        slices = 1 + size // (self.buckets * ROWS)
        tasks = min(self.buckets * slices, 1 + size // LEAST)
        piece = F.col("_bucket") * slices + F.pmod(F.xxhash64(F.lit("slice"), *map(F.col, copy.order)), F.lit(slices))
        dealt = bucketed.repartitionById(tasks, F.floor(piece * tasks / (self.buckets * slices)).cast("int"))
        writer = dealt.sortWithinPartitions("_bucket", *copy.order).write.partitionBy("_bucket").option("compression", "zstd")
        for c in copy.by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        return {n.removeprefix("_bucket="): folder for n in files.names(self.spark, path) if n.startswith("_bucket=")}

    def upserted(self, version: dict, stage: DataFrame) -> dict:
        """A version with the rows of stage in place of those of equal keys; rows that stage lacks stay.

        Only buckets that have a row of stage, or had one before, are read and written. Raises DuplicateKeys if stage has a
        key twice: two rows cannot both take the place of one. stage is read several times, so it should be a table.
        """
        if has_twins(stage, self.keys):
            raise DuplicateKeys(f"rows of one load share {', '.join(self.keys)}")
        stage = stage.select(*self.schema.names)
        keys = stage.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
        same = None
        for k in self.keys:
            one = F.col(k).eqNullSafe(F.col(f"_{k}"))
            same = one if same is None else same & one
        touched = lambda rows, copy: {r[0] for r in rows.select(bucket_of([F.col(c) for c in copy.by], self.buckets)).distinct().collect()}
        copies = self.copies()
        if not version.get(MAIN):
            return {name: self._write(copy.of(stage), copy.size(stage), name, copy) for name, copy in copies.items()}
        first, new = touched(stage, copies[MAIN]), {}
        # The keys are held and the rows pass by: neither side is sorted.
        keys = keys.hint("shuffle_hash")
        replaced = self.read(version, MAIN, first).join(keys, same, "left_semi")
        for name, copy in copies.items():
            now = version.get(name, {})
            # A row that changes may have been in another bucket of this copy.
            buckets = first if name == MAIN else touched(copy.of(stage).select(*copy.by).unionByName(copy.of(replaced).select(*copy.by)), copy)
            before = self.read(version, name, buckets)
            rest = before.join(keys, same, "left_anti")
            written = self._write(rest.unionByName(copy.of(stage)), before.count() + copy.size(stage), name, copy)
            new[name] = {b: f for b, f in now.items() if int(b) not in buckets} | written
        return new

    def vacuum(self, versions: list[dict]) -> list[str]:
        """Deletes the buckets' folders that none of the versions refers to, and says which."""
        gone = []
        for name in self.copies():
            used = {f"{folder}/_bucket={b}" for v in versions for b, folder in v.get(name, {}).items()}
            for folder in files.names(self.spark, f"{self.root}/{name}"):
                there = [f"{folder}/{b}" for b in files.names(self.spark, f"{self.root}/{name}/{folder}") if b.startswith("_bucket=")]
                old = [b for b in there if b not in used]
                for b in old if len(old) < len(there) else [folder]:
                    files.delete(self.spark, f"{self.root}/{name}/{b}")
                gone += [f"{name}/{b}" for b in old]
        return gone


class View:
    """A laid-out table as one version has it."""

    def __init__(self, layout: Layout, version: dict) -> None:
        self.layout, self.version = layout, version

    def read(self, name: str = MAIN) -> DataFrame:
        return self.layout.read(self.version, name)

    def lookup(self, values: list[tuple], name: str = MAIN) -> DataFrame:
        return self.layout.lookup(self.version, values, name)

    def among(self, keys: DataFrame, name: str = MAIN, most: int = 1000) -> DataFrame:
        """The rows of a copy whose first column of by is in a table of one column: up to most keys are looked up, more are joined."""
        column = self.layout.copies()[name].by[0]
        keys = keys.toDF(column).where(F.col(column).isNotNull()).distinct()
        few = keys.limit(most + 1).collect()
        return self.lookup([tuple(r) for r in few], name) if len(few) <= most else self.read(name).join(keys, column, "left_semi")

    def since(self, before: dict, name: str = MAIN) -> DataFrame:
        """The rows of a copy that an earlier version does not have: only buckets that have changed are read."""
        now, was = self.version.get(name, {}), before.get(name, {})
        changed = {int(b) for b, folder in now.items() if was.get(b) != folder}
        return self.layout.read(self.version, name, changed).exceptAll(self.layout.read(before, name, changed))


class Log:
    """Numbered versions below a folder, each a small file that whoever creates it first has written.

    A writer makes the version after the one that it read; if another was faster, it reads that and does its work again. The file system's
    create must be exclusive, as that of HDFS is; the local one checks first and then creates.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, self.folder) if n.endswith(".json")]

    def read(self, number: int) -> dict:
        """A version; a file that another writer is just writing is waited for."""
        for _ in range(50):
            try:
                return json.loads(files.get(self.spark, f"{self.folder}/{number:020d}.json"))
            except ValueError:
                time.sleep(0.2)
        raise ValueError(f"version {number} in {self.folder} was not written to its end")

    def latest(self) -> tuple[int, dict]:
        """(number, version) of the last version; 0 and none before the first."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, number: int, version: dict) -> bool:
        """Whether the version got this number; if not, another writer's has it."""
        return files.put(self.spark, f"{self.folder}/{number:020d}.json", json.dumps(version))


class Table:
    """One laid-out table with a log of its own. It keeps to the number of buckets that it was begun with."""

    def __init__(self, layout: Layout) -> None:
        self.log = Log(layout.spark, f"{layout.root}/_versions")
        self.layout = replace(layout, buckets=self.log.latest()[1].get("buckets", layout.buckets))

    def upsert(self, stage: DataFrame, batch: int | None = None) -> bool:
        """Adds a version; False, and nothing done, if that of this or a later batch is there. Batches are numbered by the caller."""
        while True:
            number, now = self.log.latest()
            if batch is not None and now.get("batch", -1) >= batch:
                return False
            new = {"copies": self.layout.upserted(now.get("copies", {}), stage), "batch": now.get("batch", -1) if batch is None else batch, "buckets": self.layout.buckets}
            if self.log.commit(number + 1, new):
                return True

    def view(self, number: int | None = None) -> View:
        version = self.log.latest()[1] if number is None else self.log.read(number)
        return View(self.layout, version.get("copies", {}))

    def read(self, name: str = MAIN, number: int | None = None) -> DataFrame:
        return self.view(number).read(name)

    def lookup(self, values: list[tuple], name: str = MAIN) -> DataFrame:
        return self.view().lookup(values, name)
