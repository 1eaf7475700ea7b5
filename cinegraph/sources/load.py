"""Loading and refreshing base tables, gated by the hash of the file they come from."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.operators.search import POSTINGS
from cinegraph.schemas import KEYS, LOAD_STATE, PARENTS, TABLES, duplicate_keys, parts_of
from cinegraph.sources import files
from cinegraph.sources.layout import BUCKETS, MAIN, Copy, DuplicateKeys, Layout, Log, View
from cinegraph.sources.tsv import read_tsv

#: The file that says that all tables were loaded once.
MARK = ".loaded"
ACTORS = "category in ('actor', 'actress')"
#: Besides its key, how a table can be looked up. The columns of these, and which rows are in the partial ones.
COPIES = {
    "title_basics": {"postings": POSTINGS},
    "name_basics": {"by_name": Copy(["primaryName"], ["primaryName", "nconst"], ["nconst", "primaryName", "birthYear", "knownForTitles"])},
    "title_principals": {
        "by_person": Copy(["nconst"], ["nconst", "tconst"]),
        "actors_by_person": Copy(["nconst"], ["nconst", "tconst"], ["tconst", "ordering", "nconst"], ACTORS),
        "actors_by_title": Copy(["tconst"], ["tconst", "nconst"], ["tconst", "ordering", "nconst"], ACTORS),
    },
}
#: What becomes of rows without a parent or with a null key: the load fails, or they are set aside and the rest is loaded.
REFUSE, ASIDE = "refuse", "aside"
#: Up to so many parents are sent to all workers, and their children stay where they are.
FEW = 250_000


class MissingParents(ValueError):
    pass


def upsert(base: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of stage in place of those of equal keys; rows that stage lacks stay.

    Raises DuplicateKeys if stage has a key twice: two rows cannot both take the place of one.
    """
    if not duplicate_keys(stage, keys).isEmpty():
        raise DuplicateKeys(f"rows of one load share {', '.join(keys)}")
    return base.join(stage.select(*keys), keys, "left_anti").select(*base.columns).unionByName(stage.select(*base.columns))


def sha256_of(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file's bytes, read as a stream, whatever its size; of a folder, that of its files' by name."""
    fs, p = files.at(spark, path)
    if fs.getFileStatus(p).isDirectory():
        inside = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isFile())
        return hashlib.sha256("".join(sha256_of(spark, f"{path}/{f}") for f in inside if f[0] not in "._").encode()).hexdigest()
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def changed_at(spark: SparkSession, path: str) -> dt.datetime:
    """When a file was last written, which for a download is when it was made, in UTC."""
    fs, p = files.at(spark, path)
    return dt.datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() / 1000, dt.timezone.utc)


def utc_text(at: dt.datetime) -> str:
    """A time in ISO form, in UTC."""
    return at.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def version(spark: SparkSession) -> str:
    """What the engine calls itself; that it answers says that it is alive."""
    return spark.sql("select version()").first()[0]


def judged(stage: DataFrame, keys: list[str], parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """stage with a column _wrong: why a row must not be loaded (a null key, or the first parent it lacks), else null.

    parents has (table, column of stage, column of the table). A null reference lacks nothing. One left join a parent:
    a task holds its share of the parents, in as many parts as they and their children need, and children pass by unsorted.
    """
    wrong = None
    for k in keys:
        here = F.when(F.col(k).isNull(), F.lit(f"null {k}"))
        wrong = here if wrong is None else F.coalesce(wrong, here)
    out, rows = stage.withColumn("_wrong", wrong), stage.count() if parents else 0
    for table, column, of in parents:
        known, size = table.select(F.col(of).alias("_of"), F.when(F.col(of).isNull(), 1).otherwise(0).alias("_to")), table.count()
        if size <= FEW:
            known = known.distinct().hint("broadcast")
        else:
            parts = parts_of(max(rows, size))
            known = known.repartition(parts, "_to", "_of").distinct().hint("shuffle_hash")
        # Null references match nothing and would all go to one task, so each goes where its keys say.
        out = out.withColumn("_at", F.when(F.col(column).isNull(), F.hash(*keys)).otherwise(0))
        out = out if size <= FEW else out.repartition(parts, "_at", column)
        joined = out.join(known.withColumn("_there", F.lit(True)), (F.col("_at") == F.col("_to")) & (F.col(column) == F.col("_of")), "left")
        lacks = F.when(F.col(column).isNotNull() & F.col("_there").isNull(), F.lit(f"no parent of {column}"))
        out = joined.withColumn("_wrong", F.coalesce("_wrong", lacks)).drop("_of", "_there", "_at", "_to")
    return out


def faultless(stage: DataFrame, keys: list[str], parents: list[tuple[DataFrame, str, str]]) -> bool:
    """Whether judged() finds nothing wrong. Each reference is held against its parent alone, so whole rows stay where they are."""
    if not stage.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        return False
    return all(judged(stage.select(p[1]), [p[1]], [p]).where(F.col(p[1]).isNotNull() & F.col("_wrong").isNotNull()).isEmpty() for p in parents)


class Store:
    """Base tables and load state below one folder.

    A version of the store names the folder of each bucket of each copy of each table, and the load state; one small file, made
    by one writer only, is the moment at which a load is there, whole. Readers keep to the version that they began with.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/_versions")
        # A store keeps to the number of buckets that it was begun with.
        self.buckets = buckets = self._now().get("buckets", buckets)
        self.layouts = {t: Layout(spark, f"{self.root}/{t}", T.StructType.fromDDL(TABLES[t]), KEYS[t], KEYS[t][:1], COPIES.get(t, {}), buckets) for t in TABLES}

    def _now(self) -> dict:
        return self.log.latest()[1]

    def state(self) -> DataFrame:
        """The load state: a row for each table that was loaded."""
        rows = [(t, s["source_url"], s["local_file"], s["sha256"], *(dt.datetime.fromtimestamp(s[x], dt.timezone.utc) for x in ("downloaded_at", "imported_at"))) for t, s in self._now().get("state", {}).items()]
        return self.spark.createDataFrame(rows, LOAD_STATE)

    def current(self, table: str) -> str | None:
        """The hash of the latest load of a table."""
        return self._now().get("state", {}).get(table, {}).get("sha256")

    def view(self, table: str, number: int | None = None) -> View:
        """A table as the latest version has it, or one of the others."""
        now = self._now() if number is None else self.log.read(number)
        return View(self.layouts[table], now.get("tables", {}).get(table, {}))

    def read(self, table: str, copy: str = MAIN, number: int | None = None) -> DataFrame:
        return self.view(table, number).read(copy)

    def lookup(self, table: str, values: list, copy: str = MAIN) -> DataFrame:
        """The rows whose key (the first column of it, or that of the copy) is one of values."""
        return self.view(table).lookup([(v,) for v in values], copy)

    def rejected(self, table: str) -> DataFrame:
        """The rows that the latest load of a table set aside, with the reason in _wrong."""
        path = self._now().get("state", {}).get(table, {}).get("rejected")
        schema = T.StructType([*self.layouts[table].schema, T.StructField("_wrong", T.StringType())])
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def _staged(self, table: str, path: str) -> str:
        """The staging table of a dump: read once, for all that a load asks of it."""
        staged = f"{self.root}/_stage/{uuid.uuid4().hex}"
        read_tsv(self.spark, path, table).write.parquet(staged, compression="zstd")
        return staged

    def load(self, table: str, path: str, url: str = "", orphans: str = REFUSE) -> bool:
        """Loads a dump; False if its hash is that of the last load.

        Rows are held against their parents as the version has them that they are to follow. If another loader makes the next
        version first, all this is done again after it.
        """
        if orphans not in (REFUSE, ASIDE):
            raise ValueError(f"no such way: {orphans}")
        digest, staged = sha256_of(self.spark, path), None
        try:
            while True:
                number, now = self.log.latest()
                if now.get("buckets", self.buckets) != self.buckets:
                    raise ValueError(f"another loader began this store with {now['buckets']} buckets, not {self.buckets}")
                if now.get("state", {}).get(table, {}).get("sha256") == digest:
                    return False
                staged = staged or self._staged(table, path)
                new = self._followed(now, table, self.spark.read.schema(TABLES[table]).parquet(staged), orphans)
                new["state"][table] |= {"source_url": url, "local_file": path, "sha256": digest, "downloaded_at": changed_at(self.spark, path).timestamp(), "imported_at": dt.datetime.now(dt.timezone.utc).timestamp()}
                if self.log.commit(number + 1, new):
                    return True
        finally:
            if staged:
                files.delete(self.spark, staged)

    def _followed(self, now: dict, table: str, stage: DataFrame, orphans: str) -> dict:
        """The version after now, with the rows of stage upserted, as far as it can be told before it is numbered."""
        tables, state, layout = dict(now.get("tables", {})), dict(now.get("state", {})), self.layouts[table]
        parents = [(self.layouts[p].read(tables.get(p, {})), c, k) for c, p, k in PARENTS.get(table, [])]
        state[table], good = {"rejected": None}, None
        try:
            if not faultless(stage, layout.keys, parents):
                told = judged(stage, layout.keys, parents)
                if orphans == REFUSE:
                    reasons = told.where("_wrong is not null").groupBy("_wrong").count().orderBy("_wrong").collect()
                    raise MissingParents(f"{table}: " + ", ".join(f"{r['count']} with {r['_wrong']}" for r in reasons))
                # Judged once and written, for every copy asks for the rows again.
                good, aside = f"{self.root}/_stage/{uuid.uuid4().hex}", f"{self.root}/{table}/_rejected/{uuid.uuid4().hex}"
                told.write.parquet(good, compression="zstd")
                told = self.spark.read.schema(told.schema).parquet(good)
                told.where("_wrong is not null").write.parquet(aside, compression="zstd")
                state[table] = {"rejected": aside}
                stage = told.where("_wrong is null").drop("_wrong")
            tables[table] = layout.upserted(tables.get(table, {}), stage)
        finally:
            if good:
                files.delete(self.spark, good)
        return {"tables": tables, "state": state, "buckets": self.buckets}

    def load_all(self, folder: str, mode: str = "update", minimal: bool = False, orphans: str = REFUSE) -> dict[str, bool]:
        """Loads every table in an order that has parents first; mode init leaves a mark with the time.

        Mode init does nothing if the mark is there, and tables and load state are, too: a mark alone counts for nothing.
        """
        if mode not in ("init", "update"):
            raise ValueError(f"no such mode: {mode}")
        if mode == "init" and self.marked() and all(self.current(t) for t in TABLES) and all(not self.read(t).isEmpty() for t in TABLES):
            return dict.fromkeys(TABLES, False)
        end = ".minimal.tsv.gz" if minimal else ".tsv.gz"
        order = ("name_basics", "title_basics", "title_ratings", "title_crew", "title_principals")
        done = {t: self.load(t, f"{folder}/{t.replace('_', '.')}{end}", orphans=orphans) for t in order}
        if mode == "init":
            files.put(self.spark, f"{self.root}/{MARK}", utc_text(dt.datetime.now(dt.timezone.utc)) + "\n", replace=True)
        return done

    def marked(self) -> bool:
        return files.exists(self.spark, f"{self.root}/{MARK}")

    def counts(self) -> DataFrame:
        """(table, n) of all tables, of one version."""
        out, number = None, self.log.latest()[0]
        for t in TABLES:
            one = self.read(t, number=number or None).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last versions, and the folders that only older ones refer to; not while a load runs."""
        numbers = self.log.numbers()
        last = [self.log.read(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            files.delete(self.spark, f"{self.log.folder}/{n:020d}.json")
        return [f"{t}/{gone}" for t, layout in self.layouts.items() for gone in layout.vacuum([v.get("tables", {}).get(t, {}) for v in last])]
