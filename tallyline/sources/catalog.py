"""The catalog of data sets: entries in Parquet, of which the last registration of a name and its updates count."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.metrics import column
from tallyline.models import DATASET_SCHEMA

UPDATABLE = ("profile_path", "semantic_path")
REST = [name for name in DATASET_SCHEMA.names if name != "dataset_name"]
# An entry without a generation is a registration and its own generation.
ENTRY_SCHEMA = T.StructType(
    [
        *DATASET_SCHEMA,
        T.StructField("generation", T.LongType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)
MOST_FILES = 64
READS = 3


def upsert(entries: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The entries with the changes applied: the last one of every key."""
    return latest(entries.unionByName(changes), keys, order)


def latest(entries: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last entry of every key.

    Of entries with equal order the one with the larger other columns counts, whoever reads. It is kept by an
    aggregate and not by a window, so a key with very many entries is reduced in every task before the shuffle.
    """
    rest = [name for name in entries.columns if name not in keys]
    place = F.struct(column(order), *[column(name) for name in rest if name != order])
    last = F.max_by(F.struct(*map(column, rest)), place).alias("last")
    return entries.groupBy(*map(column, keys)).agg(last).select(*map(column, keys), "last.*")


@dataclass(frozen=True)
class RegisteredDataset:
    dataset_name: str
    table_name: str
    source_path: str
    row_count: int
    location: str | None = None
    profile_path: str | None = None
    semantic_path: str | None = None
    created_at: datetime | None = None


class DatasetCatalog:
    """Register, update, look up and list data sets under one folder.

    Writers need no lock. A registration is one entry; an update is an entry that names the fields it sets and the
    registration it is about (``generation``). A reader takes each field from the last entry that sets it, so of updates
    that cross each other both count, and one that was meant for a replaced registration counts no more. Every entry is
    written to a folder of its own, and reading does not depend on the order or repetition of entries, so ``compact`` may
    write those that count once more and remove the rest while others write.
    """

    def __init__(self, spark: SparkSession, path: str, most_files: int = MOST_FILES) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.most_files = most_files

    def register(self, dataset: RegisteredDataset) -> None:
        """Add a data set, or replace the one of that name."""
        values = asdict(dataset)
        values["created_at"] = values["created_at"] or datetime.now(tz=timezone.utc)
        self._append(values, self._row(dataset.dataset_name))

    def table(self) -> DataFrame:
        """The current entries, one per name. A compaction between this call and reading the rows makes it fail."""
        return _current(self._entries()).select(*DATASET_SCHEMA.names)

    def list(self) -> DataFrame:
        return self.table().orderBy("dataset_name")

    def get(self, dataset_name: str) -> RegisteredDataset:
        row = self._row(dataset_name)
        if row is None:
            raise KeyError(f"Dataset not found: {dataset_name}")
        return RegisteredDataset(**{name: row[name] for name in RegisteredDataset.__dataclass_fields__})

    def update(self, dataset_name: str, **changes: str) -> None:
        """Set the profile or the semantic path of a registered data set."""
        unknown = set(changes) - set(UPDATABLE)
        if unknown:
            raise ValueError(f"Cannot update: {sorted(unknown)}")
        row = self._row(dataset_name)
        if row is None:
            raise KeyError(f"Dataset not found: {dataset_name}")
        self._append({"dataset_name": dataset_name, **changes}, row, sorted(changes))

    def compact(self) -> int:
        """Write the entries that count once more, in one file, and remove the files read; returns how many they were.

        An entry that arrives meanwhile is not among the files read and stays.
        """
        files = self._files()
        if not files:
            return 0
        kept = _counting(self.spark.read.schema(ENTRY_SCHEMA).parquet(*files))
        kept.coalesce(1).write.parquet(self._new_folder())
        for file in files:
            folder = file.rsplit("/", 1)[0]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder if "/entry-" in folder else file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(files)

    def _row(self, dataset_name: str) -> Row | None:
        """The current entry of a name, read again when a compaction has just removed a file."""
        for attempt in range(READS):
            try:
                return _current(self._entries().filter(F.col("dataset_name") == dataset_name)).first()
            except PySparkException as error:
                if attempt == READS - 1 or "FILE_NOT_EXIST" not in str(error):
                    raise
        return None

    def _append(self, values: dict[str, object], before: Row | None, fields: Sequence[str] | None = None) -> None:
        seq = max(time.time_ns(), before["seq"] + 1 if before else 0)  # a slow clock loses no update
        entry = {**values, "seq": seq, "generation": before["generation"] if fields else seq, "fields": fields}
        row = [tuple(entry.get(name) for name in ENTRY_SCHEMA.names)]
        self.spark.createDataFrame(row, ENTRY_SCHEMA).coalesce(1).write.parquet(self._new_folder())
        if len(self._files()) > self.most_files:
            self.compact()

    def _new_folder(self) -> str:
        # Two writers that append to one folder would share its temporary files.
        return f"{self.path}/entry-{uuid.uuid4().hex}"

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRY_SCHEMA)

    def _files(self) -> Sequence[str]:
        return self._entries().inputFiles()


def _current(entries: DataFrame) -> DataFrame:
    """The registration of each name with its updates; ``seq`` is that of the last entry, ``generation`` its own."""
    values = {name: F.col(f"registered.{name}") for name in REST}
    for name in UPDATABLE:
        values[name] = F.when(F.col(f"set_{name}").isNull(), values[name]).otherwise(F.col(f"set_{name}.{name}"))
    values["seq"] = F.greatest("registered.seq", *[f"set_{name}.seq" for name in UPDATABLE])
    return _folded(entries).select("dataset_name", "generation", *[value.alias(name) for name, value in values.items()])


def _counting(entries: DataFrame) -> DataFrame:
    """The entries that count: the registration of each name and the last update of each field."""

    def entry(part: str, known: Sequence[str], fields: Column) -> Column:
        values = {name: F.col(f"{part}.{name}") for name in known} | {"fields": fields}
        values |= {name: F.col(name) for name in ("dataset_name", "generation")}
        typed = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY_SCHEMA]
        return F.struct(*typed)

    listed = [entry("registered", REST, F.lit(None))]
    listed += [entry(f"set_{name}", ["seq", name], F.array(F.lit(name))) for name in UPDATABLE]
    return _folded(entries).select(F.inline(F.array(*listed))).filter(F.col("seq").isNotNull())


def _folded(entries: DataFrame) -> DataFrame:
    """One row per name: ``registered``, its last registration, and a ``set_`` struct for each field updated since."""
    place = F.struct("seq", *[name for name in REST if name != "seq"])
    whole = F.col("fields").isNull()
    registered = F.max_by(F.struct(*REST), F.when(whole, place)).alias("registered")
    updates = [
        F.max_by(F.struct("seq", name), F.when(F.array_contains("fields", name), place)).alias(f"set_{name}") for name in UPDATABLE
    ]
    generations = entries.groupBy("dataset_name", F.coalesce("generation", "seq").alias("generation")).agg(registered, *updates)
    columns = [name for name in generations.columns if name != "dataset_name"]
    last = F.max_by(F.struct(*columns), "generation").alias("last")
    return generations.filter(F.col("registered").isNotNull()).groupBy("dataset_name").agg(last).select("dataset_name", "last.*")
