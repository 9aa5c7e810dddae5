"""What the corpus operators share: the shared folder, lineage cuts, word splitting and labelled samples."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where spark.checkpoint.dir is unset and Spark runs in one process.
LOCAL_SHARED = "/tmp/checkpoints/gristmill"

#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: A key of more than one HOT_SHARE-th of the rows is hot; SALTS are the parts into which a salted join cuts a key.
HOT_SHARE, SALTS = 1000, 16

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what setCheckpointDir() was given."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_SHARED


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean, spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _clean(spark: SparkSession) -> None:
    for path in _written.pop(spark.sparkContext.applicationId, []) if spark.sparkContext._jsc else []:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whichever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far(spark: SparkSession) -> int:
    """How many paths shared_path() has given to this application: a mark for release()."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int, but_last: bool = True) -> None:
    """Delete what was written to shared paths after the mark, the last of them excepted."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since : len(paths) - but_last]:
        delete(spark, path)
    del paths[since : len(paths) - but_last]


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, of which n says how many rows have it.

    A key that holds at least a HOT_SHARE-th of all `total` rows would be one task's work. There are HOT_SHARE such keys at
    most, so their part of the table is broadcast and their rows stay where they are; the others are shuffled.
    """
    hot = F.col(n) * HOT_SHARE >= F.lit(total)
    few, many = table.filter(hot).drop(n), table.filter(~hot).drop(n)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")  # HOT_SHARE rows at most, here and below
    return rows.join(F.broadcast(few), key).unionByName(others.join(many, key))


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str, spread_by: Column) -> DataFrame:
    """rows joined, left or left_semi, with a table that is small beside it: its rows are repeated once for each salt.

    Of a frequent key, each salt is a task of its own; rows without the key join nothing and are not all one task's.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.filter(F.col(key).isNotNull()).withColumn("__salt", salt).join(copies, [key, "__salt"], how).drop("__salt")
    return met if how == "left_semi" else met.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


#: Fixed values of the contracts: what separates words.
SPACE = r"[\x20\x09-\x0D]"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: bytes.translate table: A-Z to lower case, other ASCII that is neither letter nor digit to a space.
ALNUM_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split_words(text: Column, separator: str) -> Column:
    """The non-empty parts of text between runs of the separator class; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separator + "+")
    return F.filter(parts, lambda w: w != "")


def text_bytes(name: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as none, for Arrow batches."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def fold_ids(label: Column) -> Column:
    """crc32 of doc_id as text, by which the contracts divide rows into folds."""
    return F.crc32(label.cast("string").cast("binary"))


def labels_once(labels: DataFrame, value: str) -> DataFrame:
    """(doc_id, y), one row for each labelled document; of contradicting rows the larger label holds, nulls are none."""
    return labels.filter(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(value).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, fold: Column, per_class: int) -> list[tuple[int, bytes]]:
    """(label, text) of at most per_class documents of each label, for fitting a classifier on the driver.

    fold says which labelled rows may be learnt from. The ids of least hash are taken, so the same table gives the same
    sample. Rows alone are bounded: texts are whole, however long.
    """
    once = labels_once(labels, value).filter(fold)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = once.filter("y = 0").orderBy(*order).limit(per_class).unionByName(once.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", text_bytes().alias("body"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("body").alias("body"))  # ids: 2 * per_class rows at most
    return [(r.y, bytes(r.body)) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_ROWS rows at most, after which a worker gives back what memory Arrow holds.

    Batches hold whole texts, so their rows are bounded in the session's setting, unless it has a lower bound. Workers are
    reused: without giving it back, each keeps the most memory that any of its tasks needed.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(whole, schema)


class BoundedCache(dict):
    """What make() gave, for the keys used lately: two generations of at most size entries, so that memory is bounded."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
