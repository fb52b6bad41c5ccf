"""What several operators share: reading, words, Arrow maps, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased UTF-8 bytes. All that
#: the class excludes is ASCII, so bytes and code points give the same words.
FOLDED_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Rows that a worker takes up in one go at most, and bytes that Spark sends it at once.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: bytes) -> bytes:
    """Lower-case A-Z alone."""
    return text.lower()


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII digits, letters and all non-ASCII characters, A-Z folded."""
    return FOLDED_WORD.findall(text.lower()) if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these six."""
    return text.split() if text else []


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary()).to_pylist()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches bounded in bytes, since texts may be long, and taken up by slices of a bounded number of rows.

    Batches of narrow rows don't come near the bound, so other plans of the session keep theirs.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = conf.get(key).removesuffix("b")
    if set_to.isdigit() and int(set_to) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(i, BATCH_ROWS) for batch in batches for i in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may make one itself."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rillgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    The table outlives lost executors and goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillgraph-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.octet_length(name).cast("long"), F.lit(0).cast("long"))


def text_key(name: str = "text") -> Column:
    """128 bits that stand for a text; null and empty are one."""
    return F.unhex(F.md5(F.coalesce(F.col(name), F.lit("")).cast("binary")))


#: Ids that may be broadcast to filter documents; 64 MB as a hashed relation, about.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of (left_semi) or besides (left_anti) the given ids.

    ``ids`` is a written table of one column ``id``. Up to BROADCAST_IDS rows it
    is broadcast and the texts stay where they are; beyond that, both sides are
    shuffled by id.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.select(F.col("id").alias("__id"))
    return docs.join(F.broadcast(ids) if small else ids, docs[id_col] == F.col("__id"), how)


#: Rows of one key beyond which they are joined where they are, not in one task.
MANY = 4096


def join_keys(rows: DataFrame, keys: DataFrame, on: Column, key: str, n: str, how: str = "inner") -> DataFrame:
    """rows joined with ``keys``, a written table that has a key's row once and in ``n`` how many of ``rows`` have it.

    Keys of many rows are broadcast, at most BROADCAST_IDS of them, since each stands for its share of all rows; the
    others are joined by a shuffle. ``n`` doesn't come back. ``how`` is inner or left.
    """
    total, top = (x or 0 for x in keys.agg(F.sum(n), F.max(n)).first())
    most = max(MANY, total // max(1, BROADCAST_IDS))
    if top <= most:
        return rows.join(keys.drop(n), on, how)
    often = F.broadcast(keys.where(F.col(n) > most).drop(n))
    rest = rows.join(often.select(key), on, "left_anti").join(keys.where(F.col(n) <= most).drop(n), on, how)
    return rows.join(often, on).union(rest)
