"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of several queries define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset and Spark runs on this machine alone (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tracelight-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Checkpoints that have been written and not removed yet, by their path.
_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its rows in the shared checkpoint folder and its lineage cut."""
    shared_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    if path := _file_of(df):
        _WRITTEN.append(path)
    return df


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: for wide tables of values that repeat, which a checkpoint would keep in full."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PARQUET[id(out)] = path
    return out


#: Paths of tables that ``stored`` made, by the identity of the DataFrame.
_PARQUET: dict[int, str] = {}


def _file_of(df: DataFrame) -> str | None:
    if id(df) in _PARQUET:
        return _PARQUET[id(df)]
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    file = plan.rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` made and that nothing to come reads."""
    for df in tables:
        path = _file_of(df)
        _PARQUET.pop(id(df), None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            remove(df.sparkSession, path)


def discard_since(spark: SparkSession, mark: int) -> None:
    """Removes the files of all that ``cut`` made since it had made ``mark`` (``len`` of ``written()``) tables."""
    for path in _WRITTEN[mark:]:
        remove(spark, path)
    del _WRITTEN[mark:]


def written() -> list[str]:
    return _WRITTEN


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that is written and read again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach an operator's own columns."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches a few rows at a time, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


#: Rows of a narrow key table that are broadcast at most; with more, the other side is shuffled.
MAX_BROADCAST_KEYS = 1_000_000


def small(keys: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``keys``, computed once, marked for a broadcast if it has at most ``limit`` rows."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


#: Links that one task takes by itself, at most; with more, every step is an exchange.
FEW_LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``: one row ``(node, root)`` per linked node, root the smallest node.

    Alternates the large-star and small-star steps, each a pre-aggregated
    ``min`` and an equi-join on the node, so a node with very many links is
    split by AQE's skew join; while there are no more links than ``FEW_LINKS``, a round is one
    task without an exchange. Rounds are cut with ``checkpoint()``, and each
    one's files go once the next has been written; their
    number is logarithmic in the longest chain. Self-loops, repeated links and
    nulls are ignored; no links give no rows.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut(e.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("u") != F.col("v"))))
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        few = (lambda df: df.coalesce(1)) if state[0] <= FEW_LINKS else (lambda df: df)
        seen, before = state, e
        both = few(e).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        each = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        e = cut(each.where("u <> v").distinct())
        discard(before)
