"""What several operators of this subpackage share. Column expressions only, no Python on executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class body: space and 0x09 to 0x0D.
ASCII_SPACE = " \\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(a: Column, b: Column) -> Column:
    """Whether both are equal or both null, as a condition that a join tests on rows that met by other keys, and isn't dealt by."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns, made from names, that no column of frame has, in any case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = ASCII_SPACE) -> Column:
    """The non-empty pieces of text between characters of the class body separators."""
    return F.filter(F.split(text, f"[{separators}]+"), lambda w: w != F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where none is named, one is made only in local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarifflens-"))
    return context.getCheckpointDir()


#: Spark's own setting: what a query has shuffled is deleted once it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(frame: DataFrame) -> DataFrame:
    """frame as a table written to the shared folder, its lineage cut and its shuffle files deleted."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    with cleaned_up(frame.sparkSession):
        frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    for made in _made:
        made.append(table)
    return table


#: Tables written so far, for each call of alone that isn't done.
_made: list[list[DataFrame]] = []


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns as a written table; the tables that it has written on its way are deleted."""
    _made.append([])
    try:
        out = written(make())
    finally:
        tables = _made.pop()
    delete(*(t for t in tables if t is not out))
    return out


def delete(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of an edge, component being the least node reachable.

    Alternating large-star and small-star steps until the edges stay as they are: each step is an
    aggregation with a map-side part and an equality join, and no node's neighbours meet in one row.
    Nulls and self-links are left out.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )

    def mark(frame: DataFrame):
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, now = now, written(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        del both, least, large, small
        delete(old)
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
