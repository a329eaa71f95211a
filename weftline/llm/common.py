"""What the operators of this subpackage share: table access, shared storage for cut lineage, and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: maximal runs without space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: The same class for DuckDB's regular expressions.
BLANKS_SQL = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A session on this machine alone (local[...]), as in tests, gets a
    folder of its own where it names none; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


#: Rows of a file, in a table whose size is about known before it is written.
FILE_ROWS = 100_000


def cut(df: DataFrame, name: str = "cut", rows: int | None = None, count: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later steps don't repeat the work, survive lost executors and see true sizes.

    rows: about how many it has at most, where that is known: a small table then is few files, whatever the number of shuffle
    partitions. Every file costs its executor a process where Hadoop's local file system sets permissions by chmod, and until
    that process runs it counts the JVM's memory twice. count: the result's cut_rows is its number of rows. The files go when
    free() is told so, or when the driver's JVM ends."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(min(max(1, -(-rows // FILE_ROWS)), 2**31 - 1))  # never more than there are
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df).write.parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if count:
        out.cut_rows = seen.get["n"]
    return out


def _folder(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def free(*cuts: DataFrame) -> None:
    """Deletes the files of tables that cut() gave, once what was made of them is written."""
    for df in cuts:
        fs, at = _folder(df.sparkSession, df.cut_path)
        fs.delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(xs: Column, start: Column | int = 0, block: int = 256) -> Column:
    """start plus the sum of all numbers before each, for an array of numbers. Blocks are summed by themselves and then moved:
    appending one by one to a whole array would take time in the square of its length."""
    zero = lambda at: F.struct(F.lit(0).cast("long").alias("at") if at is None else at.cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def run(values: Column, at: Column | None = None) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).cast("long").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(values, zero(at), step)

    first = F.lit(start) if isinstance(start, int) else start

    def long(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: run(F.slice(values, b * block + 1, F.lit(block))))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, run(F.transform(bs, lambda b: b["at"]), first)["all"], lambda b, at: F.transform(b["all"], lambda x: x + at))))

    return let(xs, lambda values: F.when(F.size(values) <= block, run(values, first)["all"]).otherwise(long(values)))


def running_max(xs: Column, block: int = 256) -> Column:
    """The largest number so far at each place of an array, block by block like prefix_sums()."""
    least = F.lit(-(2**62)).cast("long")

    def run(values: Column) -> Column:
        step = lambda acc, x: let(F.greatest(acc["at"], x), lambda m: F.struct(m.alias("at"), F.concat(acc["all"], F.array(m)).alias("all")))
        return F.aggregate(values, F.struct(least.alias("at"), F.array().cast("array<bigint>").alias("all")), step)

    def long(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: run(F.slice(values, b * block + 1, F.lit(block))))
        before = lambda bs: F.concat(F.array(least), run(F.transform(bs, lambda b: b["at"]))["all"])
        return let(blocks, lambda bs: let(before(bs), lambda ms: F.flatten(F.transform(bs, lambda b, i: F.transform(b["all"], lambda x: F.greatest(x, F.get(ms, i)))))))

    return let(xs, lambda values: F.when(F.size(values) <= block, run(values)["all"]).otherwise(long(values)))


CHUNK = 1024


def cutter(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, n) is the text's n characters from start on. Texts are cut into chunks once, so that a cut
    costs what it is long and not what stands before it."""

    def of(chunks: Column) -> Column:
        def cut(start: Column, n: Column) -> Column:
            first = F.floor(start / CHUNK).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, F.floor((start + n) / CHUNK).cast("int") - first + 1), "")
            return F.substring(held, (start - first * CHUNK + 1).cast("int"), n.cast("int"))

        return use(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), of)


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it (case aside)."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def plain_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, whatever else the table has; a missing one reads as null text."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
