"""Helpers shared by the operators: intermediate tables, joins on hot keys, local bindings, running folds, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package.
SPACE = " \t\n\x0b\f\r"
#: Rows up to which a table keyed by group may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 20_000
#: The same for tables of two numbers, which are some 40 bytes a row once broadcast.
BROADCAST_NUMBERS = 1_000_000
#: Bytes up to which a table whose rows hold arrays may be broadcast: the driver holds it several times over meanwhile.
BROADCAST_BYTES = 4 << 20
#: Rows of a table up to which one key may hold all of them in a shuffled join.
HOT_ROWS = 4_000_000

_written_here: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the session sets it. A session whose executors are threads of the driver may
    leave it unset, as tests do: it gets a local folder. On a cluster that is an error."""
    set_one = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/turnloom-{name}-{uuid.uuid4().hex}"
    for paths in _written_here:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.turnloom_path = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replaced_by(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, which is written already, once the table of old, which nothing needs any more, is deleted."""
    deleted(new.sparkSession, old.turnloom_path)
    return new


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what was written to the shared folder inside, but for the paths appended to the list it gives."""
    paths: list[str] = []
    kept: list[str] = []
    _written_here.append(paths)
    try:
        yield kept
    finally:
        _written_here.pop()  # contexts end in reverse order
        for path in paths:
            if path not in kept:
                deleted(spark, path)


def memory_returned() -> None:
    """Give back to the system what this process has freed: else the driver keeps, for all later stages, what one of them
    needed for a while. Does nothing where the C library can't."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """The running fold of an array by an associative step, its own element included: running sums, maxima and so on.

    Appending to one array would copy it each time. So blocks are folded by themselves, then their last values, and
    each block gets what came before it: n * block + (n / block) ** 2 copies, and a block's worth for short arrays.
    """
    last = lambda a: F.get(a, F.size(a) - 1)

    def folded(array: Column) -> Column:
        empty = F.array().cast(f"array<{kind}>")
        return F.aggregate(array, empty, lambda a, x: F.array_append(a, F.when(F.size(a) == 0, x).otherwise(step(last(a), x)).cast(kind)))

    def joined(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        inner = F.transform(starts, lambda at: folded(F.slice(v, at, F.lit(block))))
        return let(inner, lambda blocks: let(folded(F.transform(blocks, last)), lambda heads: F.flatten(
            F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: step(F.get(heads, i - 1), x).cast(kind)))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast(f"array<{kind}>")).when(F.size(v) <= block, folded(v)).otherwise(joined(v)))


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE, in order; null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_or_plain(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few, else as it is (the join then shuffles)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def looked_up(big: DataFrame, small: DataFrame, on: str, rows: int, how: str = "left", salts: int = 32, most: int = BROADCAST_ROWS) -> DataFrame:
    """big with the columns of small, of few rows for each value of `on`, whose rows were counted. At most `most` rows are
    broadcast; more are copied under `salts` numbers, over which the rows of a hot value are spread."""
    if rows <= most:
        return big.join(F.broadcast(small), on, how)
    spread = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [on, "__salt"], how).drop("__salt")


def joined_by_hot_key(big: DataFrame, small: DataFrame, on: str, n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of big with small, a written table of one row for each value of `on` and its number of rows in big
    as column n (which goes). Values with over hot_rows rows are joined by broadcast, never shuffled to one task;
    hot_rows is raised with the table so that at most BROADCAST_ROWS values can pass it."""
    total = small.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t"), F.max(n).alias("most")).first()
    if (total["most"] or 0) <= hot_rows:
        return big.join(small.drop(n), on)
    limit = max(hot_rows, total["t"] // BROADCAST_ROWS)
    hot, cold = small.filter(F.col(n) > limit).drop(n), small.filter(F.col(n) <= limit).drop(n)
    there = big.join(F.broadcast(hot), on)
    rest = big.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return there.unionByName(rest)
