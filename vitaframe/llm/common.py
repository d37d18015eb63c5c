"""What the text operators share: tables, staging, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.session import checkpoint_dir

# The white space between words: space and code points 9 to 13.
SPACES = " \t\n\x0b\f\r"


# Staged tables, in order.
STAGED: list[DataFrame] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of tables that are no longer named.

    It does so once the driver has collected the objects that name them; with a large
    driver that can be long after their use.
    """
    spark._jvm.System.gc()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, short lineage.

    What was shuffled for it is given up at once if the caller keeps no other name of ``df``.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    df.write.parquet(path)
    del df
    collect_garbage(spark)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    STAGED.append(out)
    return out


def discard_since(mark: int, keep: DataFrame) -> None:
    """Removes what has been staged since ``mark`` (a length of ``STAGED``), but for one table."""
    discard(*[t for t in STAGED[mark:] if t is not keep])
    STAGED[mark:] = [keep]


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: Column) -> Column:
    """The runs of anything but white space, as an array."""
    plain = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without building them one by one in a lambda."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")
