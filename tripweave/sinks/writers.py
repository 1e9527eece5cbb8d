"""Writers for ride tables, aggregates and station files.

Spark's commit protocol keeps a failed write from showing; nothing here funnels rows through one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripweave.schema import TIME_KEY
from tripweave.session import splits_to_sort
from tripweave.sources.csv import sort_rows
from tripweave.sources.tables import index_folder, index_versions, newest_index, run_folder

_MODES = {True: "overwrite", False: "ignore", None: "errorifexists"}


def write_month_table(rides: DataFrame, path: str, overwrite: bool | None = None) -> None:
    """Rides partitioned by end month and sorted by start and stop within a file.

    Rebalancing splits a hot month over several files and packs small months, and the sort gives row groups
    narrow time ranges.
    """
    rides.hint("rebalance", "end_ym").sortWithinPartitions("end_ym", *TIME_KEY).write.mode(_MODES[overwrite]).partitionBy("end_ym").parquet(path)


def write_source_month(rides: DataFrame, base: str, src_ym: int) -> None:
    """Replace one source month's slices; slices that a rerun no longer produces go away, other source months stay."""
    replace_source_months(rides.where(F.col("src_ym") == src_ym), base, [src_ym])


def replace_source_months(rides: DataFrame, base: str, months: Sequence[int] = (), clustered: bool = False) -> None:
    """Replace every source month present in ``rides``, and those in ``months`` even if they have no rides any more, with one job.

    A run's slices are written to a folder of their own; then an index that says which run each source month is read from is
    written as one small table, and readers take the newest index that was committed. Until that commit they see the old
    slices, all of them, after it the new ones; nothing is moved or deleted in between. A run that dies, also while it writes the index, leaves
    folders that no reader looks at; the next index takes a number above all there are. ``remove_old_runs`` frees the space. One writer at a time.

    ``clustered`` says that rides of a slice lie together already, as in a table stored by month: the tasks that read them write them, without a shuffle.
    """
    spark, run = rides.sparkSession, uuid.uuid4().hex
    keys = ["src_ym", "start_ym", "end_ym"]
    dealt = rides if clustered else rides.hint("rebalance", *keys)
    with splits_to_sort(spark):
        dealt.sortWithinPartitions(*keys, *TIME_KEY).write.partitionBy(*keys).parquet(run_folder(base, run))
    # Partition columns are known from folder names; the files are not read.
    written = spark.read.schema(rides.schema).parquet(run_folder(base, run)).select("src_ym").distinct()
    new = written.select(F.col("src_ym").cast("int").alias("src_ym"), F.lit(run).alias("run"))
    _, old = newest_index(spark, base)
    if old is not None:
        replaced = new.select("src_ym").unionByName(spark.createDataFrame([(int(m),) for m in months], "src_ym int"))
        new = old.join(replaced, "src_ym", "left_anti").unionByName(new)
    new.coalesce(1).write.parquet(index_folder(base, max(index_versions(spark, base), default=0) + 1))


def remove_old_runs(spark: SparkSession, base: str) -> None:
    """Delete the slices that the newest index does not name, and all other indexes, half-written ones too; not while readers of an older index or a writer are at work."""
    version, index = newest_index(spark, base)
    if index is None:
        return
    current = {(r.run, r.src_ym) for r in index.collect()}  # one row per source month
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for run in fs.listStatus(path(f"{base}/runs")):
        months = [m.getPath() for m in fs.listStatus(run.getPath()) if m.getPath().getName().startswith("src_ym=")]
        name = run.getPath().getName().removeprefix("run=")
        old = [m for m in months if (name, int(m.getName().removeprefix("src_ym="))) not in current]
        for m in [run.getPath()] if len(old) == len(months) else old:
            fs.delete(m, True)
    for other in index_versions(spark, base):
        if other != version:
            fs.delete(path(index_folder(base, other)), True)


def write_end_months(rides: DataFrame, path: str) -> None:
    """Replace only the end months present in ``rides``, for incremental runs."""
    rides.hint("rebalance", "end_ym").sortWithinPartitions("end_ym", *TIME_KEY).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("end_ym").parquet(path)


def write_table(df: DataFrame, path: str, overwrite: bool | None = None) -> None:
    """An aggregate as parquet; ``overwrite`` False keeps an existing one."""
    df.write.mode(_MODES[overwrite]).parquet(path)


def write_sorted_csv(rows: DataFrame, path: str) -> None:
    """Gzipped CSV in start, stop and id order, blank rows dropped, equal keys in their old order.

    The global order runs across part files: a range sort, no single-task collapse. The old position is part of
    the sort key, so rows with equal keys can be cut into several ranges as well. The rows that went in are counted as they are
    written and compared with what can be read back.
    """
    counted = Observation()
    wanted = rows.where(F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull())
    out = sort_rows(wanted).observe(counted, F.count(F.lit(1)).alias("n"))
    out.write.option("header", True).option("nullValue", r"\N").option("compression", "gzip").csv(path)
    back = rows.sparkSession.read.option("header", True).schema(rows.schema).csv(path).count()
    if back != counted.get["n"]:
        raise OSError(f"{path}: {back} rows can be read back of {counted.get['n']} written")


def write_json_records(df: DataFrame, path: str, overwrite: bool | None = None, order: Sequence | None = None) -> None:
    """JSON records, one per line, range-sorted by ``order`` if given."""
    (df.orderBy(*order) if order else df).write.mode(_MODES[overwrite]).json(path)


def write_keyed_json(df: DataFrame, path: str, key: str = "id", overwrite: bool | None = None) -> None:
    """Lines of ``{key: {...}}``, one row each: objects that merge into the one keyed by ``key``."""
    body = F.struct(*[c for c in df.columns if c != key])
    line = F.to_json(F.create_map(F.col(key).cast("string"), body))
    df.select(line.alias("value")).write.mode(_MODES[overwrite]).text(path)


def write_pair_json(maps: DataFrame, path: str, overwrite: bool | None = None) -> None:
    """Lines of ``{start: {end: count}}``, one start each."""
    line = F.to_json(F.create_map(F.col(maps.columns[0]).cast("string"), F.col("destinations")))
    maps.select(line.alias("value")).write.mode(_MODES[overwrite]).text(path)


def write_sql_table(df: DataFrame, table: str, jdbc_url: str | None = None, overwrite: bool | None = None, path: str | None = None) -> None:
    """A catalog table, in the warehouse or in a folder of its own, or a database table over JDBC."""
    if jdbc_url is None:
        writer = df.write.mode(_MODES[overwrite])
        (writer.option("path", path) if path else writer).saveAsTable(table)
    else:
        df.write.mode(_MODES[overwrite]).format("jdbc").option("url", jdbc_url).option("dbtable", table).save()
