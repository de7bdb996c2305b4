"""Tables on files: builds, appends, atomic replacement, bulk loads, compaction, mutations, snapshots, reports.

All paths go through Hadoop's file systems, so a table may live wherever Spark can write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    fs, p = file_system(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def create_as(rows: DataFrame, path: str, key: Sequence[str] = (), by_range: bool = False) -> DataFrame:
    """A table from a query, sorted by its key within files (across files too, if ``by_range``), so that a filter on the
    key skips row groups. Gives the table."""
    if key and by_range:
        rows = rows.repartitionByRange(*key)
    if key:
        rows = rows.sortWithinPartitions(*key)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def create_view(rows: DataFrame, name: str) -> DataFrame:
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def append_versions(rows: DataFrame, path: str, loaded_at: Column, key: str | None = None) -> None:
    """Add rows as new versions: nothing is updated in place, readers take the newest of a key."""
    out = rows.withColumn("_loaded_at", loaded_at)
    (out.sortWithinPartitions(key) if key else out).write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Replace a table whole: it is written beside the old one and takes its name by renaming, so a job that fails
    leaves the old table, and rows may be read from it."""
    spark = rows.sparkSession
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.parquet(staged)
    fs, target = file_system(spark, path)
    if fs.exists(target) and not fs.rename(target, file_system(spark, old)[1]):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(file_system(spark, staged)[1], target):
        raise OSError(f"{staged} can't be moved")
    if fs.exists(file_system(spark, old)[1]):
        fs.delete(file_system(spark, old)[1], True)


CSV = {"header": "true", "nullValue": "\\N", "emptyValue": '""', "quote": '"', "escape": '"', "multiLine": "true", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def dump_csv(rows: DataFrame, path: str) -> None:
    """CSV in which null and the empty string differ."""
    rows.write.mode("overwrite").options(**CSV).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a typed CSV; a row that does not fit the schema fails the load."""
    return spark.read.schema(schema).options(**{**CSV, "emptyValue": ""}).option("mode", "FAILFAST").csv(path)


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table kept as plain CSV with a header."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def changed_range(rows: DataFrame, changed_at: str, since: str | None, until: str) -> DataFrame:
    at = lambda s: F.lit(s).cast(rows.schema[changed_at].dataType)
    upper = F.col(changed_at) <= at(until)
    return rows.where(upper if since is None else upper & (F.col(changed_at) > at(since)))


def compact(spark: SparkSession, path: str, newest: Callable[[DataFrame], DataFrame], files: int | None = None) -> dict[str, int]:
    """Rewrite a table of versions to one row a key; rows and bytes before and after."""
    rows = spark.read.parquet(path)
    before = {"rows_before": rows.count(), "bytes_before": size(spark, path)}
    kept = newest(rows)
    replace(kept.coalesce(files) if files else kept, path)
    return {**before, "rows_after": spark.read.parquet(path).count(), "bytes_after": size(spark, path)}


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE: columns get new values in the rows that meet a condition (an unknown condition is none)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~F.coalesce(where, F.lit(False)))


def dropped(rows: DataFrame, *columns: str) -> DataFrame:
    missing = set(columns) - set(rows.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    return rows.drop(*columns)


def renamed(rows: DataFrame, old: str, new: str) -> DataFrame:
    if old not in rows.columns or new in rows.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return rows.withColumnRenamed(old, new)


def frozen(reports: Mapping[str, DataFrame], folder: str, threads: int = 4) -> dict[str, str]:
    """Write reports, which all read one snapshot of files, at the same time, the largest first. name: path."""
    of = lambda name: int(reports[name]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    reports = {name: reports[name] for name in sorted(reports, key=of, reverse=True)}
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in reports}
    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(lambda name: reports[name].write.mode("overwrite").parquet(paths[name]), reports))
    return paths


def discard(rows: DataFrame, **measures: Column) -> dict:
    """Compute all rows and keep none; the measures (aggregates) are taken on the way."""
    seen = Observation()
    (rows.observe(seen, *[m.alias(name) for name, m in measures.items()]) if measures else rows).write.format("noop").mode("overwrite").save()
    return seen.get if measures else {}


def fingerprint(rows: DataFrame) -> DataFrame:
    """n_rows, h1, h2: a table's content whatever the order of its rows (sums of 32 bits of an MD5 of each)."""
    one = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(rows.columns)]).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(one, at, 8), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), part(1).alias("h1"), part(9).alias("h2"))


def sample_by_hash(rows: DataFrame, seed: int, *key: str, n: int) -> DataFrame:
    """The ``n`` rows of least hash of seed and key: the same rows wherever and whenever it is asked."""
    return rows.orderBy(hashed(seed, *key), *key).limit(n)


def hashed(seed: int, *key: str) -> Column:
    """32 bits of an MD5 of seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def minted(rows: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """Rows numbered without a gap in an order. Ranges of the order are numbered side by side, from counts of the
    ranges before, so no task sees all rows."""
    from pyspark.sql import Window as W

    from lakeloom.session import stored

    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "minted")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own") + (start - 1)).drop("_range", "_own", "_before")


def markdown(title: str, sections: Mapping[str, DataFrame], most: int = 200) -> str:
    """A text report: each section a table of at most ``most`` rows, as the report's reader sees it; what is left out is
    counted."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        found = rows.limit(most + 1).collect()
        cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
        lines = [f"| {' | '.join(rows.columns)} |", "|" + " --- |" * len(rows.columns), *(f"| {' | '.join(cell(x) for x in r)} |" for r in found[:most])]
        more = [f"… and {rows.count() - most} more"] if len(found) > most else []
        out += [f"\n## {name}\n", *(lines if found else ["Nothing."]), *more]
    return "\n".join(out) + "\n"


# Loads.


def backfill(source: DataFrame, path: str, until: str, changed_at: str, key: str) -> None:
    """Replace the copy by a full load up to a time; earlier loads stay on record elsewhere."""
    replace(changed_range(source, changed_at, None, until).withColumn("_loaded_at", F.lit(until).cast("timestamp_ntz")), path)


def nulled(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as a loader leaves them that loses some columns."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def clock(loads: DataFrame) -> DataFrame:
    """now: where the latest load reached (null before any)."""
    return loads.agg(F.max("loaded_until").alias("now"))
