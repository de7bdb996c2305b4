"""Reads of a database table over JDBC, dealt out by counted ranges of its key.

The database counts its own rows: a histogram of the key over equal widths comes back as a row a bucket, and buckets
that hold more than a part's share are counted again over narrower widths, for all of them in one statement. From the
counts come bounds of about equally many rows, however unevenly the keys lie, and each range is one partition's own
predicate. A range of the change time is a filter that the database runs in each of them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from contextlib import suppress
from dataclasses import dataclass
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import shared_dir
from lakeloom.sources.tables import changed_range

#: Buckets of one count, over all ranges that it refines: what the driver sees at once.
BUCKETS = 1024
ROUNDS = 8
DERBY = (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"), ("preferTimestampNTZ", "true"))


@dataclass(frozen=True)
class Database:
    """Where a database is, and what its driver needs to know."""

    url: str
    options: tuple[tuple[str, str], ...] = ()

    def read(self, spark: SparkSession, source: str) -> DataFrame:
        """A table, or a statement in parentheses with a name."""
        return spark.read.format("jdbc").options(**dict(self.options)).option("url", self.url).option("dbtable", source).load()

    def write(self, rows: DataFrame, table: str, mode: str = "overwrite") -> None:
        rows.write.format("jdbc").options(**dict(self.options)).option("url", self.url).option("dbtable", table).mode(mode).save()


def quoted(name: str) -> str:
    """A name as Spark writes it in its own statements."""
    return '"' + name.replace('"', '""') + '"'


def embedded(name: str) -> Database:
    """A database in this process's memory, for one machine."""
    return Database(f"jdbc:derby:memory:{name};create=true", DERBY)


def published(rows: DataFrame, table: str) -> Database:
    """A database of one table that every executor can read: an archive in the shared folder, which Derby opens for
    reading in any number of processes, while an ``embedded`` one is seen by its own process alone. Executors write the
    rows out; a Derby has a single writer, which loads these files in this process from disk to disk. The folder has to
    be mounted where executors run."""
    spark, folder = rows.sparkSession, urlsplit(f"{shared_dir(rows.sparkSession)}/database-{uuid.uuid4().hex}")
    if folder.scheme not in ("", "file"):
        raise ValueError(f"Derby reads mounted folders only, not {folder.scheme}:")
    rows.write.options(escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{folder.geturl()}/rows")
    files = sorted(f for f in os.listdir(f"{folder.path}/rows") if f.endswith(".csv"))
    jvm = spark.sparkContext._jvm
    with tempfile.TemporaryDirectory(prefix="lakeloom-derby-") as own:
        home = f"jdbc:derby:{own}/db"
        Database(f"{home};create=true", DERBY).write(spark.createDataFrame([], rows.schema), table)  # no rows, so no task opens it
        connection = jvm.java.sql.DriverManager.getConnection(home)
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        load.setString(1, table.upper())
        for f in files:
            load.setString(2, f"{folder.path}/rows/{f}")
            load.execute()
        connection.close()
        with suppress(Py4JJavaError):  # Derby reports that it has shut down as an error
            jvm.java.sql.DriverManager.getConnection(f"{home};shutdown=true")
        with zipfile.ZipFile(f"{folder.path}/db.jar", "w", zipfile.ZIP_STORED) as jar:  # not compressed: pages are read where they lie
            for at, _, names in os.walk(f"{own}/db"):
                for name in names:
                    jar.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", own))
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.geturl()}/rows")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return Database(f"jdbc:derby:jar:({folder.path}/db.jar)db", DERBY)


def counted(db: Database, spark: SparkSession, table: str, key: str, ranges: Sequence[tuple[int, int]], where: str) -> list[tuple[int, int, int]]:
    """(first key, last key, rows) of the parts of some key ranges that hold rows, in order; one statement counts all."""
    width = [max(1, -(-(hi - lo + 1) * len(ranges) // BUCKETS)) for lo, hi in ranges]
    one = "SELECT {i} AS r, ({k} - ({lo})) / {w} AS b FROM {t} WHERE {k} >= {lo} AND {k} <= {hi}{also}"
    parts = [one.format(i=i, k=quoted(key), lo=lo, hi=hi, w=w, t=table, also=where) for i, ((lo, hi), w) in enumerate(zip(ranges, width, strict=True))]
    statement = f"(SELECT r, b, COUNT(*) AS n FROM ({' UNION ALL '.join(parts)}) x GROUP BY r, b) counts"
    found = [(ranges[r][0] + b * width[r], min(ranges[r][1], ranges[r][0] + (b + 1) * width[r] - 1), n) for r, b, n in db.read(spark, statement).collect()]
    return sorted(found)


def key_bounds(db: Database, spark: SparkSession, table: str, key: str, parts: int, where: str = "") -> list[tuple[int, int]]:
    """Key ranges, first and last key included, of about equally many rows that cover all keys which are not null. A
    range is over twice a part's share only where one key value is."""
    low, high, n = db.read(spark, f"(SELECT MIN({quoted(key)}) AS lo, MAX({quoted(key)}) AS hi, COUNT({quoted(key)}) AS n FROM {table} WHERE 1 = 1{where}) ends").first()
    if not n:
        return []
    share = -(-n // parts)
    done, open_ = [], [(int(low), int(high))]
    for _ in range(ROUNDS):
        counts = counted(db, spark, table, key, open_, where)
        open_ = [(lo, hi) for lo, hi, m in counts if m > share and lo < hi]
        done += [c for c in counts if not (c[2] > share and c[0] < c[1])]
        if not open_:
            break
    else:
        done += [(lo, hi, share) for lo, hi in open_]
    bounds, held = [], 0
    for lo, hi, m in sorted(done):
        if bounds and held + m <= share:
            bounds[-1] = (bounds[-1][0], hi)
            held += m
        else:
            bounds.append((lo, hi))
            held = m
    return bounds


def changed_rows(db: Database, spark: SparkSession, table: str, key: str, changed_at: str, since: str | None, until: str, parts: int = 8) -> DataFrame:
    """Rows of a table that changed in (since, until], one partition for each of about ``parts`` key ranges with equally
    many of *these* rows, and one for rows without a key."""
    where = f" AND {quoted(changed_at)} <= TIMESTAMP('{until}')" + (f" AND {quoted(changed_at)} > TIMESTAMP('{since}')" if since else "")
    ranges = key_bounds(db, spark, table, key, parts, where)
    predicates = [f"{quoted(key)} >= {lo} AND {quoted(key)} <= {hi}" for lo, hi in ranges] + [f"{quoted(key)} IS NULL"]
    rows = spark.read.jdbc(db.url, table, predicates=predicates, properties=dict(db.options))
    return changed_range(rows, changed_at, since, until)
