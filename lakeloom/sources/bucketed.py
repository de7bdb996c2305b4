"""Tables dealt into buckets by their key and sorted within: whoever groups, joins or takes the newest version by that key
reads them in place, without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import shared_dir


def bucketed(rows: DataFrame, name: str, key: str, order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """The rows as a table of one sorted file a bucket; tables that meet should have the same number of buckets (by
    default the session's shuffle width)."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    out = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *order)
    out.option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def newest(versions: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """One row a key, that of the largest ``by``; over a bucketed table an aggregate in place."""
    rest = [c for c in versions.columns if c != key and c not in by]
    top = F.max_by(F.struct(*by, *rest), F.struct(*by)).alias("_top")
    return versions.groupBy(key).agg(top).select(key, "_top.*")
