"""Query logs: an engine's own log and two vendors' histories, as query records.

Records have query_id, run_id, actor, actor_type, node_id, started_at, sql_text, wallclock_ms, rows_scanned,
bytes_scanned, written_rows, query_kind, tables. A row that is no record is counted by the reason.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.cost import CONSUMERS

#: Literals and comments of a statement, and the run's id in the names of a build's staging tables.
COMMENT = r"(?s)/\*.*?\*/"
STRING = r"'(?:[^'\\]|\\.|'')*'"
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"
INVOCATION = r"_[0-9a-f]{8}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{12}"
BILLED = ("Select", "Insert")
ACTORS = {"dashboard": "metabase", "dbt": "dbt", "ingestion": "loader", "reconcile": "platform", "maintenance": "platform"}

#: The columns of the vendors' histories.
BIGQUERY_JOBS = (
    "job_id string NOT NULL, creation_time string NOT NULL, start_time string, end_time string, project_id string NOT NULL, user_email string NOT NULL, "
    "job_type string NOT NULL, statement_type string, query string NOT NULL, state string NOT NULL, total_bytes_processed long, total_bytes_billed long, "
    "total_slot_ms long, cache_hit boolean, destination_table struct<project_id: string, dataset_id: string, table_id: string>, "
    "referenced_tables array<struct<project_id: string, dataset_id: string, table_id: string>> NOT NULL, labels array<struct<key: string, value: string>> NOT NULL, "
    "error_result struct<reason: string, location: string, message: string>, parent_job_id string, reservation_id string"
)
SNOWFLAKE_HISTORY = (
    "QUERY_ID string NOT NULL, QUERY_TEXT string NOT NULL, DATABASE_NAME string, SCHEMA_NAME string, QUERY_TYPE string NOT NULL, SESSION_ID long NOT NULL, "
    "USER_NAME string NOT NULL, ROLE_NAME string, WAREHOUSE_NAME string, WAREHOUSE_SIZE string, QUERY_TAG string NOT NULL, EXECUTION_STATUS string NOT NULL, "
    "ERROR_CODE long, START_TIME string NOT NULL, END_TIME string NOT NULL, TOTAL_ELAPSED_TIME long NOT NULL, BYTES_SCANNED long NOT NULL, ROWS_PRODUCED long, "
    "CREDITS_USED_CLOUD_SERVICES double NOT NULL, EXECUTION_TIME long NOT NULL, PERCENTAGE_SCANNED_FROM_CACHE double NOT NULL"
)


class QueryCollector(Protocol):
    """Anything that gives query records: an engine's log or a vendor's history."""

    def records(self) -> DataFrame: ...

    def skipped(self) -> DataFrame: ...


def redacted(text: Column) -> Column:
    """The statement with string and number literals as ``?``; comments stay as they are."""
    parts, comments = F.split(text, COMMENT, -1), F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0))
    plain = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, STRING, "?"), NUMBER, "?"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(plain) - 1), lambda i: F.concat(F.get(plain, i), F.coalesce(F.get(comments, i), F.lit("")))), "")


def node_of(text: Column) -> Column:
    """The unique_id that the first JSON comment with one names."""
    comments = F.regexp_extract_all(text, F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    named = F.transform(comments, lambda c: F.when(c.rlike(r'"unique_id"\s*:\s*"'), F.get_json_object(F.trim(c), "$.unique_id")))
    return F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0))


def unversioned(name: Column) -> Column:
    return F.regexp_replace(name, INVOCATION, "")


def tag(**values: Column) -> Column:
    """A query's tag: a JSON object of the values that are not null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def login(principal: Column) -> Column:
    """A person's name from a login: what stands before @, in lower case."""
    return F.lower(F.substring_index(principal, "@", 1))


def labelled(principal: Column, names: Mapping[str, str], otherwise: Column) -> Column:
    """A principal's entry in a small fixed table."""
    if not names:
        return otherwise
    entries = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(entries, principal), otherwise)


class EngineLog:
    """An engine's query log: type, log_comment (a JSON tag with run, sim, actor, subject, person), query_kind, query,
    read_rows, read_bytes, written_rows, tables.

    The log's ids and times are random, so records are put in a stable order (simulated time, kind of work, subject,
    person, kind, text, sizes, tables) and numbered in it within their time and kind of work."""

    def __init__(self, log: DataFrame, run_id: str):
        field = lambda k: F.get_json_object("log_comment", f"$.{k}")
        mine = log.where((F.col("type") == "QueryFinish") & (field("run") == run_id))
        own = F.array_sort(F.transform(F.filter("tables", lambda t: ~t.startswith("system.")), unversioned))
        rows = mine.select(
            F.lit(run_id).alias("run_id"), field("sim").alias("sim"), field("actor").alias("actor_type"), F.coalesce(field("subject"), F.lit("")).alias("subject"),
            F.coalesce(field("person"), F.lit("")).alias("person"), "query_kind", unversioned(F.col("query")).alias("_text"), "read_bytes", "read_rows", "written_rows",
            own.alias("tables"), F.size("tables").alias("_n"),
        )
        system = (F.col("_n") > 0) & (F.size("tables") == 0)
        reason = F.when(~F.col("query_kind").isin(*BILLED), "not billed").when(system, "system tables only")
        self.rows = rows.withColumns({"sql_text": redacted(F.col("_text")), "reason": reason})

    def skipped(self) -> DataFrame:
        return self.rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

    def records(self) -> DataFrame:
        order = W.partitionBy("sim", "actor_type").orderBy("subject", "person", "query_kind", "sql_text", "read_bytes", "read_rows", "written_rows", "tables")
        number = F.lpad((F.row_number().over(order) - 1).cast("string"), 6, "0")
        person = F.when(F.col("person") != "", F.col("person")).otherwise(labelled(F.col("actor_type"), ACTORS, F.col("actor_type")))
        node = F.when(F.col("actor_type") == "dbt", node_of(F.col("_text"))).otherwise(F.nullif(F.col("subject"), F.lit("")))
        return self.rows.where("reason IS NULL").select(
            F.concat_ws("/", "sim", "actor_type", number).alias("query_id"), "run_id", person.alias("actor"), "actor_type", node.alias("node_id"), F.col("sim").cast("timestamp_ntz").alias("started_at"),
            "sql_text", F.lit(None).cast("double").alias("wallclock_ms"), F.col("read_rows").alias("rows_scanned"), F.col("read_bytes").alias("bytes_scanned"), "written_rows", "query_kind", "tables",
        )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


class VendorHistory:
    """What the vendors' collectors share: a reason for rows that are no records, and the record's columns."""

    def __init__(self, rows: DataFrame, reason: Column, columns: Mapping[str, Column]):
        self._rows, self._columns = rows.withColumn("_reason", reason), columns

    def skipped(self) -> DataFrame:
        """reason, n."""
        return self._rows.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))

    def records(self) -> DataFrame:
        return self._rows.where("_reason IS NULL").select(*[c.alias(k) for k, c in self._columns.items()])


class BigQueryJobs(VendorHistory):
    """Jobs that are no query, not done, failed, served from cache, or a script's parent are skipped."""

    def __init__(self, rows: DataFrame, workloads: Mapping[str, str] | None = None, actors: Mapping[str, str] | None = None, project: str = "company"):
        label = lambda k: F.get(F.filter("labels", lambda x: x["key"] == k), F.lit(0))["value"]
        reason = (
            F.when(F.col("job_type") != "QUERY", "not a query")
            .when(F.col("state") != "DONE", "not finished")
            .when(F.col("error_result").isNotNull(), "failed")
            .when(F.col("cache_hit"), "served from cache")
            .when(F.col("statement_type") == "SCRIPT", "script parent")
        )
        started, ended = F.coalesce("start_time", "creation_time").cast("timestamp"), F.col("end_time").cast("timestamp")
        columns = {
            "query_id": F.concat(F.lit("bigquery:"), "job_id"),
            "run_id": F.coalesce(label("dbt_invocation_id"), "job_id"),
            "actor": labelled(F.col("user_email"), actors or {}, login(F.col("user_email"))),
            "actor_type": labelled(F.col("user_email"), workloads or {}, F.lit("adhoc")),
            "node_id": F.coalesce(node_of(F.col("query")), F.concat(F.lit(f"exposure.{project}."), label("dashboard"))),
            "started_at": started,
            "sql_text": F.col("query"),
            "wallclock_ms": F.when(F.col("start_time").isNotNull(), (F.unix_micros(ended) - F.unix_micros(started)) / 1000.0),
            "bytes_scanned": F.col("total_bytes_billed"),
        }
        super().__init__(rows, reason, columns)


class SnowflakeHistory(VendorHistory):
    """Queries that did not succeed are skipped."""

    def __init__(self, rows: DataFrame, workloads: Mapping[str, str] | None = None, actors: Mapping[str, str] | None = None, project: str = "company"):
        status = F.lower("EXECUTION_STATUS")
        inside = lambda k: F.get_json_object("QUERY_TAG", f"$.{k}")
        columns = {
            "query_id": F.concat(F.lit("snowflake:"), "QUERY_ID"),
            "run_id": F.coalesce(inside("dbt_invocation_id"), "QUERY_ID"),
            "actor": labelled(F.col("USER_NAME"), actors or {}, login(F.col("USER_NAME"))),
            "actor_type": labelled(F.col("USER_NAME"), workloads or {}, F.lit("adhoc")),
            "node_id": F.coalesce(node_of(F.col("QUERY_TEXT")), F.concat(F.lit(f"exposure.{project}."), inside("dashboard"))),
            "started_at": F.col("START_TIME").cast("timestamp"),
            "sql_text": F.col("QUERY_TEXT"),
            "wallclock_ms": F.col("TOTAL_ELAPSED_TIME").cast("double"),
            "bytes_scanned": F.col("BYTES_SCANNED"),
        }
        super().__init__(rows, F.when(status != "success", F.concat(F.lit("status "), status)), columns)


def statement_reads(records: DataFrame, catalogue: Mapping[str, Mapping[str, str]], most: int = 10_000) -> DataFrame:
    """query_id, table_name, columns, filter_columns, writes, select_star of every statement in ``records`` (query_id,
    sql_text) that can be read. Statements that differ in literals only have one shape; one text of each is parsed, on
    the driver, where Spark's parser is. More than ``most`` shapes are refused."""
    from lakeloom.operators.statements import parse

    spark, shaped = records.sparkSession, records.select("query_id", "sql_text", redacted(F.col("sql_text")).alias("_shape"))
    shapes = shaped.groupBy("_shape").agg(F.min("sql_text").alias("sql_text")).limit(most + 1).collect()
    if len(shapes) > most:
        raise ValueError(f"more than {most} different statements")
    rows = []
    for r in shapes:
        found = parse(spark, r["sql_text"], catalogue)
        rows += [(r["_shape"], t, sorted(x.columns), sorted(x.filter_columns), found.writes, found.select_star) for t, x in found.reads.items() if found.ok]
    known = spark.createDataFrame(rows, "_shape string, table_name string, columns array<string>, filter_columns array<string>, writes string, select_star boolean")
    return shaped.select("query_id", "_shape").join(F.broadcast(known), "_shape").drop("_shape")


def consumer_filters(records: DataFrame, spark: SparkSession, catalogue: Mapping[str, Mapping[str, str]], most: int = 10_000) -> DataFrame:
    """query_id, table_name, filter_columns of the statements that people and dashboards ran."""
    asked = records.where(F.col("actor_type").isin(*CONSUMERS))
    return statement_reads(asked, catalogue, most).select("query_id", "table_name", "filter_columns")
