"""Build artifacts (manifest, run results, freshness) from JSON, registries from YAML, catalogues from schemas and from
the files behind tables. Paths are opened by Spark, so any file system will do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_LIMIT = 300
FAILED_TESTS = ("fail", "error")
STALE = ("error", "runtime error")
NODE = "unique_id string, resource_type string, name string, schema string, identifier string, alias string, depends_on struct<nodes: array<string>>, attached_node string, owner struct<name: string, email: string>, config struct<materialized: string>"


def json_text(spark: SparkSession, path: str) -> DataFrame:
    """A JSON artifact as one row with the column ``value``."""
    return spark.read.text(path, wholetext=True)


def manifest_nodes(text: DataFrame) -> DataFrame:
    """unique_id, resource_type, name, relation, depends_on, attached_node, declared_owner, materialized of the nodes,
    sources and exposures of manifests (``value``)."""
    kinds = F.from_json("value", f"nodes map<string, struct<{_fields()}>>, sources map<string, struct<{_fields()}>>, exposures map<string, struct<{_fields()}>>")
    every = text.select(kinds.alias("m")).select(F.explode(F.flatten(F.array(*[F.coalesce(F.map_values(f"m.{k}"), F.array()) for k in ("nodes", "sources", "exposures")]))).alias("n")).select("n.*")
    kind = F.coalesce("resource_type", F.element_at(F.split("unique_id", r"\."), 1))
    relation = F.when(F.col("schema").isNotNull(), F.concat("schema", F.lit("."), F.coalesce("alias", "identifier", "name")))
    parents = F.filter(F.coalesce(F.col("depends_on.nodes"), F.array()), lambda p: ~p.startswith("macro."))
    return every.select("unique_id", kind.alias("resource_type"), "name", relation.alias("relation"), parents.alias("depends_on"), "attached_node", F.col("owner.name").alias("declared_owner"), F.col("config.materialized").alias("materialized"))


def _fields() -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(NODE).fields)


def run_results(text: DataFrame) -> DataFrame:
    """invocation_id, generated_at, unique_id, status, message of every result in run results (``value``)."""
    shape = "metadata struct<invocation_id: string, generated_at: string>, results array<struct<unique_id: string, status: string, message: string>>"
    rows = text.select(F.from_json("value", shape).alias("r")).select("r.metadata.*", F.explode("r.results").alias("x"))
    return rows.select("invocation_id", F.col("generated_at").cast("timestamp").alias("generated_at"), "x.unique_id", "x.status", tidy(F.col("x.message")).alias("message"))


def freshness_results(text: DataFrame) -> DataFrame:
    """The same of source freshness, with max_loaded_at and age in seconds."""
    shape = "metadata struct<invocation_id: string, generated_at: string>, results array<struct<unique_id: string, status: string, max_loaded_at: string, age: double>>"
    rows = text.select(F.from_json("value", shape).alias("r")).select("r.metadata.*", F.explode("r.results").alias("x"))
    message = F.concat(F.lit("max_loaded_at "), F.coalesce("x.max_loaded_at", F.lit("None")), F.lit(", age "), F.format_string("%.1f", F.coalesce(F.col("x.age"), F.lit(0.0)) / 3600), F.lit(" h"))
    return rows.select("invocation_id", F.col("generated_at").cast("timestamp").alias("generated_at"), "x.unique_id", "x.status", message.alias("message"))


def tidy(message: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """White space as single spaces, cut at the limit; null is empty."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " ")), 1, limit)


def test_subject(node: str = "unique_id") -> Column:
    """What a failing test is about: the model it is attached to or the source it reads, if that is its one parent; a
    test that spans models is about itself."""
    few = F.size("depends_on") <= 1
    source = F.when(F.size("depends_on") == 1, F.get("depends_on", F.lit(0)))
    return F.when(few & F.col("attached_node").isNotNull(), F.col("attached_node")).when(source.startswith("source."), source).otherwise(F.col(node))


def failures(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """check_id, check_type, subject, status, message of models that did not build and tests that failed; results of
    unknown nodes are left out."""
    rows = results.join(nodes.select("unique_id", "resource_type", "depends_on", "attached_node"), "unique_id")
    model = (F.col("resource_type") == "model") & (F.col("status") == "error")
    test = (F.col("resource_type") == "test") & F.col("status").isin(*FAILED_TESTS)
    subject = F.when(F.col("resource_type") == "test", test_subject()).otherwise(F.col("unique_id"))
    return rows.where(model | test).select(F.col("unique_id").alias("check_id"), F.col("resource_type").alias("check_type"), subject.alias("subject"), "status", "message")


def skips(results: DataFrame, nodes: DataFrame) -> DataFrame:
    return results.where("status = 'skipped'").join(nodes.select("unique_id"), "unique_id", "left_semi").select(F.col("unique_id").alias("node")).distinct()


def stale_sources(results: DataFrame) -> DataFrame:
    """The same columns as ``failures``; a warning is none."""
    rows = results.where(F.col("status").isin(*STALE))
    return rows.select(F.concat(F.lit("freshness:"), "unique_id").alias("check_id"), F.lit("freshness").alias("check_type"), F.col("unique_id").alias("subject"), "status", "message")


def merged(*parts: DataFrame) -> DataFrame:
    """One run's failures from all its parts, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def registry(spark: SparkSession, teams_yaml: str, ownership_yaml: str) -> tuple[DataFrame, DataFrame]:
    """Members (team, person) and rules (match, owner, team, tier, backup) of a registry's YAML texts. Patterns that
    stand twice are refused."""
    import yaml

    teams, datasets = (yaml.safe_load(text) or {} for text in (teams_yaml, ownership_yaml))
    members = [(t["id"], p) for t in teams.get("teams", []) for p in t.get("members", [])]
    rules = [(d["match"], d["owner"], d["team"], d.get("tier", "standard"), d.get("backup")) for d in datasets.get("datasets", [])]
    twice = sorted({r[0] for r in rules if sum(x[0] == r[0] for x in rules) > 1})
    if twice:
        raise ValueError(f"patterns that stand twice: {', '.join(twice)}")
    return spark.createDataFrame(members, "team string, person string"), spark.createDataFrame(rules, "match string, owner string, team string, tier string, backup string")


def catalogue_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, ordinal, type, scale (of decimals) of every column, from the schemas alone."""
    rows = [(t, f.name, i, f.dataType.simpleString(), getattr(f.dataType, "scale", None)) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type string, scale int")


def storage(table_name: str, rows: DataFrame) -> DataFrame:
    """table_name, files, rows, bytes of the files behind a table, from their metadata and footers."""
    files = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"))
    return files.agg(F.lit(table_name).alias("table_name"), F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"), F.sum("b").alias("bytes"))


def at_month_end(snapshots: DataFrame) -> DataFrame:
    """month, table_name, rows, bytes: of daily snapshots (day, table_name, rows, bytes) each month's last."""
    last = F.max(F.struct("day", "rows", "bytes"))
    return snapshots.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "table_name").agg(last.alias("_l")).select("month", "table_name", "_l.rows", "_l.bytes")


def catalogue(text: DataFrame) -> DataFrame:
    """table_name, column_name, type of a build's catalogue (``value``): nodes and sources with their columns."""
    entry = "map<string, struct<metadata: struct<schema: string, name: string>, columns: map<string, struct<name: string, type: string>>>>"
    found = text.select(F.from_json("value", f"nodes {entry}, sources {entry}").alias("c"))
    every = found.select(F.explode(F.flatten(F.array(*[F.coalesce(F.map_values(f"c.{k}"), F.array()) for k in ("nodes", "sources")]))).alias("n"))
    rows = every.select(F.concat_ws(".", "n.metadata.schema", "n.metadata.name").alias("table_name"), F.explode(F.map_values("n.columns")).alias("x"))
    return rows.select("table_name", F.lower("x.name").alias("column_name"), "x.type")


def table_options(spark: SparkSession, options: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """table_name, sorting_key, engine of tables, as they are built."""
    rows = [(t, ", ".join(key), engine) for t, (key, engine) in sorted(options.items())]
    return spark.createDataFrame(rows, "table_name string, sorting_key string, engine string")


def contract_problems(found: T.StructType, expected: T.StructType) -> list[str]:
    """Why rows break a contract: columns that are missing, unexpected, of another type, or null where they must not be."""
    own = {f.name: f for f in found.fields}
    out = [f"missing {f.name}" for f in expected.fields if f.name not in own]
    out += [f"unexpected {n}" for n in own if n not in expected.names]
    for f in expected.fields:
        if f.name in own and own[f.name].dataType != f.dataType:
            out.append(f"{f.name} is {own[f.name].dataType.simpleString()}")
    return sorted(out)


def contract_rows(rows: DataFrame, expected: T.StructType) -> DataFrame:
    """problem, rows: columns that must not be null and are."""
    strict = [f.name for f in expected.fields if not f.nullable and f.name in rows.columns]
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
    long = counts.select(F.explode(F.array(*[F.struct(F.concat(F.lit(c), F.lit(" is null")).alias("problem"), F.col(c).alias("rows")) for c in strict])).alias("x"))
    return long.select("x.*").where("rows > 0")
