"""Sinks that are there in full or not at all, single documents, run logs and exported contracts; by the file system of the path."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import utc_text


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system, local or remote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def write_document(spark: SparkSession, path: str, payload: object) -> None:
    """One JSON document in UTF-8 with two spaces of indentation, put in place by a rename, so that no reader sees half of it."""
    body = bytearray((json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode())
    draft, files = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(draft, True)
    try:
        stream.write(body)
    finally:
        stream.close()
    _put(spark, draft.toString(), path)


def _put(spark: SparkSession, draft: str, path: str) -> None:
    """Renames ``draft`` to ``path``; what was there is set aside first, and put back if the rename fails."""
    new, files = _files(spark, draft)
    old, aside = _files(spark, path)[0], _files(spark, f"{path}.{uuid.uuid4().hex}.old")[0]
    had = files.exists(old)
    if had and not files.rename(old, aside):
        raise OSError(f"{path} cannot be set aside")
    if not files.rename(new, old):
        if had:
            files.rename(aside, old)
        raise OSError(f"{path} cannot be put in place")
    if had:
        files.delete(aside, True)


def replace_table(rows: DataFrame, path: str) -> None:
    """A Parquet table written beside its place and then renamed: the old table stays readable until the new one is complete."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    rows.write.parquet(draft)
    _put(rows.sparkSession, draft, path)


def commit_all(tables: dict[str, DataFrame]) -> None:
    """Several tables, all or none: all are written beside their places before the first is renamed.

    If a rename fails, those before it are put back; a reader may see some new and some old tables only between two renames.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    mark = uuid.uuid4().hex
    place = lambda path, kind: _files(spark, f"{path}.{mark}.{kind}")[0]
    done: list[tuple[str, bool]] = []
    try:
        for path, rows in tables.items():
            rows.write.parquet(f"{path}.{mark}.tmp")
        for path in tables:
            old, files = _files(spark, path)
            had = files.exists(old)
            if had and not files.rename(old, place(path, "old")):
                raise OSError(f"{path} cannot be set aside")
            done.append((path, had))
            if not files.rename(place(path, "tmp"), old):
                raise OSError(f"{path} cannot be put in place")
    except Exception:
        for path, had in reversed(done):
            old, files = _files(spark, path)
            if had:
                files.delete(old, True)
                files.rename(place(path, "old"), old)
        raise
    else:
        for path, had in done:
            if had:
                _files(spark, path)[1].delete(place(path, "old"), True)
    finally:
        for path in tables:
            _files(spark, path)[1].delete(place(path, "tmp"), True)


def record_run(spark: SparkSession, path: str, run_id: str, status: str, fields: dict[str, str] | None = None) -> None:
    """Appends one event of a run (with the time) to its log; ``current_runs`` folds the log. Nothing is updated in place."""
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), utc_text(F.current_timestamp()).alias("at"), F.lit(uuid.uuid4().hex).alias("event"),
        F.lit(json.dumps(fields or {}, ensure_ascii=False, sort_keys=True)).alias("fields"),
    )
    row.write.mode("append").parquet(path)


def current_runs(log: DataFrame) -> DataFrame:
    """The last event of each run and when its first was."""
    return log.groupBy("run_id").agg(F.max_by("status", F.struct("at", "event")).alias("status"), F.max_by("fields", F.struct("at", "event")).alias("fields"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def jdbc_runs(spark: SparkSession, url: str, table: str, limit: int = 50, status: Column | None = None, **options: str) -> DataFrame:
    """The latest runs of a database's table, newest first; filter and limit are pushed down. ``limit`` is held to 1 to 1000."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    rows = rows if status is None else rows.where(status)
    return rows.orderBy(F.desc("created_at"), "run_id").limit(min(1000, max(1, limit)))


def export_schemas(spark: SparkSession, schemas: dict[str, T.StructType], folder: str) -> None:
    """A JSON Schema document for each contract, ``folder/name.json``."""
    for name, schema in sorted(schemas.items()):
        write_document(spark, f"{folder}/{name}.json", {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, **json_schema(schema)})


def json_schema(kind: T.DataType) -> dict:
    """The JSON Schema of a Spark type; a field that may be null is not required."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, T.NumericType):
        return {"type": "number"}
    return {"type": "string", "format": "date-time"} if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else {"type": "string"}
