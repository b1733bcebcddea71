"""Readers and writers of CSV, JSON and JSON lines with declared schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header row; empty cells are null; a missing path is an empty table."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, nullValue="", multiLine=False)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A list of rows, or one object as one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object a line, blanks skipped; bad lines raise, or where lenient are dropped, as is a missing path."""
    if not strict and not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_splits(spark: SparkSession, root: str, schema: StructType | str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """task/model/split.jsonl files, with these parts of the path as columns; models holding an excluded text are dropped."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root, mode="DROPMALFORMED")
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)\.jsonl$", i)
    df = df.select("*", part(1).alias("task"), part(2).alias("model"), part(3).alias("split"))
    return df.where(~has_any(F.col("model"), exclude)) if exclude else df


def read_artifacts(spark: SparkSession, root: str, schema: StructType | str, seed: int) -> DataFrame:
    """Model files of one seed below a folder, those with task, model and tau."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*__seed{seed}.json").json(root, multiLine=True)
    return df.where("task is not null and model is not null and tau is not null")


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_text(df: DataFrame, names: tuple[str, ...] = ("prompt", "text", "input", "query", "request", "task")) -> Column:
    """The first of the fields that is not empty, else all values joined by a space."""
    known = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*known, F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.csv(path, header=True, mode="overwrite")


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Without columns whose name begins with an underscore, partitioned by the columns named."""
    w = df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def markdown_report(rows: DataFrame, title: str) -> str:
    """A table as Markdown, with all its rows; they come to the driver a partition at a time."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *["| " + " | ".join(str(v) for v in r) + " |" for r in rows.toLocalIterator()]]) + "\n"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a local session that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tierwise-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, written once to a new folder that all executors share: it cuts the lineage, and later steps read it again without its work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A table from rows: lists as long as the schema or shorter (the rest is null), or dicts (missing fields are null)."""
    kind = spark.createDataFrame([], schema).schema
    full = [[r.get(n) for n in kind.names] if isinstance(r, dict) else [*r, *[None] * (len(kind) - len(r))] for r in rows]
    return spark.createDataFrame(full, kind)


def to_records(df: DataFrame) -> Iterator[dict]:
    """Rows as dicts, a partition at a time on the driver."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def with_file(df: DataFrame, root: str, name: str, task: str = "task") -> DataFrame:
    """Rows of tasks whose folder below root holds a file of this name."""
    there = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    tasks = there.select(F.element_at(F.split("path", "/"), -2).alias(task)).distinct()
    return df.join(tasks, task, "left_semi")


def audit_history(spark: SparkSession, root: str) -> DataFrame:
    """A row for each raw result file ``benchmark/run/raw/*.json``: benchmark, path, overall_status, notes; dry runs are partial."""
    df = spark.read.schema("mode string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root, multiLine=True)
    path = F.col("_metadata.file_path")
    parts, dry = F.split(path, "/"), F.coalesce(F.col("mode") == "dry_run", F.lit(False))
    named = df.select(path.alias("path"), F.element_at(parts, -4).alias("benchmark"), F.element_at(parts, -2).alias("_raw"), dry.alias("_dry")).where("_raw = 'raw'")
    return named.select("benchmark", "path", F.when(F.col("_dry"), "partial").otherwise("complete").alias("overall_status"), F.when(F.col("_dry"), F.array(F.lit("dry_run detected"))).otherwise(F.array().cast("array<string>")).alias("notes"))


def write_json(df: DataFrame, path: str) -> None:
    """One file of JSON lines, for reports of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def setup_report(task: str, seed: int | None) -> str:
    return "\n".join(["# Part A - Benchmark Setup", "", "## Task Definition", f"Task: {task}", f"Seed: {'unknown' if seed is None else seed}"])


def use_case_rows(df: DataFrame, text: str, position: str, n: int = 500) -> DataFrame:
    """The first rows of a use case, in file order, that have a text."""
    return df.where(F.trim(F.col(text)) != "").orderBy(position).limit(n)
