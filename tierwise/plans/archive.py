"""End-to-end plan of an archive: rows annotated with their difficulty, binned by task and written as JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotate
from ..operators.ordered import matched
from ..operators.relational import difficulty_bins
from ..sources.files import write_jsonl, written

#: Bins of a task with that many rows or more; one with fewer has a bin a row.
BINS = 5


def archived(rows: DataFrame, task: str, text: str, context: str) -> DataFrame:
    """Rows with difficulty_dim, difficulty_score, the features, and difficulty_bin by quantiles of the task's scores."""
    made = annotate(rows, task, text, context)
    sizes = rows.groupBy(task).agg(F.least(F.lit(BINS), F.count("*")).cast("int").alias("_bins"))
    put = written(matched(made, sizes, [task]))
    parts = [difficulty_bins(put.where(F.col("_bins") == n), "difficulty_score", [task], n).drop("_bins") for n in sorted(r["_bins"] for r in sizes.select("_bins").distinct().collect())]  # five numbers at most
    return reduce(DataFrame.unionByName, parts) if parts else put.drop("_bins").withColumn("difficulty_bin", F.lit(None).cast("int"))


def write_archive(rows: DataFrame, task: str, text: str, context: str, root: str) -> DataFrame:
    """Writes the archive, a folder ``task=<name>`` of JSON lines a task; (task, archive_path, row_count)."""
    write_jsonl(archived(rows, task, text, context), root, [task])
    there = rows.sparkSession.read.schema(f"difficulty_dim string, `{task}` string").json(root)
    path = F.concat(F.lit(f"{root.rstrip('/')}/{task}="), F.col(task))
    return there.groupBy(task).agg(F.count("*").alias("row_count")).select(task, path.alias("archive_path"), "row_count")
