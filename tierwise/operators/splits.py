"""Deterministic splits of common sample ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_name, stable_unit
from ..sources.files import written
from .fit import train_grid
from .ordered import matched
from .profiles import first_clean
from .relational import common_ids


def build_splits(df: DataFrame, task: str, model: str, sample: str, seed: str, cap: int | None = 250) -> DataFrame:
    """Ids that all of a task's models have, the first ``cap`` in order, with their split."""
    ids = common_ids(df, task, model, sample)
    if cap is not None:
        ids = ids.withColumn("_rn", F.row_number().over(Window.partitionBy(task).orderBy(sample))).where(F.col("_rn") <= cap).drop("_rn")
    return ids.withColumn("split", split_name(stable_unit(seed, F.concat_ws(":", F.col(task), F.col(sample).cast("string")))))


def label_counts(df: DataFrame, by: list[str], failed: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(~F.col(failed)).alias("fail_0"), F.count_if(F.col(failed)).alias("fail_1"))


def repair_train(assigned: DataFrame, passes: int = 3) -> DataFrame:
    """(task, sample, split): moves single ids so that every model of a task has both labels in its training rows, where it has both at all.

    assigned: task, sample (not null), split, model_order (small whole numbers), failed (null: false). Each pass visits the models in order; the first id
    outside of train with the missing label goes in, the last one of the model inside goes to val. A model without training rows moves nothing.

    A visit is one aggregate by task of the model's rows, with four extremes a task, of the tasks that lack a label somewhere; what has moved is kept apart, two
    ids a task and visit at most. So a task may have any number of ids, and only the number of models and passes sets the number of jobs.
    """
    inside, failed = F.coalesce(F.col("split") == "train", F.lit(False)), F.coalesce("failed", F.lit(False))
    rows = assigned.select("task", "sample", "split", "model_order", failed.alias("failed"))
    labels = rows.groupBy("task", "model_order").agg(F.count_distinct("failed").alias("_all"), F.count_distinct(F.when(inside, F.col("failed"))).alias("_in"))
    lacking = matched(rows, labels.where("_all = 2 AND _in = 1").select("task").distinct(), ["task"], "left_semi")
    lacking = written(lacking.select(*rows.columns))
    ends = lacking.agg(F.min("model_order").alias("first"), F.max("model_order").alias("last")).first()
    moves = None
    for _ in range(passes if ends.first is not None else 0):
        settled = True
        for order in range(ends.first, ends.last + 1):
            now = lacking.where(F.col("model_order") == order)
            swap = written(_swaps(now if moves is None else _moved(now, moves)))
            if not swap.isEmpty():
                settled, new = False, swap.select("task", F.explode(F.array(F.struct(F.col("enter").alias("sample"), F.lit("train").alias("to")), F.struct(F.col("leave").alias("sample"), F.lit("val").alias("to")))).alias("_m")).select("task", "_m.*")
                moves = written(new if moves is None else new.unionByName(moves.alias("old").join(new.alias("new"), F.expr("old.task <=> new.task AND old.sample = new.sample"), "left_anti")))
        if settled:
            break
    out = assigned.select("task", "sample", "split").distinct()
    return out if moves is None else _moved(out, moves)


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows with the split that their ids were moved to."""
    return matched(rows, moves, ["task", "sample"], "left").withColumn("split", F.coalesce("to", "split")).drop("to")


def _swaps(rows: DataFrame) -> DataFrame:
    """(task, enter, leave) of the tasks where one model's rows have one label in train and another one elsewhere."""
    inside, at = F.coalesce(F.col("split") == "train", F.lit(False)), F.col("sample")
    ends = rows.groupBy("task").agg(
        F.max(F.when(inside & F.col("failed"), at)).alias("bad_in"), F.max(F.when(inside & ~F.col("failed"), at)).alias("good_in"),
        F.min(F.when(~inside & F.col("failed"), at)).alias("bad_out"), F.min(F.when(~inside & ~F.col("failed"), at)).alias("good_out"),
    )
    enter = F.when(F.col("bad_in").isNull() & F.col("good_in").isNotNull(), F.col("bad_out")).when(F.col("bad_in").isNotNull() & F.col("good_in").isNull(), F.col("good_out"))
    return ends.select("task", enter.alias("enter"), F.coalesce("bad_in", "good_in").alias("leave")).where("enter IS NOT NULL")


def build_clean_splits(rows: DataFrame, ranks: dict[str, int], seed: str = "42", cap: int | None = 250) -> tuple[DataFrame, DataFrame]:
    """Splits of a task's common ids and their label counts by model and split.

    rows: task, model, canonical_id, file, line, failed. The first row of an id counts, by the rank of its file; ids that all models
    have are split by a stable hash and repaired, so that training rows hold both labels where there are both.
    """
    first = first_clean(rows, ranks)
    order = F.row_number().over(Window.partitionBy("task").orderBy("model")).alias("model_order")
    split = build_splits(first, "task", "model", "canonical_id", seed, cap)
    labelled = first.join(split, ["task", "canonical_id"]).select("task", F.col("canonical_id").alias("sample"), "split", "model", "failed")
    models = labelled.select("task", "model").distinct().select("task", "model", order)
    labelled = written(labelled.join(models, ["task", "model"]))
    repaired = repair_train(labelled)
    counts = label_counts(labelled.drop("split").join(repaired, ["task", "sample"]), ["task", "model", "split"], "failed")
    return repaired, counts


# Name parts that select the features of an ablation; None keeps all but those named.
ABLATIONS = {
    "all_features": ("",),
    "no_embedding": None,
    "lexical_surface": ("token", "ratio", "density", "reading", "grade", "fog", "smog"),
    "retrieval_context": ("context", "query", "bm25", "compression", "embedding"),
    "syntax_entities": ("noun", "verb", "adj", "dep_tree", "entity", "imperative"),
}


def ablated(features: list[str], name: str) -> list[str]:
    """Features of an ablation; all of them where none is left."""
    parts = ABLATIONS[name]
    kept = [f for f in features if (f != "embedding_query_context_cosine" if parts is None else any(p in f for p in parts))]
    return kept or list(features)


def ablation_models(train: DataFrame, val: DataFrame, by: list[str], features: list[str], label: str, strengths: tuple[float, ...] = (1.0,)) -> DataFrame:
    """train_grid of balanced fits for each ablation, all in the same passes: (by, ablation, c, weights, bias, mean, scale, f1, tau).

    A feature that an ablation leaves out is 0 in all of its rows, so its weight stays 0. Weights are in the order of the features.
    """

    def each(df: DataFrame) -> DataFrame:
        rows = df.withColumn("ablation", F.explode(F.array(*[F.lit(a) for a in ABLATIONS])))
        left_out = {f: [a for a in ABLATIONS if f not in ablated(features, a)] for f in features}
        return rows.withColumns({f: F.when(F.col("ablation").isin(*away), 0.0).otherwise(F.col(f)) if away else F.col(f) for f, away in left_out.items()})

    # The features may be costly, and every step of a fit reads them.
    held = [written(x.select(*by, *features, label)) for x in (train, val)]
    return train_grid(each(held[0]), each(held[1]), [*by, "ablation"], features, label, strengths, balanced=True)
