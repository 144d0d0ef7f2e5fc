"""Feature tables, targets, spatial folds, priors and baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.geo import block_id
from stratalake.operators.knn import knn
from stratalake.operators.normalize import SAFE_COLUMNS, guard_features, sanity_gate
from stratalake.storage import stored


def union_nodes(borings: DataFrame, labels: DataFrame) -> DataFrame:
    """Both kinds of points in one table; columns that one lacks are null."""
    return borings.withColumn("node_type", F.lit("boring")).unionByName(labels.withColumn("node_type", F.lit("label")), allowMissingColumns=True)


def label_family(label: Column) -> Column:
    """Leading letters of a code, else '?'."""
    return F.coalesce(F.nullif(F.regexp_extract(label, "^[A-Za-z]+", 0), F.lit("")), F.lit("?"))


def vocabulary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, idx): sorted distinct non-empty values from 2 on; 0 is missing, 1 unknown."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("e")).select("e.*")
    values = long.where("value IS NOT NULL AND value <> ''").distinct()
    return values.withColumn("idx", (F.row_number().over(Window.partitionBy("column").orderBy("value")) + 1).cast("int"))


def encode(rows: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with c_idx for each column."""
    for c in columns:
        known = vocab.where(F.col("column") == c).select(F.col("value").alias(c), F.col("idx").alias("_i"))
        rows = rows.join(known, c, "left").withColumn(f"{c}_idx", F.when(F.col(c).isNull() | (F.col(c) == ""), 0).otherwise(F.coalesce("_i", F.lit(1))).cast("int")).drop("_i")
    return rows


def feature_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) over present values; a spread of 0 is 1."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    return long.groupBy("column").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(F.stddev_pop("v"), F.lit(0.0)), F.lit(1.0)).alias("std"))


def standardized(rows: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """``rows`` with c_std (0 where missing) and c_mask; statistics over all rows or those of ``fit_on``."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    stats = (rows if fit_on is None else rows.where(fit_on)).agg(*aggs)
    out = rows.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        z = (F.col(c) - F.coalesce(f"_m_{c}", F.lit(0.0))) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumns({f"{c}_std": F.coalesce(z, F.lit(0.0)), f"{c}_mask": F.col(c).isNotNull().cast("int")})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


FREQUENCIES = (0.5, 1.0, 2.0, 4.0, 8.0)


def node_numeric(nodes: DataFrame) -> DataFrame:
    """23 numbers of (id, x, y, elevation): position over one shared scale, elevation z-score, sines and cosines."""
    stats = nodes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("elevation").alias("me"), F.stddev_pop("elevation").alias("se"))
    scale = F.coalesce(F.nullif(F.greatest("sx", "sy"), F.lit(0.0)), F.lit(1.0))
    rows = nodes.crossJoin(F.broadcast(stats))  # one row
    rows = rows.select("id", ((F.col("x") - F.col("mx")) / scale).alias("x_n"), ((F.col("y") - F.col("my")) / scale).alias("y_n"), F.coalesce((F.col("elevation") - F.col("me")) / F.coalesce(F.nullif(F.col("se"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("elev_n"), F.col("elevation").isNotNull().cast("int").alias("elev_mask"))
    waves = [f(F.col(c) * k).alias(f"{name}_{c[0]}_{i}") for i, k in enumerate(FREQUENCIES) for c in ("x_n", "y_n") for name, f in (("sin", F.sin), ("cos", F.cos))]
    return rows.select("*", *waves)


def fourier_depth(rows: DataFrame, column: str = "depth_std", octaves: int = 6) -> DataFrame:
    return rows.select("*", *[f(F.col(column) * float(2**k)).alias(f"{name}_{k}") for k in range(octaves) for name, f in (("sin", F.sin), ("cos", F.cos))])


def class_ids(rows: DataFrame, column: str) -> DataFrame:
    """(column, class_id): sorted distinct values from 0 on."""
    values = rows.where(F.col(column).isNotNull()).select(column).distinct()
    return values.withColumn("class_id", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def label_targets(labels: DataFrame) -> DataFrame:
    """(objectid, y_code, y_family, y_drainage): sorted class ids, null where there is no value."""
    rows = labels.select("objectid", "primary_label", label_family(F.col("primary_label")).alias("family"), "drainage")
    for c, y in (("primary_label", "y_code"), ("family", "y_family"), ("drainage", "y_drainage")):
        rows = rows.join(class_ids(rows, c).withColumnRenamed("class_id", y), c, "left")
    return rows.select("objectid", "y_code", "y_family", "y_drainage")


def near_surface_class(strata: DataFrame) -> DataFrame:
    """Per boring the class of its topmost interval that has one."""
    w = Window.partitionBy("boring_id").orderBy(F.asc_nulls_last("top_depth"), "interval_index")
    return strata.where("uscs_class IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("boring_id", "uscs_class")


def block_summary(nodes: DataFrame, size: float) -> DataFrame:
    """(block, n, dominant) of (id, x, y, class_id): size and most frequent class of each block, ties to the smaller."""
    rows = nodes.withColumn("block", block_id(F.col("x"), F.col("y"), size))
    counts = rows.groupBy("block", "class_id").count()
    best = Window.partitionBy("block").orderBy(F.col("class_id").isNull(), F.desc("count"), "class_id")
    top = counts.withColumn("_n", F.row_number().over(best)).withColumn("n", F.sum("count").over(Window.partitionBy("block"))).where("_n = 1")
    return top.select("block", "n", F.col("class_id").alias("dominant"))


def _place(folds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, classes, out = [0] * folds, {}, []
        for block, rows in sorted(pdf.groupby("block"), key=lambda g: (-int(g[1]["count"].sum()), int(g[1]["draw"].iloc[0]))):
            known = rows[rows["class_id"].notna()].sort_values(["count", "class_id"], ascending=[False, True])
            seen = classes.setdefault(int(known["class_id"].iloc[0]), [0] * folds) if len(known) else [0] * folds
            fold = min(range(folds), key=lambda f: (seen[f], sizes[f], f))
            sizes[fold] += int(rows["count"].sum())
            for r in known.itertuples():
                classes.setdefault(int(r.class_id), [0] * folds)[fold] += int(r.count)
            out.append((block, fold))
        return pd.DataFrame(out, columns=["block", "fold"])

    return run


def spatial_kfold(nodes: DataFrame, size: float = 20000.0, folds: int = 5, seed: int = 1337, most: int = 1_000_000) -> DataFrame:
    """(id, block, fold): whole blocks, largest first, to the fold with fewest of their dominant class, then smallest.

    The greedy pass sees the block summary only: one row per block and class, whose number follows the area and
    not the number of nodes.  The pass is one task, so a summary of over ``most`` rows is an error: choose larger blocks.
    """
    rows = nodes.withColumn("block", block_id(F.col("x"), F.col("y"), size))
    counts = stored(rows.groupBy("block", "class_id").count().withColumn("draw", F.xxhash64("block", F.lit(seed))), "blocks")
    if counts.count() > most:
        raise ValueError("too many blocks for one greedy pass: choose a larger size")
    placed = counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_place(folds), "block long, fold int")
    return rows.join(placed, "block").select("id", "block", "fold")


def fold_roles(assigned: DataFrame, folds: int = 5) -> DataFrame:
    """(id, run, role) for each run: its fold is the test, the next one validates, the rest trains."""
    rows = assigned.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("fold") == F.col("run"), "test").when(F.col("fold") == (F.col("run") + 1) % folds, "val").otherwise("train")
    return rows.select("id", "run", role.alias("role"))


def geology_prior(train: DataFrame, alpha: float = 2.0, weight: float = 1.0) -> DataFrame:
    """(unit, class_id, logit): log of class shares per unit shrunk to the global ones, centred per unit.

    The row of a null unit is the global one, for units that the training rows do not have.
    """
    labelled = train.where("class_id IS NOT NULL").select(F.coalesce("unit", F.lit("")).alias("unit"), "class_id")
    counts = labelled.groupBy("unit", "class_id").count()
    per_class = counts.groupBy("class_id").agg(F.sum("count").alias("all"))
    everything = Window.partitionBy()
    base = per_class.select("class_id", ((F.col("all") + alpha) / (F.sum("all").over(everything) + alpha * F.count(F.lit(1)).over(everything))).alias("p"), F.count(F.lit(1)).over(everything).alias("classes"))
    # units x classes rows is the result itself
    units = counts.groupBy("unit").agg(F.sum("count").alias("n"))
    grid = units.join(F.broadcast(base), F.lit(True)).join(counts, ["unit", "class_id"], "left")
    shrunk = (F.coalesce("count", F.lit(0)) + alpha * F.col("p") * F.col("classes")) / (F.col("n") + alpha * F.col("classes"))
    rows = grid.select("unit", "class_id", F.ln(shrunk).alias("l")).unionByName(base.select(F.lit(None).cast("string").alias("unit"), "class_id", F.ln("p").alias("l")))
    return rows.select("unit", "class_id", (weight * (F.col("l") - F.avg("l").over(Window.partitionBy("unit")))).alias("logit"))


def class_weights(rows: DataFrame, beta: float = 0.99) -> DataFrame:
    """(class_id, weight): effective-number weights with mean 1."""
    raw = rows.where("class_id IS NOT NULL").groupBy("class_id").count().withColumn("w", (1 - beta) / (1 - F.pow(F.lit(beta), F.col("count"))))
    return raw.select("class_id", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("weight"))


def sample_admission(strata: DataFrame) -> DataFrame:
    return strata.where("top_depth IS NOT NULL AND (spt_n IS NOT NULL OR uscs_class IS NOT NULL)")


def depth_targets(strata: DataFrame) -> DataFrame:
    """Admitted and gated intervals with log blow count; all other columns stay."""
    return sanity_gate(sample_admission(strata)).withColumn("y_spt_log", F.log1p("spt_n"))


def depth_samples(derived: DataFrame) -> DataFrame:
    """Admitted and gated samples of intervals with their properties (``derive`` with top_depth, spt_n and uscs_class): log blow count, standardised depth and physics inputs with masks."""
    guard_features(list(SAFE_COLUMNS))
    rows = depth_targets(derived).select("boring_id", "interval_index", F.col("top_depth").alias("depth"), "y_spt_log", "uscs_class", *SAFE_COLUMNS)
    # read for the statistics and for the rows
    rows = standardized(stored(rows, "depth-inputs"), ["depth", *SAFE_COLUMNS])
    return rows.select("boring_id", "interval_index", "depth", "depth_std", "y_spt_log", "uscs_class", *[f"{c}_{k}" for c in SAFE_COLUMNS for k in ("std", "mask")])


def nearest_label_vote(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(qid, class_id, share): soft vote of the k nearest labelled training points (id, x, y, class_id)."""
    near = knn(queries, train, k).join(train.select("id", "class_id"), "id")
    votes = near.groupBy("qid", "class_id").agg((F.count(F.lit(1)) / k).alias("share"))
    return votes


def depth_mean_baseline(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """(run, mu, sigma): mean and spread of the training targets."""
    return samples.join(roles.where("role = 'train'"), "id").groupBy("run").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sigma"))


def posterior_combine(draws: DataFrame) -> DataFrame:
    """(row_id, mu, var) over draws (row_id, draw, mu, var): mean, and mean variance plus the variance of means."""
    return draws.groupBy("row_id").agg(F.avg("mu").alias("mu"), (F.avg("var") + F.coalesce(F.var_samp("mu"), F.lit(0.0))).alias("var"))


def posterior_classes(draws: DataFrame) -> DataFrame:
    """(row_id, class_id, p): mean class probability over draws (row_id, draw, class_id, p)."""
    return draws.groupBy("row_id", "class_id").agg(F.avg("p").alias("p"))
