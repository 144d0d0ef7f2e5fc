"""Registered queries: features, targets, folds, priors, baselines, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.operators import ensembles, evaluate, features, graph, metrics, profile
from stratalake.operators.normalize import SAFE_COLUMNS
from stratalake.plans.fixtures import Tables
from stratalake.plans.registry import query
from stratalake.plans.soils import _DERIVED
from stratalake.plans.spatial import _LAB, _PTS, _near, covariates, graph_labels, graph_points, union_points, union_edges
from stratalake.storage import stored


@query("union_nodes", """SELECT 'boring' AS node_type, boring_id, CAST(NULL AS BIGINT) AS label_id, x_ft, y_ft, CAST(NULL AS VARCHAR) AS primary_label FROM borings
    UNION ALL SELECT 'label', NULL, objectid, x_ft, y_ft, primary_label FROM soil_labels""")
def union_nodes(t: Tables) -> DataFrame:
    labels = t.soil_labels.select(F.col("objectid").alias("label_id"), "x_ft", "y_ft", "primary_label")
    return features.union_nodes(t.borings.select("boring_id", "x_ft", "y_ft"), labels).select("node_type", "boring_id", "label_id", "x_ft", "y_ft", "primary_label")


@query("label_family", "SELECT objectid, coalesce(nullif(regexp_extract(primary_label, '^[A-Za-z]+'), ''), '?') AS family FROM soil_labels")
def label_family(t: Tables) -> DataFrame:
    return t.soil_labels.select("objectid", features.label_family(F.col("primary_label")).alias("family"))


@query("vocab_encode", """WITH v AS (SELECT DISTINCT primary_label AS value FROM soil_labels WHERE objectid % 4 <> 0 AND primary_label <> ''), i AS (SELECT value, CAST(row_number() OVER (ORDER BY value) + 1 AS INT) AS idx FROM v),
    w AS (SELECT DISTINCT drainage AS value FROM soil_labels WHERE objectid % 4 <> 0 AND drainage <> ''), j AS (SELECT value, CAST(row_number() OVER (ORDER BY value) + 1 AS INT) AS idx FROM w)
    SELECT objectid, CASE WHEN primary_label IS NULL OR primary_label = '' THEN 0 ELSE coalesce(i.idx, 1) END AS primary_label_idx, CASE WHEN drainage IS NULL OR drainage = '' THEN 0 ELSE coalesce(j.idx, 1) END AS drainage_idx
    FROM soil_labels LEFT JOIN i ON i.value = primary_label LEFT JOIN j ON j.value = drainage""")
def vocab_encode(t: Tables) -> DataFrame:
    columns = ["primary_label", "drainage"]
    vocab = features.vocabulary(t.soil_labels.where("objectid % 4 <> 0"), columns)
    return features.encode(t.soil_labels, vocab, columns).select("objectid", "primary_label_idx", "drainage_idx")


@query("feature_stats", """SELECT 'x_ft' AS "column", round(avg(x_ft), 6) AS mean, round(stddev_pop(x_ft), 6) AS std FROM borings UNION ALL SELECT 'lat', round(avg(lat), 6), round(stddev_pop(lat), 6) FROM borings""")
def feature_stats(t: Tables) -> DataFrame:
    return features.feature_stats(t.borings, ["x_ft", "lat"])


_WAVES = ", ".join(f"round({f}({c}_n * {k!r}e0), 6) + 0e0 AS {f}_{c}_{i}" for i, k in enumerate(features.FREQUENCIES) for c in "xy" for f in ("sin", "cos"))


@query("node_numeric_features", f"""WITH n AS (SELECT boring_id AS id, x_ft AS x, y_ft AS y, elevation_m AS e FROM borings LEFT JOIN dem_samples USING (boring_id)), s AS (SELECT avg(x) AS mx, avg(y) AS my, greatest(stddev_pop(x), stddev_pop(y)) AS sc, avg(e) AS me, stddev_pop(e) AS se FROM n),
    z AS (SELECT id, (x - mx) / sc AS x_n, (y - my) / sc AS y_n, coalesce((e - me) / se, 0) AS elev_n, (e IS NOT NULL)::INT AS elev_mask FROM n, s)
    SELECT id, round(x_n, 6) AS x_n, round(y_n, 6) AS y_n, round(elev_n, 6) AS elev_n, elev_mask, {_WAVES} FROM z""")
def node_numeric_features(t: Tables) -> DataFrame:
    nodes = t.borings.join(t.dem_samples, "boring_id", "left").select(F.col("boring_id").alias("id"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), F.col("elevation_m").alias("elevation"))
    return features.node_numeric(nodes)


@query("label_targets", """WITH l AS (SELECT *, coalesce(nullif(regexp_extract(primary_label, '^[A-Za-z]+'), ''), '?') AS family FROM soil_labels)
    SELECT objectid, CAST(dense_rank() OVER (ORDER BY primary_label) - 1 AS INT) AS y_code, CAST(dense_rank() OVER (ORDER BY family) - 1 AS INT) AS y_family, CASE WHEN drainage IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY drainage NULLS LAST) - 1 AS INT) END AS y_drainage FROM l""")
def label_targets(t: Tables) -> DataFrame:
    return features.label_targets(t.soil_labels)


@query("near_surface_class", "SELECT boring_id, uscs_class FROM (SELECT *, row_number() OVER (PARTITION BY boring_id ORDER BY top_depth NULLS LAST, interval_index) AS k FROM strata WHERE uscs_class IS NOT NULL) WHERE k = 1")
def near_surface_class(t: Tables) -> DataFrame:
    return features.near_surface_class(t.strata)


def class_nodes(t: Tables) -> DataFrame:
    """Labels as (id, x, y, class_id, unit)."""
    ids = features.class_ids(t.soil_labels, "drainage")
    rows = t.soil_labels.join(ids, "drainage", "left")
    return rows.select(F.col("objectid").cast("string").alias("id"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), "class_id", F.col("primary_label").alias("unit"))


_CLASS = "SELECT CAST(objectid AS VARCHAR) AS id, x_ft AS x, y_ft AS y, CASE WHEN drainage IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY drainage NULLS LAST) - 1 AS INT) END AS class_id, primary_label AS unit FROM soil_labels"


@query("block_dominant_class", f"""WITH c AS (SELECT CAST(floor(x / 20000) * 1000003 + floor(y / 20000) AS BIGINT) AS block, class_id, count(*) AS n FROM ({_CLASS}) AS n GROUP BY block, class_id)
    SELECT block, CAST(sum(n) OVER (PARTITION BY block) AS BIGINT) AS n, class_id AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY block ORDER BY class_id IS NULL, n DESC, class_id) = 1""")
def block_dominant_class(t: Tables) -> DataFrame:
    return features.block_summary(class_nodes(t), 20000.0)


@query("spatial_kfold")
def spatial_kfold(t: Tables) -> DataFrame:
    return features.spatial_kfold(class_nodes(t))


@query("fold_roles", "SELECT CAST(objectid AS VARCHAR) AS id, run, CASE WHEN objectid % 5 = run THEN 'test' WHEN objectid % 5 = (run + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM (SELECT objectid, CAST(unnest(range(5)) AS INT) AS run FROM soil_labels)")
def fold_roles(t: Tables) -> DataFrame:
    return features.fold_roles(t.soil_labels.select(F.col("objectid").cast("string").alias("id"), (F.col("objectid") % 5).cast("int").alias("fold")))


@query("geology_prior", f"""WITH tr AS (SELECT * FROM ({_CLASS}) AS n WHERE CAST(id AS INT) % 3 <> 0 AND class_id IS NOT NULL), k AS (SELECT count(DISTINCT class_id) AS c, count(*) AS n FROM tr), g AS (SELECT class_id, (count(*) + 2e0) / (max(n) + 2e0 * max(c)) AS p FROM tr, k GROUP BY class_id),
    u AS (SELECT unit, count(*) AS n FROM tr GROUP BY unit), uc AS (SELECT unit, class_id, count(*) AS m FROM tr GROUP BY unit, class_id),
    l AS (SELECT u.unit, g.class_id, ln((coalesce(m, 0) + 2e0 * p * c) / (u.n + 2e0 * c)) AS l FROM u CROSS JOIN g CROSS JOIN k LEFT JOIN uc ON uc.unit = u.unit AND uc.class_id = g.class_id UNION ALL SELECT NULL, class_id, ln(p) FROM g)
    SELECT unit, class_id, round(l - avg(l) OVER (PARTITION BY unit), 6) AS logit FROM l""")
def geology_prior(t: Tables) -> DataFrame:
    return features.geology_prior(class_nodes(t).where("CAST(id AS INT) % 3 <> 0"))


@query("class_weights", f"WITH c AS (SELECT class_id, (1 - 0.99e0) / (1 - pow(0.99e0, count(*))) AS w FROM ({_CLASS}) AS n WHERE class_id IS NOT NULL GROUP BY class_id) SELECT class_id, round(w / avg(w) OVER (), 6) AS weight FROM c")
def class_weights(t: Tables) -> DataFrame:
    return features.class_weights(class_nodes(t))


_STD = ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 0), 6) + 0e0 AS {c}_std, ({c} IS NOT NULL)::INT AS {c}_mask" for c in SAFE_COLUMNS)
_SAMPLES = f"""WITH {_DERIVED}, s AS (SELECT a.boring_id, a.interval_index, top_depth AS depth, CASE WHEN a.spt_n BETWEEN 0 AND 100 THEN ln(1 + a.spt_n) END AS y, a.uscs_class, {', '.join('d.' + c for c in SAFE_COLUMNS)}
    FROM strata AS a LEFT JOIN derived AS d USING (boring_id, interval_index) WHERE top_depth BETWEEN 0 AND 200 AND (a.spt_n IS NOT NULL OR a.uscs_class IS NOT NULL))"""


def derived_strata(t: Tables) -> DataFrame:
    """Properties of all intervals beside what makes them samples."""
    return profile.derive(t.strata, also=("top_depth", "spt_n", "uscs_class"))


@query("depth_samples", f"{_SAMPLES} SELECT boring_id, interval_index, depth, round((depth - avg(depth) OVER ()) / stddev_pop(depth) OVER (), 6) + 0e0 AS depth_std, round(y, 6) AS y_spt_log, uscs_class, {_STD} FROM s")
def depth_samples(t: Tables) -> DataFrame:
    return features.depth_samples(derived_strata(t))


@query("fourier_depth", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({f}(q * {2.0**k!r}e0), 6) + 0e0 AS {f}_{k}" for k in range(6) for f in ("sin", "cos")) + " FROM (SELECT *, (l_quantity - 25) / 10 AS q FROM lineitem)")
def fourier_depth(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") - 25) / 10).alias("q"))
    return features.fourier_depth(rows, "q").drop("q")


_TRAIN = f"SELECT * FROM ({_CLASS}) AS n WHERE class_id IS NOT NULL AND CAST(id AS INT) % 3 <> 0"


@query("nearest_label_vote", f"WITH tr AS ({_TRAIN}), {_near('nn', _PTS, 'SELECT * FROM tr', 5, False)} SELECT qid, class_id, round(count(*) / 5e0, 6) AS share FROM nn JOIN tr USING (id) GROUP BY qid, class_id")
def nearest_label_vote(t: Tables) -> DataFrame:
    return features.nearest_label_vote(graph_points(t), class_nodes(t).where("class_id IS NOT NULL AND CAST(id AS INT) % 3 <> 0"))


@query("depth_mean_baseline", f"{_SAMPLES}, r AS (SELECT unnest(range(5)) AS run) SELECT CAST(run AS INT) AS run, round(avg(y), 6) AS mu, round(stddev_pop(y), 6) AS sigma FROM s JOIN r ON interval_index % 5 <> run AND interval_index % 5 <> (run + 1) % 5 GROUP BY run")
def depth_mean_baseline(t: Tables) -> DataFrame:
    samples = features.depth_targets(t.strata).select(F.col("interval_index").alias("id"), F.col("y_spt_log").alias("y"))
    roles = features.fold_roles(samples.select("id", (F.col("id") % 5).alias("fold")).distinct())
    return features.depth_mean_baseline(samples, roles)


@query("posterior_combine", "WITH d AS (SELECT vec_id, CAST(embedding[k] AS DOUBLE) AS mu, abs(CAST(embedding[k + 30] AS DOUBLE)) AS v FROM (SELECT *, unnest(range(1, 31)) AS k FROM embeddings)) SELECT vec_id AS row_id, round(avg(mu), 6) AS mu, round(avg(v) + var_samp(mu), 6) AS var FROM d GROUP BY vec_id")
def posterior_combine(t: Tables) -> DataFrame:
    mu = F.col("embedding")
    draws = t.embeddings.select(F.col("vec_id").alias("row_id"), F.posexplode(F.slice(mu, 1, 30)).alias("draw", "m"), mu.alias("e"))
    draws = draws.select("row_id", "draw", F.col("m").cast("double").alias("mu"), F.abs(F.get("e", F.col("draw") + 30).cast("double")).alias("var"))
    return features.posterior_combine(draws)


@query("posterior_classes", """WITH s AS (SELECT vec_id, d, unnest(range(10)) AS c, exp(CAST(embedding[d * 10 + unnest(range(10)) + 1] AS DOUBLE)) AS e FROM (SELECT *, unnest(range(6)) AS d FROM embeddings)), p AS (SELECT vec_id, d, c, e / sum(e) OVER (PARTITION BY vec_id, d) AS p FROM s)
    SELECT vec_id AS row_id, CAST(c AS INT) AS class_id, round(avg(p), 6) AS p FROM p GROUP BY vec_id, c""")
def posterior_classes(t: Tables) -> DataFrame:
    part = t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("draw"))
    logits = F.transform(F.slice("embedding", F.col("draw") * 10 + 1, F.lit(10)), lambda v: F.exp(v.cast("double")))
    rows = part.withColumn("e", logits).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    draws = rows.select("row_id", "draw", "total", F.posexplode("e").alias("class_id", "v")).select("row_id", "draw", "class_id", (F.col("v") / F.col("total")).alias("p"))
    return features.posterior_classes(draws)


# --- metrics ----------------------------------------------------------------------------------------------
def class_predictions(t: Tables) -> DataFrame:
    """(row_id, fold, y, probs): softmax of the first ten dimensions, rounded so that sums cannot decide ties."""
    e = F.transform(F.slice("scores", 1, 10), lambda v: F.exp(v.cast("double") * 3))
    rows = t.class_predictions.withColumn("e", e).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    return rows.select("row_id", "fold", "y", F.transform("e", lambda v: F.round(v / F.col("total"), 9)).alias("probs"))


_PRED = """e AS (SELECT row_id, fold, y, list_transform(scores[1:10], lambda v: exp(CAST(v AS DOUBLE) * 3)) AS e FROM class_predictions), f AS (SELECT row_id, fold, y, list_transform(e, lambda v: round(v / list_sum(e), 9)) AS probs FROM e),
    p AS (SELECT *, list_max(probs) AS conf, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred FROM f)"""


@query("classification_metrics", f"""WITH {_PRED}, b AS (SELECT y AS c, 1 AS t, 0 AS q, (pred = y)::INT AS h FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p), c AS (SELECT c, sum(t) AS t, sum(q) AS q, sum(h) AS h FROM b GROUP BY c)
    SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((pred = y)::INT) FROM p), 6) AS accuracy, round((SELECT avg(2 * h / (t + q)) FROM c), 6) AS macro_f1, round((SELECT avg(h / t) FROM c WHERE t > 0), 6) AS balanced_accuracy,
        round((SELECT avg((k < 3)::INT) FROM (SELECT len(list_filter(probs, lambda v: v > probs[y + 1])) + len(list_filter(probs[1:y], lambda v: v = probs[y + 1])) AS k FROM p)), 6) AS top3_accuracy""")
def classification_metrics(t: Tables) -> DataFrame:
    return metrics.classification_metrics(class_predictions(t))


@query("nll", f"WITH {_PRED} SELECT round(avg(-ln(greatest(least(probs[y + 1], 1e0), 1e-9))), 6) AS nll FROM p")
def nll(t: Tables) -> DataFrame:
    return metrics.nll(class_predictions(t))


_CURVE = f"WITH {_PRED}, c AS (SELECT CAST(ceil(conf * 15) AS INT) AS bin, count(*) AS n, avg(conf) AS confidence, avg((pred = y)::INT) AS accuracy FROM p GROUP BY ceil(conf * 15))"


@query("reliability_curve", f"{_CURVE} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM c")
def reliability_curve(t: Tables) -> DataFrame:
    return metrics.reliability_curve(class_predictions(t))


@query("ece", f"{_CURVE} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM c")
def ece(t: Tables) -> DataFrame:
    return metrics.ece(class_predictions(t))


@query("uncertainty_auroc", f"""WITH {_PRED}, u AS (SELECT round(list_sum(list_transform(probs, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END)), 12) AS u, pred <> y AS w FROM p), r AS (SELECT *, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2e0 AS r FROM u)
    SELECT round((sum(r) FILTER (WHERE w) - count_if(w) * (count_if(w) + 1) / 2e0) / (count_if(w) * count_if(NOT w)), 6) AS auroc FROM r""")
def uncertainty_auroc(t: Tables) -> DataFrame:
    return metrics.uncertainty_auroc(class_predictions(t))


@query("regression_metrics", """SELECT count(*) AS n, round(sqrt(avg(pow(mu - y, 2))), 6) AS rmse, round(avg(abs(mu - y)), 6) AS mae, round(avg((abs(mu - y) <= 1.6449e0 * sigma)::INT), 6) AS cov90,
    round(sqrt(avg(pow(exp(mu) - exp(y), 2))), 6) AS rmse_blows, round(avg(abs(exp(mu) - exp(y))), 6) AS mae_blows FROM reg_predictions""")
def regression_metrics(t: Tables) -> DataFrame:
    return metrics.regression_metrics(t.reg_predictions)


@query("gaussian_crps", f"SELECT round(avg({metrics.crps_sql('mu', 'sigma', 'y')}), 6) AS crps FROM reg_predictions")
def gaussian_crps(t: Tables) -> DataFrame:
    return metrics.gaussian_crps(t.reg_predictions)


_RESULTS = """SELECT CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END AS method, l_orderkey % 5 AS fold, l_linestatus AS metric, avg(l_discount) AS value FROM {t} GROUP BY 1, 2, 3
    UNION ALL SELECT 'a', 7, 'F', CAST('NaN' AS DOUBLE)"""
_RESULTS_SQL = _RESULTS.replace("{t}", "lineitem")


def fold_results(t: Tables) -> DataFrame:
    return t.spark.sql(_RESULTS, t=t.lineitem)


@query("cv_mean", f"SELECT method, metric, round(avg(value), 6) AS value FROM ({_RESULTS_SQL}) AS r WHERE NOT isnan(value) GROUP BY method, metric")
def cv_mean(t: Tables) -> DataFrame:
    return metrics.cv_mean(fold_results(t))


@query("fold_wins", f"WITH r AS ({_RESULTS_SQL}) SELECT a.metric, count_if(a.value > b.value)::BIGINT AS wins, count(*) AS folds FROM r AS a JOIN r AS b ON a.fold = b.fold AND a.metric = b.metric WHERE a.method = 'a' AND b.method = 'b' GROUP BY a.metric")
def fold_wins(t: Tables) -> DataFrame:
    return metrics.fold_wins(fold_results(t), "a", "b")


_CV = f"SELECT method, metric, avg(value) AS value FROM ({_RESULTS_SQL}) AS r WHERE NOT isnan(value) GROUP BY method, metric"


@query("ablation_table", f"WITH m AS ({_CV}) SELECT m.method, m.metric, round(m.value, 6) AS value, round(m.value - b.value, 6) + 0e0 AS delta FROM m LEFT JOIN m AS b ON b.metric = m.metric AND b.method = 'a'")
def ablation_table(t: Tables) -> DataFrame:
    return metrics.ablation(fold_results(t), "a")


def indexed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with an index for each column."""
    return features.encode(rows, features.vocabulary(rows, columns), columns)


def label_runs(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    """Labels with a class, their runs and roles over spatial blocks, and the number of classes."""
    nodes = stored(class_nodes(t).where("class_id IS NOT NULL"), "labels")
    return nodes, evaluate.spatial_runs(nodes), (nodes.agg(F.max("class_id")).first()[0] or 0) + 1


def over_runs(rows: DataFrame, runs: DataFrame, name: str, key: str = "id") -> DataFrame:
    """``rows`` in each run, with their role there, read from one stored copy of them."""
    at = runs.groupBy(key).agg(F.collect_list(F.struct("run", "role")).alias("at"))  # as many as there are runs
    once = stored(rows.join(at, key), name)
    return once.withColumn("in", F.explode("at")).select(*rows.columns, "in.run", "in.role")


def label_inputs(t: Tables, nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Coordinates, unit indices and the 23 numbers of labels."""
    units = ["surficial_unit", "bedrock_unit", "ssurgo_component"]
    rows = nodes.join(covariates(t, t.soil_labels, "objectid").select(F.col("id").cast("string").alias("id"), *units), "id", "left")
    numbers = features.node_numeric(nodes.withColumn("elevation", F.lit(None).cast("double")))
    rows = indexed(rows, ["unit", *units]).join(numbers, "id")
    return rows, ["x", "y", *[f"{c}_idx" for c in ("unit", *units)], *[c for c in numbers.columns if c != "id"]]


def forest_predictions(t: Tables) -> DataFrame:
    """(run, id, y, probs): of each label by the forest of the run that tests its block."""
    nodes, runs, classes = label_runs(t)
    rows, columns = label_inputs(t, nodes)
    return ensembles.forest(over_runs(rows.select("id", "class_id", *columns), runs, "forest-rows"), columns, classes)


def _classes(rows: DataFrame) -> DataFrame:
    return metrics.with_argmax(rows).select("id", "run", F.col("y").alias("class_id"), "pred", "probs")


@query("random_forest_baseline")
def random_forest_baseline(t: Tables) -> DataFrame:
    return _classes(forest_predictions(t))


#: Edge sets of the ablation: all, without the edges between labels and borings, and geometric ones alone.
EDGE_SETS = {"all": ["knn", "delaunay", "same_geology", "label_boring"], "no_bridge": ["knn", "delaunay", "same_geology"], "knn_delaunay": ["knn", "delaunay"]}


def graph_predictions(t: Tables, sets: dict[str, list[str]]) -> DataFrame:
    """(method, run, id, y, probs): forests over graph context, one for each edge set and run, in one plan."""
    nodes, runs, classes = label_runs(t)
    edges, points = stored(union_edges(t), "union-edges"), stored(union_points(t), "union-points")
    every = None
    for k, types in enumerate(sets.values()):
        context = graph.graph_context(graph.edge_subset(edges, types), points, ["x", "y"]).where("id LIKE 'l:%'").withColumn("id", F.expr("substr(id, 3)"))
        rows = over_runs(nodes.select("id", "class_id").join(context, "id"), runs.withColumn("run", F.col("run") + 100 * k), "graph-rows")
        every = rows if every is None else every.unionByName(rows)
    columns = [c for c in every.columns if c not in ("id", "class_id", "run", "role")]
    got = ensembles.forest(every, columns, classes)
    method = F.element_at(F.array(*[F.lit(n) for n in sets]), F.floor(F.col("run") / 100).cast("int") + 1)
    return got.select(method.alias("method"), (F.col("run") % 100).alias("run"), "id", "y", "probs")


@query("graph_model_baseline")
def graph_model_baseline(t: Tables) -> DataFrame:
    return _classes(graph_predictions(t, {"all": EDGE_SETS["all"]}))


@query("edge_ablation")
def edge_ablation(t: Tables) -> DataFrame:
    """Fold means of the graph model per edge set, and what each set changes."""
    scores = evaluate.classification_folds(graph_predictions(t, EDGE_SETS), ["method", "run"]).withColumnRenamed("run", "fold")
    return metrics.ablation(stored(scores, "scores"), "all")


@query("spatial_cv_classes")
def spatial_cv_classes(t: Tables) -> DataFrame:
    """(method, fold, metric, value) of the class baselines over spatial folds."""
    nodes, runs, classes = label_runs(t)
    near = evaluate.nearest_labels(stored(nodes.join(runs, "id"), "vote-rows"), classes)
    both = near.withColumn("method", F.lit("nearest_label")).unionByName(forest_predictions(t).withColumn("method", F.lit("rf_covariates")))
    return evaluate.classification_folds(stored(both, "predictions"), ["method", "run"]).withColumnRenamed("run", "fold")


def depth_rows(t: Tables) -> tuple[DataFrame, list[str], list[str]]:
    """(run, role, id, boring_id, interval_index, y, columns) of depth samples with a blow count; columns of geology and depth, and of physics."""
    samples = stored(features.depth_samples(derived_strata(t)).where("y_spt_log IS NOT NULL").withColumnRenamed("y_spt_log", "y"), "samples")
    units = ["surficial_unit", "bedrock_unit"]
    geology = indexed(covariates(t).select(F.col("id").alias("boring_id"), *units), units).drop(*units)
    nodes = t.borings.join(t.dem_samples, "boring_id", "left").select(F.col("boring_id").alias("id"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), F.col("elevation_m").alias("elevation"))
    numbers = features.node_numeric(nodes)
    places = samples.select("boring_id").join(nodes.select(F.col("id").alias("boring_id"), "x", "y"), "boring_id").where("x IS NOT NULL AND y IS NOT NULL")
    runs = evaluate.spatial_runs(places.select(F.col("boring_id").alias("id"), "x", "y", F.lit(None).cast("int").alias("class_id"))).withColumnRenamed("id", "boring_id")
    rows = samples.join(geology, "boring_id").join(numbers.withColumnRenamed("id", "boring_id"), "boring_id").withColumn("id", F.concat_ws("/", "boring_id", "interval_index"))
    plain = ["depth_std", *[f"{c}_idx" for c in units], *[c for c in numbers.columns if c != "id"]]
    return over_runs(rows, runs, "depth-rows", "boring_id"), plain, [*plain, *[f"{c}_{k}" for c in SAFE_COLUMNS for k in ("std", "mask")]]


@query("boosted_trees_baseline")
def boosted_trees_baseline(t: Tables) -> DataFrame:
    rows, _, columns = depth_rows(t)
    got = ensembles.boosting(rows, columns)
    return got.join(rows.select("id", "boring_id", "interval_index").distinct(), "id").select("boring_id", "interval_index", "run", "y", "mu", "sigma")


@query("spatial_cv_depth")
def spatial_cv_depth(t: Tables) -> DataFrame:
    """(method, fold, metric, value) of the blow-count baselines over spatial folds: mean, geology and depth, and with physics."""
    rows, plain, physics = depth_rows(t)
    mean = rows.where("role = 'train'").groupBy("run").agg(F.avg("y").alias("mu"), F.coalesce(F.nullif(F.stddev_pop("y"), F.lit(0.0)), F.lit(1.0)).alias("sigma"))
    means = rows.where("role = 'test'").select("run", "id", "y").join(F.broadcast(mean), "run").withColumn("method", F.lit("depth_mean"))  # one row a run
    every = means.unionByName(ensembles.boostings(rows, {"geology_depth_gbm": plain, "geology_depth_phys_gbm": physics}))
    return evaluate.regression_folds(stored(every, "predictions"), ["method", "run"]).withColumnRenamed("run", "fold")
