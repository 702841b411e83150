"""Queries: evaluation of scored orders, model reports, training and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import evaluate as ev, resample, train as tr
from riskframe.operators.stratify import stratified_folds
from riskframe.plans import workload as w
from riskframe.plans.catalog import (
    CURVE, METRIC_COLUMNS, PR, REPORT_LINES, SCORED, SWEEP, matrix_sql, query, r, rounded,
)
from riskframe.plans.catalog_features import SIZES, model_matrices
from riskframe.session import fresh_path, stage
from riskframe.sources import reports, sinks

# --- evaluation without a model -------------------------------------------------------


@query(f"""WITH {SCORED} SELECT count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
 round(count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1), 6) AS positive_weight,
 round(count(*)::DOUBLE / (2 * count(*) FILTER (label = 0)), 6) AS balanced_weight_0, round(count(*)::DOUBLE / (2 * count(*) FILTER (label = 1)), 6) AS balanced_weight_1 FROM scored""")
def class_weight(spark, sf) -> DataFrame:
    return rounded(ev.class_balance(w.scored_orders(spark, sf), "label"), "positive_weight", "balanced_weight_0", "balanced_weight_1")


@query(f"""WITH {SCORED}, {matrix_sql('0.5::DOUBLE')} SELECT 0 AS actual, 0 AS predicted, tn AS n FROM m UNION ALL SELECT 0, 1, fp FROM m
 UNION ALL SELECT 1, 0, fn FROM m UNION ALL SELECT 1, 1, tp FROM m""")
def confusion(spark, sf) -> DataFrame:
    return ev.confusion_cells(ev.confusion(w.scored_orders(spark, sf), "label", ev.predicted("score", 0.5)))


@query("""WITH s AS (SELECT quality AS label, (n_chars >= 2000)::INT AS p FROM labels JOIN documents USING (doc_id)) SELECT count(*) FILTER (label = 0 AND p = 0) AS tn,
 count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 1 AND p = 1) AS tp FROM s""")
def confusion_documents(spark, sf) -> DataFrame:
    df = w.table(spark, sf, "labels").join(w.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return ev.confusion(df, "quality", (F.col("n_chars") >= 2000).cast("int"))


@query(f"WITH {SCORED}, {matrix_sql('0.5::DOUBLE')} SELECT tn, fp, fn, tp, {METRIC_COLUMNS} FROM m")
def binary_metrics(spark, sf) -> DataFrame:
    matrix = ev.confusion(w.scored_orders(spark, sf), "label", ev.predicted("score", 0.5))
    return rounded(ev.with_metrics(matrix), "accuracy", "precision", "recall", "f1_score")


REPORT = """SELECT 'Not Canceled (0)' AS "class", round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, tn + fp AS support FROM t
 UNION ALL SELECT 'Canceled (1)', round(p1, 6), round(r1, 6), round(f1, 6), tp + fn FROM t
 UNION ALL SELECT 'accuracy', round((tp + tn)::DOUBLE / total, 6), round((tp + tn)::DOUBLE / total, 6), round((tp + tn)::DOUBLE / total, 6), total FROM t
 UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), total FROM t
 UNION ALL SELECT 'weighted avg', round((p0 * (tn + fp) + p1 * (tp + fn)) / total, 6), round((r0 * (tn + fp) + r1 * (tp + fn)) / total, 6),
 round((f0 * (tn + fp) + f1 * (tp + fn)) / total, 6), total FROM t"""


@query(f"WITH {SCORED}, {matrix_sql('0.5::DOUBLE')}, {REPORT_LINES} {REPORT}")
def class_report(spark, sf) -> DataFrame:
    matrix = ev.confusion(w.scored_orders(spark, sf), "label", ev.predicted("score", 0.5))
    return rounded(ev.class_report(matrix), "precision", "recall", "f1_score")


@query(f"""WITH {CURVE} SELECT max(p) AS positives, max(n) AS negatives, round(sum(neg * (2 * (tp - pos) + pos))::DOUBLE / 2 / max(p) / max(n), 6) AS roc_auc FROM curve""")
def roc_auc(spark, sf) -> DataFrame:
    return rounded(ev.ranking_metrics(w.scored_orders(spark, sf), "label", "score"), "roc_auc").drop("average_precision")


@query(f"""WITH {CURVE} SELECT round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), 6) AS average_precision FROM curve""")
def avg_precision(spark, sf) -> DataFrame:
    return rounded(ev.ranking_metrics(w.scored_orders(spark, sf), "label", "score"), "average_precision").select("average_precision")


GROUP_CURVE = SCORED + """, counts AS (SELECT grp, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY grp, score),
 curve AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER (PARTITION BY grp))::BIGINT AS p,
 (sum(neg) OVER (PARTITION BY grp))::BIGINT AS n FROM counts WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"""
RANKED = """ranked AS (SELECT grp, round(sum(neg * (2 * (tp - pos) + pos))::DOUBLE / 2 / max(p) / max(n), {d}) AS roc_auc,
 round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), {d}) AS average_precision FROM curve GROUP BY grp)"""


@query(f"""WITH {GROUP_CURVE}, {RANKED.format(d=6)}, {matrix_sql('0.5::DOUBLE', 'grp')}
 SELECT grp, tn, fp, fn, tp, {METRIC_COLUMNS}, roc_auc, average_precision FROM m JOIN ranked USING (grp)""")
def evaluate_by_group(spark, sf) -> DataFrame:
    found = ev.evaluate(w.scored_orders(spark, sf), "label", "score", 0.5, by=["grp"])
    return rounded(found, "accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision")


@query(f"""WITH {CURVE} SELECT score AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM curve
 UNION ALL SELECT 'inf'::DOUBLE, 0, 0""")
def roc_points(spark, sf) -> DataFrame:
    return rounded(ev.roc_points(w.scored_orders(spark, sf), "label", "score"), "fpr", "tpr")


@query(f"""WITH {CURVE}, s AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM curve WINDOW w AS (ORDER BY score DESC))
 SELECT score AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM s WHERE before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
 UNION ALL SELECT 'inf'::DOUBLE, 0, 0""")
def roc_corners(spark, sf) -> DataFrame:
    return rounded(ev.roc_points(w.scored_orders(spark, sf), "label", "score", corners_only=True), "fpr", "tpr")


@query(f"""WITH {PR} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr UNION ALL SELECT NULL, 1, 0""")
def pr_points(spark, sf) -> DataFrame:
    return rounded(ev.pr_points(w.scored_orders(spark, sf), "label", "score"), "precision", "recall")


SWEEP_ROWS = "SELECT step, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM sweep"


@query(f"WITH {SWEEP} {SWEEP_ROWS}")
def threshold_sweep(spark, sf) -> DataFrame:
    return rounded(ev.threshold_sweep(w.scored_orders(spark, sf), "label", "score"), "precision", "recall", "f1_score")


@query(f"WITH {SWEEP} {SWEEP_ROWS} WHERE step % 10 = 0")
def sweep_every_10th(spark, sf) -> DataFrame:
    sweep = ev.threshold_sweep(w.scored_orders(spark, sf), "label", "score")
    return rounded(ev.every_kth(sweep, 10), "precision", "recall", "f1_score")


@query(f"WITH {SWEEP} {SWEEP_ROWS}")
def sweep_csv_roundtrip(spark, sf) -> DataFrame:
    sweep = ev.threshold_sweep(w.scored_orders(spark, sf), "label", "score")
    path = sinks.write_csv(sweep, fresh_path(spark, "sweep_csv"))
    back = spark.read.schema(sweep.schema).option("header", True).csv(path)
    return rounded(back, "precision", "recall", "f1_score")


@query(f"WITH {SWEEP} SELECT threshold, round(f1_score, 6) AS f1_score FROM sweep ORDER BY sweep.f1_score DESC, threshold LIMIT 1")
def best_f1_sweep(spark, sf) -> DataFrame:
    sweep = ev.threshold_sweep(w.scored_orders(spark, sf), "label", "score")
    return rounded(ev.best_of_sweep(sweep).select("threshold", "f1_score"), "f1_score")


BEST_CURVE = """best AS (SELECT threshold, 2 * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1 FROM pr ORDER BY f1 DESC, threshold LIMIT 1)"""


@query(f"WITH {PR}, {BEST_CURVE} SELECT threshold, round(f1, 6) AS f1_score FROM best")
def best_f1_pr(spark, sf) -> DataFrame:
    points = ev.pr_points(w.scored_orders(spark, sf), "label", "score")
    return rounded(ev.best_of_curve(points).select("threshold", "f1_score"), "f1_score")


def _chosen(scored: DataFrame) -> DataFrame:
    curve = ev.best_of_curve(ev.pr_points(scored, "label", "score"))
    return ev.chosen_threshold(curve, ev.best_of_sweep(ev.threshold_sweep(scored, "label", "score")))


SWEEP_ONLY = SWEEP.replace(SCORED + ", ", "")


@query(f"""WITH {PR}, {BEST_CURVE}, {SWEEP_ONLY}, a AS (SELECT threshold AS curve_threshold FROM best), b AS (SELECT threshold AS sweep_threshold FROM sweep ORDER BY f1_score DESC, threshold LIMIT 1)
 SELECT curve_threshold, sweep_threshold, CASE WHEN curve_threshold > 0 AND curve_threshold < 1 THEN curve_threshold WHEN sweep_threshold > 0 AND sweep_threshold < 1 THEN sweep_threshold ELSE 0.5 END AS threshold FROM a, b""")
def chosen_threshold(spark, sf) -> DataFrame:
    return _chosen(w.scored_orders(spark, sf))


@query(f"""WITH {PR}, {BEST_CURVE}, {matrix_sql('(SELECT threshold FROM best)')} SELECT tn, fp, fn, tp, {METRIC_COLUMNS} FROM m""")
def eval_at_threshold(spark, sf) -> DataFrame:
    scored = stage(w.scored_orders(spark, sf))
    threshold = _chosen(scored).select("threshold").scalar()
    matrix = ev.confusion(scored, "label", ev.predicted("score", threshold))
    return rounded(ev.with_metrics(matrix), "accuracy", "precision", "recall", "f1_score")


@query(f"""WITH {CURVE}, {matrix_sql('0.5::DOUBLE')}, k AS (SELECT round(sum(neg * (2 * (tp - pos) + pos))::DOUBLE / 2 / max(p) / max(n), 6) AS roc_auc,
 round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), 6) AS average_precision FROM curve) SELECT tn, fp, fn, tp, {METRIC_COLUMNS}, roc_auc, average_precision FROM m, k""")
def evaluate_all(spark, sf) -> DataFrame:
    """All metrics, written as JSON and read back."""
    found = ev.evaluate(w.scored_orders(spark, sf), "label", "score")
    path = sinks.write_metrics(found, fresh_path(spark, "metrics_json"))
    back = spark.read.schema(found.schema).json(path)
    return rounded(back, "accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision")


@query(f"""WITH {GROUP_CURVE}, {RANKED.format(d=6)} SELECT round(avg(average_precision), 5) AS mean_score, count(*) AS folds FROM ranked""")
def mean_group_score(spark, sf) -> DataFrame:
    scores = ev.scores_per_fold(w.scored_orders(spark, sf), "label", "score", "grp")
    return rounded(ev.mean_fold_score(rounded(scores, "average_precision"), "average_precision"), "mean_score", digits=5)


# --- reports --------------------------------------------------------------------------

PARSED = f"""parsed AS (SELECT grp AS name, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall,
 round((2 * tp)::DOUBLE / (2 * tp + fp + fn), 4) AS f1_score, average_precision AS pr_auc, roc_auc, tn, fp, fn, tp FROM m JOIN ranked USING (grp))"""


def _reports(spark, sf) -> DataFrame:
    """One report per order priority, written as text files and read back."""
    found = ev.evaluate(w.scored_orders(spark, sf), "label", "score", 0.5, by=["grp"])
    path = reports.write_reports(reports.render(found, "grp"), fresh_path(spark, "reports"))
    return reports.parse(reports.read_reports(spark, path))


@query(f"""WITH {GROUP_CURVE}, {RANKED.format(d=4)}, {matrix_sql('0.5::DOUBLE', 'grp')}, {PARSED}
 SELECT name, precision, recall, f1_score, pr_auc, roc_auc, tn, fp, fn, tp FROM parsed""")
def report_parse(spark, sf) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all("matrix_text", F.lit(r"(\d+)")), lambda n: n.cast("long"))
    parsed = _reports(spark, sf).withColumn("cells", numbers)
    cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("tn", "fp", "fn", "tp"))]
    return parsed.select("name", *reports.COMPARED, *cells)


@query(f"""WITH {GROUP_CURVE}, {RANKED.format(d=4)}, {matrix_sql('0.5::DOUBLE', 'grp')}, {PARSED} SELECT name, precision, recall, f1_score, pr_auc, roc_auc,
 precision = max(precision) OVER () AS best_precision, recall = max(recall) OVER () AS best_recall, f1_score = max(f1_score) OVER () AS best_f1_score,
 pr_auc = max(pr_auc) OVER () AS best_pr_auc, roc_auc = max(roc_auc) OVER () AS best_roc_auc FROM parsed""")
def model_compare(spark, sf) -> DataFrame:
    return reports.compare(_reports(spark, sf))


# --- models: the library's defaults are the published settings; these are smaller -----

TREES = {**tr.BASELINE_BOOSTING, "n_estimators": 20}
FOREST = {**tr.FOREST, "n_estimators": 20}


class _Data:
    """Train and test rows (plan_id, label, features, weight) with feature names."""

    def __init__(self, spark, sf, scheme: str = "positive"):
        matrices = model_matrices(spark, sf)
        rows = matrices.data.withColumnRenamed("was_canceled", "label")
        self.train = tr.weighted(rows.filter("not is_test"), "label", scheme)
        self.test = rows.filter("is_test")
        self.names = [r["name"] for r in matrices.preprocessor.names().orderBy("position").collect()]


def _scores(model, test: DataFrame) -> DataFrame:
    return rounded(tr.score(model, test, ["plan_id", "label"]), "score")


@query()
def gbt_scores(spark, sf) -> DataFrame:
    data = _Data(spark, sf)
    return _scores(tr.boosting(TREES).fit(tr.bounded(data.train)), data.test)


@query()
def gbt_early_stopping(spark, sf) -> DataFrame:
    """Boosting that stops once the loss on one fold no longer improves."""
    data = _Data(spark, sf)
    folded = stratified_folds(data.train, "label", ["plan_id"]).withColumn("validation", F.col("fold") == 0)
    model = tr.boosting(TREES, validation="validation").fit(tr.bounded(folded))
    return _scores(model, data.test).withColumn("trees", F.lit(model.getNumTrees))


@query()
def rf_scores(spark, sf) -> DataFrame:
    data = _Data(spark, sf, "balanced")
    model = tr.forest(FOREST).fit(tr.bounded(data.train))
    path = sinks.save_model(model, fresh_path(spark, "forest"))
    return _scores(type(model).load(path), data.test)


def _logistic(data: _Data):
    total = data.train.agg(F.sum("weight")).first()[0]
    return tr.l1_logistic(total).fit(data.train)


@query()
def lr_scores(spark, sf) -> DataFrame:
    data = _Data(spark, sf, "balanced")
    return _scores(_logistic(data), data.test)


@query()
def coef_top20(spark, sf) -> DataFrame:
    data = _Data(spark, sf, "balanced")
    top = ev.top_features(tr.coefficients(spark, _logistic(data), data.names), "coefficient", absolute=True)
    return rounded(top, "coefficient")


@query()
def importance_top20(spark, sf) -> DataFrame:
    data = _Data(spark, sf)
    model = tr.boosting(TREES).fit(tr.bounded(data.train))
    return rounded(ev.top_features(tr.importances(spark, model, data.names)), "importance")


@query()
def model_evaluation(spark, sf) -> DataFrame:
    """All metrics of boosted trees on the test rows."""
    data = _Data(spark, sf)
    scored = stage(tr.score(tr.boosting(TREES).fit(tr.bounded(data.train)), data.test, ["plan_id", "label"]))
    found = ev.evaluate(scored, "label", "score", prediction=F.col("prediction"))
    return rounded(found, "accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision")


def _search(spark, sf, draws) -> DataFrame:
    data = _Data(spark, sf)
    train = tr.bounded(stage(stratified_folds(data.train, "label", ["plan_id"])))
    fitted = tr.search(train, draws, tr.boosting(TREES), keys=["plan_id"])
    return rounded(tr.search_table(spark, draws, fitted), "mean_score", "std_score")


@query()
def search_best(spark, sf) -> DataFrame:
    """Random search: all published draws over all published values."""
    return _search(spark, sf, tr.random_draws(tr.RANDOM_SEARCH_SPACE, tr.RANDOM_SEARCH_DRAWS))


@query()
def search_ranges(spark, sf) -> DataFrame:
    """Seeded draws from all published ranges, as many as published, cross-validated like the random search."""
    return _search(spark, sf, tr.range_draws(tr.GUIDED_SEARCH_RANGES, tr.GUIDED_SEARCH_DRAWS))


@query()
def cv_fold_scores(spark, sf) -> DataFrame:
    """Average precision per fold of out-of-fold scores of a small boosted model."""
    data = _Data(spark, sf)
    train = tr.bounded(stage(stratified_folds(data.train, "label", ["plan_id"])))
    scored = tr.fold_scores(train, tr.boosting({**TREES, "n_estimators": 5}), ["plan_id", "label"])
    return rounded(ev.scores_per_fold(stage(scored), "label", "score"), "roc_auc", "average_precision")


# --- what SQL can confirm of models: rows scored per class, scores in range, better than chance --

FACTS = f"""WITH {SIZES} SELECT y AS label, (n - train_n)::BIGINT AS n, true AS in_range FROM sizes"""


def _facts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


@query(FACTS)
def gbt_score_facts(spark, sf) -> DataFrame:
    return _facts(gbt_scores(spark, sf))


@query(FACTS)
def rf_score_facts(spark, sf) -> DataFrame:
    return _facts(rf_scores(spark, sf))


@query(FACTS)
def lr_score_facts(spark, sf) -> DataFrame:
    return _facts(lr_scores(spark, sf))


# --- balance the classes, fit, evaluate -----------------------------------------------

FLOW = f"""WITH {SIZES} SELECT sum(n - train_n) FILTER (y = 0)::BIGINT AS negatives, sum(n - train_n) FILTER (y = 1)::BIGINT AS positives,
 (sum(train_n) FILTER (y = 0) - sum(train_n) FILTER (y = 1))::BIGINT AS added, true AS better_than_chance FROM sizes"""


def _flow(spark, sf, balance) -> DataFrame:
    """Balance the training rows, fit on them, evaluate on the untouched test rows."""
    data = _Data(spark, sf)
    train = stage(data.train.select("plan_id", F.col("label").cast("int").alias("label"), "features"))
    even = stage(balance(train).withColumn("weight", F.lit(1.0)))
    scored = stage(tr.score(tr.l1_logistic(float(even.count())).fit(even), data.test, ["plan_id", "label"]))
    found = ev.evaluate(scored, "label", "score", prediction=F.col("prediction"))
    return found.select(
        (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"),
        F.lit(even.count() - train.count()).cast("long").alias("added"), (F.col("roc_auc") > 0.5).alias("better_than_chance"))


@query(FLOW)
def oversample_fit_evaluate(spark, sf) -> DataFrame:
    return _flow(spark, sf, lambda train: resample.oversample(train, "label", ["plan_id"]).select("label", "features"))


@query(FLOW)
def smote_fit_evaluate(spark, sf) -> DataFrame:
    def balance(train: DataFrame) -> DataFrame:
        first = train.filter("features IS NOT NULL").select("features").first()
        made = resample.as_vectors(resample.smote(train, "label", "plan_id"), len(first[0]) if first else 0)
        return resample.with_synthetic(train, made, ["label", "features"])
    return _flow(spark, sf, balance)
