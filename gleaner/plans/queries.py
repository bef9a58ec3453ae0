"""The registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys, vectors
from gleaner.operators import (
    collect,
    dedup,
    ensemble_weights,
    featurize,
    folds,
    knn,
    labeling,
    linear,
    metrics,
    peaks,
    routing,
    trees,
    validate,
)
from gleaner.operators.ensemble import fit_ensemble, weighted_score
from gleaner.operators.params import DEFAULT, TreeParams, for_sample_size
from gleaner.plans.apply import dedup_across_routes, dedup_routed, score_and_route
from gleaner.plans.train import fit_labeled, retrain_and_rescore, score_items
from gleaner.session import new_path, spread, staged
from gleaner.sources import items as items_source
from gleaner.sources import models as models_source
from gleaner.sources import store
from gleaner.streaming import progress, scoring

DOCUMENT_MODELS = ("shape8", "letters27")
TEXT_THRESHOLD = 0.9999
VECTOR_THRESHOLD = 0.4
NAME_DAY = "2024-01-31"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "sample_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the documents that featurizers read, on all cores."""
    return spread(documents(spark, sf_dir).select("sample_id", "text", "n_chars", "lang"))


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeled documents: joined first, so that only they are featurized."""
    return texts(spark, sf_dir).join(labels(spark, sf_dir), "sample_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("label")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), vectors.as_doubles("embedding").alias("vec"), "label"
    )


def long_form(df: DataFrame, vec: str = "vec", value: str = "value") -> DataFrame:
    """One row per vector element, rounded to six digits."""
    return df.select("sample_id", F.posexplode(vec).alias("position", "x")).select(
        "sample_id", "position", F.round("x", 6).alias(value)
    )


def toy_scores(items: DataFrame, *keep: str) -> DataFrame:
    """Three fixed scores of the shape of every document, and their weighted mean."""
    shape = items.select(
        "sample_id", *keep, featurize.feature_column("shape8").alias("vec")
    )

    def clipped(value: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)

    scores = shape.select(
        "sample_id",
        *keep,
        clipped(F.element_at("vec", 7)).alias("p_knn"),
        clipped(1.0 - 5.0 * F.element_at("vec", 3)).alias("p_lr"),
        clipped(2.0 - 2.4 * F.element_at("vec", 8)).alias("p_gbt"),
    )
    return scores.withColumn("p", weighted_score(DEFAULT.weights))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toy_scores(texts(spark, sf_dir))


def labeled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toy_scores(labeled_documents(spark, sf_dir), "label")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


# --- features -------------------------------------------------------------------------


def doc_letter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = featurize.featurize(texts(spark, sf_dir), "letters27")
    return long_form(features.withColumn("vec", vectors.l2_normalize("vec")))


def doc_shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(featurize.featurize(texts(spark, sf_dir), "shape8"))


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        keys.sample_id("url").alias("sample_id"),
        keys.extension("url").alias("extension"),
        keys.routed_id(keys.sample_id("url")).alias("dest_id"),
    )


def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return items_source.id_collisions(items_source.items_from_table(pages, "url"))


def feature_store_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left to featurize when the labeled ones are in the store already."""
    docs = texts(spark, sf_dir)
    cached = store.FeatureStore(spark, new_path(spark, "features"), id_type="bigint")
    featurize.extract_features(
        docs.join(labels(spark, sf_dir), "sample_id", "left_semi"), ["shape8"], cached
    )
    return cached.pending(docs, "shape8").select("sample_id", "n_chars")


def feature_store_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents, computed in two visits to one store."""
    docs = texts(spark, sf_dir)
    cached = store.FeatureStore(spark, new_path(spark, "features"), id_type="bigint")
    labeled = docs.join(labels(spark, sf_dir), "sample_id", "left_semi")
    featurize.extract_features(labeled, ["shape8"], cached)
    featurize.extract_features(docs, ["shape8"], cached)
    return long_form(collect.collect_features(docs, cached.read(["shape8"]), "shape8"))


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the embeddings as the features of models ``a`` and ``b``."""
    featurize.register_slice("a", "embedding", 1, 32)
    featurize.register_slice("b", "embedding", 33, 32)
    items = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "sample_id")
    return featurize.featurize(items, "a").unionByName(featurize.featurize(items, "b"))


def concat_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(collect.concat_features(two_models(spark, sf_dir), ["a", "b"]))


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lack one of two models: ``b`` exists for the labeled ones only."""
    docs = documents(spark, sf_dir).select("sample_id")
    a = docs.withColumn("model", F.lit("a"))
    b = labels(spark, sf_dir).select("sample_id").withColumn("model", F.lit("b"))
    return collect.misaligned_items(a.unionByName(b), ["a", "b"]).select("sample_id", "n_models")


def width_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.width_range(embeddings(spark, sf_dir))


# --- near duplicates ------------------------------------------------------------------


def letter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.direct_features(
        texts(spark, sf_dir), ["letters27"], keep=["n_chars", "lang"]
    )


def near_dup_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dropped_items(letter_vectors(spark, sf_dir), threshold=TEXT_THRESHOLD)


def near_dup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_worst_near_duplicates(
        letter_vectors(spark, sf_dir), "n_chars", threshold=TEXT_THRESHOLD
    ).select("sample_id", "n_chars")


def near_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = letter_vectors(spark, sf_dir)
    dropped = dedup.dropped_items(items, order=["n_chars"], threshold=TEXT_THRESHOLD)
    return dedup.dedup_report(items, dropped)


def near_dup_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dropped_items(
        letter_vectors(spark, sf_dir), order=["n_chars"], threshold=0.999, group=["lang"]
    )


def near_dup_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``near_dup_drop`` in many small cells: pivots, visits and witnesses."""
    items = letter_vectors(spark, sf_dir)
    return dedup.dropped_items(items, threshold=TEXT_THRESHOLD, tile_rows=64, n_pivots=24)


def near_dup_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = embeddings(spark, sf_dir).withColumn("vec", vectors.l2_normalize("vec"))
    return dedup.dropped_items(items, threshold=VECTOR_THRESHOLD)


def near_dup_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity summed over two models, compared with twice the threshold."""
    items = collect.concat_features(two_models(spark, sf_dir), ["a", "b"])
    return dedup.dropped_items(items, threshold=VECTOR_THRESHOLD, n_models=2)


def near_dup_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-scored copies inside each route."""
    routed = routing.route_items(document_scores(spark, sf_dir), 0.7, 0.6)
    kept = dedup_routed(routed, letter_vectors(spark, sf_dir), 1, TEXT_THRESHOLD)
    return kept.select("sample_id", "route")


def near_dup_across_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a near duplicate of a clearer score in another route."""
    routed = routing.route_items(document_scores(spark, sf_dir), 0.7, 0.6)
    kept = dedup_across_routes(routed, letter_vectors(spark, sf_dir), 1, TEXT_THRESHOLD)
    return kept.select("sample_id", "route")


# --- evaluation -----------------------------------------------------------------------


def labeled_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("sample_id", "n_chars")
    known = labels(spark, sf_dir)
    positive = docs.join(known.where("label = 1"), "sample_id", "left_semi")
    negative = docs.join(known.where("label = 0"), "sample_id", "left_semi")
    return store.labeled_set(positive, negative)


def accuracy_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = labeled_scores(spark, sf_dir).withColumn("all", F.lit("all"))
    joined = metrics.accuracy(scores, "p", "label", ["all"]).join(
        metrics.rmse(scores, "p", "label", ["all"]), "all"
    )
    return rounded(joined.drop("all"), "accuracy", "rmse")


def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(labeled_scores(spark, sf_dir), "p", "label"), "auc")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(labeled_scores(spark, sf_dir), "p", "label")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep(spark, sf_dir), "t", "tp", "fp", "fn", "tn")


def ratio_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = metrics.ratio_curves(sweep(spark, sf_dir))
    return rounded(
        curves.select("k", "positives_ratio", "negatives_ratio"),
        "positives_ratio",
        "negatives_ratio",
    )


def ratio_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        peaks.ratio_peaks(metrics.ratio_curves(sweep(spark, sf_dir))),
        "positive_threshold",
        "negative_threshold",
    )


def safe_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = peaks.ratio_peaks(metrics.ratio_curves(sweep(spark, sf_dir)))
    margins = peaks.safe_margins(found).select("positive_margin", "negative_margin")
    return rounded(margins, "positive_margin", "negative_margin")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = metrics.histogram(labeled_scores(spark, sf_dir), "p", by=["label"])
    return rounded(counted, "left_edge")


def adaptive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation, prediction and session histograms, bins by number of rows."""
    scores = document_scores(spark, sf_dir)
    known = labels(spark, sf_dir)
    judged = scores.join(known, "sample_id")
    pool = scores.join(known, "sample_id", "left").withColumn(
        "is_labeled", F.col("label").isNotNull()
    )
    parts = {
        "validation": metrics.adaptive_histogram(judged, "p", "validation", ["label"]),
        "prediction": metrics.adaptive_histogram(
            pool, "p", "prediction", labeled="is_labeled"
        ).withColumn("label", F.lit(None).cast("double")),
        "session": metrics.adaptive_histogram(judged, "p", "session", ["label"]),
    }
    chosen = [
        df.select(F.lit(kind).alias("kind"), F.coalesce("label", F.lit(-1.0)).alias("label"), "bin", "n")
        for kind, df in parts.items()
    ]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


def tail_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = metrics.tail_fractions(document_scores(spark, sf_dir))
    return rounded(tails, "share_high", "share_low")


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_pairs(labeled_scores(spark, sf_dir))


def sort_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        labeling.sort_by_score(document_scores(spark, sf_dir).select("sample_id", "p")), "p"
    )


# --- routing --------------------------------------------------------------------------


def route_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping thresholds: items from 0.6 to 0.7 take both routes."""
    routed = routing.route_items(document_scores(spark, sf_dir), positive=0.6, negative=0.7)
    return rounded(routed.select("sample_id", "p", "route"), "p")


def route_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_scores(spark, sf_dir).select("sample_id", "p")
    left = routing.residual(scores, routing.route_items(scores, positive=0.8, negative=0.6))
    return rounded(left, "p")


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_items(document_scores(spark, sf_dir), positive=0.8, negative=0.6)
    features = featurize.featurize(texts(spark, sf_dir), "shape8").select("sample_id", "vec")
    moved = routing.routed_features(routed, features)
    return moved.select(
        "dest_id", "route", F.round(F.element_at("vec", 6), 6).alias("log_length")
    )


def routed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of two sources into the same sets, the second one repeated."""
    out = new_path(spark, "routed-sets")
    scores = staged(document_scores(spark, sf_dir), "scores")
    routed = routing.route_items(scores, positive=0.8, negative=0.6)
    features = staged(featurize.featurize(texts(spark, sf_dir), "shape8").select("sample_id", "vec"), "shape")
    items = documents(spark, sf_dir).select(
        "sample_id", F.concat(F.col("source"), F.lit("/"), F.col("sample_id"), F.lit(".txt")).alias("path")
    )
    for run, source in (("1", ""), ("2", "again"), ("2", "again")):
        part = routed.where(F.col("sample_id") % 2 == int(run) - 1)
        routing.write_routed(part, items, features, out, run, source, path="path")
    moved = routing.read_routed(spark, out, "pretrained_features").select("dest_id", "run", "vec")
    both = routing.read_routed(spark, out).join(moved.select("dest_id", "run").distinct(), ["dest_id", "run"])
    return both.select("run", "route", "dest_id", "dest_name")


def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.cold_start_scores(documents(spark, sf_dir).select("sample_id"))


def model_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = models_source.model_name_column(
        "taste", F.count("*"), F.lit(35), F.lit(NAME_DAY).cast("date")
    )
    return labels(spark, sf_dir).agg(name.alias("name"))


# --- splits and searches --------------------------------------------------------------


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(labels(spark, sf_dir), "sample_id", "label", n_repeats=2)


def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.shuffle_split(labels(spark, sf_dir), "sample_id").select("sample_id", "subset")


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = folds.stratified_folds(labeled_scores(spark, sf_dir), "sample_id", "label")
    scores = drawn.withColumn("p_ensemble", F.col("p")).withColumn("subset", F.lit("valid"))
    per_fold = validate.fold_metrics(scores)
    return rounded(folds.fold_summary(per_fold), "mean_auc", "std_auc")


def _searched(found: DataFrame) -> DataFrame:
    names = ["w_knn", "w_lr", "w_gbt", "auc", "accuracy", "positive_margin", "negative_margin", "score"]
    return rounded(found.select("weight_id", *names), *names)


def weight_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 36 triples of a simplex grid."""
    oof = staged(labeled_scores(spark, sf_dir), "oof")
    return _searched(ensemble_weights.weight_search(oof, ensemble_weights.grid_weights(spark)))


def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 10,000 random triples."""
    oof = staged(labeled_scores(spark, sf_dir), "oof")
    return _searched(ensemble_weights.best_weights(ensemble_weights.weight_search(oof)))


def uncertainty_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = labeling.uncertainty_sample(
        document_scores(spark, sf_dir).select("sample_id", "p"), labels(spark, sf_dir), 50, 0.35, 0.65, 7
    )
    return rounded(drawn.select("sample_id", "p", "weight"), "p", "weight")


# --- labeling session -----------------------------------------------------------------


def label_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Click and error events as positive and negative labels of documents."""
    n = documents(spark, sf_dir).count()
    events = table(spark, sf_dir, "events") if events is None else events
    return events.where(F.col("event_type").isin("click", "error")).select(
        "event_id",
        "ts",
        F.pmod("event_id", F.lit(n)).alias("sample_id"),
        (F.col("event_type") == "click").cast("int").alias("label"),
    )


def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = labeling.first_labels(label_events(spark, sf_dir))
    return labeling.label_progress(documents(spark, sf_dir).select("sample_id"), given)


def session_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = labeling.first_labels(label_events(spark, sf_dir))
    found = labeling.session_eval(given, document_scores(spark, sf_dir))
    return rounded(found, "accuracy", "auc")


# --- models ---------------------------------------------------------------------------


def template_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = embeddings(spark, sf_dir).withColumn("y", vectors.one_hot("label", 10))
    return data, knn.template_aggregate(data, "label", "vec", "y", 10)


def template_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, templates = template_tables(spark, sf_dir)
    return long_form(knn.knn_join(data, templates, 3), "y_hat", "share")


def template_knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``template_knn`` with templates in blocks of two."""
    data, templates = template_tables(spark, sf_dir)
    return long_form(knn.knn_join(data, templates, 3, block_bytes=1200), "y_hat", "share")


def multiclass_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, templates = template_tables(spark, sf_dir)
    predicted = knn.knn_join(data, templates, 1).join(data.select("sample_id", "y"), "sample_id")
    both = metrics.multiclass_accuracy(predicted, "y_hat", "y")
    error = metrics.rmse(predicted, "y_hat", "y")
    side = both.withColumn("n", F.lit(0)).join(error.withColumn("n", F.lit(0)), "n").drop("n")
    return rounded(side, "accuracy", "rmse")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both document models side by side, written once for the several passes of a fit."""
    return staged(collect.direct_features(texts(spark, sf_dir), DOCUMENT_MODELS), "vectors")


def labeled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the labeled documents only."""
    known = labeled_documents(spark, sf_dir)
    return staged(collect.direct_features(known, DOCUMENT_MODELS, keep=["label"]), "labeled")


def fitted_knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, knn.CompressedKnnModel]:
    data = labeled_vectors(spark, sf_dir)
    return data, knn.fit_knn(data, for_sample_size(DEFAULT, data.count()).knn)


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, model = fitted_knn(spark, sf_dir)
    return rounded(model.pca_variance(data), "ratio", "cumulative")


def compressed_knn_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, model = fitted_knn(spark, sf_dir)
    return model.report(data)


def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, model = fitted_knn(spark, sf_dir)
    return model.predict(data).select("sample_id", "label", "p_knn")


def multiclass_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed kNN with one-hot labels of the embeddings."""
    data = embeddings(spark, sf_dir).withColumn("y", vectors.one_hot("label", 10))
    model = knn.fit_knn(data, replace(DEFAULT.knn, n_cols=60, n_rows=120, n_neighbors=1), label="y")
    predicted = model.predict_all(data)
    return predicted.select("sample_id", "label", vectors.argmax("y_hat").alias("predicted"))


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = labeled_vectors(spark, sf_dir)
    model = linear.fit_logistic(data, for_sample_size(DEFAULT, data.count()).logistic)
    return model.predict(data).select("sample_id", "label", "p_lr")


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns (log length, distinct words) of the labeled documents."""
    pair = F.slice(featurize.feature_column("shape8"), 6, 2).alias("vec")
    return staged(labeled_documents(spark, sf_dir).select("sample_id", "label", pair), "pair")


def lr_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = pair_vectors(spark, sf_dir)
    model = linear.fit_logistic(data, DEFAULT.logistic)
    return rounded(model.predict(data).select("sample_id", "p_lr"), "p_lr", digits=3)


def lda_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = pair_vectors(spark, sf_dir)
    model = linear.fit_discriminant(data)
    return rounded(model.predict(data).select("sample_id", "p_lda"), "p_lda")


def pca_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = pair_vectors(spark, sf_dir)
    model = knn.fit_knn(data, for_sample_size(DEFAULT, data.count()).knn)
    return rounded(model.pca_variance(data), "ratio", "cumulative")


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = labeled_vectors(spark, sf_dir)
    model = trees.fit_trees(data, for_sample_size(DEFAULT, data.count()))
    return model.predict(data).select("sample_id", "label", "p_gbt")


def gbt_two_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boosting steps of two leaves each, over two rounded columns and all rows."""
    rounding = F.array(F.round(F.element_at("vec", 1), 1), F.round(F.element_at("vec", 2), 2))
    data = pair_vectors(spark, sf_dir).withColumn("vec", rounding)
    stump = TreeParams(num_leaves=2, min_data_in_leaf=10, column_sample=1.0, row_sample=1.0)
    model = trees.fit_trees(data, replace(DEFAULT, trees=stump, boosting=(2, 0.5)))
    return rounded(model.predict(data).select("sample_id", "p_gbt"), "p_gbt")


def lda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = labeled_vectors(spark, sf_dir)
    model = linear.fit_discriminant(data)
    return model.predict(data).select("sample_id", "label", "p_lda")


def two_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kNN and discriminant in equal parts, over all documents."""
    data, first = fitted_knn(spark, sf_dir)
    second = linear.fit_discriminant(data)
    scored = second.predict(first.predict(document_vectors(spark, sf_dir)))
    mixed = weighted_score([0.5, 0.5], ["p_knn", "p_lda"])
    return scored.select("sample_id", "p_knn", "p_lda", mixed.alias("p"))


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_ensemble(labeled_vectors(spark, sf_dir), DEFAULT)
    return score_items(model, document_vectors(spark, sf_dir))


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labeled documents, score and route the others, count the routes."""
    known = labels(spark, sf_dir)
    model = fit_labeled(labeled_vectors(spark, sf_dir), DEFAULT, DOCUMENT_MODELS).model
    pool = texts(spark, sf_dir).join(known, "sample_id", "left_anti")
    pool_vectors = collect.direct_features(pool, DOCUMENT_MODELS)
    routed, _ = score_and_route(model, pool_vectors)
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("mean_p"))


def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_fold = validate.cross_validate(labeled_vectors(spark, sf_dir), DEFAULT).fold_metrics
    return rounded(per_fold, "accuracy", "rmse", "auc")


def retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refit with validated weights, save, and score the unlabeled documents as loaded."""
    others = texts(spark, sf_dir).join(labels(spark, sf_dir), "sample_id", "left_anti")
    pool = staged(collect.direct_features(others, DOCUMENT_MODELS), "pool")
    training, _ = retrain_and_rescore(
        labeled_vectors(spark, sf_dir),
        pool,
        DEFAULT,
        new_path(spark, "models"),
        models_for_features=DOCUMENT_MODELS,
    )
    return score_items(models_source.load_model(spark, training.path), pool)


# --- streaming ------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A table arriving as a stream of at least ``files`` files, half of them to a micro-batch.

    A larger table comes in as many files as it has pieces: a task writes and reads one.
    """
    rows = table(spark, sf_dir, name)
    files = max(files, rows.rdd.getNumPartitions())
    folder = new_path(spark, "arriving")
    rows.repartition(files).write.parquet(folder)
    at_once = -(-files // 2)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def _toy_score(items: DataFrame) -> DataFrame:
    shape = featurize.featurize(items, "shape8")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at("vec", 7)))
    return shape.select("sample_id", F.round(ratio, 6).alias("p"))


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving as a file stream, scored and routed once each."""
    out = new_path(spark, "routed")
    arriving = _stream(spark, sf_dir, "documents").withColumnRenamed("doc_id", "sample_id")
    scoring.stream_score(
        arriving, _toy_score, out, new_path(spark, "checkpoint"), positive=0.8, negative=0.6
    ).awaitTermination()
    schema = "sample_id long, p double, route string, batch_id long"
    written = scoring.routed_so_far(spark, out, schema)
    return written.select("sample_id", "p", F.coalesce("route", F.lit("none")).alias("route"))


def stream_label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events arriving as a file stream, reduced to progress counters."""
    out = new_path(spark, "labels")
    arriving = label_events(spark, sf_dir, _stream(spark, sf_dir, "events"))
    progress.stream_first_labels(
        arriving, out, new_path(spark, "checkpoint")
    ).awaitTermination()
    given = progress.current_labels(spark, out)
    return labeling.label_progress(documents(spark, sf_dir).select("sample_id"), given)


def stream_session_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events arriving as a file stream, judged against the scores."""
    out = new_path(spark, "labels")
    arriving = label_events(spark, sf_dir, _stream(spark, sf_dir, "events"))
    progress.stream_first_labels(
        arriving, out, new_path(spark, "checkpoint")
    ).awaitTermination()
    found = progress.current_session(spark, out, document_scores(spark, sf_dir))
    return rounded(found, "accuracy", "auc")


QUERIES: dict[str, Query] = {
    "doc_letter_features": doc_letter_features,
    "doc_shape_features": doc_shape_features,
    "sample_ids": sample_ids,
    "id_collisions": id_collisions,
    "feature_store_pending": feature_store_pending,
    "feature_store_collect": feature_store_collect,
    "concat_two_models": concat_two_models,
    "alignment_check": alignment_check,
    "width_check": width_check,
    "near_dup_drop": near_dup_drop,
    "near_dup_keep_best": near_dup_keep_best,
    "near_dup_report": near_dup_report,
    "near_dup_by_group": near_dup_by_group,
    "near_dup_embeddings": near_dup_embeddings,
    "near_dup_two_models": near_dup_two_models,
    "near_dup_routed": near_dup_routed,
    "near_dup_across_routes": near_dup_across_routes,
    "labeled_set": labeled_set,
    "accuracy_rmse": accuracy_rmse,
    "auc_exact": auc_exact,
    "threshold_sweep": threshold_sweep,
    "ratio_curves": ratio_curves,
    "ratio_peaks": ratio_peaks,
    "safe_margins": safe_margins,
    "score_histogram": score_histogram,
    "adaptive_histogram": adaptive_histogram,
    "tail_fractions": tail_fractions,
    "score_pairs": score_pairs,
    "sort_by_score": sort_by_score,
    "route_items": route_items,
    "route_residual": route_residual,
    "route_features": route_features,
    "cold_start": cold_start,
    "model_name": model_name,
    "stratified_folds": stratified_folds,
    "shuffle_split": shuffle_split,
    "fold_summary": fold_summary,
    "weight_grid_search": weight_grid_search,
    "weight_search": weight_search,
    "uncertainty_sample": uncertainty_sample,
    "label_progress": label_progress,
    "session_eval": session_eval,
    "template_knn": template_knn,
    "multiclass_accuracy": multiclass_accuracy,
    "pca_variance": pca_variance,
    "compressed_knn_fit": compressed_knn_fit,
    "knn_scores": knn_scores,
    "multiclass_knn": multiclass_knn,
    "lr_scores": lr_scores,
    "gbt_scores": gbt_scores,
    "gbt_two_stumps": gbt_two_stumps,
    "lda_scores": lda_scores,
    "two_model_scores": two_model_scores,
    "ensemble_scores": ensemble_scores,
    "route_counts": route_counts,
    "cross_validate": cross_validate,
    "retrain_and_rescore": retrain,
    "stream_score": stream_score,
    "stream_label_progress": stream_label_progress,
    "stream_session_eval": stream_session_eval,
    "routed_sink": routed_sink,
    "lr_two_columns": lr_two_columns,
    "lda_two_columns": lda_two_columns,
    "pca_two_columns": pca_two_columns,
    "near_dup_cells": near_dup_cells,
    "template_knn_blocks": template_knn_blocks,
}
