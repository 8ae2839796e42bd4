"""The query catalogue: operators bound to the driver's tables. Each is (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.functions.hashing import hash_int, hash_order
from gleanset.operators import boost, budget, coreset, coupled, distance, encode, kdtree, noise, quality, sample, scoring, select, stats, trained, trees
from gleanset.sources import results
from gleanset.sources.points import embeddings, lineitem_points

C = 10  # classes of the embeddings table
R = 6


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, R).alias(name)


# Scans, encoders, normalisers.
def scan_points(s, d):
    e = embeddings(s, d)
    return e.select("row_id", "label", F.size("features").alias("d"), r6(V.norm(F.col("features")), "norm"), F.col("label").alias("hot"))


def label_encode(s, d):
    li = _t(s, d, "lineitem")
    ids = encode.label_dictionary(li, "l_returnflag")
    return li.groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n")).join(ids, "value").select("value", F.col("id").cast("int").alias("id"), "n")


def label_lookup_fallback(s, d):
    part = _t(s, d, "part")
    known = encode.label_dictionary(part.where("p_size <= 10 AND p_brand <> 'Brand#3'"), "p_brand")
    out = encode.encode_labels(part, "p_brand", known)
    return out.select("p_partkey", "label", "was_missing", "was_illegal")


def lenient_cast_impute(s, d):
    e = _t(s, d, "events").select("event_id", F.expr("try_cast(nullif(get_json_object(props, '$.k'), '69') AS double)").alias("k"))
    m = e.agg(F.median("k")).first()[0]
    return e.select("event_id", encode.repaired(F.col("k"), m).alias("k"), F.col("k").isNull().alias("was_missing"))


def rule_repair(s, d):
    c = _t(s, d, "customer")
    r = c.where("c_nationkey < 20").agg(F.median("c_acctbal").alias("m"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).first()
    lo, hi = r["lo"] + 500, r["hi"] - 500
    return c.select("c_custkey", F.round(encode.repaired(F.col("c_acctbal"), r["m"], lo, hi), 4).alias("acctbal"), ((F.col("c_acctbal") < lo) | (F.col("c_acctbal") > hi)).alias("out_of_range"))


def standardize(s, d):
    z = encode.standardise(embeddings(s, d))
    return z.select("row_id", r6(F.col("features")[0], "z0"), r6(F.col("features")[63], "z63"), r6(V.vsum(F.col("features")), "z_sum"))


def row_l2(s, d):
    x = embeddings(s, d).withColumn("features", V.scale(F.col("features"), F.col("row_id") % 7))
    return encode.row_l2(x).select("row_id", r6(F.col("features")[0], "x0"), r6(V.norm(F.col("features")), "norm"))


def center_by_class(s, d):
    x = encode.centred_by_class(embeddings(s, d))
    return x.select("row_id", "label", r6(F.col("features")[0], "x0"), r6(V.norm(F.col("features")), "norm"))


def minmax01(s, d):
    o = _t(s, d, "orders")
    r = o.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return o.select("o_orderkey", r6(encode.minmax01(F.col("o_totalprice"), *r), "scaled"))


# Aggregates.
def class_counts(s, d):
    return _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") == 0).alias("n_no_discount"))


def mode_label(s, d):
    return stats.mode(_t(s, d, "orders"), "o_orderpriority")


def quantile_thresholds(s, d):
    return stats.quantiles(_t(s, d, "lineitem"), "l_extendedprice", [0.2, 0.5, 0.8], "l_returnflag").select("l_returnflag", *[r6(F.col(f"q{q}"), f"q{q}") for q in (20, 50, 80)])


def column_bounds(s, d):
    lo, hi, sd = stats.bounds(lineitem_points(s, d))
    return s.createDataFrame([(i, round(a, R), round(b, R), round(c, R)) for i, (a, b, c) in enumerate(zip(lo, hi, sd, strict=True))], "i int, lo double, hi double, sd double")


def dedupe_selected(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("row_id"), F.col("value").alias("w"), F.col("event_id").alias("pos"))
    return stats.deduped(e, "row_id", "w", "pos").select("row_id", F.round("w", 4).alias("w"), "pos")


def weighted_epoch_loss(s, d):
    e = _t(s, d, "events").select((F.col("event_id") % 10).alias("epoch"), F.col("value").alias("loss"), (F.col("user_id") % 5).cast("double").alias("w"))
    return stats.weighted_epoch_loss(e, "epoch", "loss", "w").select("epoch", r6(F.col("mean_loss"), "mean_loss"))


# Samples, splits, sets.
def stratified_split(s, d):
    return sample.stratified_split(embeddings(s, d), "label", "row_id").select("row_id", "label", "split")


def kfold_assign(s, d):
    return sample.kfold(embeddings(s, d), "label", "row_id", 5).select("row_id", "fold")


def exact_sample(s, d):
    return sample.exact_sample(_t(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 42)


def trial_subsets(s, d):
    return sample.trial_subsets(embeddings(s, d), "row_id", 3, 40)


def overlap_check(s, d):
    e = sample.stratified_split(embeddings(s, d), "label", "row_id", 7)
    again = sample.stratified_split(embeddings(s, d), "label", "row_id", 8)
    a, b = e.where("split = 'train'").select("row_id"), again.where("split = 'test'").select("row_id")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_overlap"))


def anti_remaining(s, d):
    e = sample.stratified_split(embeddings(s, d), "label", "row_id", 7)
    return embeddings(s, d).select("row_id", "label").join(e.where("split = 'train'").select("row_id"), "row_id", "left_anti")


def clean_dirty_pairs(s, d):
    """1:1 join of clean and dirty rows on id; rows with a legal clean label stay."""
    o = _t(s, d, "orders")
    clean = o.select(F.col("o_orderkey").alias("row_id"), encode.normalised_label(F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("clean"))
    dirty = o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("dirty"))
    return clean.where("clean IS NOT NULL").join(dirty, "row_id").groupBy("clean", "dirty").agg(F.count(F.lit(1)).alias("n"))


# Noise.
def noise_types(s, d):
    return noise.error_types(_t(s, d, "orders").select(F.col("o_orderkey").alias("row_id")), 0.2).select("row_id", F.col("error_type").cast("int").alias("error_type"))


def _noisy(df):
    return df.select("row_id", "label", F.col("error_type").cast("int").alias("error_type"), F.size(F.filter("corrupted_mask", lambda m: m)).alias("n_corrupted"), r6(V.vsum(F.col("features")), "f_sum"))


def random_noise(s, d):
    return _noisy(noise.random_noise(embeddings(s, d), 0.2, C))


def shift_noise(s, d):
    return _noisy(noise.shift_noise(embeddings(s, d), 0.2, C))


def noise_validation(s, d):
    a = noise.validate(noise.random_noise(embeddings(s, d), 0.2, C), 0.2, C).withColumn("kind", F.lit("random"))
    b = noise.validate(noise.shift_noise(embeddings(s, d), 0.2, C), 0.2, C, shift=True).withColumn("kind", F.lit("shift"))
    return a.union(b)


# Budgets and top-k.
def class_allocation(s, d):
    counts = stats.class_counts(embeddings(s, d))
    return s.createDataFrame(sorted(budget.allocation(counts, C, 0.1).items()), "label int, budget int")


def _losses(s, d):
    e = embeddings(s, d)
    return scoring.with_probs(e, scoring.Centroid.fit(e, C)).withColumn("loss", scoring.loss(F.col("probs"), F.col("label")))


def classwise_topk(s, d):
    return budget.classwise_topk(_losses(s, d), "loss", C, 0.1).select("row_id", "label", "rank", r6(F.col("sample_weight"), "sample_weight"))


def bounded_candidates(s, d):
    return budget.bounded_candidates(_losses(s, d), C, 123, "loss").select("row_id", "label")


def weighted_top_fraction(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal")
    return budget.top_fraction(c, "c_acctbal", 0.0731)


# Scores.
def centroid_scores(s, d):
    x = _losses(s, d)
    return x.select("row_id", V.argmax(F.col("probs")).alias("predicted"), r6(F.col("loss"), "loss"), r6(F.array_max("probs"), "top"))


def confusion_macro_f1(s, d):
    x = _losses(s, d).withColumn("predicted", V.argmax(F.col("probs")))
    return stats.macro_scores(x, "label", "predicted", C).select(*[r6(F.col(c), c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


def _snap(s, d):
    e = embeddings(s, d)
    models = scoring.snapshots(e, C, 3)
    return e, models, scoring.snapshot_losses(e, models)


def snapshot_loss_stats(s, d):
    return _snap(s, d)[2].select("row_id", r6(F.col("mean_loss"), "mean_loss"), r6(F.col("std_loss"), "std_loss"))


def class_loss_mean(s, d):
    e, models, _ = _snap(s, d)
    x = scoring.class_losses(e, models)
    return x.select("row_id", F.posexplode("class_losses").alias("c", "l")).select("row_id", F.col("c").alias("class"), r6(F.col("l"), "loss"))


def residual_gradient(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C))
    return x.select("row_id", r6(V.norm(F.col("g")), "g_norm"), r6(V.at(F.col("g"), F.col("label")), "g_own"))


def input_gradient(s, d):
    e = embeddings(s, d)
    g = scoring.input_gradients(e, [scoring.Centroid.fit(e, C)])
    return g.select("row_id", F.round(F.col("gradient")[0], 5).alias("g0"), F.round(V.norm(F.col("gradient")), 5).alias("g_norm"))


def deepfool_margin(s, d):
    e = embeddings(s, d)
    return scoring.deepfool_margin(e, scoring.Centroid.fit(e, C)).select("row_id", "predicted", r6(F.col("margin"), "margin"))


# Label and feature quality.
def _oof(s, d):
    e = sample.kfold(embeddings(s, d), "label", "row_id", 5)
    return scoring.out_of_fold(e, C, 5)


def confident_thresholds(s, d):
    return quality.confident_thresholds(_oof(s, d)).select("label", r6(F.col("threshold"), "threshold"))


def confident_joint(s, d):
    return quality.confident_joint(_oof(s, d), C)


def label_issues(s, d):
    return quality.label_issues(_oof(s, d), C).select("row_id", "label", "confident", r6(F.col("margin"), "margin"))


def misdetect_rounds(s, d):
    x = quality.misdetect(embeddings(s, d), C, rounds=3, ratio=0.05)
    return x.where("removed_in IS NOT NULL").select("row_id", "removed_in")


def knn_label_disagreement(s, d):
    e = embeddings(s, d)
    return quality.label_disagreement(e, e, 7).select("row_id", r6(F.col("disagreement"), "disagreement"))


def _curves(s, d):
    """Loss curves: each user's events, in order, are the epochs."""
    e = _t(s, d, "events")
    x = e.withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return x.select(F.col("user_id").alias("row_id"), (F.col("user_id") % 3).cast("int").alias("label"), "epoch", F.col("value").alias("loss"))


def loss_moving_average(s, d):
    return quality.moving_average(_curves(s, d), "row_id", "epoch", "loss", 5).select("row_id", "epoch", r6(F.col("ma"), "ma"))


def ctrl_flags(s, d):
    curves = _curves(s, d)
    epochs = (curves.agg(F.max("epoch")).first()[0] or 0) + 1
    return quality.ctrl_flags(curves, epochs, 3, 2.0).select("row_id", "label", "clean_votes", "noisy")


def ctrl_clusters(s, d):
    """Three clusters of curves in each class and half of the epochs, of which the two of the largest areas are noisy."""
    curves = _curves(s, d)
    epochs = (curves.agg(F.max("epoch")).first()[0] or 0) + 1
    return quality.ctrl_clusters(curves, epochs, 2, 2.0, clusters=3, noisy_clusters=2, restarts=1, iterations=6).select("row_id", "label", "clean_votes", "noisy")


def early_stop_fold(s, d):
    return stats.early_stop(_curves(s, d), "row_id", "epoch", "loss", 4, 0.01)


def recent_drop_stop(s, d):
    """Where the smoothed losses of a user have hardly fallen three times in a row."""
    ma = quality.moving_average(_curves(s, d), "row_id", "epoch", "loss", 5)
    return stats.recent_drop_stop(ma, "row_id", "epoch", "ma", 3, 0.02).select("row_id", r6(F.col("best_loss"), "best_loss"), "steps", "stopped")


def deem_blend_labels(s, d):
    x = quality.blended_soft_labels(_losses(s, d), C)
    return x.select("row_id", r6(F.col("alpha"), "alpha"), r6(V.at(F.col("soft_label"), F.col("label")), "own"), r6(F.array_max("soft_label"), "top"))


def deem_history_labels(s, d):
    e, models, _ = _snap(s, d)
    return quality.history_soft_labels(e, models, C).select("row_id", r6(F.col("observed_prob"), "observed_prob"), r6(F.array_max("soft_label"), "top"))


def dirty_detection(s, d):
    return quality.dirty_rows(_snap(s, d)[2], 0.6, 0.6).select("row_id", "label")


def _dirty(s, d):
    e, models, losses = _snap(s, d)
    dirty = scoring.class_losses(quality.dirty_rows(losses, 0.6, 0.6), models)
    typical = quality.typical_loss(losses, 0.2)
    return dirty, models, typical, losses


def label_candidates(s, d):
    dirty, _, typical, _ = _dirty(s, d)
    x = quality.label_candidates(dirty, C, typical, 6.0, 0.2)
    return x.select("row_id", F.size("candidates").alias("n_candidates"), F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def _stated(s, d):
    dirty, _, typical, _ = _dirty(s, d)
    x = quality.label_candidates(dirty, C, typical, 6.0, 0.2).where("size(candidates) > 0")
    x = x.withColumn("p", F.expr("cast(NULL AS array<double>)")).withColumn("dom_hist", F.expr("cast(array() AS array<int>)")).withColumn("weight", F.lit(0.5))
    for _ in range(3):
        x = quality.updated_label_state(x, C)
    return x, typical


def soft_label_ema(s, d):
    x, _ = _stated(s, d)
    return x.select("row_id", V.argmax(F.col("p")).alias("dominant"), r6(F.array_max("p"), "top"), F.size("dom_hist").alias("n_hist"))


def label_decision(s, d):
    x, typical = _stated(s, d)
    y = quality.label_decision(x, typical, p_hard=0.5, p_soft=0.3, hard_factor=6.0, soft_factor=9.0)
    return y.select("row_id", "decision", "label", r6(F.col("new_weight"), "new_weight"))


def feature_core_concentration(s, d):
    """Core columns of p - q gradients."""
    x = _losses(s, d).withColumn("gradient", scoring.residual(F.col("probs"), F.col("label"), C))
    y = quality.feature_core(x, 0.8, 3)
    return y.select("row_id", r6(F.col("amplitude"), "amplitude"), F.array_join(F.col("core").cast("array<string>"), ",").alias("core"))


def mixed_and_clean_weights(s, d):
    _, _, losses = _snap(s, d)
    dirty = quality.dirty_rows(losses, 0.6, 0.6).select("row_id", F.lit(True).alias("dirty"))
    x = losses.join(dirty, "row_id", "left").withColumn("is_dirty", F.coalesce("dirty", F.lit(False))).withColumn("is_mixed", F.col("is_dirty") & (F.col("row_id") % 2 == 0)).withColumn("weight", (F.col("row_id") % 10) / 10.0)
    return quality.mixed_and_clean_weights(x, least=0.1).select("row_id", r6(F.col("new_weight"), "new_weight"))


# Coresets.
def _reps(s, d):
    return sample.exact_sample(embeddings(s, d), "row_id", 40, "reps")


def nearest_center_map(s, d):
    return distance.nearest(embeddings(s, d), _reps(s, d)).select("row_id", "rep_id", r6(F.col("d2"), "d2"))


def kd_map(s, d):
    """The nearest of 400 representatives by one descent of a k-d tree."""
    e = embeddings(s, d)
    return kdtree.kd_nearest(e, sample.exact_sample(e, "row_id", 400, "kd")).select("row_id", "rep_id", r6(F.col("d2"), "d2"))


def coreset_weights(s, d):
    r = _reps(s, d)
    return distance.representative_weights(distance.nearest(embeddings(s, d), r), r)


def coreset_error(s, d):
    e, r = embeddings(s, d), _reps(s, d)
    return distance.coreset_error(e, "features", distance.representative_weights(distance.nearest(e, r), r)).select(r6(F.col("gradient_error"), "gradient_error"), r6(F.col("weight_error"), "weight_error"))


def deem_topk_cosine(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C))
    return select.topk_cosine(x, "g", 50).select("row_id", r6(F.col("sample_weight"), "sample_weight"))


def herding_per_class(s, d):
    return select.herding(embeddings(s, d), C, 0.1).select("label", "pick", "row_id", r6(F.col("sample_weight"), "sample_weight"))


def goodcore_greedy(s, d):
    return select.goodcore(embeddings(s, d), C, 0.06).select("label", "pick", "row_id")


def weighted_coverage(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C)).withColumn("w", (F.col("row_id") % 10 + 1) / 10.0)
    return select.weighted_coverage(x, "g", 12, "w")


def gradmatch_omp(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C))
    return select.gradmatch(x, "g", C, 0.1).select("label", "pick", "row_id", r6(F.col("sample_weight"), "sample_weight"))


def random_trial_coreset(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C))
    return select.random_trials(x, "g", 25, 3).select("trial", r6(F.col("gradient_error"), "gradient_error"), r6(F.col("weight_error"), "weight_error"))


def incremental_blocks(s, d):
    x = _losses(s, d).withColumn("g", scoring.residual(F.col("probs"), F.col("label"), C))
    return select.incremental_blocks(x, "g", 20, 10, 2)


def rep_replacement(s, d):
    return select.best_replacement(distance.nearest(embeddings(s, d), _reps(s, d)), "features")


def farthest_first(s, d):
    k = budget.allocation(stats.class_counts(embeddings(s, d)), C, 0.06)
    return select.farthest(embeddings(s, d), k).select("label", "pick", "row_id")


def coreset_slice(s, d):
    """The flagship slice: standardise, score, budget by class, top-k, nearest representative, weights."""
    e = encode.standardise(embeddings(s, d))
    x = scoring.with_probs(e, scoring.Centroid.fit(e, C, 10.0)).withColumn("loss", scoring.loss(F.col("probs"), F.col("label")))
    reps = budget.classwise_topk(x, "loss", C, 0.1, largest=False).select("row_id", "features", "label")
    return distance.representative_weights(distance.nearest(e, reps), reps)


# Trees and composed methods.
def leaf_homogeneity(s, d):
    """Leaf scores of lineitem, with three bucketed columns for trees."""
    li = lineitem_points(s, d)
    f = F.col("features")
    leaves = F.array(F.floor(f[0] / 10), F.floor(f[1] / 2000), F.floor(f[2] * 20 + 0.5)).cast("array<int>")
    x = trees.leaf_scores(li.withColumn("leaves", leaves), 5, 0.55)
    return x.groupBy("label", r6(F.col("score"), "score")).agg(F.count(F.lit(1)).alias("n"))


def _sign_leaves(s, d):
    return embeddings(s, d).withColumn("leaves", F.transform(F.slice("features", 1, 8), lambda x: (x > 0).cast("int")))


def coretab_groups(s, d):
    return trees.pure_groups(_sign_leaves(s, d), 8)


def coretab_thinned(s, d):
    return trees.thinned(_sign_leaves(s, d), 8, 0.03, 10).select("row_id", "label")


def boosted_leaves(s, d):
    """Leaves of two rounds of depth 2 that tell classes 5 to 9 from the others."""
    e = embeddings(s, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    model = boost.fit(e, 2, n_rounds=2, depth=2, rate=0.3, bins=16, spaced="width")
    return boost.with_leaves(e, model).select("row_id", F.col("leaves")[0].alias("first"), F.col("leaves")[1].alias("second"))


def coretab_datamap(s, d):
    return trees.datamap_coreset(embeddings(s, d), C, 0.1, 10, 3).select("row_id", "label", "sample_weight")


def pipeline_misdetect_coretab(s, d):
    return coreset.misdetect_then_trees(embeddings(s, d), C, 0.1)


def quality_coreset(s, d):
    """The staged loop over noisy embeddings."""
    noisy = noise.random_noise(embeddings(s, d), 0.2, C).select("row_id", "features", "label")
    return coreset.quality_coreset(noisy, C, coreset.Config())[0].select("row_id", "label", r6(F.col("sample_weight"), "sample_weight"))


def parallel_epoch(s, d):
    """Losses after one data-parallel epoch from nothing: shards of about 100 rows step once each, models are averaged by rows."""
    e = embeddings(s, d).select("row_id", "features", "label")
    fit = coupled.Coupled(hidden=(), dropout=0.0, batch=1 << 20, rate=0.01, shard=100)
    net = scoring.Mlp(stats.width(e), C, (), 0.0)
    net = net.with_state(net.state() * 0, 0, fit.seed)
    rows = e.select("row_id", "features", V.one_hot(F.col("label"), C).alias("soft_label"), F.lit(1.0).alias("sample_weight"))
    net = coupled.epochs(coupled.dealt(rows, fit.shard), net, fit, 0, 1)[0][0]
    out = scoring.with_probs(e, net)
    return out.select("row_id", "label", r6(scoring.loss(F.col("probs"), F.col("label")), "loss"), V.argmax(F.col("probs")).alias("predicted"))


def quality_training(s, d):
    """The staged loop over noisy embeddings on a network that trains as it goes: the coreset of its last stage."""
    noisy = noise.random_noise(embeddings(s, d), 0.2, C).select("row_id", "features", "label")
    fit = coupled.Coupled(hidden=(256, 128), norm=True, warmup=5, interval=4, epochs=30, batch=256)
    return trained.quality_training(noisy, C, trained.Trained(fraction=0.02, fit=fit)).coreset.select("row_id", "label", r6(F.col("sample_weight"), "sample_weight"))


# Experiments.
def experiment_pivot(s, d):
    o = _t(s, d, "orders")
    x = o.select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    return x.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


def experiment_transpose(s, d):
    o = _t(s, d, "orders")
    wide = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    long = wide.unpivot("o_orderstatus", ["n", "avg_price"], "metric", "value")
    return long.groupBy("metric").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("value"))


def job_matrix(s, d):
    """Jobs: datasets x methods x noise rates, without rates for the real dirty dataset."""
    ds_, me = _t(s, d, "region").select(F.col("r_name").alias("dataset")), _t(s, d, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("method"))
    rates = s.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,)], "rate double")
    return ds_.join(me).join(rates).where((F.col("dataset") != "ASIA") | (F.col("rate") == 0.0))


def training_overlay(s, d):
    """Rows to train on: rows of class 0 are relabelled, soft targets are the first two features' sizes."""
    e = embeddings(s, d)
    fix = e.select("row_id", F.when(F.col("label") == 0, 1).alias("label"), F.array(*[F.abs(F.col("features")[i]) for i in (0, 1)]).alias("soft"))
    out = results.training_rows(e, labels=fix, soft=fix)
    return out.select("row_id", "label", r6(F.col("soft")[0], "first"), r6(F.col("soft")[1], "second"), "sample_weight")


QUERIES = {
    f.__name__: f
    for f in (
        scan_points, label_encode, label_lookup_fallback, lenient_cast_impute, rule_repair, standardize, row_l2, center_by_class, minmax01,
        class_counts, mode_label, quantile_thresholds, column_bounds, dedupe_selected, weighted_epoch_loss,
        stratified_split, kfold_assign, exact_sample, trial_subsets, overlap_check, anti_remaining, clean_dirty_pairs,
        noise_types, random_noise, shift_noise, noise_validation, class_allocation, classwise_topk, bounded_candidates, weighted_top_fraction,
        centroid_scores, confusion_macro_f1, snapshot_loss_stats, class_loss_mean, residual_gradient, input_gradient, deepfool_margin,
        confident_thresholds, confident_joint, label_issues, misdetect_rounds, knn_label_disagreement, loss_moving_average, ctrl_flags, ctrl_clusters, early_stop_fold, recent_drop_stop,
        deem_blend_labels, deem_history_labels, dirty_detection, label_candidates, soft_label_ema, label_decision, feature_core_concentration, mixed_and_clean_weights,
        nearest_center_map, kd_map, coreset_weights, coreset_error, deem_topk_cosine, herding_per_class, goodcore_greedy, weighted_coverage, gradmatch_omp,
        random_trial_coreset, incremental_blocks, rep_replacement, farthest_first, coreset_slice, leaf_homogeneity, coretab_groups, coretab_thinned,
        boosted_leaves, coretab_datamap, pipeline_misdetect_coretab, quality_coreset, parallel_epoch, quality_training, experiment_pivot, experiment_transpose, job_matrix, training_overlay,
    )
}
