"""Label and feature quality: confident learning, loss-based detection, soft labels, decisions on labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.operators import kmeans, scoring, stats
from gleanset.operators.distance import nearest_k
from gleanset.operators.scratch import checkpointed


# Confident learning (our definition, from the published method).
def confident_thresholds(scored: DataFrame) -> DataFrame:
    """(label, threshold): mean probability of the own label, by label."""
    return scored.groupBy("label").agg(F.avg(V.at(F.col("probs"), F.col("label"))).alias("threshold"))


def _threshold_array(scored: DataFrame, n_classes: int) -> list[float]:
    t = {r["label"]: r["threshold"] for r in confident_thresholds(scored).collect()}
    return [t.get(c, float("inf")) for c in range(n_classes)]


def confident_labels(scored: DataFrame, n_classes: int) -> DataFrame:
    """Adds ``confident``: of the classes at or over their thresholds the likeliest; null if there is none."""
    t = _threshold_array(scored, n_classes)
    over = F.zip_with("probs", V.vector(t), lambda p, h: F.when(p >= h, p).otherwise(-1.0))
    return scored.withColumn("confident", F.when(F.array_max(over) >= 0, V.argmax(over)))


def confident_joint(scored: DataFrame, n_classes: int) -> DataFrame:
    """(label, confident, n) counts."""
    return confident_labels(scored, n_classes).where("confident IS NOT NULL").groupBy("label", "confident").agg(F.count(F.lit(1)).alias("n"))


def label_issues(scored: DataFrame, n_classes: int, filter_by: str = "confident_learning", share: float = 0.0) -> DataFrame:
    """Rows whose label is likely wrong, with ``margin`` (likeliest less own probability) and its rank.

    ``confident_learning``: the confident class differs; ``predicted_neq_given``: the likeliest class
    differs; ``prune_by_class``: of each class as many rows of the lowest own probability as the joint
    counts off its diagonal; ``prune_by_noise_rate``: for each off-diagonal cell as many rows of the largest
    margin towards that class. ``share`` > 0 keeps only so large a part of the table.
    """
    own = V.at(F.col("probs"), F.col("label"))
    df = confident_labels(scored, n_classes).withColumn("predicted", V.argmax(F.col("probs"))).withColumn("margin", F.array_max("probs") - own)
    if filter_by == "confident_learning":
        out = df.where("confident IS NOT NULL AND confident <> label")
    elif filter_by == "predicted_neq_given":
        out = df.where("predicted <> label")
    elif filter_by in ("prune_by_class", "prune_by_noise_rate"):
        joint = {(r["label"], r["confident"]): r["n"] for r in confident_joint(scored, n_classes).collect()}
        if filter_by == "prune_by_class":
            off = {c: sum(n for (a, b), n in joint.items() if a == c != b) for c in range(n_classes)}
            limit = F.element_at(F.array(*[F.lit(off[c]) for c in range(n_classes)]), F.col("label") + 1)
            out = df.withColumn("__r", F.row_number().over(Window.partitionBy("label").orderBy(own, "row_id"))).where(F.col("__r") <= limit).drop("__r")
        else:
            cells = F.array(*[F.struct(F.lit(b).alias("to"), F.array(*[F.lit(joint.get((a, b), 0)) for a in range(n_classes)]).alias("n")) for b in range(n_classes)])
            each = df.withColumn("__c", F.explode(cells)).where(F.col("__c.to") != F.col("label")).withColumn("__m", V.at(F.col("probs"), F.col("__c.to")) - own)
            each = each.withColumn("__r", F.row_number().over(Window.partitionBy("label", "__c.to").orderBy(F.desc("__m"), "row_id")))
            out = each.where(F.col("__r") <= F.element_at(F.col("__c.n"), F.col("label") + 1)).drop("__c", "__m", "__r").dropDuplicates(["row_id"])
    else:
        raise ValueError(f"unknown filter {filter_by}")
    if share > 0:
        out = out.orderBy(F.desc("margin"), "row_id").limit(max(1, round(share * scored.count())))
    return out


def apply_action(points: DataFrame, issues: DataFrame, action: str, weight: float = 0.1) -> DataFrame:
    """Adds sample_weight and corrected label: ``remove``, ``downweight`` or ``relabel``; all rows at weight 1 if none would be left."""
    flagged = issues.select("row_id", F.col("predicted").alias("__p")).withColumn("__bad", F.lit(True))
    df = points.join(flagged, "row_id", "left")
    bad = F.coalesce("__bad", F.lit(False))
    if action == "remove":
        df = df.withColumn("sample_weight", F.lit(1.0))
        if df.where(~bad).isEmpty():
            return df.drop("__p", "__bad")
        return df.where(~bad).drop("__p", "__bad")
    if action == "downweight":
        return df.withColumn("sample_weight", F.when(bad, weight).otherwise(1.0)).drop("__p", "__bad")
    if action == "relabel":
        return df.withColumn("label", F.when(bad, F.col("__p")).otherwise(F.col("label"))).withColumn("sample_weight", F.lit(1.0)).drop("__p", "__bad")
    raise ValueError(f"unknown action {action}")


# Loss-based detection.
def misdetect(points: DataFrame, n_classes: int, rounds: int = 3, ratio: float = 0.05, strategy: str = "top_ratio", factor: float = 1.0, max_ratio: float = 1.0, min_remaining: int = 20, tau: float = scoring.TAU) -> DataFrame:
    """Adds ``removed_in`` (round, or null): each round fits on what is left and removes the largest losses.

    ``top_ratio`` removes max(1, round(ratio * n)) rows; ``mean_std`` those over mean + factor * deviation, cut
    to max_ratio in id order; both leave ``min_remaining`` rows.
    """
    df = points.withColumn("removed_in", F.lit(None).cast("int"))
    for r in range(1, rounds + 1):
        left = df.where("removed_in IS NULL")
        n = left.count()
        room = n - min_remaining
        if room <= 0:
            break
        scored = scoring.with_probs(left, scoring.Centroid.fit(left, n_classes, tau)).select("row_id", scoring.loss(F.col("probs"), F.col("label")).alias("l"))
        if strategy == "top_ratio":
            gone = scored.orderBy(F.desc("l"), "row_id").limit(min(room, max(1, round(ratio * n))))
        else:
            m = scored.agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s")).first()
            gone = scored.where(F.col("l") > m["m"] + factor * m["s"]).orderBy("row_id").limit(min(room, max(1, round(max_ratio * n))))
        df = df.join(gone.select("row_id", F.lit(r).alias("__r")), "row_id", "left").withColumn("removed_in", F.coalesce("removed_in", "__r")).drop("__r")
    return df


def label_disagreement(candidates: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Adds ``disagreement``: the share of the k nearest other rows of the pool whose label differs."""
    near = nearest_k(candidates, pool, k)
    same = F.size(F.filter("neighbours", lambda s: s["label"] == F.col("label")))
    return near.withColumn("disagreement", F.when(F.size("neighbours") > 0, 1.0 - same / F.size("neighbours")).otherwise(0.0)).drop("neighbours")


# Loss curves.
def moving_average(curves: DataFrame, row: str, epoch: str, loss: str, window: int) -> DataFrame:
    """Adds ``ma``: the trailing mean of ``window`` epochs; earlier epochs take the first full one's. Epochs count from 0."""
    w = Window.partitionBy(row).orderBy(epoch)
    n = F.count(F.lit(1)).over(Window.partitionBy(row))
    width = F.least(F.lit(window), n)
    trail = F.avg(loss).over(w.rowsBetween(-(window - 1), 0))
    whole = Window.partitionBy(row).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = curves.withColumn("__ma", trail).withColumn("__w", width)
    first = F.first(F.when(F.col(epoch) == F.col("__w") - 1, F.col("__ma")), ignorenulls=True).over(whole)
    return df.withColumn("ma", F.when(F.col(epoch) < F.col("__w") - 1, first).otherwise(F.col("__ma"))).drop("__ma", "__w")


def epoch_windows(epochs: int, windows: int) -> list[tuple[int, int]]:
    """Equal windows of epochs: edges at int(k * epochs / windows)."""
    edges = [int(k * epochs / windows) for k in range(windows + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def split_in_two(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``high``: exact two-means of a scalar in each group. The best cut is between two neighbours in order.

    Sums of each prefix give every cut's within-group squares; the first best cut counts.
    """
    w = Window.partitionBy(*by).orderBy(value, "row_id")
    whole = Window.partitionBy(*by)
    x = df.withColumn("__n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__all", F.count(F.lit(1)).over(whole)).withColumn("__total", F.sum(value).over(whole))
    between = F.when(F.col("__n") < F.col("__all"), F.col("__s") * F.col("__s") / F.col("__n") + (F.col("__total") - F.col("__s")) * (F.col("__total") - F.col("__s")) / (F.col("__all") - F.col("__n")))
    x = x.withColumn("__b", F.coalesce(F.round(between, 9), F.lit(-1.0)))
    x = x.withColumn("__cut", -F.max(F.struct(F.col("__b").alias("b"), (-F.col("__n")).alias("n"))).over(whole).getField("n"))
    return x.withColumn("high", (F.col("__n") > F.col("__cut")) & (F.col("__all") > 1)).drop("__cut").drop("__n", "__s", "__all", "__total", "__b")


def ctrl_flags(curves: DataFrame, epochs: int, windows: int = 1, threshold: float = 1.0, smooth: int = 5) -> DataFrame:
    """(row_id, label, clean_votes, noisy) from loss curves (row_id, label, epoch, loss).

    Smoothed curves are cut in windows; in each class and window the rows with the larger area (two-means) get no
    clean vote. Rows with fewer clean votes than required are noisy.
    """
    ma = moving_average(curves, "row_id", "epoch", "loss", smooth)
    edges = epoch_windows(epochs, windows)
    which = F.coalesce(*[F.when((F.col("epoch") >= a) & (F.col("epoch") < b), k) for k, (a, b) in enumerate(edges)])
    areas = ma.withColumn("window", which).groupBy("row_id", "label", "window").agg(F.sum("ma").alias("area"))
    votes = split_in_two(areas, ["label", "window"], "area").groupBy("row_id", "label").agg(F.sum((~F.col("high")).cast("int")).alias("clean_votes"))
    return votes.withColumn("noisy", F.col("clean_votes") < votes_needed(threshold, len(edges)))


def ctrl_clusters(curves: DataFrame, epochs: int, windows: int = 1, threshold: float = 1.0, smooth: int = 5, clusters: int = 2, noisy_clusters: int = 1, restarts: int = 10, iterations: int = 100) -> DataFrame:
    """(row_id, label, clean_votes, noisy) as ``ctrl_flags``, from k-means over the smoothed curves themselves.

    In each class and window of epochs the ``noisy_clusters`` clusters of the largest mean area give no clean vote. Epochs that a
    curve lacks count 0 in its window; a curve without any epoch there has no vote of it; a class of one row is clean.
    """
    edges = epoch_windows(epochs, windows)
    ma = moving_average(curves, "row_id", "epoch", "loss", smooth)
    of = lambda values: F.coalesce(*[F.when((F.col("epoch") >= a) & (F.col("epoch") < b), v) for v, (a, b) in zip(values, edges, strict=True)])
    each = ma.withColumns({"window": of(range(len(edges))), "a": of([a for a, _ in edges])})
    width = max((b - a for a, b in edges), default=0)
    known = each.groupBy("row_id", "label", "window").agg(F.map_from_entries(F.collect_list(F.struct((F.col("epoch") - F.col("a")).cast("int").alias("at"), "ma"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    rows = checkpointed(known.select("row_id", "label", "window", (F.col("label").cast("long") * len(edges) + F.col("window")).alias("group"), v.alias("v")))
    found = kmeans.clustered(rows, max(2, clusters), restarts, iterations).select("row_id", "label", "window", "group", "cluster", V.vsum(F.col("v")).alias("area"))
    mean = found.groupBy("group", "cluster").agg(F.round(F.avg("area"), 9).alias("area"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("group")  # as many rows as clusters
    rank = F.row_number().over(of_group.orderBy(F.desc("area"), "cluster"))
    bad = mean.select("group", "cluster", ((rank <= noisy_clusters) & (F.sum("n").over(of_group) > 1)).alias("bad"))
    votes = found.join(F.broadcast(bad), ["group", "cluster"]).groupBy("row_id", "label").agg(F.sum((~F.col("bad")).cast("int")).alias("clean_votes"))
    return votes.withColumn("noisy", F.col("clean_votes") < votes_needed(threshold, len(edges)))


def votes_needed(threshold: float, windows: int) -> int:
    """A threshold of at most 1 is rounded up, a larger one down; at least one vote, at most all windows."""
    return max(1, min(int(-(-threshold // 1)) if threshold <= 1 else int(threshold), windows))


# Soft labels.
def blended_soft_labels(scored: DataFrame, n_classes: int, alpha_max: float = 0.8, gamma: float = 1.0) -> DataFrame:
    """Adds ``alpha`` and ``soft_label``: the hard label mixed with ``probs``, more so for larger ``loss``."""
    r = scored.agg(F.min("loss").alias("lo"), F.max("loss").alias("hi")).first()
    lo, span = r["lo"] or 0.0, max((r["hi"] or 0.0) - (r["lo"] or 0.0), 1e-12)
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(alpha_max), alpha_max * F.pow((F.col("loss") - lo) / span, F.lit(gamma))))
    df = scored.withColumn("alpha", alpha)
    mixed = F.zip_with(V.one_hot(F.col("label"), n_classes), "probs", lambda h, p: (1 - F.col("alpha")) * h + F.col("alpha") * p)
    return df.withColumn("soft_label", V.sum_normalised(mixed))


def history_soft_labels(points: DataFrame, models: list, n_classes: int) -> DataFrame:
    """Adds ``soft_label`` and ``observed_prob`` from the mean and deviation of class losses over snapshots."""
    def over(of):
        return ("array<double>", lambda x, _: of([-np.log(np.clip(m.probs(x), 1e-12, 1)) for m in models], 0).tolist())

    df = scoring.with_arrays(points, {"__m": over(np.mean), "__s": over(np.std)})
    r = df.agg(*[f(g(c)).alias(f"{c}{n}") for c in ("__m", "__s") for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))]).first()
    scaled = lambda c: F.transform(c, lambda x: (x - r[f"{c}lo"]) / (r[f"{c}hi"] - r[f"{c}lo"])) if r[f"{c}lo"] is not None and r[f"{c}hi"] > r[f"{c}lo"] else F.transform(c, lambda x: F.lit(0.0))
    h = F.zip_with(scaled("__m"), scaled("__s"), lambda a, b: F.greatest(1.0 - 0.5 * (a + b), F.lit(1e-6)))
    return df.withColumn("soft_label", V.sum_normalised(h)).withColumn("observed_prob", V.at(F.col("soft_label"), F.col("label"))).drop("__m", "__s")


def drop_unlikely(df: DataFrame, prob: str, ratio: float, min_remaining: int) -> DataFrame:
    """Without the round(ratio * n) lowest probabilities, leaving ``min_remaining`` rows."""
    n = df.count()
    k = max(0, min(n - min_remaining, round(ratio * n)))
    gone = df.orderBy(prob, "row_id").limit(k).select("row_id") if k else df.limit(0).select("row_id")
    return df.join(gone, "row_id", "left_anti")


# Stage decisions of the flagship method.
def dirty_rows(losses: DataFrame, mean_q: float = 0.8, std_q: float = 0.5, most: int = 0) -> DataFrame:
    """Rows with a large mean loss and a small deviation over snapshots; at most ``most`` (0: all) by mean loss."""
    t = losses.agg(F.percentile("mean_loss", F.lit(mean_q)).alias("m"), F.percentile("std_loss", F.lit(std_q)).alias("s")).first()
    if t["m"] is None:
        return losses.limit(0)
    out = losses.where((F.col("mean_loss") >= t["m"]) & (F.col("std_loss") <= t["s"]))
    return out.orderBy(F.desc("mean_loss"), "row_id").limit(most) if most else out


def typical_loss(losses: DataFrame, q: float = 0.2) -> float:
    return max(losses.agg(F.percentile("mean_loss", F.lit(q))).first()[0] or 0.0, 1e-8)


def label_candidates(dirty: DataFrame, n_classes: int, typical: float, abs_factor: float = 1.8, rel_improve: float = 0.2) -> DataFrame:
    """Adds ``candidates``: other classes whose loss is small, absolutely and beside the current label's."""
    cur = F.greatest(V.at(F.col("class_losses"), F.col("label")), F.lit(1e-8))
    fits = lambda c: (c != F.col("label")) & (V.at(F.col("class_losses"), c) <= abs_factor * typical) & (V.at(F.col("class_losses"), c) <= (1 - rel_improve) * cur)
    return dirty.withColumn("candidates", F.filter(F.sequence(F.lit(0), F.lit(n_classes - 1)), fits))


def updated_label_state(df: DataFrame, n_classes: int, temperature: float = 2.0, alpha: float = 0.7, window: int = 3) -> DataFrame:
    """One update of the label state ``p`` (array or null) and ``dom_hist`` from ``candidates`` and ``class_losses``.

    The instant distribution is a softmax of -T * loss over the candidates; p moves towards it by ``1 - alpha``
    (at first it is taken whole); the dominant class joins the history of ``window`` entries.
    """
    least = F.array_min(F.transform("candidates", lambda c: V.at(F.col("class_losses"), c)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.when(F.array_contains("candidates", c), F.exp(-temperature * (V.at(F.col("class_losses"), c) - least))).otherwise(0.0))
    df = df.withColumn("__i", V.sum_normalised(raw))
    moved = V.sum_normalised(F.zip_with("p", "__i", lambda a, b: alpha * a + (1 - alpha) * b))
    df = df.withColumn("p", F.when(F.col("p").isNull(), F.col("__i")).otherwise(moved)).drop("__i")
    longer = F.concat(F.coalesce("dom_hist", F.expr("cast(array() AS array<int>)")), F.array(V.argmax(F.col("p"))))
    return df.withColumn("dom_hist", F.slice(longer, F.greatest(F.lit(1), F.size(longer) - window + 1), F.lit(window)))


def stable(window: int, consistency: float) -> Column:
    """Whether the history is full and its last dominant class frequent enough."""
    dom = F.element_at("dom_hist", -1)
    return (F.size("dom_hist") >= window) & (F.size(F.filter("dom_hist", lambda x: x == dom)) / F.size("dom_hist") >= consistency)


def label_decision(df: DataFrame, typical: float, judge: bool = True, p_hard: float = 0.9, p_soft: float = 0.55, window: int = 3, consistency: float = 0.67, hard_factor: float = 1.5, soft_factor: float = 2.2, delete_factor: float = 3.0, rho_max: float = 0.5, p_upper: float = 0.75, decay: float = 0.7, floor: float = 0.3, initial: float = 0.5) -> DataFrame:
    """Adds ``decision`` (hard, soft, decay, remove, keep), the new label and ``new_weight``.

    hard: on a judging stage, stable, confident and of small loss: relabel at weight 1. soft: stable and rather
    confident: the weight rises with the confidence. Otherwise, uncertain rows decay and, if their best loss
    is large, are removed; the rest keep a weight between floor and initial.
    """
    dom, top = V.argmax(F.col("p")), F.array_max("p")
    loss = V.at(F.col("class_losses"), dom)
    steady = stable(window, consistency)
    share = F.array_max(F.transform(F.array_distinct("dom_hist"), lambda c: F.size(F.filter("dom_hist", lambda x: x == c)))) / F.size("dom_hist")
    hard = F.lit(judge) & steady & (top >= p_hard) & (loss <= hard_factor * typical)
    soft = steady & (top >= p_soft) & (loss <= soft_factor * typical)
    uncertain = (share <= rho_max) & (top <= p_upper)
    remove = uncertain & (F.array_min("class_losses") >= delete_factor * typical)
    ramp = F.lit(floor) + (1 - floor) * (top - p_soft) / max(1e-12, p_hard - p_soft)
    decision = F.when(hard, "hard").when(soft, "soft").when(remove, "remove").when(uncertain, "decay").otherwise("keep")
    weight = F.when(hard, 1.0).when(soft, F.greatest(F.lit(floor), F.least(F.lit(1.0), ramp))).when(remove, 0.0).when(uncertain, F.col("weight") * decay).otherwise(F.greatest(F.lit(floor), F.least(F.lit(initial), F.col("weight"))))
    return df.withColumn("decision", decision).withColumn("label", F.when(hard | soft, dom).otherwise(F.col("label"))).withColumn("new_weight", weight)


def feature_core(df: DataFrame, share: float = 0.8, most: int = 3, gradient: str = "gradient") -> DataFrame:
    """Adds ``amplitude`` and ``core``: the fewest columns that hold ``share`` of |gradient|, if ``most`` suffice; else null."""
    sized = F.transform(gradient, lambda g, i: F.struct((-F.abs(g)).alias("a"), i.alias("i")))
    df = df.withColumn("amplitude", V.vsum(F.transform(gradient, F.abs))).withColumn("__o", F.slice(F.array_sort(sized), 1, most))
    sums = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: V.vsum(F.transform(F.slice("__o", F.lit(1), k), lambda s: -s["a"])))
    k = F.array_position(F.transform(sums, lambda s: s >= share * F.col("amplitude") - 1e-12), True).cast("int")
    return df.withColumn("core", F.when((F.col("amplitude") > 1e-12) & (k > 0), F.transform(F.slice("__o", F.lit(1), F.greatest(k, F.lit(1))), lambda s: s["i"]))).drop("__o")


def virtual_step(df: DataFrame, step: float = 0.05) -> DataFrame:
    """Adds ``virtual``: the core's features moved against the sign of the gradient."""
    return df.withColumn("virtual", F.transform("features", lambda x, i: F.when(F.array_contains("core", i), x - step * F.signum(F.element_at("gradient", i + 1))).otherwise(x)))


def repair_coefficients(g, previous, previous_sign, smooth: float = 0.9, lo: float = 0.2, hi: float = 1.0):
    """Step sizes by column from relative |gradient| of a row (or of each row), smoothed over steps; a changed sign counts as 0. (numpy)"""
    rel = np.abs(g) / np.maximum(np.abs(g).sum(-1, keepdims=True), 1e-12)
    steady = np.ones_like(rel) if previous_sign is None else (np.sign(g) == previous_sign).astype(float)
    score = np.clip(smooth * previous + (1 - smooth) * rel * steady, 0, 1)
    return lo + (hi - lo) * score, score


def mixed_and_clean_weights(df: DataFrame, down: float = 0.5, up: float = 0.05, least: float = 0.05) -> DataFrame:
    """Adds ``new_weight``: mixed rows are weighed down (removed under ``least``), stable clean ones up to 1.

    ``df`` has weight, mean_loss, std_loss, is_dirty and is_mixed. Clean rows are those that aren't dirty, with a mean
    loss up to the median and a deviation up to its median.
    """
    t = df.agg(F.percentile("mean_loss", F.lit(0.5)).alias("m"), F.percentile("std_loss", F.lit(0.5)).alias("s")).first()
    lowered = F.col("weight") * down
    clean = ~F.col("is_dirty") & (F.col("mean_loss") <= (t["m"] or 0.0)) & (F.col("std_loss") <= (t["s"] or 0.0))
    w = F.when(F.col("is_mixed"), F.when(lowered < least, 0.0).otherwise(lowered)).when(clean & (F.col("weight") > 0), F.least(F.lit(1.0), F.col("weight") + up)).otherwise(F.col("weight"))
    return df.withColumn("new_weight", w)


def centroid_cleaning(points: DataFrame, n_classes: int, folds: int = 5, **options) -> DataFrame:
    """Out-of-fold probabilities by stratified folds, then label issues."""
    from gleanset.operators.sample import kfold

    k = min(folds, max(2, min(stats.class_counts(points).values(), default=2)))
    return label_issues(scoring.out_of_fold(kfold(points, "label", "row_id", folds), n_classes, k), n_classes, **options)
