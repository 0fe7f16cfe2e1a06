"""Difficulty: a percentile rule, probes by pattern, and a multinomial model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import band
from ..plans.cut import cut, size_checked
from .stats import impute_median, percentile_ranks, standardize, unpivot

# ---------------------------------------------------------------- fixed values
RULE_FEATURES = ("midi_max", "max_chord_stack", "voice_count_max", "polyphonic_measure_ratio", "measure_count")
BANDS = ((0.0, 20.0, "3"), (20.0, 35.0, "5"), (35.0, 55.0, "6"), (55.0, 80.0, "7"), (80.0, 101.0, "8"))
MODEL_FEATURES = (
    "midi_min midi_max midi_range midi_median key_changes meter_changes smallest_division dotted_count tied_count tuplet_count notes_per_measure "
    "accidentals_outside_key max_chord_stack polyphonic_measure_ratio voice_count_max ornament_mordent ornament_trill ornament_turn grace_count "
    "harmonic_count barre_count pitch_min_fret_max pitch_min_fret_p90 pitch_position_shifts measure_count note_count duration_sec_approx"
).split()
RECODE = {4: 5, 10: 9}
# ---------------------------------------------------------------- end of fixed values
BLOCK = 4096  # rows of a block of ``packed``
PART_ROWS = 100_000  # rows of a partition of them, about


def rule_grades(rows: DataFrame, key: Sequence[str], features: Sequence[str] = RULE_FEATURES, bands=BANDS) -> DataFrame:
    """(key..., composite, predicted): the mean of the row's percentile ranks in the
    features it has, and the band that falls in; null without any. ``key`` identifies rows."""
    long = unpivot(rows, key, features).where("x is not null")
    # sums of many decimals depend on their order; a sorted array does not
    ranks = size_checked(cut(percentile_ranks(rows, features)), 500_000)  # a value may be that of most rows
    got = long.join(ranks, ["feature", "x"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("feature", "pct"))).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["pct"]) / F.size("p")
    return rows.select(*key).join(got.select(*key, F.round(mean, 6).alias("composite")), list(key), "left").withColumn("predicted", band("composite", bands))


def probe_matches(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe with the rows whose title and composer match its patterns; a probe
    without a match keeps one row of nulls. ``probes`` (probe, title_re, composer_re,
    consensus) is a short list; rows are scanned once."""
    cond = F.expr("r.title rlike p.title_re and r.composer rlike p.composer_re")
    return probes.alias("p").join(rows.alias("r"), cond, "left").select("p.*", "r.candidate_id", "r.g", "r.source")


def consensus(matched: DataFrame) -> DataFrame:
    """Per probe: how many grades, the upper median, least, greatest, the sources, the
    difference to the consensus and a verdict."""
    g = F.sort_array(F.collect_list("g"))
    a = matched.groupBy("probe", "consensus").agg(F.count("candidate_id").alias("n_match"), g.alias("gs"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))
    median = F.get("gs", F.floor(F.size("gs") / 2).cast("int"))
    d = median - F.col("consensus")
    verdict = F.when(F.col("n_match") == 0, "no match").when(F.size("gs") == 0, "no grade").when(F.abs(d) <= 1, "good").when(F.abs(d) <= 2, "fair").otherwise("off")
    return a.select("probe", "consensus", "n_match", median.alias("median"), F.array_min("gs").alias("least"), F.array_max("gs").alias("greatest"), "sources", d.alias("delta"), verdict.alias("verdict"))


def recode(c):
    return F.coalesce(*[F.when(F.col(c) == a, F.lit(b)) for a, b in RECODE.items()], F.col(c))


def design(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Median-imputed features; the medians are over all rows, labelled or not."""
    return impute_median(rows, list(features))


def fit_logistic(labelled: DataFrame, features: Sequence[str], label: str = "label", iterations: int = 2000):
    """Multinomial logistic regression with L2 (C = 1) and balanced class weights
    n / (k n_class), which sum to n, so that regParam is 1 / n. Features must already be
    standardised. Returns the fitted model and its classes in order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    by = labelled.groupBy(label).agg(F.count("*").alias("_c"))
    classes = sorted(r[label] for r in by.select(label).collect())  # as many rows as classes
    n = labelled.count()
    index = F.coalesce(*[F.when(F.col(label) == c, F.lit(float(i))) for i, c in enumerate(classes)])
    data = labelled.join(F.broadcast(by), label).withColumn("_w", F.lit(float(n)) / (len(classes) * F.col("_c"))).withColumn("_y", index)
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(data).select("_x", "_y", "_w")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)
    return model, classes


def score_logistic(rows: DataFrame, features: Sequence[str], coef: Sequence[Sequence[float]], intercept: Sequence[float], classes: Sequence, mean: Sequence[float] | None = None, std: Sequence[float] | None = None) -> DataFrame:
    """Adds ``probabilities`` and ``predicted`` from plain coefficients: a softmax of dot
    products in column expressions, so a stored model needs no library."""
    x = F.array(*[(F.col(f).cast("double") - (mean[i] if mean else 0.0)) / (std[i] if std else 1.0) for i, f in enumerate(features)])
    logits = F.array(*[F.aggregate(F.zip_with(F.col("_x"), F.array(*[F.lit(float(w)) for w in c]), lambda a, b: a * b), F.lit(float(b0)), lambda s, v: s + v) for c, b0 in zip(coef, intercept)])
    top = F.array_max("_l")
    e = F.transform("_l", lambda v: F.exp(v - F.col("_top")))
    out = rows.withColumn("_x", x).withColumn("_l", logits).withColumn("_top", top).withColumn("_e", e)
    total = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)
    labels = F.array(*[F.lit(c) for c in classes])
    return out.withColumn("probabilities", F.transform("_e", lambda v: v / total)).withColumn("predicted", F.get(labels, F.array_position("_l", F.col("_top")).cast("int") - 1)).drop("_x", "_l", "_top", "_e")


def folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold``: classes dealt out evenly in an order shuffled by a hash of the key.
    Classes with fewer than ``k`` rows are left out."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    n = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    return df.join(F.broadcast(n), label).withColumn("fold", (F.row_number().over(w) - 1) % k).drop("_n")


def evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(n, exact, within_one) of a model fitted on ``train`` (scaled by its own means and
    deviations) on ``test``."""
    same = train is test
    train = cut(train.select(label, *features))  # read once a step of the solver
    test = train if same else test
    stats = train.agg(*[F.avg(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean = [stats[f"a{i}"] or 0.0 for i in range(len(features))]
    std = [stats[f"s{i}"] or 1.0 for i in range(len(features))]
    scaled = train.select(label, *[((F.col(f) - mean[i]) / std[i]).alias(f) for i, f in enumerate(features)])
    model, classes = fit_logistic(scaled, features, label)
    scored = score_logistic(test, features, model.coefficientMatrix.toArray().tolist(), list(model.interceptVector), classes, mean, std)
    return scored.agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("exact"), F.avg((F.abs(F.col(label) - F.col("predicted")) <= 1).cast("double")).alias("within_one"))


def packed(dealt: DataFrame, features: Sequence[str], label: str, classes: Sequence, mean: Sequence[float], std: Sequence[float], n: int) -> DataFrame:
    """(x, y, fold) written out: blocks of rows as bytes, the features standardised with a
    column of ones, the place of each row's class and its fold."""
    columns, place = list(features), {c: i for i, c in enumerate(classes)}
    mean, std = np.array(mean), np.array(std)

    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x = np.column_stack([(part[columns].to_numpy(float) - mean) / std, np.ones(len(part))])
                y = np.array([place[v] for v in part[label]], np.int32)
                yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "fold": [part["fold"].to_numpy(np.int32).tobytes()]})

    parts = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    return cut(dealt.select(label, "fold", *columns).repartition(parts).mapInPandas(pack, "x binary, y binary, fold binary"))


def summed(blocks: DataFrame, one, width: int) -> np.ndarray:
    """The sum over all blocks of what ``one(x, y, fold)`` gives, ``width`` numbers each;
    one row a partition comes to the driver."""

    def run(batches):
        total = np.zeros(width)
        for pdf in batches:
            for x, y, f in zip(pdf["x"], pdf["y"], pdf["fold"]):
                y = np.frombuffer(y, np.int32)
                total += one(np.frombuffer(x).reshape(len(y), -1), y, np.frombuffer(f, np.int32))
        yield pd.DataFrame({"t": [total.tobytes()]})

    return sum((np.frombuffer(r.t) for r in blocks.mapInPandas(run, "t binary").collect()), np.zeros(width))


def fit_folds(blocks: DataFrame, d: int, counts: np.ndarray, iterations: int = 2000) -> np.ndarray:
    """For each fold the coefficients (d + 1 rows, the last the intercept; a column a class)
    of ``fit_logistic``'s model of all other rows, standardised by their own means and
    deviations, told for the features as they stand in ``blocks``. ``counts``: rows of each
    fold by class.

    All folds take each step in the same pass over the data: L-BFGS, preconditioned by the
    bound that half the weighted squares of the features set to the curvature, so that tens
    of passes do."""
    folds, k = counts.shape
    there = counts.sum(0) - counts  # rows of each fold's training by class
    n = np.maximum(1, there.sum(1))
    weight = n[:, None] / (k * np.maximum(1, there))

    def squares(x, y, f):
        out = np.empty((folds, 2, d + 1, d + 1))
        for i in range(folds):
            z = x[f != i]
            out[i] = z.T @ z, (z * weight[i][y[f != i]][:, None]).T @ z
        return out.ravel()

    plain, weighted = summed(blocks, squares, folds * 2 * (d + 1) ** 2).reshape(folds, 2, d + 1, d + 1).swapaxes(0, 1)
    mean = plain[:, -1, :d] / n[:, None]
    var = np.einsum("fii->fi", plain)[:, :d] / n[:, None] - mean**2
    std = np.sqrt(np.where(var > 1e-12, var, 1.0))
    to_block = np.zeros((folds, d + 1, d + 1))  # coefficients of a fold's own scale to those of the blocks
    for i in range(folds):
        to_block[i] = np.diag([*(1 / std[i]), 1.0])
        to_block[i, -1, :d] = -mean[i] / std[i]
    ridge = np.zeros((folds, d + 1, 1))
    ridge[:, :d] = 1.0 / n[:, None, None]
    bound = [np.linalg.inv(to_block[i].T @ weighted[i] @ to_block[i] / (2 * n[i]) + np.diag(ridge[i, :, 0]) + 1e-9 * np.eye(d + 1)) for i in range(folds)]

    def values(at: np.ndarray):
        """The loss of each fold and its gradient."""
        flat = np.concatenate(list(to_block @ at), axis=1)

        def one(x, y, f):
            z = (x @ flat).reshape(len(y), folds, k)
            z -= z.max(2, keepdims=True)
            rows = np.arange(len(y))
            own = z[rows, :, y]
            np.exp(z, out=z)
            total = z.sum(2)
            w = weight[:, y].T * (f[:, None] != np.arange(folds))
            z *= (w / total)[:, :, None]
            z[rows, :, y] -= w
            return np.concatenate([(w * (np.log(total) - own)).sum(0), (x.T @ z.reshape(len(y), -1)).ravel()])

        got = summed(blocks, one, folds + (d + 1) * folds * k)
        g = got[folds:].reshape(d + 1, folds, k).swapaxes(0, 1)
        loss = got[:folds] / n + (ridge * at**2).sum((1, 2)) / 2
        return loss, to_block.swapaxes(1, 2) @ g / n[:, None, None] + ridge * at

    def direction(i):
        """Where fold i's last steps and slopes point to."""
        q, keep = grad[i].copy(), []
        for s, y in reversed(past[i]):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            keep.append(a)
        q = bound[i] @ q
        if past[i]:
            s, y = past[i][-1]
            q *= (s * y).sum() / (y * (bound[i] @ y)).sum()
        for (s, y), a in zip(past[i], reversed(keep)):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        return -q

    at = np.zeros((folds, d + 1, k))
    loss, grad = values(at)
    past: list[list] = [[] for _ in range(folds)]
    going, ways, step = set(range(folds)), {i: direction(i) for i in range(folds)}, np.ones(folds)
    for _ in range(iterations):
        # the slope in the measure of the bound: what may still be gained is half its square
        going = {i for i in going if (grad[i] * (bound[i] @ grad[i])).sum() > 1e-8 and step[i] > 1e-8}
        if not going:
            break
        trial = at.copy()
        for i in going:
            trial[i] += step[i] * ways[i]
        new_loss, new_grad = values(trial)
        for i in going:
            if new_loss[i] > loss[i] + 1e-4 * step[i] * (grad[i] * ways[i]).sum():
                step[i] /= 2
                continue
            s, y = trial[i] - at[i], new_grad[i] - grad[i]
            if (s * y).sum() > 1e-14 * (s * s).sum():
                past[i] = [*past[i][-19:], (s, y)]
            at[i], loss[i], grad[i], step[i] = trial[i], new_loss[i], new_grad[i], 1.0
            ways[i] = direction(i)
    return to_block @ at


def cross_validate(df: DataFrame, features: Sequence[str], key: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """Mean and population deviation of the folds' scores. The folds' models are fitted
    together, each pass over the data serving all."""
    spark = df.sparkSession
    dealt = cut(folds(df, label, key, k, seed))
    d = len(features)
    stats = dealt.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    by = dealt.groupBy(label, "fold").agg(F.count("*").alias("n")).collect()  # a row for each class and fold
    classes = sorted({r[label] for r in by})
    counts = np.zeros((k, max(1, len(classes))))
    for r in by:
        counts[r["fold"], classes.index(r[label])] = r["n"]
    blocks = packed(dealt, features, label, classes, [stats[f"a{i}"] or 0.0 for i in range(d)], [stats[f"s{i}"] or 1.0 for i in range(d)], stats["n"])
    flat = np.concatenate(list(fit_folds(blocks, d, counts)), axis=1)
    value = np.array(classes or [0], float)

    def hits(x, y, f):
        z = (x @ flat).reshape(len(y), k, -1)[np.arange(len(y)), f]
        off = np.abs(value[z.argmax(1)] - value[y])
        return np.concatenate([np.bincount(f, w, k) for w in (np.ones(len(f)), off == 0, off <= 1)])

    n, exact, near = summed(blocks, hits, 3 * k).reshape(3, k)
    rows = [(int(a), float(b / a) if a else None, float(c / a) if a else None) for a, b, c in zip(n, exact, near)]
    out = spark.createDataFrame(rows, "n long, exact double, within_one double")
    return out.agg(F.count("*").alias("folds"), F.sum("n").alias("n"), F.avg("exact").alias("exact"), F.stddev_pop("exact").alias("exact_std"), F.avg("within_one").alias("within_one"))


__all__ = ["BANDS", "MODEL_FEATURES", "RULE_FEATURES", "consensus", "cross_validate", "design", "evaluate", "fit_folds", "fit_logistic", "folds", "probe_matches", "recode", "rule_grades", "score_logistic", "standardize"]
