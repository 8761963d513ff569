"""Additive models as tables: every term's bins and scores are rows, so scores explain themselves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import risk_level
from ..functions.exprs import flag
from ..session import durable
from . import metrics, sampling
from .ordered import top_n_per_key
from .pairs import bin_by_edges, quantile_edges, rank_interactions, top_scores, unpivot

INTERCEPT = "__intercept"
# Shape tables up to this many rows are sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
# An iteration limit that no fit reaches: the loss is convex, so a fit ends by its tolerance.
UNTIL_SETTLED = 2**31 - 1
# Counted training rows are cut to at most this share of all, so that sums of weights act like sums of rows.
PARTS = 100_000


@dataclass
class AdditiveModel:
    """Bin edges per feature, listed pairs, and the table (model, term, bin, score)."""

    edges: dict[str, list[float]]
    pairs: list[tuple[str, str]]
    shapes: DataFrame
    n_rows: int

    @property
    def terms(self) -> list[str]:
        return [*self.edges, *[f"{a} & {b}" for a, b in self.pairs]]


def feature_edges(df: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Quantile edges fitted on ``df``; n_bins + 1 numbers per feature come back to the driver.

    Where quantiles are only two values, as of a flag, the middle between them is an edge too: one bin would tell nothing.
    """
    found = {r["feature"]: list(r["edges"]) for r in quantile_edges(unpivot(df, [], features), "feature", "value", n_bins).collect()}
    return {f: [e[0], e[0] / 2 + e[1] / 2, e[1]] if len(e) == 2 else e for f, e in found.items()}


def bin_columns(edges: Mapping[str, Sequence[float]], pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Bin index per term; null values get the extra bin 0 and values count from 1."""

    def one(f: str) -> Column:
        e = F.array(*[F.lit(float(x)) for x in edges[f]])
        return F.coalesce(bin_by_edges(F.col(f).cast("double"), e, False, len(edges[f]) - 1) + 1, F.lit(0))

    out = {f: one(f) for f in edges}
    for a, b in pairs:
        out[f"{a} & {b}"] = one(a) * F.lit(len(edges[b]) + 1) + one(b)
    return out


def counted(df: DataFrame, weight: str) -> DataFrame:
    """The different rows of ``df``; ``weight`` (there or not) becomes the weight of all copies of a row together.

    A row with very many copies stays several rows of at most 1/``PARTS`` of all, since the spread by which the fit scales features
    corrects for few heavy rows. Up to ``PARTS`` rows, every row is kept.
    """
    cols = df.columns
    sums = df.groupBy(*cols).agg(F.count("*").alias("__copies"))
    total = sums.agg(F.sum("__copies").alias("__all"))
    most = F.ceil(F.col("__all") / PARTS)
    pieces = F.ceil(F.col("__copies") / most).cast("int")
    each = (F.col(weight) if weight in cols else F.lit(1.0)) * F.col("__copies") / pieces
    out = sums.crossJoin(F.broadcast(total)).select(*[c for c in cols if c != weight], each.alias(weight), pieces.alias("__pieces"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("__pieces"))).alias("__piece")).drop("__pieces", "__piece")


def fit_additive(
    df: DataFrame, features: Sequence[str], label: str, pairs: Sequence[tuple[str, str]] = (), weight: str | None = None,
    n_bins: int = 8, reg: float = 0.01, model: int = 0, edges: dict[str, list[float]] | None = None, max_iter: int | None = 30,
    pairs_only: bool = False,
) -> AdditiveModel:
    """Logistic regression on one-hot bins: one score per bin of every feature and listed pair, or of the pairs alone (``pairs_only``).

    Rows with the same bins, label and weight are counted first, so the iterations read combinations of bins and not rows.
    With ``max_iter`` None the fit ends when its loss has settled, after however many iterations.
    """
    edges = edges or feature_edges(df, features, n_bins)
    size_of = {f: len(e) + 1 for f, e in edges.items()} | {f"{a} & {b}": (len(edges[a]) + 1) * (len(edges[b]) + 1) for a, b in pairs}
    cols = {t: c for t, c in bin_columns(edges, pairs).items() if not (pairs_only and t in edges)}
    names, sizes = list(cols), [size_of[t] for t in cols]
    keep = [F.col(label).cast("double").alias("__y")] + ([F.col(weight).cast("double").alias("__w")] if weight else [])
    ints = counted(df.select(*keep, *[c.cast("double").alias(f"t{i}") for i, c in enumerate(cols.values())]), "__w")
    # The encoder must know all bins, so its sizes come from the edges and not from the rows at hand.
    top = ints.sparkSession.range(1).select(*[F.lit(float(n - 1)).alias(f"t{i}") for i, n in enumerate(sizes)])
    encoder = OneHotEncoder(inputCols=[f"t{i}" for i in range(len(names))], outputCols=[f"o{i}" for i in range(len(names))], dropLast=False).fit(top)
    rows = VectorAssembler(inputCols=[f"o{i}" for i in range(len(names))], outputCol="x").transform(encoder.transform(ints))
    lr = LogisticRegression(
        featuresCol="x", labelCol="__y", regParam=reg, elasticNetParam=0.0, maxIter=UNTIL_SETTLED if max_iter is None else max_iter,
        standardization=False, weightCol="__w",
    ).fit(rows.select("x", "__y", "__w"))
    beta, at, table = lr.coefficients.toArray(), 0, [(model, INTERCEPT, "", float(lr.intercept))]
    for name, size in zip(names, sizes):
        table += [(model, name, str(b), float(beta[at + b])) for b in range(size)]
        at += size
    shapes = df.sparkSession.createDataFrame(table, "model int, term string, bin string, score double")
    return AdditiveModel(edges, list(pairs), shapes, len(table))


def term_bins(df: DataFrame, id_col: str, model: AdditiveModel) -> DataFrame:
    """Long (id, term, bin, value) of a wide feature frame."""
    cols = bin_columns(model.edges, model.pairs)
    cells = [
        F.struct(F.lit(t).alias("term"), c.cast("string").alias("bin"), (F.col(t).cast("double") if t in model.edges else F.lit(None).cast("double")).alias("value"))
        for t, c in cols.items()
    ]
    return df.select(id_col, F.explode(F.array(*cells)).alias("c")).select(id_col, "c.*")


def contributions(bins: DataFrame, shapes: DataFrame, small: bool = True) -> DataFrame:
    """Score of every (id, model, term); the intercept is not a term."""
    table = shapes.where(F.col("term") != INTERCEPT)
    return bins.join(F.broadcast(table) if small else table, ["term", "bin"])


def score_ensemble(bins: DataFrame, shapes: DataFrame, id_col: str, threshold: float = 0.5, small: bool = True) -> DataFrame:
    """Mean probability over the models, label, and risk level per id."""
    base = shapes.where(F.col("term") == INTERCEPT).select("model", F.col("score").alias("b"))
    logit = contributions(bins, shapes, small).groupBy(id_col, "model").agg(F.sum("score").alias("s"))
    p = 1 / (1 + F.exp(-(F.col("s") + F.coalesce("b", F.lit(0.0)))))
    proba = logit.join(F.broadcast(base), "model", "left").groupBy(id_col).agg(F.avg(p).alias("pred_proba"))
    return proba.select(id_col, "pred_proba", flag(F.col("pred_proba") >= threshold).alias("pred_label"), risk_level("pred_proba").alias("risk_level"))


def _shape_row(shapes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row: ``__models``, per model its intercept and per term an array of scores by bin number (null where a bin has none)."""
    table: dict[int, dict[str, dict[int, float]]] = {}
    for r in shapes.collect():  # at most BROADCAST_ROWS scores
        table.setdefault(r["model"], {}).setdefault(r["term"], {})[int(r["bin"] or 0)] = r["score"]
    listed = lambda cells: [cells.get(i) for i in range(max(cells) + 1)] if cells else None
    models = [(m, c.get(INTERCEPT, {}).get(0), *[listed(c.get(t)) for t in terms]) for m, c in sorted(table.items())]
    lists = "".join(f", t{i}: array<double>" for i in range(len(terms)))
    return shapes.sparkSession.createDataFrame([(models,)], f"__models array<struct<model: int, b: double{lists}>>")


def batch_predict(df: DataFrame, id_col: str, model: AdditiveModel, threshold: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Align the frame to the model's features, then score it; ``keep`` columns stay beside the scores.

    Ids must be unique. A row is scored where it is: the shapes travel to the rows as one row of arrays.
    """
    from .cohort import align_to_schema

    aligned = align_to_schema(df, [id_col, *model.edges, *[c for c in keep if c != id_col and c not in model.edges]], None)
    if model.n_rows > BROADCAST_ROWS:
        scored = score_ensemble(term_bins(aligned, id_col, model), model.shapes, id_col, threshold, False)
        return scored.join(df.select(id_col, *keep), id_col) if keep else scored
    bins = {f"__b{i}": c for i, c in enumerate(bin_columns(model.edges, model.pairs).values())}

    def proba(m: Column) -> Column:
        found = [F.get(m[f"t{i}"], F.col(b)) for i, b in enumerate(bins)]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in found[1:]), F.coalesce(found[0], F.lit(0.0)))
        return F.when(F.coalesce(*found).isNotNull(), 1 / (1 + F.exp(-(total + F.coalesce(m["b"], F.lit(0.0))))))

    rows = aligned.withColumns(bins).crossJoin(F.broadcast(_shape_row(model.shapes, model.terms)))
    rows = rows.withColumn("__p", F.filter(F.transform("__models", proba), lambda x: x.isNotNull())).where(F.size("__p") > 0)
    p = (F.aggregate("__p", F.lit(0.0), lambda a, x: a + x) / F.size("__p")).alias("pred_proba")
    out = rows.select(id_col, *keep, p)
    return out.select(id_col, "pred_proba", flag(F.col("pred_proba") >= threshold).alias("pred_label"), risk_level("pred_proba").alias("risk_level"), *keep)


def local_explanation(bins: DataFrame, shapes: DataFrame, id_col: str, k: int = 10, noise: float = 0.001, small: bool = True) -> DataFrame:
    """Up to k strongest terms per id, averaged over the models."""
    n_models = shapes.select("model").distinct().count()
    mean = contributions(bins, shapes, small).groupBy(id_col, "term").agg((F.sum("score") / n_models).alias("contribution"), F.max("value").alias("value"))
    strong = mean.where(F.abs("contribution") > noise)
    top = top_n_per_key(strong, [id_col], [F.desc(F.abs("contribution")), F.col("term")], k, "rank")
    return top.withColumn("kind", F.when(F.col("contribution") > 0, "risk").otherwise("protective"))


def global_importance(bins: DataFrame, shapes: DataFrame, k: int = 100, pairs_only: bool = True, small: bool = True) -> DataFrame:
    """Mean absolute score per term, averaged over the models; the k strongest (pairs)."""
    per_model = contributions(bins, shapes, small).groupBy("term", "model").agg(F.avg(F.abs("score")).alias("m"))
    mean = per_model.groupBy("term").agg(F.avg("m").alias("importance"))
    kept = mean.where(F.col("term").contains(" & ")) if pairs_only else mean
    return kept.orderBy(F.desc("importance"), "term").limit(k)


def active_pairs(values: DataFrame, pairs: DataFrame, id_col: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Listed (vital, nlp, score) pairs whose text flag is 1 for an id, with the vital's value."""
    on = values.where(F.col(value) == 1).select(id_col, F.col(feature).alias("nlp"))
    hits = on.join(pairs, "nlp")
    vital = values.select(id_col, F.col(feature).alias("vital"), F.col(value).alias("vital_value"))
    return hits.join(vital, [id_col, "vital"], "left").select(
        id_col, "vital", "nlp", "vital_value", F.col("score").alias("importance"),
        F.concat(F.lower("vital"), F.lit(" weighs more while "), F.lower("nlp"), F.lit(" is noted")).alias("description"),
    )


def soft_vote(scores: Sequence[DataFrame], id_col: str, proba: str = "pred_proba", weights: Sequence[float] | None = None) -> DataFrame:
    """(Weighted) mean of several models' probabilities for ids scored by all."""
    weights = list(weights or [1.0] * len(scores))
    parts = None
    for w, s in zip(weights, scores):
        one = s.select(id_col, F.col(proba).alias("p"), F.lit(float(w)).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(id_col).agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias(proba), F.count("*").alias("n")).where(
        F.col("n") == len(scores)
    ).drop("n")


def fit_ensemble(
    df: DataFrame, id_col: str, features: Sequence[str], label: str, n_models: int = 5, ratios: Sequence[float] = (0.4,), seed: int = 42,
    pairs: Sequence[tuple[str, str]] = (), n_bins: int = 8, max_iter: int = 30,
) -> AdditiveModel:
    """One model per seed, each on its own undersample; several ratios give the diverse variant.

    The edges are fitted once on all training rows, so the models share their bins.
    """
    edges = feature_edges(df, features, n_bins)
    shapes, n = None, 0
    for i in range(n_models):
        part = sampling.undersample(df, id_col, label, ratios[i % len(ratios)], seed + i)
        m = fit_additive(part, features, label, pairs, n_bins=n_bins, model=i, edges=edges, max_iter=max_iter)
        shapes, n = (m.shapes if shapes is None else shapes.unionByName(m.shapes)), n + m.n_rows
    return AdditiveModel(edges, list(pairs), shapes, n)


def residuals(df: DataFrame, id_col: str, label: str, model: AdditiveModel, keep: Sequence[str] = ()) -> DataFrame:
    """label - probability per id, the input of the pair ranking, beside the ``keep`` columns."""
    return batch_predict(df, id_col, model, keep=[label, *keep]).select(id_col, *keep, (F.col(label) - F.col("pred_proba")).alias("residual"))


class Discovery(NamedTuple):
    """Main effects alone, every ranked pair with its score and whether it was ``chosen``, and the model with the chosen pairs."""

    main: AdditiveModel
    ranking: DataFrame
    final: AdditiveModel


def discover_interactions(
    df: DataFrame, id_col: str, v_cols: Sequence[str], t_cols: Sequence[str], label: str, top: int = 20, n_bins: int = 10,
    min_samples: int = 50, weight: str | None = None, max_iter: int = 100,
) -> Discovery:
    """Learn which (continuous, flag) pairs matter: fit main effects, rank pairs on what they leave unexplained, fit again with the best ``top``.

    Ids must be unique and not null. Rows without a label take no part. The frame is written once and read by all
    steps; at most ``top`` names and the edges of the features reach the driver.
    """
    names = [*v_cols, *t_cols]
    rows = durable(df.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label, *names, *([weight] if weight else [])))
    edges = feature_edges(rows, names, n_bins)
    main = fit_additive(rows, names, label, weight=weight, n_bins=n_bins, edges=edges, max_iter=max_iter)
    left = residuals(rows, id_col, label, main, names)
    ranked = durable(rank_interactions(left, v_cols, t_cols, "residual", n_bins, min_samples))
    best = top_scores(ranked, "interaction_score", top, ["vital_feature", "nlp_feature"]).select("vital_feature", "nlp_feature").collect()  # ``top`` rows
    listed = [(r["vital_feature"], r["nlp_feature"]) for r in best]
    final = fit_additive(rows, names, label, listed, weight=weight, n_bins=n_bins, edges=edges, max_iter=max_iter)
    chosen = F.struct("vital_feature", "nlp_feature").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in listed]) if listed else F.lit(False)
    return Discovery(main, ranked.withColumn("chosen", chosen), final)


def fit_boosted_trees(df: DataFrame, features: Sequence[str], label: str, max_iter: int = 20, depth: int = 3):
    """Gradient-boosted baseline; positives weigh as much in all as negatives. Returns a fitted pipeline."""
    c = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    scale = c.get(0, 1) / max(c.get(1, 1), 1)
    rows = df.withColumn("__w", F.when(F.col(label) == 1, scale).otherwise(1.0)).withColumn("__y", F.col(label).cast("double"))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"),
        GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=max_iter, maxDepth=depth, seed=42),
    ]
    return Pipeline(stages=stages).fit(rows)


def positive_probability(scored: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(id_col, *keep, vector_to_array("probability")[1].alias("pred_proba"))


def platt_calibration(held_out: DataFrame, label: str, proba: str = "pred_proba") -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on the logit of held-out scores."""
    p = F.least(F.greatest(F.col(proba), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = counted(held_out.select(F.ln(p / (1 - p)).alias("z"), F.col(label).cast("double").alias("y")), "w")
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=50).fit(rows.select(array_to_vector(F.array("z")).alias("x"), "y", "w"))
    return float(m.coefficients[0]), float(m.intercept)


def calibrate(df: DataFrame, slope: float, intercept: float, proba: str = "pred_proba") -> DataFrame:
    p = F.least(F.greatest(F.col(proba), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * F.ln(p / (1 - p)) + F.lit(intercept)))))


def grid_search_cv(
    df: DataFrame, id_col: str, features: Sequence[str], label: str, grid: Mapping[str, Mapping], k: int = 3, seed: int = 42,
    fit: Callable[..., AdditiveModel] = fit_additive,
) -> DataFrame:
    """Per named parameter set: mean and spread of the fold metrics, best first by the mean smallest one.

    Only one row of counts per fold leaves the cluster.
    """
    folds = sampling.stratified_kfold(df, id_col, label, k, seed).persist()
    rows = []
    for name, params in grid.items():
        for f in range(k):
            train, test = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
            m = fit(train, features, label, **params)
            scored = batch_predict(test, id_col, m, keep=[label])
            r = metrics.choose_threshold(metrics.threshold_table(scored, label, "pred_proba", metrics.grid(0.05, 0.95, 0.05)), "min_metric").first()
            if r is not None:
                rows.append((name, f, r["precision"], r["recall"], r["f1"]))
    folds.unpersist()
    table = df.sparkSession.createDataFrame(rows, "name string, fold int, precision double, recall double, f1 double")
    worst = F.least("precision", "recall", "f1")
    return table.groupBy("name").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("precision", "recall", "f1")], *[F.stddev_pop(c).alias(f"{c}_std") for c in ("precision", "recall", "f1")],
        F.avg(worst).alias("min_metric_mean"),
    ).orderBy(F.desc("min_metric_mean"), "name")


def risk_narrative(scores: DataFrame, factors: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Short text per id from its probability and ranked factors (at most the explained ones per id)."""
    p = F.col("pred_proba")
    name = F.replace(F.replace(F.col("term"), F.lit("tfidf_"), F.lit("Note keyword: ")), F.lit("_"), F.lit(" "))
    line = F.concat(
        F.lit("- "), name, F.when(F.col("contribution") > 0, " increases risk").otherwise(" reduces risk"),
        F.lit(" (impact "), F.format_number("contribution", 3), F.lit(")"),
    )
    listed = factors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("l"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Risk: "), F.when(p >= threshold, "HIGH").otherwise("LOW"), F.lit(" ("), F.floor(p * 100).cast("string"), F.lit("/100)")),
        F.when(p >= threshold, "Main drivers:").otherwise("Observations:"),
        F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<rank:int,line:string>>")), lambda x: x["line"]), "\n"),
        F.when(p >= threshold, "Advice: consider postponing the transfer and monitor closely.").otherwise("Advice: standard protocol; watch the listed factors."),
    )
    return scores.join(listed, id_col, "left").select(id_col, text.alias("narrative"))


def modality_ablation(
    df: DataFrame, id_col: str, label: str, feature_sets: Mapping[str, Sequence[str]], pairs: Sequence[tuple[str, str]] = (), seed: int = 42,
    n_bins: int = 8, max_iter: int | None = None,
) -> DataFrame:
    """Test metrics of a model per feature set, and of one on the pairs alone when pairs are given.

    The models are compared by what their features can tell, so each is fitted until its loss has settled unless ``max_iter`` is given.
    The edges are fitted once on all training rows, so the models share their bins.
    """
    split = sampling.stratified_split(df, id_col, label, 0.2, seed).persist()
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    out = None
    jobs = [(n, list(f), []) for n, f in feature_sets.items()]
    if pairs:
        jobs.append(("pairs", sorted({c for p in pairs for c in p}), list(pairs)))
    edges = feature_edges(train, sorted({f for _, feats, _ in jobs for f in feats}), n_bins)
    for name, feats, ps in jobs:
        m = fit_additive(train, feats, label, ps, edges={f: edges[f] for f in feats if f in edges}, max_iter=max_iter, pairs_only=bool(ps))
        scored = durable(batch_predict(test, id_col, m, keep=[label]).select(label, "pred_proba"))  # read several times by the metrics
        one = durable(metrics.best_f1_threshold(scored, label, "pred_proba").join(metrics.auroc(scored, label, "pred_proba"))).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def kmeans_clusters(df: DataFrame, id_col: str, embedding: str, k: int = 8, seed: int = 42) -> DataFrame:
    rows = df.select(id_col, array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select(id_col, F.col("prediction").alias("cluster"))


def standardize_pca(train: DataFrame, df: DataFrame, id_col: str, embedding: str, n: int = 50) -> DataFrame:
    """Standardize and project on the first n components, both fitted on ``train``."""
    vec = lambda d: d.select(id_col, array_to_vector(F.col(embedding).cast("array<double>")).alias("raw"))
    pipe = Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="std"), PCA(k=n, inputCol="std", outputCol="pc")])
    return pipe.fit(vec(train)).transform(vec(df)).select(id_col, vector_to_array("pc").alias("components"))


def zero_vectors(df: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """Ids whose vector has length 0."""
    norm2 = F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.where(F.col(embedding).isNull() | (norm2 == 0)).select(id_col)


def refill_vectors(df: DataFrame, replacement: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """Replace zero vectors where a new one exists."""
    zero = zero_vectors(df, id_col, embedding)
    new = replacement.join(zero, id_col, "left_semi").select(id_col, F.col(embedding).alias("__new"))
    return df.join(new, id_col, "left").withColumn(embedding, F.coalesce("__new", embedding)).drop("__new")
