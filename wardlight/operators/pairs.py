"""Cross-modal feature pairs: quantile bins, pair features, residual-based ranking, list filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, total
from .ordered import grouped_quantiles

# Number of feature names a pair list may hold; beyond it names are joined without broadcast.
MAX_NAMES = 100_000


def enumerate_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Every (continuous, binary) combination of feature names.

    Only distinct names are combined, so the size depends on the schema and not on the rows; the
    right names ride along as one array.
    """
    names = right.select(b).where(F.col(b).isNotNull()).distinct().agg(F.sort_array(F.collect_set(b)).alias("__all"))
    one = F.lit(1).alias("__one")
    return (
        left.select(a).where(F.col(a).isNotNull()).distinct().select(a, one)
        .join(F.broadcast(names.select("__all", one)), "__one")
        .select(a, F.explode("__all").alias(b))
    )


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; every value becomes a double."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*ids, F.explode(cells).alias("__c")).select(*ids, f"__c.{name}", f"__c.{value}")


def quantile_edges(long: DataFrame, feature: str, value: str, n_bins: int) -> DataFrame:
    """(feature, edges): distinct interior quantile edges per feature, exact and interpolated."""
    probs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    q = grouped_quantiles(long, [feature], value, probs, few_keys=True)
    return q.select(feature, F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in probs]))).alias("edges"))


def bin_by_edges(value: str | Column, edges: str | Column, right_closed: bool, n_bins: int) -> Column:
    """0-based bin from at most n_bins + 1 ascending distinct edges (first and last are the extremes).

    ``right_closed`` puts a value equal to an edge in the lower bin; otherwise in the upper one, the
    maximum always staying in the last bin.
    """
    v = F.col(value) if isinstance(value, str) else value
    e = F.col(edges) if isinstance(edges, str) else edges
    passed = total([flag((F.get(e, F.lit(i)) < v) if right_closed else (F.get(e, F.lit(i)) <= v)) for i in range(1, n_bins + 1)])
    return F.when(v.isNotNull(), F.least(passed, F.greatest(F.size(e) - 2, F.lit(0))))


def quantile_bin(long: DataFrame, feature: str, value: str, n_bins: int, right_closed: bool = False, keep_small: int = 0) -> DataFrame:
    """Adds ``bin`` (string). Features with at most ``keep_small`` distinct values keep the value itself.

    Edges and counts have one row per feature and go to the rows, which are not shuffled: a feature holds far too many for one task.
    """
    edges = quantile_edges(long, feature, value, n_bins)
    out = long.join(F.broadcast(edges), feature, "left").withColumn("bin", bin_by_edges(value, "edges", right_closed, n_bins).cast("string"))
    if keep_small:
        small = (
            long.where(F.col(value).isNotNull()).groupBy(feature, value).agg(F.lit(1).alias("__1"))
            .groupBy(feature).agg(F.count("*").alias("__distinct"))
        )
        out = out.join(F.broadcast(small), feature, "left").withColumn(
            "bin", F.when(F.col("__distinct") <= keep_small, F.col(value).cast("string")).otherwise(F.col("bin"))
        ).drop("__distinct")
    return out.drop("edges")


def pair_features(df: DataFrame, id_col: str, pairs: Sequence[tuple[str, str]], n_bins: int = 5) -> DataFrame:
    """One string column ``I{k}_{a}_x_{b}`` = ``bin(a)_bin(b)`` per listed pair."""
    names = sorted({c for p in pairs for c in p if c in df.columns})
    numeric = [f.name for f in df.schema.fields if f.name in names and f.dataType.typeName() not in ("string", "boolean")]
    edges: dict[str, list[float]] = {}
    distinct: dict[str, int] = {}
    if numeric:
        long = unpivot(df, [], numeric)
        counted = (
            long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.lit(1).alias("o")).groupBy("feature").agg(F.count("*").alias("n"))
        )
        # One row of edges per column of the list comes back to the driver.
        for r in quantile_edges(long, "feature", "value", n_bins).collect():
            edges[r["feature"]] = list(r["edges"])
        for r in counted.collect():
            distinct[r["feature"]] = r["n"]

    def code(c: str) -> Column:
        if c in numeric and distinct.get(c, 0) > n_bins:
            e = F.array(*[F.lit(float(x)) for x in edges[c]])
            return bin_by_edges(F.col(c).cast("double"), e, False, len(edges[c]) - 1).cast("string")
        return F.col(c).cast("string")

    usable = [(k, a, b) for k, (a, b) in enumerate(pairs) if a in df.columns and b in df.columns]
    return df.select(id_col, *[F.concat_ws("_", code(a), code(b)).alias(f"I{k:02d}_{a}_x_{b}") for k, a, b in usable])


def product_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{v}__x__{t}": F.col(v) * F.col(t) for v, t in pairs})


def rank_interactions(
    df: DataFrame, v_cols: Sequence[str], t_cols: Sequence[str], residual: str, n_bins: int = 10, min_samples: int = 50
) -> DataFrame:
    """Score every (continuous v, binary t) pair by how the residual's shape over v differs between t = 0 and 1.

    Rows are never paired and no t column is summed where it is 0. A row carries the list of its set and its
    unknown flags; each v is counted once in its bin, and once more for each flag on that list. These sums are
    combined before the exchange, which has at most V x bins x 2T rows for any number of input rows. The
    t = 0 side is the bin's total less the set and the unknown part.

    Rows whose t is null count on neither side of that t; bins are cut over all rows that have a v. Values are
    centred on the middle edge of their feature before they are summed, so large offsets do not cancel.
    """
    # -1: the row itself; 2i: flag i is set; 2i + 1: flag i is unknown
    marks = F.array_compact(F.array(F.lit(-1), *[F.when(F.col(t) == 1, 2 * i).when(F.col(t).isNull(), 2 * i + 1) for i, t in enumerate(t_cols)]))
    long = (
        df.select(marks.alias("__marks"), F.col(residual).cast("double").alias("__r"),
                  F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).cast("double").alias("x")) for v in v_cols])).alias("__c"))
        .select("__marks", "__r", F.col("__c.v").alias("v"), F.col("__c.x").alias("x"))
        .where("x IS NOT NULL")
    )
    edges = quantile_edges(unpivot(df, [], v_cols, "v", "x"), "v", "x", n_bins)
    small = F.broadcast(edges) if len(v_cols) <= MAX_NAMES else edges
    binned = long.join(small, "v").withColumn("bin", bin_by_edges("x", "edges", True, n_bins))
    binned = binned.withColumn("x", F.col("x") - F.coalesce(F.try_element_at("edges", (F.size("edges") / 2).cast("int") + 1), F.lit(0.0)))
    r, x, mark = F.col("__r"), F.col("x"), F.col("mark")
    terms = {"n": F.lit(1.0), "r": r, "rr": r * r, "x": x, "xx": x * x, "xr": x * r}
    sums = binned.select("v", "bin", "__r", "x", F.explode("__marks").alias("mark")).groupBy("v", "bin", "mark").agg(*[F.sum(e).alias(f"__{k}") for k, e in terms.items()])
    # a total goes to every flag, a part to its own
    flags = F.when(mark < 0, F.array(*[F.lit(i) for i in range(len(t_cols))]).cast("array<int>")).otherwise(F.array(F.floor(mark / 2).cast("int")))
    cells = sums.withColumn("t", F.explode(flags)).groupBy("v", "bin", "t").agg(
        *[F.sum(F.when((mark >= 0) & (mark % 2 == 0), F.col(f"__{k}")).otherwise(0.0)).alias(f"{k}1") for k in terms],
        *[F.sum(F.when(mark < 0, F.col(f"__{k}")).otherwise(-F.col(f"__{k}"))).alias(f"{k}0") for k in terms],
    )
    both = (F.col("n0") >= 5) & (F.col("n1") >= 5)
    diff = F.try_divide(F.col("r0"), F.col("n0")) - F.try_divide(F.col("r1"), F.col("n1"))

    def anova(side: str) -> dict[str, Column]:
        ok = F.col(f"n{side}") >= 3
        return {
            f"k{side}": F.sum(flag(ok)),
            f"an{side}": F.sum(F.when(ok, F.col(f"n{side}")).otherwise(0.0)),
            f"ar{side}": F.sum(F.when(ok, F.col(f"r{side}")).otherwise(0.0)),
            f"arr{side}": F.sum(F.when(ok, F.col(f"rr{side}")).otherwise(0.0)),
            f"am{side}": F.sum(F.when(ok, F.try_divide(F.col(f"r{side}") * F.col(f"r{side}"), F.col(f"n{side}"))).otherwise(0.0)),
        }

    stats = {**anova("0"), **anova("1")}
    pair = cells.groupBy("v", "t").agg(
        *[F.sum(f"{k}{s}").alias(f"s_{k}{s}") for k in terms for s in "01"],
        F.sum(F.when(both, diff * diff)).alias("dd"), F.sum(flag(both)).alias("db"),
        *[e.alias(n) for n, e in stats.items()],
    )

    def corr(s: str) -> Column:
        n, sr, sx, srr, sxx, sxr = (F.col(f"s_{k}{s}") for k in ("n", "r", "x", "rr", "xx", "xr"))
        den = (n * sxx - sx * sx) * (n * srr - sr * sr)
        return F.when(n > 10, F.when(den > 0, (n * sxr - sx * sr) / F.sqrt(den))).otherwise(0.0)

    groups = F.col("k0") + F.col("k1")
    an, ar = F.col("an0") + F.col("an1"), F.col("ar0") + F.col("ar1")
    ss_between = F.col("am0") + F.col("am1") - F.try_divide(ar * ar, an)
    ss_within = F.col("arr0") + F.col("arr1") - F.col("am0") - F.col("am1")
    f_stat = F.try_divide(F.try_divide(ss_between, groups - 1), F.try_divide(ss_within, an - groups))
    scored = (
        pair.where(
            (F.col("s_n0") + F.col("s_n1") >= 4 * min_samples) & (F.col("s_n0") >= 2 * min_samples) & (F.col("s_n1") >= 2 * min_samples)
        )
        .withColumn("residual_diff_score", F.when(F.col("db") > 0, F.sqrt(F.col("dd") / F.col("db")) * 100).otherwise(0.0))
        .withColumn("f_score", F.when(groups >= 4, F.least(F.coalesce(f_stat, F.lit(0.0)), F.lit(100.0))).otherwise(0.0))
        .withColumn("corr_t0", corr("0"))
        .withColumn("corr_t1", corr("1"))
        .withColumn("corr_diff", F.abs(F.col("corr_t0") - F.col("corr_t1")))
    )
    score = 0.4 * F.col("residual_diff_score") + 0.4 * F.col("f_score") + 20.0 * F.col("corr_diff")
    return scored.select(
        F.col("v").alias("vital_feature"), F.get(F.array(*[F.lit(t) for t in t_cols]), F.col("t")).alias("nlp_feature"), score.alias("interaction_score"), "residual_diff_score", "f_score",
        "corr_t0", "corr_t1", "corr_diff", F.col("s_n0").cast("long").alias("n_t0"), F.col("s_n1").cast("long").alias("n_t1"),
        (F.col("s_n0") + F.col("s_n1")).cast("long").alias("n_total"),
    )


def cross_modal(pairs: DataFrame, a: str, b: str, text_pattern: str = "TFIDF_") -> DataFrame:
    """Pairs with exactly one text side."""
    return pairs.where(F.col(a).contains(text_pattern) != F.col(b).contains(text_pattern))


def top_scores(df: DataFrame, score: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k best rows, ties by name; Spark keeps only k rows per task on the way."""
    return df.orderBy(F.desc(score), *tie).limit(k)
