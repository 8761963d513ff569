"""Skew-safe operators against brute force on fixtures where one key holds most rows, and plan checks."""

from __future__ import annotations

import random
import shutil
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import models, ordered, pairs, series, temporal
from wardlight.plans.catalog import QUERIES
from wardlight.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.choice([0.0, -1.5, 3.25, round(rng.gauss(0, 50), 2)])) for i in range(3000)]
    return pd.DataFrame(rows, columns=["id", "key", "v"])


def test_positions(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ordered.positions(df, ["key"], F.floor(F.col("id") / 100).cast("int"), [F.col("id")]).toPandas().set_index("id")["rn"]
    want = skewed.sort_values("id").groupby("key").cumcount() + 1
    assert (got.sort_index().to_numpy() == want.sort_index().to_numpy()).all()


def test_hash_positions_number_every_class_once(spark, skewed):
    got = ordered.hash_positions(spark.createDataFrame(skewed), ["key"], ["id"], 1).toPandas()
    for _, g in got.groupby("key"):
        assert sorted(g["rn"]) == list(range(1, len(g) + 1))


def test_quantiles(spark, skewed):
    probs = {"a": 0.0, "b": 0.1, "m": 0.5, "q": 0.75, "z": 1.0}
    got = ordered.grouped_quantiles(spark.createDataFrame(skewed), ["key"], "v", probs).toPandas().set_index("key")
    for key, g in skewed.groupby("key"):
        for name, p in probs.items():
            assert got.loc[key, name] == pytest.approx(np.percentile(g["v"], p * 100))


def test_weighted_quantiles_and_no_keys(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, w int")
    r = ordered.grouped_quantiles(df, [], "v", {"m": 0.5}, "w").first()
    assert r["m"] == pytest.approx(np.median([1, 1, 1, 2, 10, 10, 10, 10]))


def test_pair_ranking_over_many_flags(spark):
    """Sparse sums per flag against one flag at a time, with unknown, constant and rare flags."""
    rng = np.random.default_rng(9)
    n = 3000
    df = pd.DataFrame({"a": np.round(rng.normal(size=n), 2), "b": rng.normal(size=n) + 1e6, "r": rng.normal(size=n)})
    df.loc[rng.random(n) < 0.1, "a"] = np.nan
    for i, share in enumerate((0.5, 0.1, 0.05, 0.0, 1.0)):
        df[f"t{i}"] = (rng.random(n) < share).astype(float)
    df.loc[rng.random(n) < 0.2, "t1"] = np.nan
    df.loc[:, "r"] += df["a"].fillna(0) * (df["t0"] == 1)
    frame = spark.createDataFrame(df.astype(object).where(df.notna(), None), "a double, b double, r double, t0 double, t1 double, t2 double, t3 double, t4 double")
    flags = [f"t{i}" for i in range(5)]
    together = pairs.rank_interactions(frame, ["a", "b"], flags, "r").toPandas().set_index(["vital_feature", "nlp_feature"]).sort_index()
    assert set(together.index) == {(v, t) for v in "ab" for t in ("t0", "t1", "t2")}  # constant flags have one side only
    alone = pd.concat([pairs.rank_interactions(frame, [v], [t], "r").toPandas() for v, t in together.index]).set_index(["vital_feature", "nlp_feature"]).sort_index()
    pd.testing.assert_frame_equal(together, alone, rtol=1e-6)
    assert together["interaction_score"].idxmax() == ("a", "t0")
    for v, t in together.index:
        known = df[df[t].notna() & df[v].notna()]
        assert (together.loc[(v, t), "n_t0"], together.loc[(v, t), "n_t1"]) == ((known[t] == 0).sum(), (known[t] == 1).sum())
        for side in (0, 1):
            part = known[known[t] == side]
            assert together.loc[(v, t), f"corr_t{side}"] == pytest.approx(np.corrcoef(part[v], part["r"])[0, 1], abs=1e-5)


def test_discovery_finds_the_planted_pair(spark):
    """Main effects cannot show x times t; the ranking on residuals does, and the model with the pair fits better."""
    rng = np.random.default_rng(3)
    n = 4000
    x, z, t, u = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2.5 * x * (2 * t - 1) + 0.5 * z)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "t": t, "u": u, "y": y}))
    found = models.discover_interactions(df, "id", ["x", "z"], ["t", "u"], "y", top=1, n_bins=6, max_iter=25)
    assert [(r.vital_feature, r.nlp_feature) for r in found.ranking.where("chosen").collect()] == [("x", "t")]
    assert found.final.pairs == [("x", "t")] and found.main.pairs == []

    def loss(p):
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    main, final = (loss(models.batch_predict(df, "id", m).toPandas().set_index("id")["pred_proba"].sort_index().to_numpy()) for m in (found.main, found.final))
    cells = pd.DataFrame({"bin": pd.qcut(x, 6, labels=False), "t": t, "y": y})
    best = loss(cells.groupby(["bin", "t"])["y"].transform("mean").clip(0.001, 0.999).to_numpy())  # what the pair's bins can tell at most, without z
    assert main - final > 0.8 * (main - best), (main, final, best)


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(seconds=rng.randrange(0, 200_000))
    left = pd.DataFrame([(i, "hot" if i % 3 else "b", at()) for i in range(300)], columns=["lid", "k", "ts"])
    right = pd.DataFrame([(i, "hot" if i % 4 else "b", at(), float(i)) for i in range(250)], columns=["rid", "k", "rts", "v"])
    ntz = lambda d, c: spark.createDataFrame(d).withColumn(c, F.col(c).cast("timestamp_ntz"))
    got = temporal.nearest(ntz(left, "ts"), ntz(right, "rts"), "k", "ts", "rts", "v", "rid", 1800).toPandas().set_index("lid")["match_value"].to_dict()
    want = {}
    for lid, k, ts in left.itertuples(index=False):
        c = [(abs((r.rts - ts).total_seconds()), r.rts, r.rid, r.v) for r in right.itertuples() if r.k == k]
        best = min(c)
        if best[0] <= 1800:
            want[lid] = best[3]
    assert got == want


def test_runs_equal_the_grid(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(4000)
    keys = ["user_id", "event_type"]
    grid = series.locf_grid(events, keys, "ts", "value").groupBy(*keys).agg(F.avg("value").alias("a"), F.median("value").alias("m"), F.count("*").alias("n"))
    runs = series.locf_stats(events, keys, "ts", "value")
    bad = grid.join(runs, keys).where("abs(a - v_avg) > 1e-9 OR abs(m - v_median) > 1e-9 OR n <> v_count").count()
    assert grid.count() == runs.count() and bad == 0


def test_dense_short_series_uses_ranks(spark, monkeypatch):
    monkeypatch.setattr(series, "DENSE_ROWS", 3)
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(seconds=i), float(i * i)) for i in range(9)] + [(2, t0, 1.0)]
    got = {r["id"]: r["v_median"] for r in series.locf_stats(spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double"), ["id"], "ts", "v").collect()}
    assert got == {1: 16.0, 2: 1.0}


def test_pair_ranking_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 1200
    v = np.round(rng.normal(size=n), 1)
    t = (rng.random(n) < 0.35).astype(int)
    r = 0.3 * v * t + rng.normal(scale=0.2, size=n)
    got = pairs.rank_interactions(spark.createDataFrame(pd.DataFrame({"v": v, "t": t, "r": r})), ["v"], ["t"], "r").first()
    b = pd.qcut(v, 10, labels=False, duplicates="drop")
    d = [(r[(b == i) & (t == 0)].mean() - r[(b == i) & (t == 1)].mean()) ** 2 for i in np.unique(b) if min(((b == i) & (t == 0)).sum(), ((b == i) & (t == 1)).sum()) >= 5]
    groups = [r[(b == i) & (t == k)] for i in np.unique(b) for k in (0, 1) if ((b == i) & (t == k)).sum() >= 3]
    every = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - len(groups))
    assert got["residual_diff_score"] == pytest.approx(np.sqrt(np.mean(d)) * 100)
    assert got["f_score"] == pytest.approx(min(between / within, 100))
    assert got["corr_diff"] == pytest.approx(abs(np.corrcoef(v[t == 0], r[t == 0])[0, 1] - np.corrcoef(v[t == 1], r[t == 1])[0, 1]))


def test_stream_carry_over_batches(spark, tmp_path):
    """Restarts go on from the checkpoint; rows within the delay count, later ones do not; a lost state is an error."""
    t0 = datetime(2024, 1, 1)
    at = lambda h, m=0: t0 + timedelta(hours=h, minutes=m)
    batches = [
        [("a", at(0), 1.0), ("a", at(2), 3.0), ("b", at(0), 5.0), (None, at(0), 2.0), ("a", at(4), 4.0)],  # watermark 2:00
        [("a", at(2, 30), 5.0), ("a", at(1), 99.0), ("b", at(3), 6.0), ("a", at(9), 7.0)],  # late by less than the delay, by more; watermark 7:00
        [("c", at(20), 1.0)],
    ]
    src, base = tmp_path / "in", str(tmp_path / "run")

    def add(rows):
        spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(str(src))
        schema = spark.read.parquet(str(src)).schema
        streams.carry_forward(streams.read_files(spark, str(src), schema), ["k"], "ts", "v", base)
        got = spark.read.parquet(f"{base}/filled").toPandas()
        start = int(at(0).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
        return {(k, (h - start) // 3_600_000_000): v for k, h, v in zip(got["k"], got["hour_us"], got["value"])}

    first = {("a", 0): 1.0, ("b", 0): 5.0, (None, 0): 2.0}
    assert add(batches[0]) == first
    second = first | {("a", 1): 1.0, ("a", 2): 4.0, ("a", 3): 4.0, ("a", 4): 4.0, ("b", 1): 5.0, ("b", 2): 5.0, ("b", 3): 6.0}
    assert add(batches[1]) == second
    assert add(batches[2]) == second | {("a", h): 4.0 for h in range(5, 9)} | {("a", 9): 7.0}
    shutil.rmtree(f"{base}/checkpoint/state/0")
    with pytest.raises(Exception, match="(?i)state"):
        add([("a", at(40), 1.0)])


@pytest.mark.parametrize("hours,slide,groups,at_once", [(24, 1, 3, False), (5, 2, 3, False), (24, 1, 1, True)])
def test_stream_lookback_counts_hold_rows_once_and_late_rows_count_in_open_windows(spark, tmp_path, hours, slide, groups, at_once):
    """Same rows as Spark's own sliding windows over batches with late rows, from one state row per group of keys."""
    t0 = datetime(2024, 1, 1)
    at = lambda h, m=0: t0 + timedelta(hours=h, minutes=m)
    big = 2**60 + 1
    batches = [
        [(big, at(0), "x"), (big, at(0, 30), "x"), (None, at(1), "y"), (7, at(4), None), (7, None, "x")],  # watermark 2:00, the end of a window
        [(big, at(0, 10), "x"), (None, at(2, 30), "y"), (7, at(9, 59), None)],  # the first is late, other windows of its are open
        [(big, at(3), "x"), (big, at(40), "x"), (7, at(41, 30), None)],
        [(7, at(10), None), (7, at(39), None), (big, at(38), "x")] + [(big, at(41, m), "x") for m in range(50)],  # the first is too late for any window
        [(None, at(200), "y")],
    ]
    src = tmp_path / "in"
    schema = spark.createDataFrame([], "k long, ts timestamp_ntz, s string").schema

    def own(events):
        w = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours").groupBy(F.window("at", f"{hours} hours", f"{slide} hours"), "k", "s")
        return w.agg(F.count("*").alias("n")).select("k", "s", F.col("window.end").alias("until"), "n")

    def run(name, counts):
        events = streams.read_files(spark, str(src), schema, files_per_batch=1)
        q = streams.run_to_files(counts(events), str(tmp_path / name), str(tmp_path / f"{name}_checkpoint"))
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
        rows = spark.read.parquet(str(tmp_path / name)).select("k", "s", F.unix_micros("until"), "n").collect()
        return sorted(map(tuple, rows), key=str), held

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.01)  # files are taken by their time
        if not at_once or i == len(batches) - 1:
            want, _ = run("own", own)
            got, held = run("got", lambda e: streams.lookback_counts(e, ["k", "s"], "ts", hours, slide, groups=groups))
            assert got == want
            assert held <= 4 * groups  # a row and a timer of each group, by key and by time
    assert len(got) > 15


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["A2_scan_events"].run(spark, SF))
    assert "PushedFilters: [In(event_type, [click,view])" in text or "In(event_type" in text
    assert "props" not in text.split("ReadSchema")[-1]


def test_top_n_is_trimmed_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(QUERIES["E5_first_n_notes"].run(spark, SF))


@pytest.mark.parametrize("name", ["C7_theta_anti_join", "C8_theta_semi_join_label", "C12_nearest_asof_join", "J4_stratified_split", "J16_rank_interactions", "K3_pr_curve", "I24_tfidf"])
def test_no_pair_explosion(spark, name):
    text = plan(QUERIES[name].run(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_synthetic_rows_lie_between_neighbours(spark):
    from wardlight.operators import neighbors

    rng = np.random.default_rng(2)
    vecs = np.round(rng.normal(size=(40, 3)), 2)
    vecs[5:12] = vecs[5]  # copies
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(100 + i, 0, [9.0, 9.0, 9.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    new = neighbors.smote(df, "id", "y", "v", 3, 0.9, 1).toPandas()
    assert len(new) == 50
    for i, v in zip(new["id"], new["v"]):
        d = np.sqrt(((vecs - vecs[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        ends = vecs[np.argsort(d, kind="stable")[:3]]
        near = vecs[d <= np.sort(d)[2] + 1e-9]
        off = [np.linalg.norm(np.cross(np.array(v) - vecs[i], e - vecs[i])) for e in near]
        assert min(off) < 1e-6 and len(ends) == 3


@pytest.mark.parametrize("group_rows", [None, 60])
def test_nearest_rows_compare_groups_not_every_pair_of_blocks(spark, monkeypatch, group_rows):
    from wardlight.operators import neighbors

    rng = np.random.default_rng(7)
    vecs = np.round(rng.normal(size=(400, 8)), 1) + 1e5  # far from zero: products round more than the distances between rows
    vecs = np.concatenate([vecs, [vecs[0] + 1.0, vecs[0] - 1.0]])  # equally far from the first
    calls, closest = spark.sparkContext.accumulator(0), neighbors._closest

    def counted(*args):
        calls.add(1)
        return closest(*args)

    monkeypatch.setattr(neighbors, "_closest", counted)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "rep long, vec array<double>")
    more = {"group_rows": group_rows} if group_rows else {}
    found = neighbors.nearest_rows(df, 3, block_rows=4, **more).toPandas()
    want = []
    for i, v in enumerate(vecs):
        d = np.sqrt(((vecs - v) ** 2).sum(axis=1))
        d[i] = np.inf
        want += [(i, int(j), r + 1, d[j]) for r, j in enumerate(np.lexsort((np.arange(len(d)), d))[:3])]
    got = sorted(found[["rep", "neighbor", "rank", "distance"]].itertuples(index=False, name=None), key=lambda r: (r[0], r[2]))
    assert got == want
    assert calls.value <= (1 if group_rows is None else 20**2)


def test_cells_are_dealt_to_groups_of_bounded_size():
    from wardlight.operators.neighbors import _groups

    assert _groups([0, 3, 4, 25, 2, 8, 1], 10) == ([0, 0, 0, 1, 4, 4, 5], [1, 1, 1, 3, 1, 1, 1])


def test_fits_read_combinations_of_bins_and_scores_stay_with_their_rows(spark, monkeypatch):
    from wardlight.operators import models

    seen, fit = [], models.LogisticRegression.fit

    def noted(self, rows, *a):
        seen.append(rows.selectExpr("count(*)", "sum(" + self.getWeightCol() + ")").first())
        return fit(self, rows, *a)

    monkeypatch.setattr(models.LogisticRegression, "fit", noted)
    df = spark.range(250_000).selectExpr("id", "double(id % 7) AS a", "double(id % 2) AS b", "int(id % 5 = 0 OR id % 7 > 4) AS y")
    m = models.fit_additive(df, ["a", "b"], "y", n_bins=3, max_iter=5)
    assert [round(s[1], 3) for s in seen] == [250_000] and seen[0][0] < 120_000
    scored = models.batch_predict(df, "id", m, keep=["y"])
    text = plan(scored)
    assert "hashpartitioning(id" not in text and "SortMergeJoin" not in text
    want = models.score_ensemble(models.term_bins(df.limit(500), "id", m), m.shapes, "id").toPandas().set_index("id")
    got = scored.join(df.limit(500).select("id"), "id").toPandas().set_index("id").loc[want.index]
    assert np.allclose(got["pred_proba"], want["pred_proba"], atol=1e-12) and (got["pred_label"] == want["pred_label"]).all()


def test_ablation_fits_settle_and_its_pairs_stand_alone(spark, monkeypatch):
    """Every model of J30 is at the minimum of its loss, so it expects as many positives as there are; the last one has each clinical x text pair and no single feature."""
    fits, fit, variants, predict = [], models.LogisticRegression.fit, [], models.batch_predict

    def noted(self, rows, *a):
        m = fit(self, rows, *a)
        fits.append((self.getRegParam(), rows.toPandas(), m.coefficients.toArray(), m.intercept))
        return m

    monkeypatch.setattr(models.LogisticRegression, "fit", noted)
    monkeypatch.setattr(models, "batch_predict", lambda df, id_col, m, **k: variants.append((m, predict(df, id_col, m, **k))) or variants[-1][1])
    QUERIES["J30_modality_ablation"].run(spark, SF)
    assert len(fits) == len(variants) == 3
    for reg, rows, beta, b in fits:
        x, y, w = np.stack([v.toArray() for v in rows["x"]]), rows["__y"].to_numpy(), rows["__w"].to_numpy()
        off = w * (1 / (1 + np.exp(-(x @ beta + b))) - y) / w.sum()
        assert np.abs(np.append(x.T @ off + reg * beta, off.sum())).max() < 1e-6
    for (m, scored), (_, rows, _, _) in zip(variants, fits):
        expected, n = scored.agg(F.sum("pred_proba"), F.count("*")).first()
        assert abs(expected / n - (rows["__y"] * rows["__w"]).sum() / rows["__w"].sum()) < 0.02
    want = {f"{a} & {b}" for a in ("o_totalprice", "tax") for b in ("n_lines", "qty")} | {models.INTERCEPT}
    assert {r["term"] for r in variants[-1][0].shapes.select("term").distinct().collect()} == want
