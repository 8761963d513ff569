"""Null keys, null order values, infinities and large keys: nothing is lost and the grain stays."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wardlight.functions import notes
from wardlight.operators import documents, metrics, ordered, pairs, sampling


def test_positions_keep_null_keys_and_put_null_times_last(spark):
    rows = [(1, "2020-01-02 00:00:00"), (1, None), (1, "2020-01-01 00:00:00"), (None, "2020-01-01 00:00:00"), (None, None)]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("t", F.to_timestamp("t"))
    got = {(r.k, r.t and r.t.day): r.rn for r in ordered.positions(df, ["k"], ordered.day_bucket("t"), [F.col("t")]).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, None): 3, (None, 1): 1, (None, None): 2}


def test_split_keeps_rows_without_label(spark):
    df = spark.range(100).selectExpr("id", "if(id % 5 = 0, null, cast(id % 2 as int)) as y")
    assert sampling.stratified_split(df, "id", "y", 0.2).count() == 100


def test_one_row_per_key_at_any_size(spark):
    df = spark.range(2500).selectExpr("1 as k", "id as t", "concat('n', id) as text")
    got = documents.concat_notes(df, "k", F.floor(F.col("t") / 256).cast("int"), ["t"], "text", " ").collect()
    assert len(got) == 1 and got[0].text == " ".join(f"n{i}" for i in range(2500)) and got[0].n_notes == 2500
    again = df.unionByName(df.withColumn("t", F.col("t") + 5000))
    assert [r.n_notes for r in documents.concat_unique(again, "k", F.floor(F.col("t") / 256).cast("int"), "t", "text").collect()] == [2500]


def test_quantiles_with_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, x) for x in (-inf, 1.0, 2.0, 3.0, inf)] + [(2, inf), (2, inf)], "k int, x double")
    got = {r.k: r for r in ordered.grouped_quantiles(df, ["k"], "x", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert (got[1].lo, got[1].mid, got[1].hi) == (-inf, 2.0, inf) and got[2].mid == inf


def test_prefilter_never_hides_a_match(spark):
    texts = ["an ac here", "ab", "abbc", "a.c", "x\ny", "food", "fed", "colour", "color", "abab"]
    patterns = ["ab{0,2}c", "ab?c?", "a\\.c", "x\\ny", "(fo(o|e))?d", "f(oo|e)d", "colou?r", "(ab)+", "(?:ab){2}", "[xy]*d", "z*food", "a\\b|q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[notes.holds(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for r in got:
        assert [r[f"p{i}"] for i in range(len(patterns))] == [re.search(p, r.t) is not None for p in patterns], r.t


def test_pair_ranking_masks_unknown_and_ignores_offsets(spark):
    base = spark.range(4000).selectExpr("id", "(id * 7919 % 1000) / 10.0 as x", "if(id % 4 = 0, null, cast(id % 4 = 1 as int)) as t", "sin(id) + (id * 7919 % 1000) / 500.0 as r")
    one = pairs.rank_interactions(base, ["x"], ["t"], "r").first()
    known = base.where("t is not null")
    assert (one.n_t0, one.n_t1) == (known.where("t = 0").count(), known.where("t = 1").count())
    far = pairs.rank_interactions(base.withColumn("x", F.col("x") + 1e7), ["x"], ["t"], "r").first()
    for side in (0, 1):
        want = known.where(f"t = {side}").select(F.corr("x", "r")).first()[0]
        assert abs(one[f"corr_t{side}"] - want) < 1e-6 and abs(far[f"corr_t{side}"] - want) < 1e-4


def test_quantiles_of_crowded_values_and_null_keys(spark):
    """All values within 1 % of width, infinities and both zeros; a null key keeps its row."""
    inf = float("inf")
    rows = [("hot", 140 + i / 7000) for i in range(7000)] + [(None, x) for x in (inf, -inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, float("nan"), None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ordered.grouped_quantiles(df, ["k"], "v", {"low": 0.0, "q": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    assert abs(got["hot"].q - (140 + 6999 / 4 / 7000)) < 1e-9 and abs(got["hot"].mid - (140 + 6999 / 2 / 7000)) < 1e-9
    assert (got[None].low, got[None].mid, got[None].top) == (-inf, 0.0, inf) and len(got) == 2
    assert ordered.grouped_quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_crowded_scores_fill_many_slices(spark):
    df = spark.range(40_000).selectExpr("id % 3 = 0 as y", "id * 0.0002 / 40000 as s").withColumn("y", F.col("y").cast("int"))
    slices = ordered.border_bucket(df, [], "s", "b").groupBy("b").count().collect()
    assert len(slices) > 900 and max(r["count"] for r in slices) < 200
    steps = metrics.score_steps(df, "y", "s").orderBy(F.desc("threshold")).collect()
    tp = 0
    for r in steps:
        tp += r.pos
        assert r.tp == tp
    assert len(steps) == 40_000


def test_priority_keeps_notes_without_key_or_category(spark):
    df = spark.createDataFrame([(1, "a", 1, "x"), (1, None, 2, "y"), (None, None, 3, "z"), (None, "a", 4, "w")], "k int, c string, t int, text string")
    got = {r.k: r.combined for r in documents.priority_concat(df, "k", "c", "t", "text", ["b"], sep="|").collect()}
    assert got == {1: "x|y", None: "z|w"}


def test_mentions_have_flags_of_their_own(spark):
    from wardlight.operators import corpus

    pad = "x" * 60
    text = f"No fever today {pad} fever {pad} mother had fever {pad} possible chest pain"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    terms = spark.createDataFrame([("fever", "P"), ("chest pain", "P")], "term string, label string")
    got = corpus.mentions_in_context(corpus.dictionary_entities(df, "id", "text", terms, "term", "label"), "entity_norm").orderBy("start_char").collect()
    assert [r.name for r in got] == ["Absent_fever", "fever", "Family_fever", "Possible_chest_pain"]
    assert [r.keep for r in got] == [False, True, True, True]


def test_contained_notes_are_left_out(spark):
    """Next to the plain fold: equal, quoted, overlapping, short and empty notes, across joints, with null keys and orders."""
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.choice([3, 30, 39, 40, 200, 2000]))) for _ in range(60)]
    rows = [(k, i, x) for k in (1, None) for i, x in enumerate(base)]
    for i in range(300):
        x = rng.choice(base)
        a = rng.randrange(len(x))
        piece = x[a : a + rng.choice([1, 10, 38, 39, 60, 500])]
        rows.append((rng.choice([1, 2, None]), rng.choice([100 + i, None]), rng.choice(["", " ", "\n"]) + piece + rng.choice(["", "z"])))
    rows += [(1, 990, base[2].strip() + "\n\n" + base[3].strip()), (3, 1, " \n"), (3, 2, None), (4, 1, "one")]
    got = {r.k: (r.n_notes, r.text) for r in documents.concat_contained(spark.createDataFrame(rows, "k int, o int, text string").repartition(3), "k", "o", "text").collect()}
    want = {}
    for k in (1, 2, None, 4):
        own, seen, text, n = [(o is not None, o or 0, x.encode(), x) for key, o, x in rows if key == k and x is not None], set(), None, 0
        for *_, x in sorted(own):
            if x not in seen and x.strip() and (text is None or x.strip() not in text):
                text, n = x.strip() if text is None else text + "\n\n" + x.strip(), n + 1
            seen.add(x)
        want[k] = (n, text)
    assert got == want


def test_samples_shuffle_no_other_column(spark):
    """Exact shares per class, ties of ids and null labels included, and no exchange carries the payload."""
    df = spark.range(3000).selectExpr("id % 2500 as id", "case when id % 10 = 0 then null when id % 7 = 0 then 1 else 0 end as y", "repeat('x', 50) as payload")
    sizes = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    split = sampling.stratified_split(df.dropDuplicates(["id"]), "id", "y", 0.3)
    for r in split.groupBy("y").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == int(r.n * 0.3)
    one = spark.range(3000).selectExpr("id", "if(id % 9 = 0, 1, 0) as y", "repeat('x', 50) as payload")
    few = sampling.undersample(one, "id", "y", 0.5)
    assert {r.y: r["count"] for r in few.groupBy("y").count().collect()} == {1: 334, 0: 668}
    more = sampling.oversample(one, "id", "y")
    assert {r.y: r["count"] for r in more.groupBy("y").count().collect()} == {1: 2666, 0: 2666}
    assert sizes[None] == 300
    spark.range(1).write.mode("overwrite").format("noop").save()
    for out in (sampling.stratified_split(one, "id", "y"), few, more):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "payload" in plan
        physical = out._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hashpartitioning" in line and "payload" in line for line in physical.split("\n"))
        assert "SortMergeJoin" not in physical


def test_a_growing_text_holds_little_beside_its_text():
    import random
    import tracemalloc

    r = random.Random(1)
    found = [" ".join(str(r.random()) for _ in range(150)).encode() for _ in range(400)]
    tracemalloc.start()
    held = documents.GrowingText("\n\n")
    for note in found:
        held.add(note)
        held.add(note[7:300].strip())
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.n == len(found) and bytes(held.body) == b"\n\n".join(found)
    assert all(note[100:900] in held for note in found) and b"x" + found[0][:300] not in held
    assert used < 5 * len(held.body)  # 11 times when the marks were lists by value
