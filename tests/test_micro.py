"""Hand-computed values for the rules that are easy to get wrong."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardlight.functions import clinical, exprs, fixed, notes, spans
from wardlight.operators import cohort, corpus, documents, metrics, models, pairs, sampling, series, temporal
from wardlight.sources import export, ingest


def ts(day: int, hour: int = 0, minute: int = 0, second: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute, second)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


SERIES = [
    (1, ts(1, 0, 10), 10.0), (1, ts(1, 0, 50), 20.0), (1, ts(1, 3, 5), 40.0),
    (2, ts(1, 0, 50), 1.0), (2, ts(1, 1, 20), 3.0),
    (3, ts(1, 5), 7.0),
]


@pytest.fixture(scope="module")
def readings(spark):
    return frame(spark, SERIES, "id long, ts timestamp_ntz, v double")


def test_locf_grid_and_statistics(readings):
    grid = [r["value"] for r in series.locf_grid(readings, ["id"], "ts", "v").where("id = 1").orderBy("at_us").collect()]
    assert grid == [15.0, 15.0, 15.0, 40.0]
    s = {r["id"]: r for r in series.locf_stats(readings, ["id"], "ts", "v").collect()}
    a = s[1]
    assert (a["v_min"], a["v_max"], a["v_avg"], a["v_median"], a["v_std"], a["v_count"]) == (15.0, 40.0, 21.25, 15.0, 12.5, 4)
    assert a["v_slope"] == pytest.approx(135000 / 64800000)
    b = s[2]
    assert (b["v_count"], b["v_avg"]) == (2, 2.0)
    assert b["v_std"] == pytest.approx(math.sqrt(2)) and b["v_slope"] == pytest.approx(2 / 1800)
    assert s[3]["v_count"] == 1 and s[3]["v_std"] is None and s[3]["v_slope"] is None


def test_last_value_skips_nulls(spark):
    df = frame(spark, [(1, ts(1), 4.0), (1, ts(2), None)], "id long, ts timestamp_ntz, v double")
    r = series.last_value(df, ["id"], "ts", "v").first()
    assert r["v_last"] == 4.0 and r["v_last_time"] == ts(2)


def test_raw_slope(readings):
    s = {r["id"]: r["v_slope"] for r in series.slope(readings, ["id"], "ts", "v").collect()}
    assert s[2] == pytest.approx(2 / 1800) and s[3] is None


def test_nearest_and_ratio(spark):
    left = frame(spark, [(1, ts(1, 10), 90.0), (1, ts(1, 12), 80.0)], "id long, ts timestamp_ntz, p double")
    right = frame(spark, [(1, 1, ts(1, 9, 30), 50.0), (2, 1, ts(1, 10, 20), 0.4), (3, 1, ts(1, 14), 0.21)], "rid long, id long, rts timestamp_ntz, f double")
    out = temporal.pf_ratio(left, right, "id", "ts", "p", "rts", "f", "rid").collect()
    assert [(r["fio2"], round(r["ratio"], 6)) for r in out] == [(0.4, 225.0)]


def test_nearest_ties_take_the_earlier_row(spark):
    left = frame(spark, [(1, ts(1, 10))], "id long, ts timestamp_ntz")
    right = frame(spark, [(5, 1, ts(1, 9, 50), 1.0), (4, 1, ts(1, 10, 10), 2.0), (3, 1, ts(1, 9, 50), 3.0)], "rid long, id long, rts timestamp_ntz, v double")
    assert temporal.nearest(left, right, "id", "ts", "rts", "v", "rid", 3600).first()["match_value"] == 3.0


def test_lookback_bounds(spark):
    from datetime import timedelta

    out = ts(10)
    rows = [(1, out - timedelta(hours=50)), (1, out - timedelta(hours=30)), (1, out - timedelta(hours=10)), (1, out + timedelta(hours=5))]
    e, cut = frame(spark, rows, "id long, ts timestamp_ntz"), frame(spark, [(1, out)], "id long, out timestamp_ntz")
    loose = series.window_counts(e, cut, "id", ["id"], "ts", "out", bounded=False).first()
    tight = series.window_counts(e, cut, "id", ["id"], "ts", "out", bounded=True).first()
    assert (loose["n_24h"], loose["n_48h"], tight["n_24h"], tight["n_48h"]) == (2, 3, 1, 2)


def test_bins_are_left_closed(spark):
    from datetime import timedelta

    out = ts(10)
    rows = [(0, out - timedelta(hours=48), out), (1, out - timedelta(seconds=1), out), (2, out, out)]
    df = frame(spark, rows, "k long, ts timestamp_ntz, out timestamp_ntz").select("k", temporal.bin_index("ts", "out", 48, 60).alias("b"))
    assert {r["k"]: r["b"] for r in df.collect()} == {0: 0, 1: 47, 2: None}


def test_interval_overlap(spark):
    from datetime import timedelta

    t, h = ts(10), lambda n: timedelta(hours=n)
    rows = [(1, 0, t - h(40), t - h(25)), (1, 1, t - h(40), t - h(24)), (1, 2, t, t + h(2)), (1, 3, t + timedelta(seconds=1), t + h(2))]
    df = frame(spark, rows, "id long, k long, s timestamp_ntz, e timestamp_ntz")
    got = temporal.overlapping(df, frame(spark, [(1, t)], "id long, out timestamp_ntz"), "id", "s", "e", "out")
    assert sorted(r["k"] for r in got.collect()) == [1, 2]


def test_return_label(spark):
    rows = [(1, 1, ts(1), ts(3)), (1, 2, ts(3), ts(4)), (2, 3, ts(1), ts(3)), (2, 4, ts(5), ts(6)), (3, 5, ts(4), ts(2))]
    df = frame(spark, rows, "hadm long, stay long, i timestamp_ntz, o timestamp_ntz")
    got = {r["stay"]: r["Y"] for r in temporal.label_return(df, "hadm", "stay", "i", "o").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}  # stay 5 ends before it starts and must not count itself


def test_age_and_death(spark):
    from datetime import timedelta

    at = datetime(2020, 1, 1)
    rows = [(1, at, at - timedelta(days=17.5 * 365.25), ts(3)), (2, at, at - timedelta(days=17.49 * 365.25), ts(4)), (3, at, at, None)]
    df = frame(spark, rows, "k long, a timestamp_ntz, b timestamp_ntz, d timestamp_ntz")
    assert [r["k"] for r in df.where(cohort.is_adult("a", "b")).collect()] == [1]
    start, end = F.lit(ts(1)).cast("timestamp_ntz"), F.lit(ts(3)).cast("timestamp_ntz")
    assert sorted(r["k"] for r in df.where(cohort.survived_stay("d", start, end)).collect()) == [2, 3]


def test_charlson_and_dotted_codes(spark):
    codes = [(1, c) for c in ("41001", "4280", "25040", "25000", "1970", "1500")] + [(2, "443.9"), (3, "583"), (4, "5836"), (5, "V42.0")]
    got = clinical.comorbidity_score(frame(spark, codes, "id long, c string"), "id", "c", fixed.CHARLSON, fixed.CHARLSON_SUPPRESSES)
    assert {r["id"]: r["score"] for r in got.collect()} == {1: 10, 2: 1, 3: 0, 4: 2, 5: 2}


def test_budget_skips_but_goes_on(spark):
    df = frame(spark, [(1, 1, "abcdef"), (1, 2, "abcdefg"), (1, 3, "xyz")], "id long, o long, t string")
    assert documents.concat_with_budget(df, "id", ["o"], "t", 50, 10).first()["clean_text"] == "abcdef xyz"


def test_concatenation_has_one_row_per_key_and_a_long_form(spark):
    df = frame(spark, [(1, i, f"n{i}") for i in range(25)], "id long, o long, t string")
    whole = documents.concat_notes(df, "id", F.col("o"), ["o"], "t", " ").collect()
    assert [(p["n_notes"], p["t"]) for p in whole] == [(25, " ".join(f"n{i}" for i in range(25)))]
    long = documents.ordered_texts(df, ["id"], F.col("o"), ["o"], "t").collect()
    assert {(p["pos"], p["t"]) for p in long} == {(i + 1, f"n{i}") for i in range(25)}


def test_note_rules(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(notes.pattern_flags(F.lit("pt 10 ml"), {"nlp_pain": fixed.CONCEPT_PATTERNS["nlp_pain"]})[0]) == 1
    assert one(notes.clean_text(F.lit("[**Name\n**] fine.. <b>ok</b>\tAdmission Date: x\nend"))) == "fine. ok end"
    assert one(notes.clean_text(F.lit("a."))) == ""
    assert one(notes.clean_note(F.lit("pt w/o pain s/p fall"), fixed.ABBREVIATIONS_SHORT)) == "patient witho pain status post fall"  # "w/" comes first
    assert one(F.array_join(notes.preprocess(F.lit("The cat, and the dog!")), "|")) == "cat|dog"
    assert one(notes.mark_words(F.lit("The pain; painful"), ["pain"])).startswith("The <mark")
    sents = spark.range(1).select(notes.sentences(F.lit("Denies fever. Pneumonia noted.")).alias("s"))
    row = sents.select(*notes.concept_flags_negated("s")).first()
    assert (row["fever"], row["pneumonia"]) == (0, 1)


def test_unicode_word_edges(spark):
    row = spark.createDataFrame([("épe",), ("a pe b",)], "t string").select(*notes.pattern_flags("t", {"x": r"\bpe\b"})).collect()
    assert [r["x"] for r in row] == [0, 1]


def test_required_literals_never_hide_a_match():
    import re

    samples = ["ef 30%", "post-op", "postop day", "creatinine  rising", "ph < 7.3 noted", "stage 3 ulcer", "oriented x2", "intubated", "10", "nrs 8"]
    for p in fixed.CONCEPT_PATTERNS.values():
        words = notes.required_literals(p)
        for s in samples:
            if re.search(p, s):
                assert not words or any(w in s for w in words)


def test_positions(spark):
    out = spark.createDataFrame([(1, "Pain, then PAIN; no pain")], "id long, t string").select(spans.match_positions("t", r"\bpain\b", 2).alias("m")).first()["m"]
    assert [(m["text"], m["start"], m["end"]) for m in out] == [("Pain", 0, 4), ("PAIN", 11, 15)]


def test_matches_are_searched_as_plain_bytes_first(spark):
    """Both operators look for a byte string before any regex, and fold no other letter into an ASCII one."""
    p = r"\bsepsis\b|\bseptic\b"
    df = spark.createDataFrame([(1, "SEPSIS, septic"), (2, "\u017fepsis"), (3, None), (4, "asepsis"), (5, "x septic sepsis septic")], "id long, t string")
    out = df.select("id", spans.match_positions("t", p, 2).alias("m"), notes.first_matches("t", p, 2).alias("f"), notes.first_matches("t", r"\bSEPSIS\b", 2).alias("u"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(") >= 4
    got = {r.id: ([(m.text, m.start, m.end) for m in r.m], r.f, r.u) for r in out.collect()}
    assert got[1] == ([("SEPSIS", 0, 6), ("septic", 8, 14)], ["sepsis", "septic"], ["sepsis"])
    assert got[5] == ([("septic", 2, 8), ("sepsis", 9, 15)], ["septic", "sepsis"], ["sepsis"])
    assert [got[i][:2] for i in (2, 3, 4)] == [([], [])] * 3


def test_factored_patterns_match_alike():
    import re

    samples = ["ef 30%", "post-op", "creatinine  rising", "the mi, or pe", "nrs 10", "10", "x10", "ventilatory", "a stage 3 ulcer", "format or"]
    for p in [*fixed.CONCEPT_PATTERNS.values(), *fixed.RISK_PATTERNS.values(), r"\ba\(b|mi", r"\bx[(|]|\bmi"]:
        assert all([m.span() for m in re.finditer(p, s)] == [m.span() for m in re.finditer(notes.factored(p), s)] for s in samples)
    assert notes.factored(r"\bmi\b|\bpe\b") == r"\b(?:mi\b|pe\b)"


def test_negated_flags_search_the_note_first(spark):
    df = spark.createDataFrame([(1, ["No evidence of Sepsis", "chest PAIN"]), (2, []), (3, ["denies pain", "pain"])], "id long, s array<string>")
    flags = notes.concept_flags_negated("s", {"sepsis": ["sepsis"], "pain": ["pain", "ache"]})
    out = df.select("id", *flags)
    assert "Contains(lower(array_join" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(1, 0, 1), (2, 0, 0), (3, 0, 1)}


def test_rows_of_a_feature_are_not_gathered(spark):
    """Per-feature tables go to the rows; joined by shuffle, one task would get all rows of a feature."""
    from wardlight.operators import audit, pairs

    long = spark.range(40).selectExpr("'f' as feature", "cast(id as double) as value", "cast(id % 2 as int) as y")
    for out in (audit.class_overlap(long, "feature", "value", "y"), pairs.quantile_bin(long, "feature", "value", 5, keep_small=3)):
        assert "ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString()
    binned = pairs.quantile_bin(long, "feature", "value", 5).groupBy("bin").count().collect()
    assert sorted((r.bin, r["count"]) for r in binned) == [(str(i), 8) for i in range(5)]


def test_words_leave_a_worker_in_bounded_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["One two three", None, "w " * 40_000])], names=["id", "t"])
    out = list(spans.word_cutter(r"\w+", 2, ["id", "gram", "n", "first", "start_char", "end_char"])(iter([batch])))
    assert max(b.num_rows for b in out) == spans.OUT_ROWS and sum(b.num_rows for b in out) == 5 + 79_999
    assert [tuple(r.values()) for r in out[0].slice(0, 5).to_pylist()] == [
        (7, "one", 1, 1, 0, 3), (7, "two", 1, 2, 4, 7), (7, "one two", 2, 1, 0, 7), (7, "three", 1, 3, 8, 13), (7, "two three", 2, 2, 4, 13)]


def test_dictionary_prefers_longest(spark):
    df = spark.createDataFrame([(1, "Chronic Heart Failure and heart rate")], "id long, t string")
    terms = spark.createDataFrame([("heart failure", "PROBLEM"), ("heart", "TEST"), ("failure", "TEST")], "term string, label string")
    got = corpus.dictionary_entities(df, "id", "t", terms, "term", "label").orderBy("start_char").collect()
    assert [(r["entity_text"], r["entity_label"], r["start_char"]) for r in got] == [("Heart Failure", "PROBLEM", 8), ("heart", "TEST", 26)]


def test_chi2_form(spark):
    labels = spark.createDataFrame([(i, 1 if i < 4 else 0) for i in range(10)], "id long, y int")
    feats = spark.createDataFrame([(i, "x", 1.0) for i in (0, 1, 2, 5)], "id long, f string, v double")
    r = corpus.chi2_scores(feats, labels, "id", "f", "v", "y").first()
    assert r["chi2_score"] == pytest.approx(1.225 + 0.816667, abs=1e-5) and r["pvalue"] == pytest.approx(math.erfc(math.sqrt(r["chi2_score"] / 2)), abs=1e-6)


def test_tfidf_against_plain_python(spark):
    docs = ["fever and cough", "fever high fever", "cough cough night", "night calm"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    voc = corpus.tfidf_fit(df, "t", 100, (1, 1), 0.0, 1.0)
    got = {(r["id"], r["term"]): r["tfidf"] for r in corpus.tfidf_transform(df, "id", "t", voc, (1, 1)).collect()}
    toks = [[w for w in d.split() if w != "and"] for d in docs]
    terms = {w for t in toks for w in t}
    idf = {w: math.log(5 / (1 + sum(w in t for t in toks))) + 1 for w in terms}
    for i, t in enumerate(toks):
        raw = {w: t.count(w) * idf[w] for w in set(t)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            assert got[(i, w)] == pytest.approx(x / norm)


def test_sampling_counts(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(12)], "id long, y int")
    under = sampling.undersample(df, "id", "y", 0.4).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in under} == {1: 2, 0: 5}
    over = sampling.oversample(df, "id", "y").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in over} == {1: 10, 0: 10}
    folds = sampling.stratified_kfold(df, "id", "y", 2).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in folds} == {(1, 0): 1, (1, 1): 1, (0, 0): 5, (0, 1): 5}


def test_false_negative_cost(spark):
    assert spark.range(1).select(sampling.false_negative_cost(F.lit(93 / 7.0)).alias("c")).first()["c"] == pytest.approx(2.659260, abs=1e-6)


def test_curve_values(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    curve = [(r["precision"], r["recall"]) for r in metrics.pr_curve(df, "y", "p").orderBy(F.desc_nulls_last("threshold")).collect()]
    assert [(round(p, 4), r) for p, r in curve] == [(1.0, 0.5), (0.5, 0.5), (0.6667, 1.0), (0.5, 1.0), (1.0, 0.0)]
    assert metrics.auroc(df, "y", "p").first()[0] == 0.75
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(0.833333, abs=1e-6)
    best = metrics.best_f1_threshold(df, "y", "p").first()
    assert best["threshold"] == 0.7 and best["f1"] == pytest.approx(0.8, abs=1e-6)


def test_column_helpers():
    class Names:
        columns = ["subject_id", "tfidf_x", "AGE"]

        @staticmethod
        def toDF(*cols):  # noqa: N802
            return list(cols)

    assert cohort.standardize_ids(Names) == ["SUBJECT_ID", "TFIDF_X", "AGE"]
    assert cohort.standardize_ids(Names, exact_ids=True) == ["SUBJECT_ID", "tfidf_x", "AGE"]
    assert cohort.split_modalities(["TFIDF_a", "nlp_x", "AGE"]) == (["TFIDF_a", "nlp_x"], ["AGE"])
    assert cohort.dedupe_columns(["a", "b", "a", "a"]) == ["a", "b", "a_engineered", "a_engineered2"]
    assert cohort.find_column(["HR_Max", "HR_Mean", "WBC"], ["HR"]) == "HR_Mean"
    assert cohort.find_column(["HR_Max", "WBC"], ["wbc"]) == "WBC"
    assert notes.safe_feature_name("a-b c") == "NLP_a_b_c"
    assert notes.safe_feature_name("a b", ["NLP_a_b"]) == "NLP_a_b_1"


def test_run_thresholds(spark):
    runs = spark.createDataFrame(
        [("a/m.csv", "0.6", "0.6", "0.6"), ("b/m.csv", "0.4", "0.45", "0.4"), ("c/m.csv", "0.5", "0.5", "0.5"), ("d/m.csv", "x", "0.9", "0.9")],
        "file string, precision string, recall string, f1 string",
    )
    assert sorted(r["dir"] for r in ingest.passing_runs(runs).collect()) == ["a", "c"]
    assert [r["dir"] for r in ingest.passing_runs(runs, strict=True).collect()] == ["a"]


def test_csv_ingest_types_blanks_and_lines(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "NOTES.csv").write_text('ROW_ID,VALUE,TEXT\n1,2.5,"a ""b""\nc"\n2,,\n3,bad,x\n')
    schema = T.StructType.fromDDL("ROW_ID BIGINT, VALUE DOUBLE, TEXT STRING")
    assert ingest.ingest_csv_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"NOTES": schema}, multi_line=["NOTES"]) == ["NOTES"]
    rows = spark.read.parquet(str(tmp_path / "out" / "NOTES")).orderBy("ROW_ID").collect()
    assert [(r["VALUE"], r["TEXT"]) for r in rows] == [(2.5, 'a "b"\nc'), (None, None), (None, "x")]


def test_pair_list_and_metadata(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("Top pairs\nHR & TFIDF_pain: 0.9\nBUN & TFIDF_fall: 0.5\nx\n")
    got = ingest.read_interaction_list(spark, str(tmp_path / "pairs.txt"), 1).collect()
    assert [(r["a"], r["b"], r["score"]) for r in got] == [("HR", "TFIDF_pain", 0.9)]
    (tmp_path / "meta.json").write_text('{"measured_cols": ["BUN_measured"]}')
    assert ingest.read_feature_metadata(str(tmp_path / "meta.json"))["measured_cols"] == ["BUN_measured"]
    assert ingest.read_feature_metadata(str(tmp_path / "none.json"), ["a_measured", "b"])["measured_cols"] == ["a_measured"]


def test_versions_stay_readable(spark, tmp_path):
    df = spark.range(3)
    a, b = export.write_features(df, str(tmp_path), "1"), export.write_features(df, str(tmp_path), "2")
    assert a != b and spark.read.parquet(a).count() == 3
    with pytest.raises(ValueError):
        ingest.read_embeddings(spark.range(3), spark.range(2), "id")


def test_population_median_only_for_unmeasured(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2), (2, "a", 3.0, 5), (3, "a", None, None), (4, "a", None, 1)], "id long, c string, m double, n long")
    got = {r["id"]: r["m"] for r in series.fill_population_median(df, "c", "n", ["m"]).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: None}


def test_additive_model_learns_and_explains(spark):
    rows = [(i, float(i % 10), float(i % 3), 1 if i % 10 >= 5 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    m = models.fit_additive(df, ["a", "b"], "y", [("a", "b")], n_bins=5, reg=0.001)
    scored = models.batch_predict(df, "id", m).join(df, "id")
    assert metrics.auroc(scored, "y", "pred_proba").first()[0] > 0.95
    top = models.local_explanation(models.term_bins(df, "id", m), m.shapes, "id", 1).where("id = 9").first()
    assert top["term"] in ("a", "a & b") and top["kind"] == "risk"
    res = models.residuals(df, "id", "y", m).agg(F.avg("residual").alias("m")).first()["m"]
    assert abs(res) < 0.05


def test_clip_keeps_null(spark):
    row = spark.createDataFrame([(None,), (50.0,)], "x double").select(exprs.clip("x", 0, 10).alias("c")).collect()
    assert [r["c"] for r in row] == [None, 10.0]


def test_expert_rule_defaults(spark):
    df = spark.createDataFrame([(1, None, 2.0), (None, 9.0, None)], "nlp_sepsis int, LOS_ICU double, Creatinine_Max double")
    got = [r["prolonged_icu_sepsis"] for r in df.select(*[c.alias(n) for n, c in clinical.expert_interactions(df.columns).items()]).collect()]
    assert got == [0.0, 0.0]
    assert pairs.MAX_NAMES > 0


def test_rounded_equals_round_and_seldom_needs_it(spark):
    import random
    import re

    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0000005, -2.5000005, 0.1 + 0.2, 999999.9999995, 1e6, -1e6, 1e22, 1e-320, 1.7976931348623157e308]
    ties = [s * (k + 0.5) / 1e6 + d for k in range(0, 40_000, 97) for s in (1, -1) for d in (0.0, 1e-12, -1e-12, 1e-10)]
    values = odd + ties + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 9) for _ in range(20_000)]
    df = frame(spark, [(v,) for v in values], "v double")
    for digits in (0, 2, 6, 8):
        got = df.select(F.round("v", digits).alias("a"), exprs.rounded("v", digits).alias("b"))
        assert got.where("NOT (cast(a AS string) <=> cast(b AS string))").count() == 0
    from wardlight.plans.catalog import QUERIES

    plan = QUERIES["H11_abnormality"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    before = re.findall(r"(\w+) round\(\w+_Dist", plan)
    assert before and set(before) == {"ELSE"}


@pytest.mark.parametrize("in_row", [10_000, 0])
def test_tfidf_counts_only_terms_whose_hash_value_is_frequent(spark, monkeypatch, in_row):
    from collections import Counter

    monkeypatch.setattr(corpus, "BUCKETS_IN_ROW", in_row)
    texts = [f"heart rate {'heart' if i % 2 else 'kidney'} word{i} other{i}x" for i in range(60)] + ["", None, "rare heart"]
    voc = corpus.tfidf_fit(frame(spark, [(t,) for t in texts], "t string"), "t", 100, (1, 2), 0.1, 1.0, [])
    df, total = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        df.update(set(terms))
        total.update(terms)
    want = {(t, df[t], total[t]) for t in df if df[t] >= 0.1 * len(texts)}
    assert {(r["term"], r["df"], r["total"]) for r in voc.collect()} == want and ("rate heart", 30, 30) in want
    assert "pmod(xxhash64(" in voc._jdf.queryExecution().optimizedPlan().toString()  # rare terms leave before they are counted
