"""Row-level clinical features; the variables are derived from lineitem columns, some missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical, fixed
from ..functions.exprs import flag, rounded
from ..operators import aggregates, pairs, series
from .aggregate_queries import IQR_SQL
from .registry import Tables, query
from .series_queries import CUT_SQL, cutoffs

VARS = {
    "HeartRate": "l_quantity * 3", "SysBP": "60 + l_extendedprice / 700", "DiasBP": "30 + l_extendedprice / 1100", "RespRate": "l_partkey % 41",
    "Temperature": "34 + l_tax * 60", "WBC": "l_suppkey % 25", "Platelet": "l_partkey % 450", "INR": "l_discount * 30",
    "PTT": "l_orderkey % 91", "Glucose": "l_partkey % 403", "Sodium": "118 + l_orderkey % 43", "Potassium": "2 + l_discount * 50",
    "Creatinine": "l_tax * 40", "BUN": "l_suppkey % 60", "Chloride": "90 + l_partkey % 20", "Bicarbonate": "15 + l_suppkey % 15",
    "SpO2": "85 + l_suppkey % 16", "Lactate": "l_discount * 70",
}
# Every seventh line has no measurements of the last three variables, every fifth none of the first three.
ABSENT = {"Glucose": 7, "Sodium": 7, "Lactate": 7, "HeartRate": 5, "SysBP": 5, "RespRate": 5}
KEY = ["l_orderkey", "l_partkey", "l_linenumber"]
VITAL_SQL = "vit AS (SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(
    f'CASE WHEN l_partkey % {ABSENT[n]} = 0 THEN NULL ELSE ({e})::DOUBLE END AS "{n}"' if n in ABSENT else f'({e})::DOUBLE AS "{n}"' for n, e in VARS.items()
) + " FROM lineitem)"


def vitals(t: Tables):
    cols = []
    for n, e in VARS.items():
        c = F.expr(e).cast("double")
        cols.append((F.when(F.col("l_partkey") % ABSENT[n] != 0, c) if n in ABSENT else c).alias(n))
    return t.heavy("lineitem").select(*KEY, *cols)


def finish(df, out: dict, digits: int = 6):
    raw = df.select(*KEY, *[c.alias(n) for n, c in out.items()])  # rounding refers to a value several times
    doubles = {n for n, kind in raw.dtypes if kind == "double"}
    return raw.select(*KEY, *[(rounded(n, digits) if n in doubles else F.round(n, digits).cast("double")).alias(n) for n in out])


def sql_out(exprs: dict[str, str], source: str = "vit", extra: str = "", with_: str = VITAL_SQL) -> str:
    cols = ", ".join(f'round(({e})::DOUBLE, 6) AS "{n}"' for n, e in exprs.items())
    return f"WITH {with_}{extra} SELECT {', '.join(KEY)}, {cols} FROM {source}"


def case(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def div0(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"


def clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


ORDER_SQL = """st AS (SELECT l_orderkey, min(l_quantity) AS mn, max(l_quantity) AS mx, avg(l_quantity) AS av, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1)"""


def order_stats(t):
    return series.series_stats(t("lineitem", "l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", median=False)


@query("H1_range_pct", f"WITH {ORDER_SQL} SELECT l_orderkey, mx - mn AS span, round((mx - mn) / (abs(av) + 1e-9), 6) AS pct FROM st")
def _(t):
    span, pct = clinical.range_pct("v_min", "v_max", "v_avg")
    return order_stats(t).select("l_orderkey", span.alias("span"), F.round(pct, 6).alias("pct"))


@query("H2_interaction_products", "SELECT l_orderkey, l_partkey, l_linenumber, (l_returnflag = 'R')::INTEGER * l_quantity AS \"flag__x__qty\" FROM lineitem")
def _(t):
    li = t("lineitem").withColumn("flag", flag(F.col("l_returnflag") == "R")).withColumn("qty", F.col("l_quantity"))
    return pairs.product_features(li, [("flag", "qty")]).select(*KEY, "flag__x__qty")


@query("H3_abnormal_last", f"""WITH {IQR_SQL}, b AS (SELECT max(lo) FILTER (WHERE feature = 'price') AS plo, max(hi) FILTER (WHERE feature = 'price') AS phi,
max(lo) FILTER (WHERE feature = 'quantity') AS qlo, max(hi) FILTER (WHERE feature = 'quantity') AS qhi FROM bounds),
a AS (SELECT l_orderkey, l_partkey, l_linenumber, {case('l_extendedprice < plo OR l_extendedprice > phi')} AS price_abnormal,
{case('l_quantity * 2 < qlo OR l_quantity * 2 > qhi')} AS quantity_abnormal FROM lineitem, b)
SELECT *, price_abnormal + quantity_abnormal AS num_abnormal FROM a""")
def _(t):
    li = t("lineitem").select(*KEY, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    found = aggregates.iqr_bounds(pairs.unpivot(li, [], ["quantity", "price"]), "feature", "value").collect()
    b = {r["feature"]: (F.lit(r["lo"]), F.lit(r["hi"])) for r in found}  # one row per feature
    out = li.withColumns(
        {"price_abnormal": clinical.abnormal_last("price", *b["price"]), "quantity_abnormal": clinical.abnormal_last(F.col("quantity") * 2, *b["quantity"])}
    )
    return out.select(*KEY, "price_abnormal", "quantity_abnormal", (F.col("price_abnormal") + F.col("quantity_abnormal")).alias("num_abnormal"))


CODES_SQL = "codes AS (SELECT l_orderkey AS hadm_id, lpad((l_partkey % 1000)::VARCHAR, 3, '0') || (l_suppkey % 10)::VARCHAR AS code FROM lineitem)"


def codes(t: Tables):
    three = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    return t("lineitem", "l_orderkey", "l_partkey", "l_suppkey").select(
        F.col("l_orderkey").alias("hadm_id"), F.concat(three, (F.col("l_suppkey") % 10).cast("string")).alias("code")
    )


def group_sql(rules) -> str:
    parts = []
    for g, (_, prefixes, exact) in rules.items():
        conds = [f"starts_with(code, '{p}')" for p in prefixes] + [f"code = '{x}'" for x in exact]
        parts.append(f"max(({' OR '.join(conds)})::INTEGER) AS g_{g}")
    return f"g AS (SELECT hadm_id, {', '.join(parts)} FROM codes GROUP BY 1)"


_MILD = {m: s for s, m in fixed.CHARLSON_SUPPRESSES.items()}


@query("H4_charlson", f"WITH {CODES_SQL}, {group_sql(fixed.CHARLSON)} SELECT hadm_id, (" + " + ".join(
    f"CASE WHEN g_{_MILD[g]} = 1 THEN 0 ELSE {w} * g_{g} END" if g in _MILD else f"{w} * g_{g}" for g, (w, _, _) in fixed.CHARLSON.items()) + ")::INTEGER AS cci_score FROM g")
def _(t):
    return clinical.comorbidity_score(codes(t), "hadm_id", "code", fixed.CHARLSON, fixed.CHARLSON_SUPPRESSES, "cci_score")


@query("H5_elixhauser", f"WITH {CODES_SQL}, {group_sql(fixed.ELIXHAUSER)} SELECT hadm_id, (" + " + ".join(f"g_{g}" for g in fixed.ELIXHAUSER) + ")::INTEGER AS elixhauser_index FROM g")
def _(t):
    return clinical.comorbidity_score(codes(t), "hadm_id", "code", fixed.ELIXHAUSER, None, "elixhauser_index")


@query("H6_comorbidity_flags", f"""WITH {CODES_SQL} SELECT hadm_id, max((substr(code, 1, 3) IN ('401', '402', '403', '404', '405'))::INTEGER) AS hypertension,
max((substr(code, 1, 3) IN ('410', '411', '412', '413', '414', '428'))::INTEGER) AS cardiovascular FROM codes GROUP BY 1""")
def _(t):
    return clinical.any_code_flags(codes(t), "hadm_id", "code", {"hypertension": fixed.HYPERTENSION_PREFIXES, "cardiovascular": fixed.CARDIOVASCULAR_PREFIXES})


@query("H7_ventilation_usage", f"WITH {CODES_SQL} SELECT o_orderkey AS hadm_id, (o_orderkey IN (SELECT hadm_id FROM codes WHERE code IN ('9670', '9671', '9672')))::INTEGER AS ventilation FROM orders")
def _(t):
    vent = codes(t).where(F.col("code").isin(fixed.VENTILATION_CODES)).select("hadm_id").distinct().withColumn("ventilation", F.lit(1))
    return t("orders").select(F.col("o_orderkey").alias("hadm_id")).join(vent, "hadm_id", "left").fillna(0)


@query("H8_clinical_ratios", sql_out({
    "Shock_Index": div0('"HeartRate"', '"SysBP"'), "MAP_Avg": '("SysBP" + 2 * "DiasBP") / 3.0',
    "Modified_Shock_Index": div0('"HeartRate"', '(("SysBP" + 2 * "DiasBP") / 3.0)'), "Pulse_Pressure": '"SysBP" - "DiasBP"',
    "ROX_Index": div0('"SpO2"', '"RespRate"'), "BUN_Creatinine_Ratio": div0('"BUN"', '"Creatinine"'), "GCS_Decline": '"WBC" - "INR"',
    "Sepsis_Risk_Proxy": '"Lactate" * "HeartRate"'}))
def _(t):
    out = clinical.clinical_ratios("HeartRate", "SysBP", "DiasBP", "SpO2", "RespRate", "BUN", "Creatinine", "INR", "WBC", "Lactate")
    return finish(aggregates.scale_by_max(vitals(t), "SpO2"), out)


_D = '("Glucose" - "Platelet")'


@query("H9_temporal_features", sql_out({
    "x_Delta_24h_48h": _D, "x_Trend_24h_48h": f"sign({_D})", "x_PctChange_24h_48h": clip_sql(f'{_D} / (abs("Platelet") + 1e-8)', -10, 10),
    "x_Delta_First_Last": '"BUN" - "PTT"', "x_Trend_First_Last": 'sign("BUN" - "PTT")'}))
def _(t):
    return finish(vitals(t), clinical.temporal_features("x", "Glucose", "Platelet", "PTT", "BUN"))


@query("H10_variability", sql_out({
    "x_CV": clip_sql('"WBC" / (abs("HeartRate") + 1e-8)', 0, 10), "x_HighVariability": case('"WBC" / (abs("HeartRate") + 1e-8) > 0.3'),
    "x_RelativeRange": clip_sql('"PTT" / (abs("HeartRate") + 1e-8)', 0, 10), "plain_cv": 'CASE WHEN abs("Glucose") = 0 THEN 0 ELSE "WBC" / abs("Glucose") END'}))
def _(t):
    out = clinical.variability("x", "HeartRate", "WBC", "PTT")
    return finish(vitals(t), {**out, "plain_cv": clinical.plain_cv("Glucose", "WBC")})


def range_sql(names):
    out = {}
    for n in names:
        lo, hi, clo, chi = fixed.RANGES[n]
        q = f'"{n}"'
        out |= {
            f"{n}_IsLow": case(f"{q} < {lo}"), f"{n}_IsHigh": case(f"{q} > {hi}"), f"{n}_IsAbnormal": case(f"{q} < {lo} OR {q} > {hi}"),
            f"{n}_IsCriticalLow": case(f"{q} < {clo}"), f"{n}_IsCriticalHigh": case(f"{q} > {chi}"), f"{n}_IsCritical": case(f"{q} < {clo} OR {q} > {chi}"),
            f"{n}_DistFromNormal": f"CASE WHEN {q} < {lo} THEN {lo} - {q} WHEN {q} > {hi} THEN {q} - {hi} ELSE 0 END",
            f"{n}_DistFromMid": f"abs({q} - {(lo + hi) / 2})",
        }
    out["Total_Abnormal_Count"] = " + ".join(f"({out[f'{n}_IsAbnormal']})" for n in names)
    out["Total_Critical_Count"] = " + ".join(f"({out[f'{n}_IsCritical']})" for n in names)
    return out


RANGED = [n for n in VARS if n in fixed.RANGES]


@query("H11_abnormality", sql_out(range_sql(RANGED)))
def _(t):
    return finish(vitals(t), clinical.abnormality_features({n: n for n in RANGED}))


_SIRS = " + ".join(f"({case(c)})" for c in ('"Temperature" > 38 OR "Temperature" < 36', '"HeartRate" > 90', '"RespRate" > 20', '"WBC" > 12 OR "WBC" < 4'))
_MEWS = """(CASE WHEN "HeartRate" < 40 THEN 2 WHEN "HeartRate" < 50 THEN 1 WHEN "HeartRate" > 130 THEN 2 WHEN "HeartRate" > 110 THEN 1 ELSE 0 END)
+ (CASE WHEN "SysBP" < 70 THEN 3 WHEN "SysBP" < 80 THEN 2 WHEN "SysBP" < 100 THEN 1 WHEN "SysBP" > 200 THEN 2 ELSE 0 END)
+ (CASE WHEN "RespRate" < 9 THEN 2 WHEN "RespRate" > 29 THEN 3 WHEN "RespRate" > 20 THEN 2 WHEN "RespRate" > 14 THEN 1 ELSE 0 END)
+ (CASE WHEN "Temperature" < 35 THEN 2 WHEN "Temperature" > 38.5 THEN 2 ELSE 0 END)"""
_COAG = """(CASE WHEN "Platelet" < 50 THEN 2 WHEN "Platelet" < 100 THEN 1 ELSE 0 END) + (CASE WHEN "INR" > 2.0 THEN 2 WHEN "INR" > 1.5 THEN 1 ELSE 0 END)
+ (CASE WHEN "PTT" > 60 THEN 2 WHEN "PTT" > 40 THEN 1 ELSE 0 END)"""
_META = """(CASE WHEN "Glucose" < 60 THEN 2 WHEN "Glucose" > 300 THEN 2 WHEN "Glucose" < 70 OR "Glucose" > 180 THEN 1 ELSE 0 END)
+ (CASE WHEN "Sodium" < 125 OR "Sodium" > 155 THEN 2 WHEN "Sodium" < 130 OR "Sodium" > 150 THEN 1 ELSE 0 END)
+ (CASE WHEN "Potassium" < 2.5 OR "Potassium" > 6.5 THEN 2 WHEN "Potassium" < 3.0 OR "Potassium" > 5.5 THEN 1 ELSE 0 END)"""
_SI, _BC = '"HeartRate" / ("SysBP" + 1e-8)', '"BUN" / ("Creatinine" + 1e-8)'


@query("H12_acuity_scores", sql_out({
    "SIRS_Score": _SIRS, "MEWS_Score": _MEWS, "Coagulation_Risk_Score": _COAG, "Metabolic_Score": _META, "Shock_Index": clip_sql(_SI, 0, 3),
    "Shock_Index_Elevated": case(f"{_SI} > 0.9"), "Shock_Index_High": case(f"{_SI} > 1.0"), "AKI_Stage1": case('"Creatinine" >= 1.5'),
    "AKI_Stage2": case('"Creatinine" >= 2.0'), "AKI_Stage3": case('"Creatinine" >= 3.0'), "BUN_Creat_Ratio": clip_sql(_BC, 0, 100),
    "Prerenal_Indicator": case(f"{_BC} > 20"), "SIRS_Positive": case(f"{_SIRS} >= 2"), "MEWS_High": case(f"{_MEWS} >= 4"),
    "Coag_Risk_High": case(f"{_COAG} >= 2"), "Metabolic_High": case(f"{_META} >= 2"), "Overall_Acuity": f"{_SIRS} + {_MEWS} + {_COAG} + {_META}"}))
def _(t):
    return finish(vitals(t), clinical.acuity_scores({n: n for n in VARS}))


@query("H13_ratio_features", sql_out({
    **{n: clip_sql(f'"{a}" / ("{b}" + 1e-8)', 0, 100) for n, a, b in (
        ("HR_SBP_Ratio", "HeartRate", "SysBP"), ("HR_RR_Ratio", "HeartRate", "RespRate"), ("WBC_Plt_Ratio", "WBC", "Platelet"),
        ("Gluc_K_Ratio", "Glucose", "Potassium"), ("Na_K_Ratio", "Sodium", "Potassium"))},
    "Calc_Anion_Gap": '"Sodium" - "Chloride" - "Bicarbonate"'}))
def _(t):
    return finish(vitals(t), clinical.ratio_features({n: n for n in VARS}))


_DET = {"HeartRate": ("HeartRate", "PTT", 80.0), "Glucose": ("Glucose", "Platelet", 105.0), "WBC": ("WBC", "BUN", 7.5)}


def det_sql():
    out = {}
    for n, (a, b, mid) in _DET.items():
        out[f"{n}_Deteriorating"] = case(f'abs("{a}" - {mid}) > abs("{b}" - {mid}) * 1.1')
        out[f"{n}_RapidDeterioration"] = case(f'abs("{a}" - {mid}) > abs("{b}" - {mid}) * 1.2')
    n = " + ".join(f"({out[f'{k}_Deteriorating']})" for k in _DET)
    return {**out, "Total_Deterioration_Count": n, "Multi_Organ_Deterioration": case(f"{n} >= 3")}


@query("H14_deterioration", sql_out(det_sql()))
def _(t):
    return finish(vitals(t), clinical.deterioration({n: (a, b) for n, (a, b, _) in _DET.items()}))


@query("H15_window_comparison", sql_out({
    "x_Recent_vs_Earlier": _D, "x_Variability_Change": clip_sql('"WBC" / ("BUN" + 1e-8)', 0, 10), "x_Instability_Increasing": case('"WBC" / ("BUN" + 1e-8) > 1.2'),
    "x_Monitoring_Intensity": clip_sql('"RespRate" / ("PTT" + 1e-8)', 0, 10), "x_Increased_Monitoring": case('"RespRate" / ("PTT" + 1e-8) > 1.5')}))
def _(t):
    return finish(vitals(t), clinical.window_comparison("x", ("Glucose", "Platelet"), ("WBC", "BUN"), ("RespRate", "PTT")))


EXPERT_COLUMNS = {
    "Creatinine_Max": '"Creatinine"', "SpO2_Min": '"SpO2"', "AGE": '"PTT"', "CCI_Score": '"WBC"', "LOS_ICU": '"INR"', "HeartRate_Max": '"HeartRate"',
    "SBP_Min": '"SysBP"', "RespRate_Max": '"RespRate"', "GCS_Min": '"Bicarbonate"', "HMG_Min": '"WBC"', "Platelet_Min": '"Platelet"',
    "Lactate_Max": '"Lactate"', "BUN_Creat_Ratio": '"BUN"', "UrineOutput_Median": '"Glucose"',
}
EXPERT_FLAGS = [
    "nlp_heart_failure", "nlp_liver_failure", "nlp_sepsis", "nlp_vasopressors", "nlp_ards", "nlp_respiratory_failure", "nlp_acute_kidney_injury",
    "nlp_coagulopathy", "nlp_gi_bleed", "nlp_intubation", "nlp_central_line", "nlp_surgery", "nlp_chronic_kidney_disease", "nlp_copd", "Ventilation_Usage",
]
EXPERT_SQL = ", ex AS (SELECT " + ", ".join(KEY) + ", " + ", ".join(f'{e} AS "{n}"' for n, e in EXPERT_COLUMNS.items()) + ", " + ", ".join(
    f"CASE WHEN l_partkey % 11 = {i % 11} THEN NULL ELSE ((l_partkey + {i}) % {2 + i % 3} = 0)::INTEGER END AS \"{n}\"" for i, n in enumerate(EXPERT_FLAGS)) + " FROM vit)"


def expert_sql() -> dict[str, str]:
    f = lambda n: f'coalesce("{n}", 0)'
    c = lambda n, d, op, b: f'(CASE WHEN coalesce("{n}", {d}) {op} {b} THEN 1 ELSE 0 END)'
    hf, lf, sep, vaso, ards = f("nlp_heart_failure"), f("nlp_liver_failure"), f("nlp_sepsis"), f("nlp_vasopressors"), f("nlp_ards")
    resp, aki, coag = f("nlp_respiratory_failure"), f("nlp_acute_kidney_injury"), f("nlp_coagulopathy")
    old, older, long_icu = c("AGE", 60, ">=", 70), c("AGE", 60, ">=", 80), c("LOS_ICU", 1, ">=", 5)
    high = f"{f('Ventilation_Usage')} + {vaso} + {sep} + {resp}"
    chronic = f"{f('nlp_chronic_kidney_disease')} + {hf} + {f('nlp_copd')} + {lf}"
    return {
        "cardiorenal_syndrome": f"{hf} * {c('Creatinine_Max', 1, '>', 1.5)}", "hepatorenal_syndrome": f"{lf} * {c('Creatinine_Max', 1, '>', 1.5)}",
        "septic_shock": f"{sep} * {vaso}", "ards_with_hypoxia": f"{ards} * {c('SpO2_Min', 95, '<', 90)}",
        "elderly_sepsis": f"{old} * {sep}", "elderly_heart_failure": f"{old} * {hf}", "very_elderly_resp_failure": f"{older} * {resp}",
        "elderly_high_cci": f"{old} * {c('CCI_Score', 0, '>=', 3)}", "prolonged_icu_vent": f"{long_icu} * {f('Ventilation_Usage')}",
        "prolonged_icu_sepsis": f"{long_icu} * {sep}", "prolonged_icu_aki": f"{long_icu} * {aki}", "resp_renal_failure": f"{resp} * {aki}",
        "cardiac_renal_failure": f"{hf} * {aki}", "coag_gi_bleed": f"{coag} * {f('nlp_gi_bleed')}",
        "tachycardia_hypotension": f"{c('HeartRate_Max', 80, '>', 110)} * {c('SBP_Min', 120, '<', 90)}",
        "tachypnea_hypoxia": f"{c('RespRate_Max', 16, '>', 24)} * {c('SpO2_Min', 95, '<', 92)}", "gcs_sepsis": f"{c('GCS_Min', 15, '<', 14)} * {sep}",
        "severe_anemia_coag": f"{c('HMG_Min', 12, '<', 8)} * {coag}", "thrombocytopenia_sepsis": f"{c('Platelet_Min', 200, '<', 50)} * {sep}",
        "lactate_aki": f"{c('Lactate_Max', 1, '>', 4)} * {aki}", "prerenal_low_urine": f"{c('BUN_Creat_Ratio', 15, '>', 20)} * {c('UrineOutput_Median', 100, '<', 50)}",
        "intubation_ards": f"{f('nlp_intubation')} * {ards}", "central_line_sepsis": f"{f('nlp_central_line')} * {sep}",
        "surgery_anemia": f"{f('nlp_surgery')} * {c('HMG_Min', 12, '<', 10)}", "high_acuity_composite": high,
        "very_high_acuity": f"CASE WHEN {high} >= 3 THEN 1 ELSE 0 END", "chronic_disease_burden": chronic,
        "high_chronic_burden": f"CASE WHEN {chronic} >= 2 THEN 1 ELSE 0 END",
    }


@query("H17_expert_interactions", sql_out(expert_sql(), "ex", EXPERT_SQL))
def _(t):
    v = vitals(t)
    flags = [
        F.when(F.col("l_partkey") % 11 != i % 11, flag((F.col("l_partkey") + i) % (2 + i % 3) == 0)).alias(n) for i, n in enumerate(EXPERT_FLAGS)
    ]
    ex = v.select(*KEY, *[F.col(e.strip('"')).alias(n) for n, e in EXPERT_COLUMNS.items()], *flags)
    return finish(ex, clinical.expert_interactions(ex.columns))


_S18 = f"""({case('coalesce("HeartRate", 0) > 90')}) + ({case('coalesce("RespRate", 0) > 20')}) + ({case('coalesce("WBC", 0) > 12 OR coalesce("WBC", 0) < 4')})"""


@query("H18_serving_scores", sql_out({
    "SIRS_Score": _S18, "SIRS_Positive": case(f"{_S18} >= 2"),
    "Shock_Index": 'CASE WHEN coalesce("SysBP", 120) > 0 THEN coalesce("HeartRate", 80) / coalesce("SysBP", 120) ELSE 0 END',
    "BUN_Creatinine_Ratio": 'CASE WHEN coalesce("Creatinine", 1) > 0 THEN coalesce("BUN", 0) / coalesce("Creatinine", 1) ELSE 0 END'}))
def _(t):
    return finish(vitals(t), clinical.serving_scores("HeartRate", "RespRate", "WBC", "SysBP", "BUN", "Creatinine"))


@query("H19_fluid_balance_24h", f"""WITH {CUT_SQL}, w AS (SELECT * FROM events JOIN cut USING (user_id) WHERE epoch_us(out_ts) - epoch_us(ts) BETWEEN 0 AND 24 * 3600000000)
SELECT user_id, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type IN ('click', 'view') THEN -value ELSE 0 END), 6) AS balance FROM w GROUP BY 1""")
def _(t):
    from ..operators import temporal

    near = temporal.lookback(t("events", "user_id", "event_type", "ts", "value"), cutoffs(t), "user_id", "ts", "out_ts", 24)
    into, out = F.col("event_type").isin("purchase", "signup"), F.col("event_type").isin("click", "view")
    sums = near.groupBy("user_id").agg(F.sum(F.when(into, F.col("value")).otherwise(0.0)).alias("i"), F.sum(F.when(out, F.col("value")).otherwise(0.0)).alias("o"))
    return sums.select("user_id", F.round(F.col("i") - F.col("o"), 6).alias("balance"))


_ETH = "CASE c_custkey % 6 WHEN 0 THEN 'White - Russian' WHEN 1 THEN 'BLACK/AFRICAN' WHEN 2 THEN 'asian - chinese' WHEN 3 THEN 'Latino' WHEN 4 THEN NULL ELSE c_mktsegment END"


def ethnicity():
    k = F.col("c_custkey") % 6
    return F.when(k == 0, "White - Russian").when(k == 1, "BLACK/AFRICAN").when(k == 2, "asian - chinese").when(k == 3, "Latino").when(k == 5, F.col("c_mktsegment"))


@query("H20_ethnicity_group", f"""WITH e AS (SELECT c_custkey, upper(coalesce({_ETH}, '')) AS e FROM customer) SELECT c_custkey,
CASE WHEN e LIKE '%WHITE%' THEN 'WHITE' WHEN e LIKE '%BLACK%' THEN 'BLACK' WHEN e LIKE '%ASIAN%' THEN 'ASIAN' WHEN e LIKE '%HISPANIC%' OR e LIKE '%LATINO%' THEN 'HISPANIC' ELSE 'OTHER' END AS grp FROM e""")
def _(t):
    return t("customer", "c_custkey", "c_mktsegment").select("c_custkey", clinical.ethnicity_group(ethnicity()).alias("grp"))


@query("H21_social_features", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNKNOWN' ELSE c_mktsegment END AS insurance,
coalesce(n_name, 'UNKNOWN') AS marital FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0""")
def _(t):
    n = t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("marital"))
    c = t("customer", "c_custkey", "c_nationkey", "c_mktsegment").withColumn("insurance", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return c.join(n, "c_nationkey", "left").select("c_custkey", "insurance", "marital").fillna("UNKNOWN")


@query("H22_antibiotic_filter", """SELECT p_partkey FROM part WHERE regexp_matches(CASE p_partkey % 4 WHEN 0 THEN 'vancomycin hcl ' WHEN 1 THEN 'IV Cefepime ' WHEN 2 THEN 'OXACILLIN' ELSE '' END || p_name,
'(?i)vancomycin|piperacillin|cefepime|meropenem|levofloxacin|ciprofloxacin|ceftriaxone|metronidazole|azithromycin|gentamicin|tobramycin|ampicillin|nafcillin|oxacillin')""")
def _(t):
    k = F.col("p_partkey") % 4
    drug = F.concat(F.when(k == 0, "vancomycin hcl ").when(k == 1, "IV Cefepime ").when(k == 2, "OXACILLIN").otherwise(""), F.col("p_name"))
    return t("part", "p_partkey", "p_name").where(clinical.is_antibiotic(drug)).select("p_partkey")


@query("H23_risk_level", """SELECT event_id, CASE WHEN value / 100 < 0.3 THEN 'Low' WHEN value / 100 < 0.5 THEN 'Moderate' WHEN value / 100 < 0.7 THEN 'Elevated' ELSE 'High' END AS level FROM events""")
def _(t):
    return t("events", "event_id", "value").select("event_id", clinical.risk_level(F.col("value") / 100).alias("level"))
