"""Row-level clinical expressions; inputs are column names so any frame can use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .exprs import clip, col, flag, safe_div, total

TINY = 1e-8


def ratio(a: str | Column, b: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    r = F.try_divide(col(a), col(b) + F.lit(TINY))
    return r if lo is None else clip(r, lo, hi)


def range_pct(lo: str, hi: str, avg: str) -> tuple[Column, Column]:
    span = F.col(hi) - F.col(lo)
    return span, span / (F.abs(F.col(avg)) + F.lit(1e-9))


def abnormal_last(last: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return flag((col(last) < col(lo)) | (col(last) > col(hi)))


def clinical_ratios(hr: str, sbp: str, dbp: str, spo2: str, rr: str, bun: str, creat: str, gcs_min: str, gcs_max: str, lactate: str) -> dict[str, Column]:
    """``spo2`` must already be a percentage; see ``scale_by_max``."""
    mean_pressure = (F.col(sbp) + 2 * F.col(dbp)) / 3.0
    return {
        "Shock_Index": safe_div(hr, sbp),
        "MAP_Avg": mean_pressure,
        "Modified_Shock_Index": safe_div(F.col(hr), mean_pressure),
        "Pulse_Pressure": F.col(sbp) - F.col(dbp),
        "ROX_Index": safe_div(spo2, rr),
        "BUN_Creatinine_Ratio": safe_div(bun, creat),
        "GCS_Decline": F.col(gcs_max) - F.col(gcs_min),
        "Sepsis_Risk_Proxy": F.col(lactate) * F.col(hr),
    }


def temporal_features(base: str, mean_24h: str, mean_48h: str, first: str, last: str) -> dict[str, Column]:
    recent = F.col(mean_24h) - F.col(mean_48h)
    whole = F.col(last) - F.col(first)
    return {
        f"{base}_Delta_24h_48h": recent,
        f"{base}_Trend_24h_48h": F.signum(recent),
        f"{base}_PctChange_24h_48h": clip(recent / (F.abs(F.col(mean_48h)) + F.lit(TINY)), -10, 10),
        f"{base}_Delta_First_Last": whole,
        f"{base}_Trend_First_Last": F.signum(whole),
    }


def variability(base: str, mean: str, std: str, span: str | Column) -> dict[str, Column]:
    scale = F.abs(F.col(mean)) + F.lit(TINY)
    cv = F.col(std) / scale
    return {
        f"{base}_CV": clip(cv, 0, 10),
        f"{base}_HighVariability": flag(cv > 0.3),
        f"{base}_RelativeRange": clip(col(span) / scale, 0, 10),
    }


def plain_cv(mean: str, std: str) -> Column:
    """std / |mean|, 0 where the mean is 0."""
    return safe_div(F.col(std), F.abs(F.col(mean)))


def abnormality(value: str | Column, ranges: Sequence[float]) -> dict[str, Column]:
    low, high, crit_low, crit_high = (float(x) for x in ranges)
    v = col(value)
    return {
        "IsLow": flag(v < low),
        "IsHigh": flag(v > high),
        "IsAbnormal": flag((v < low) | (v > high)),
        "IsCriticalLow": flag(v < crit_low),
        "IsCriticalHigh": flag(v > crit_high),
        "IsCritical": flag((v < crit_low) | (v > crit_high)),
        "DistFromNormal": F.when(v < low, F.lit(low) - v).when(v > high, v - F.lit(high)).otherwise(0.0),
        "DistFromMid": F.abs(v - F.lit((low + high) / 2)),
    }


def abnormality_features(columns: Mapping[str, str], table: Mapping[str, Sequence[float]] = fixed.RANGES) -> dict[str, Column]:
    """All range features of the listed variables (name -> column) and the two totals."""
    out: dict[str, Column] = {}
    for base, c in columns.items():
        out |= {f"{base}_{k}": e for k, e in abnormality(c, table[base]).items()}
    out["Total_Abnormal_Count"] = total([out[f"{b}_IsAbnormal"] for b in columns])
    out["Total_Critical_Count"] = total([out[f"{b}_IsCritical"] for b in columns])
    return out


def steps(value: str | Column, rules: Sequence[tuple[Column, int]]) -> Column:
    """Points of the first rule that holds, else 0."""
    out = None
    for cond, points in rules:
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(0)


def acuity_scores(c: Mapping[str, str]) -> dict[str, Column]:
    """Severity scores from the variables present in ``c`` (variable -> column name)."""
    g = {k: F.col(v) for k, v in c.items()}
    zero = F.lit(0)
    sirs, mews, coag, metabolic = [zero], [zero], [zero], [zero]
    out: dict[str, Column] = {}
    if "Temperature" in g:
        t = g["Temperature"]
        sirs.append(flag((t > 38) | (t < 36)))
        mews.append(steps(t, [(t < 35, 2), (t > 38.5, 2)]))
    if "HeartRate" in g:
        h = g["HeartRate"]
        sirs.append(flag(h > 90))
        mews.append(steps(h, [(h < 40, 2), (h < 50, 1), (h > 130, 2), (h > 110, 1)]))
    if "RespRate" in g:
        r = g["RespRate"]
        sirs.append(flag(r > 20))
        mews.append(steps(r, [(r < 9, 2), (r > 29, 3), (r > 20, 2), (r > 14, 1)]))
    if "WBC" in g:
        sirs.append(flag((g["WBC"] > 12) | (g["WBC"] < 4)))
    if "SysBP" in g:
        s = g["SysBP"]
        mews.append(steps(s, [(s < 70, 3), (s < 80, 2), (s < 100, 1), (s > 200, 2)]))
        if "HeartRate" in g:
            shock = ratio(g["HeartRate"], s)
            out |= {"Shock_Index": clip(shock, 0, 3), "Shock_Index_Elevated": flag(shock > 0.9), "Shock_Index_High": flag(shock > 1.0)}
    if "Creatinine" in g:
        k = g["Creatinine"]
        out |= {"AKI_Stage1": flag(k >= 1.5), "AKI_Stage2": flag(k >= 2.0), "AKI_Stage3": flag(k >= 3.0)}
        if "BUN" in g:
            b = ratio(g["BUN"], k)
            out |= {"BUN_Creat_Ratio": clip(b, 0, 100), "Prerenal_Indicator": flag(b > 20)}
    if "Platelet" in g:
        p = g["Platelet"]
        coag.append(steps(p, [(p < 50, 2), (p < 100, 1)]))
    if "INR" in g:
        i = g["INR"]
        coag.append(steps(i, [(i > 2.0, 2), (i > 1.5, 1)]))
    if "PTT" in g:
        p = g["PTT"]
        coag.append(steps(p, [(p > 60, 2), (p > 40, 1)]))
    if "Glucose" in g:
        v = g["Glucose"]
        metabolic.append(steps(v, [(v < 60, 2), (v > 300, 2), ((v < 70) | (v > 180), 1)]))
    if "Sodium" in g:
        v = g["Sodium"]
        metabolic.append(steps(v, [((v < 125) | (v > 155), 2), ((v < 130) | (v > 150), 1)]))
    if "Potassium" in g:
        v = g["Potassium"]
        metabolic.append(steps(v, [((v < 2.5) | (v > 6.5), 2), ((v < 3.0) | (v > 5.5), 1)]))
    scores = {"SIRS_Score": total(sirs), "MEWS_Score": total(mews), "Coagulation_Risk_Score": total(coag), "Metabolic_Score": total(metabolic)}
    return {
        **scores,
        **out,
        "SIRS_Positive": flag(scores["SIRS_Score"] >= 2),
        "MEWS_High": flag(scores["MEWS_Score"] >= 4),
        "Coag_Risk_High": flag(scores["Coagulation_Risk_Score"] >= 2),
        "Metabolic_High": flag(scores["Metabolic_Score"] >= 2),
        "Overall_Acuity": total(list(scores.values())),
    }


def ratio_features(c: Mapping[str, str]) -> dict[str, Column]:
    pairs = {
        "HR_SBP_Ratio": ("HeartRate", "SysBP"), "HR_RR_Ratio": ("HeartRate", "RespRate"), "WBC_Plt_Ratio": ("WBC", "Platelet"),
        "Gluc_K_Ratio": ("Glucose", "Potassium"), "Na_K_Ratio": ("Sodium", "Potassium"),
    }
    out = {n: ratio(c[a], c[b], 0, 100) for n, (a, b) in pairs.items() if a in c and b in c}
    if all(k in c for k in ("Sodium", "Chloride", "Bicarbonate")):
        out["Calc_Anion_Gap"] = F.col(c["Sodium"]) - F.col(c["Chloride"]) - F.col(c["Bicarbonate"])
    return out


def deterioration(means: Mapping[str, tuple[str, str]], table: Mapping[str, Sequence[float]] = fixed.RANGES) -> dict[str, Column]:
    """Variable -> (24 h mean, 48 h mean): is the recent mean further from the middle of the normal range?"""
    out: dict[str, Column] = {}
    for base, (m24, m48) in means.items():
        mid = F.lit((table[base][0] + table[base][1]) / 2.0)
        near, far = F.abs(F.col(m24) - mid), F.abs(F.col(m48) - mid)
        out[f"{base}_Deteriorating"] = flag(near > far * 1.1)
        out[f"{base}_RapidDeterioration"] = flag(near > far * 1.2)
    count = total([out[f"{b}_Deteriorating"] for b in means])
    return {**out, "Total_Deterioration_Count": count, "Multi_Organ_Deterioration": flag(count >= 3)}


def window_comparison(base: str, mean: tuple[str, str], std: tuple[str, str], count: tuple[str, str]) -> dict[str, Column]:
    var, freq = ratio(*std), ratio(*count)
    return {
        f"{base}_Recent_vs_Earlier": F.col(mean[0]) - F.col(mean[1]),
        f"{base}_Variability_Change": clip(var, 0, 10),
        f"{base}_Instability_Increasing": flag(var > 1.2),
        f"{base}_Monitoring_Intensity": clip(freq, 0, 10),
        f"{base}_Increased_Monitoring": flag(freq > 1.5),
    }


# Expert combinations (fixed values). A factor is (column, null default, comparison, threshold), or
# (column,) for a 0/1 flag with default 0. The value is the product of the factors.
EXPERT_RULES: dict[str, list[tuple]] = {
    "cardiorenal_syndrome": [("nlp_heart_failure",), ("Creatinine_Max", 1, ">", 1.5)],
    "hepatorenal_syndrome": [("nlp_liver_failure",), ("Creatinine_Max", 1, ">", 1.5)],
    "septic_shock": [("nlp_sepsis",), ("nlp_vasopressors",)],
    "ards_with_hypoxia": [("nlp_ards",), ("SpO2_Min", 95, "<", 90)],
    "elderly_sepsis": [("AGE", 60, ">=", 70), ("nlp_sepsis",)],
    "elderly_heart_failure": [("AGE", 60, ">=", 70), ("nlp_heart_failure",)],
    "very_elderly_resp_failure": [("AGE", 60, ">=", 80), ("nlp_respiratory_failure",)],
    "elderly_high_cci": [("AGE", 60, ">=", 70), ("CCI_Score", 0, ">=", 3)],
    "prolonged_icu_vent": [("LOS_ICU", 1, ">=", 5), ("Ventilation_Usage",)],
    "prolonged_icu_sepsis": [("LOS_ICU", 1, ">=", 5), ("nlp_sepsis",)],
    "prolonged_icu_aki": [("LOS_ICU", 1, ">=", 5), ("nlp_acute_kidney_injury",)],
    "resp_renal_failure": [("nlp_respiratory_failure",), ("nlp_acute_kidney_injury",)],
    "cardiac_renal_failure": [("nlp_heart_failure",), ("nlp_acute_kidney_injury",)],
    "coag_gi_bleed": [("nlp_coagulopathy",), ("nlp_gi_bleed",)],
    "tachycardia_hypotension": [("HeartRate_Max", 80, ">", 110), ("SBP_Min", 120, "<", 90)],
    "tachypnea_hypoxia": [("RespRate_Max", 16, ">", 24), ("SpO2_Min", 95, "<", 92)],
    "gcs_sepsis": [("GCS_Min", 15, "<", 14), ("nlp_sepsis",)],
    "severe_anemia_coag": [("HMG_Min", 12, "<", 8), ("nlp_coagulopathy",)],
    "thrombocytopenia_sepsis": [("Platelet_Min", 200, "<", 50), ("nlp_sepsis",)],
    "lactate_aki": [("Lactate_Max", 1, ">", 4), ("nlp_acute_kidney_injury",)],
    "prerenal_low_urine": [("BUN_Creat_Ratio", 15, ">", 20), ("UrineOutput_Median", 100, "<", 50)],
    "intubation_ards": [("nlp_intubation",), ("nlp_ards",)],
    "central_line_sepsis": [("nlp_central_line",), ("nlp_sepsis",)],
    "surgery_anemia": [("nlp_surgery",), ("HMG_Min", 12, "<", 10)],
}
# Sums of flags and the count from which they are high (fixed values).
EXPERT_SUMS = {
    ("high_acuity_composite", "very_high_acuity", 3): ["Ventilation_Usage", "nlp_vasopressors", "nlp_sepsis", "nlp_respiratory_failure"],
    ("chronic_disease_burden", "high_chronic_burden", 2): ["nlp_chronic_kidney_disease", "nlp_heart_failure", "nlp_copd", "nlp_liver_failure"],
}


def expert_interactions(columns: Sequence[str], rules: Mapping[str, list[tuple]] = EXPERT_RULES) -> dict[str, Column]:
    """Every rule whose input columns exist, and the composite counts."""
    compare = {
        ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
    }

    def factor(f: tuple) -> Column:
        if len(f) == 1:
            return F.coalesce(F.col(f[0]), F.lit(0)).cast("double")
        name, default, op, bound = f
        return flag(compare[op](F.coalesce(F.col(name).cast("double"), F.lit(float(default))), F.lit(float(bound)))).cast("double")

    def product(factors: list[tuple]) -> Column:
        out = factor(factors[0])
        for f in factors[1:]:
            out = out * factor(f)
        return out

    have = set(columns)
    out = {n: product(fs) for n, fs in rules.items() if all(f[0] in have for f in fs)}
    for (name, high, bound), parts in EXPERT_SUMS.items():
        known = [factor((p,)) for p in parts if p in have]
        if known:
            out[name] = total(known)
            out[high] = flag(out[name] >= bound)
    return out


def serving_scores(hr: str, rr: str, wbc: str, sbp: str, bun: str, creat: str) -> dict[str, Column]:
    """Reduced scores of the request path; missing inputs take its defaults."""
    h0, r, w = (F.coalesce(F.col(x), F.lit(0.0)) for x in (hr, rr, wbc))
    sirs = flag(h0 > 90) + flag(r > 20) + flag((w > 12) | (w < 4))
    h, s = F.coalesce(F.col(hr), F.lit(80.0)), F.coalesce(F.col(sbp), F.lit(120.0))
    b, k = F.coalesce(F.col(bun), F.lit(0.0)), F.coalesce(F.col(creat), F.lit(1.0))
    return {
        "SIRS_Score": sirs,
        "SIRS_Positive": flag(sirs >= 2),
        "Shock_Index": F.when(s > 0, F.try_divide(h, s)).otherwise(0.0),
        "BUN_Creatinine_Ratio": F.when(k > 0, F.try_divide(b, k)).otherwise(0.0),
    }


def ethnicity_group(c: str | Column) -> Column:
    up = F.upper(F.coalesce(col(c), F.lit("")))
    return (
        F.when(up.contains("WHITE"), "WHITE").when(up.contains("BLACK"), "BLACK").when(up.contains("ASIAN"), "ASIAN")
        .when(up.contains("HISPANIC") | up.contains("LATINO"), "HISPANIC").otherwise("OTHER")
    )


def is_antibiotic(drug: str | Column, names: Sequence[str] = fixed.ANTIBIOTICS) -> Column:
    return F.coalesce(col(drug).rlike("(?i)" + "|".join(names)), F.lit(False))


def risk_level(score: str | Column) -> Column:
    out = None
    for bound, name in fixed.RISK_LEVELS:
        out = F.when(col(score) < bound, name) if out is None else out.when(col(score) < bound, name)
    return out.otherwise("High")


def code_matches(code: str | Column, prefixes: Sequence[str], exact: Sequence[str]) -> Column:
    c = F.replace(col(code), F.lit("."), F.lit(""))
    hit = F.lit(False)
    # Prefixes of one length are one set lookup.
    for n in sorted({len(p) for p in prefixes}):
        hit = hit | F.substring(c, 1, n).isin([p for p in prefixes if len(p) == n])
    if exact:
        hit = hit | c.isin(list(exact))
    return hit


def comorbidity_score(
    codes: DataFrame, key: str, code: str, rules: Mapping[str, tuple[int, Sequence[str], Sequence[str]]],
    suppresses: Mapping[str, str] | None = None, name: str = "score",
) -> DataFrame:
    """Weighted number of rule groups among a key's codes; no code list is ever gathered.

    ``suppresses`` maps a severe group to the mild one that then no longer counts.
    """
    hits = codes.groupBy(key).agg(*[F.max(flag(code_matches(code, p, e))).alias(f"g_{g}") for g, (_, p, e) in rules.items()])
    mild_of = {mild: severe for severe, mild in (suppresses or {}).items()}

    def points(g: str) -> Column:
        present = F.col(f"g_{g}")
        if g in mild_of:
            present = present * (1 - F.col(f"g_{mild_of[g]}"))
        return present * rules[g][0]

    return hits.select(key, total([points(g) for g in rules]).alias(name))


def any_code_flags(codes: DataFrame, key: str, code: str, flags: Mapping[str, Sequence[str]]) -> DataFrame:
    return codes.groupBy(key).agg(*[F.max(flag(code_matches(code, p, []))).alias(n) for n, p in flags.items()])
