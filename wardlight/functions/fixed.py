"""Item sets, code groups, word lists, patterns and thresholds.

Results depend on these being exactly what they are; nothing here is logic.
"""

from __future__ import annotations

PAO2_ITEMS = [50821, 490]
FIO2_ITEMS = [50816, 223835, 3420, 190]
VENTILATION_CODES = ["9670", "9671", "9672"]
ICU_UNITS = ["MICU", "SICU", "CCU", "CSRU", "TSICU"]
ANTIBIOTICS = [
    "Vancomycin", "Piperacillin", "Cefepime", "Meropenem", "Levofloxacin", "Ciprofloxacin",
    "Ceftriaxone", "Metronidazole", "Azithromycin", "Gentamicin", "Tobramycin", "Ampicillin",
    "Nafcillin", "Oxacillin",
]
LEAKING_COLUMNS = ["WARD_LOS_HRS", "MICRO_POS_48H", "MICRO_TOTAL_POS", "DISCHARGE_LOCATION", "TRANSFER_COUNT"]
LEAKING_PARTS = ["nlp_", "tfidf", "topic_"]
TEXT_SIGNATURES = [
    "tfidf_", "nlp_", "sentiment", "concern_", "reassurance_", "uncertainty_", "_positive", "_negated", "_any",
]

# --- comorbidity rules (fixed values): group -> (weight, prefixes, exact codes) ----------
# Exact codes are written undotted; the group that suppresses another is in *_SUPPRESSES.
CHARLSON = {
    "mi": (1, ["410"], ["412"]),
    "chf": (1, ["428"], []),
    "pvd": (1, ["441", "7854"], ["4439", "V434"]),
    "cva": (1, ["430", "431", "432", "433", "434", "435", "436", "437", "438"], []),
    "dementia": (1, ["290"], []),
    "copd": (1, [str(c) for c in range(490, 506)], ["5064"]),
    "connective": (1, ["725"], ["7100", "7101", "7104", "7140", "7141", "7142", "71481"]),
    "ulcer": (1, ["531", "532", "533", "534"], []),
    "liver_mild": (1, ["5714"], ["5712", "5715", "5716"]),
    "liver_severe": (3, ["5722", "5723", "5724", "5725", "5726", "5727", "5728", "4560", "4561", "4562"], []),
    "diabetes_plain": (1, ["2500", "2501", "2502", "2503", "2507"], []),
    "diabetes_organ": (2, ["2504", "2505", "2506"], []),
    "hemiplegia": (2, ["342"], ["3441"]),
    "ckd": (2, ["582", "585", "586", "5830", "5831", "5832", "5833", "5834", "5835", "5836", "V56"], ["V420", "V451"]),
    "tumor": (2, [str(c) for c in range(140, 196) if c != 173], []),
    "metastasis": (6, ["196", "197", "198", "199"], []),
    "leukemia": (2, ["204", "205", "206", "207", "208"], []),
    "lymphoma": (2, ["200", "201", "202", "203"], ["2386"]),
    "aids": (6, ["042", "043", "044"], []),
}
CHARLSON_SUPPRESSES = {"liver_severe": "liver_mild", "diabetes_organ": "diabetes_plain", "metastasis": "tumor"}

ELIXHAUSER = {
    "chf": (1, ["425", "428"], [
        "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493"]),
    "arrhythmia": (1, ["426", "427"], []),
    "valvular": (1, ["394", "395", "396", "397", "424", "746"], ["0932", "V422", "V433"]),
    "pulmonary_circulation": (1, ["415", "416", "417"], []),
    "peripheral_vascular": (1, ["440", "441", "442", "443"], ["4471", "5571", "5579", "V434"]),
    "hypertension": (1, ["401", "402", "403", "404", "405"], []),
    "paralysis": (1, ["342", "344"], []),
    "neurological": (1, [
        "330", "331", "332", "333", "334", "335", "336", "337", "340", "341", "345"],
        ["3481", "3483", "7803", "7843"]),
    "chronic_pulmonary": (1, [str(c) for c in range(490, 506)], ["5064"]),
    "diabetes": (1, [f"250{d}" for d in range(10)], []),
    "hypothyroidism": (1, ["243", "244"], []),
    "renal": (1, ["585", "586", "V56"], ["V420", "V451"]),
    "liver": (1, ["070", "570", "571", "572", "573"], ["V427"]),
    "ulcer": (1, ["531", "532", "533", "534"], []),
    "aids": (1, ["042", "043", "044"], []),
    "lymphoma": (1, ["200", "201", "202"], ["2030", "2386"]),
    "metastasis": (1, ["196", "197", "198", "199"], []),
    "tumor": (1, [str(c) for c in range(140, 196) if c != 173], []),
    "rheumatoid": (1, ["710", "714", "720", "725"], ["7010"]),
    "coagulopathy": (1, ["286"], ["2871", "2873", "2874", "2875"]),
    "obesity": (1, ["2780"], []),
    "weight_loss": (1, ["260", "261", "262", "263", "7832"], []),
    "fluid_electrolyte": (1, ["276"], []),
    "blood_loss_anemia": (1, [], ["2800"]),
    "deficiency_anemia": (1, ["280", "281"], []),
    "alcohol": (1, ["291", "303", "3050"], []),
    "drugs": (1, ["292", "304", "3052", "3053", "3054", "3055", "3056", "3057", "3058", "3059"], []),
    "psychoses": (1, ["295", "296", "297", "298", "2991"], []),
    "depression": (1, ["309", "311"], ["3004", "30112"]),
}
HYPERTENSION_PREFIXES = ["401", "402", "403", "404", "405"]
CARDIOVASCULAR_PREFIXES = ["410", "411", "412", "413", "414", "428"]

# --- normal and critical ranges (fixed values): low, high, critical low, critical high ---
RANGES = {
    "HeartRate": (60, 100, 40, 150),
    "SysBP": (90, 140, 70, 180),
    "DiasBP": (60, 90, 40, 110),
    "MeanBP": (65, 100, 50, 120),
    "RespRate": (12, 20, 8, 30),
    "SpO2": (95, 100, 90, 100),
    "Temperature": (36, 38, 35, 39),
    "WBC": (4, 11, 2, 20),
    "Platelet": (150, 400, 50, 500),
    "HMG": (12, 17, 7, 20),
    "Creatinine": (0.6, 1.2, 0.4, 4.0),
    "BUN": (7, 20, 5, 50),
    "Glucose": (70, 140, 50, 400),
    "Sodium": (135, 145, 125, 155),
    "Potassium": (3.5, 5.0, 2.5, 6.5),
    "Lactate": (0.5, 2.0, 0.3, 4.0),
    "PTT": (25, 35, 20, 60),
    "INR": (0.9, 1.1, 0.8, 2.0),
    "Bilirubin": (0.1, 1.2, 0.05, 5.0),
    "Anion_Gap": (8, 12, 6, 20),
}

# --- note patterns (fixed values) --------------------------------------------------------
CONCEPT_PATTERNS = {
    "nlp_sepsis": r"\bsepsis\b|\bseptic\b|\bsirs\b|\bbacteremia\b",
    "nlp_pneumonia": r"\bpneumonia\b|\bpna\b|\bcap\b|\bhap\b|\bvap\b",
    "nlp_cellulitis": r"\bcellulitis\b|\bskin infection\b|\berysipelas\b",
    "nlp_uti": r"\buti\b|\burinary tract infection\b|\bpyelonephritis\b",
    "nlp_fever": r"\bfever\b|\bfebrile\b|\btemperature\s*>\s*38\b",
    "nlp_heart_failure": r"\bheart failure\b|\bchf\b|\bhfref\b|\bhfpef\b|\bef\s*[<>]?\s*\d+%",
    "nlp_arrhythmia": r"\barrhythmia\b|\bafib\b|\batrial fibrillation\b|\bvt\b|\bvfib\b",
    "nlp_hypotension": r"\bhypotension\b|\bhypotensive\b|\bmap\s*<\s*65\b|\bsbp\s*<\s*90\b",
    "nlp_hypertension": r"\bhypertension\b|\bhtn\b|\bhypertensive\b",
    "nlp_cardiac_arrest": r"\bcardiac arrest\b|\bcode blue\b|\brosc\b|\bcpr\b",
    "nlp_myocardial_infarction": r"\bmyocardial infarction\b|\bmi\b|\bnstemi\b|\bstemi\b|\btroponin\b",
    "nlp_stroke": r"\bstroke\b|\bcva\b|\bcerebrovascular\b|\btia\b",
    "nlp_dvt_pe": r"\bdvt\b|\bpe\b|\bpulmonary embolism\b|\bdeep vein thrombosis\b",
    "nlp_respiratory_failure": r"\brespiratory failure\b|\bhypoxia\b|\bhypoxic\b|\bards\b",
    "nlp_ards": r"\bards\b|\bacute respiratory distress\b",
    "nlp_copd": r"\bcopd\b|\bchronic obstructive\b|\bemphysema\b",
    "nlp_pleural_effusion": r"\bpleural effusion\b|\bpneumothorax\b|\bchest tube\b",
    "nlp_intubation": r"\bintubat\w*\b|\bventilat\w*\b|\bett\b|\bextubat\w*\b",
    "nlp_chronic_kidney_disease": r"\bckd\b|\bchronic kidney\b|\besrd\b|\bdialysis\b",
    "nlp_acute_kidney_injury": r"\baki\b|\bacute kidney injury\b|\bacute renal\b|\bcreatinine\s*(rising|elevated)\b",
    "nlp_liver_failure": r"\bliver failure\b|\bhepatic failure\b|\bcirrhosis\b|\bhepatic encephalopathy\b",
    "nlp_thrombocytopenia": r"\bthrombocytopenia\b|\blow platelet\b|\bplt\s*<\s*100\b",
    "nlp_anemia": r"\banemia\b|\bhgb\s*<\s*[78]\b|\btransfusion\b|\bprbc\b",
    "nlp_coagulopathy": r"\bcoagulopathy\b|\bdic\b|\binr\s*>\s*[23]\b|\bbleeding\b",
    "nlp_gi_bleed": r"\bgi bleed\b|\bgastrointestinal bleed\b|\bhematemesis\b|\bmelena\b|\bhematochezia\b",
    "nlp_electrolyte_imbalance": r"\belectrolyte\b|\bhyponatremia\b|\bhyperkalemia\b|\bhypokalemia\b",
    "nlp_acidosis": r"\bacidosis\b|\bmetabolic acidosis\b|\bph\s*<\s*7\.3\b|\blactate\s*>\s*[24]\b",
    "nlp_diabetes": r"\bdiabetes\b|\bdm\b|\bhyperglycemia\b|\bdiabetic\b|\binsulin\b",
    "nlp_pancreatitis": r"\bpancreatitis\b|\blipase\b|\bamylase elevated\b",
    "nlp_altered_mental_status":
        r"\baltered mental\b|\bconfusion\b|\bdelirium\b|\bencephalopathy\b|\boriented\s*x\s*[012]\b",
    "nlp_seizure": r"\bseizure\b|\bepilepsy\b|\bconvulsion\b|\bstatus epilepticus\b",
    "nlp_surgery": r"\bsurgery\b|\bpost[- ]?op\b|\boperative\b|\bor\b|\bprocedure\b",
    "nlp_central_line": r"\bcentral line\b|\bpicc\b|\bcvc\b|\bcentral venous\b",
    "nlp_vasopressors": r"\bvasopressor\b|\bnorepinephrine\b|\blevophed\b|\bdopamine\b|\bphenylephrine\b",
    "nlp_unstable": r"\bunstable\b|\bdecompensating\b|\bdeteriorating\b|\bworsening\b",
    "nlp_edema": r"\bedema\b|\bswelling\b|\banasarca\b|\bfluid overload\b",
    "nlp_pressure_ulcer": r"\bpressure ulcer\b|\bdecubitus\b|\bbed sore\b|\bstage [1-4] ulcer\b",
    "nlp_falls": r"\bfall\b|\bfell\b|\bfound on floor\b",
    "nlp_pain": r"\bpain\b|\bdiscomfort\b|\bnrs\s*[7-9]|10\b",
    "nlp_code_status": r"\bcode status\b|\bdnr\b|\bdni\b|\bfull code\b|\bcomfort care\b",
    "nlp_icu_admission": r"\bicu\b|\bintensive care\b|\bccu\b|\bmicu\b|\bsicu\b",
}
RISK_PATTERNS = {
    "nlp_agitation": r"\bagitated\b|\bagitation\b|\bcombative\b|\brestraints\b",
    "nlp_intubation": r"\bintubated\b|\bintubation\b|\bventilat",
    "nlp_suicide": r"\bsuicide\b|\boverdose\b|\bself[- ]harm\b",
    "nlp_withdrawal": r"\bwithdrawal\b|\bciwa\b|\balcohol\b|\bdt\b",
    "nlp_sepsis": r"\bsepsis\b|\bseptic\b|\binfection\b|\bbacteremia\b",
    "nlp_hypotension": r"\bhypotension\b|\bhypotensive\b|\bshock\b|\bpressors\b",
    "nlp_respiratory_failure": r"\brespiratory failure\b|\bapnea\b|\bhypoxia\b|\bcpap\b|\bbipap\b",
    "nlp_altering_mental_status": r"\baltered mental status\b|\bconfusion\b|\bdisoriented\b|\bencephalopathy\b",
    "nlp_fall": r"\bfall\b|\bfell\b|\btrauma\b",
    "nlp_pain": r"\bpain\b|\bdiscomfort\b|\banalgesics\b",
    "nlp_kidney_injury": r"\baki\b|\brenal failure\b|\bdialysis\b|\bcrrt\b",
    "nlp_bleeding": r"\bbleeding\b|\bhemorrhage\b|\bgi bleed\b|\bhematemesis\b",
    "nlp_cardiac_event": r"\bcardiac arrest\b|\bmi\b|\bstemi\b|\bheart failure\b|\bchf\b",
    "nlp_pneumonia": r"\bpneumonia\b|\baspiration\b|\bconsolidation\b",
    "nlp_anemia": r"\banemia\b|\bhgb\b|\btransfusion\b",
}
CONCEPT_GROUPS = {
    "cardiac_arrest": ["cardiac arrest", "asystole", "pulseless", "code blue"],
    "heart_failure": ["heart failure", "chf", "congestive heart failure", "hfref", "hfpef", "cardiomyopathy"],
    "myocardial_infarction": [
        "myocardial infarction", "mi", "stemi", "nstemi", "heart attack", "troponin elevated"],
    "arrhythmia": [
        "arrhythmia", "atrial fibrillation", "afib", "a-fib", "ventricular tachycardia", "vtach", "bradycardia",
        "tachycardia"],
    "hypertension": ["hypertension", "htn", "high blood pressure", "hypertensive"],
    "hypotension": ["hypotension", "low blood pressure", "hypotensive", "shock"],
    "respiratory_failure": ["respiratory failure", "hypoxic", "hypoxia", "hypoxemic", "desaturation"],
    "pneumonia": ["pneumonia", "pna", "lung infection", "consolidation"],
    "ards": ["ards", "acute respiratory distress", "ali"],
    "copd": ["copd", "chronic obstructive", "emphysema"],
    "intubation": [
        "intubated", "intubation", "mechanical ventilation", "ventilator", "extubated", "extubation"],
    "pleural_effusion": ["pleural effusion", "effusion"],
    "altered_mental_status": [
        "altered mental status", "ams", "confusion", "confused", "delirium", "encephalopathy", "obtunded"],
    "stroke": ["stroke", "cva", "cerebrovascular", "tia", "ischemic stroke", "hemorrhagic stroke"],
    "seizure": ["seizure", "sz", "epilepsy", "convulsion"],
    "acute_kidney_injury": [
        "acute kidney injury", "aki", "acute renal failure", "arf", "creatinine elevated"],
    "chronic_kidney_disease": [
        "chronic kidney disease", "ckd", "esrd", "end stage renal", "dialysis", "hemodialysis"],
    "sepsis": ["sepsis", "septic", "sirs", "bacteremia", "septic shock"],
    "uti": ["urinary tract infection", "uti", "pyelonephritis"],
    "cellulitis": ["cellulitis", "skin infection"],
    "gi_bleed": [
        "gi bleed", "gastrointestinal bleed", "melena", "hematochezia", "hematemesis", "upper gi bleed",
        "lower gi bleed"],
    "liver_failure": ["liver failure", "hepatic failure", "cirrhosis", "hepatic encephalopathy"],
    "pancreatitis": ["pancreatitis", "lipase elevated"],
    "anemia": ["anemia", "low hemoglobin", "low hgb", "transfusion"],
    "coagulopathy": ["coagulopathy", "dic", "inr elevated", "bleeding"],
    "thrombocytopenia": ["thrombocytopenia", "low platelets", "plt low"],
    "diabetes": ["diabetes", "dm", "hyperglycemia", "dka", "diabetic ketoacidosis", "insulin"],
    "electrolyte_imbalance": [
        "hyponatremia", "hypernatremia", "hypokalemia", "hyperkalemia", "hypocalcemia", "hypercalcemia"],
    "acidosis": ["acidosis", "metabolic acidosis", "respiratory acidosis", "lactic acidosis"],
    "surgery": ["surgery", "surgical", "operation", "operative", "post-op", "postoperative"],
    "central_line": ["central line", "central venous catheter", "cvc", "picc", "port"],
    "vasopressors": [
        "vasopressor", "levophed", "norepinephrine", "dopamine", "vasopressin", "phenylephrine", "epinephrine"],
    "icu_admission": ["icu", "intensive care", "micu", "sicu", "ccu", "critical care"],
    "unstable": ["unstable", "deteriorating", "worsening", "decompensated"],
    "code_status": ["dnr", "dni", "comfort care", "cmo", "palliative", "hospice"],
    "falls": ["fall", "fell", "mechanical fall"],
    "pressure_ulcer": ["pressure ulcer", "decubitus", "bedsore", "pressure injury"],
    "dvt_pe": ["dvt", "deep vein thrombosis", "pe", "pulmonary embolism", "vte"],
    "pain": ["pain", "painful"],
    "fever": ["fever", "febrile", "temperature elevated"],
    "edema": ["edema", "swelling", "fluid overload", "volume overload"],
}
SENTENCE_NEGATIONS = [
    r"no\s+(?:evidence|signs?|symptoms?|history)\s+of",
    r"denies",
    r"negative\s+for",
    r"ruled\s+out",
    r"without",
    r"not\s+(?:have|show|demonstrate)",
    r"absence\s+of",
    r"free\s+of",
]
CONTEXT_TRIGGERS = {
    "negated": [
        r"\bno\b", r"\bnot\b", r"\bwithout\b", r"\bdenies\b", r"\bdenied\b", r"\bnegative\b", r"\bnever\b",
        r"\bfree of\b", r"\babsent\b", r"\bno evidence of\b", r"\brules out\b", r"\bruled out\b",
        r"\bno sign of\b", r"\bno signs of\b", r"\bno history of\b", r"\bno further\b", r"\bnot have\b",
        r"\bdoes not have\b", r"\bunlikely\b", r"\bwas ruled out\b", r"\bhas been ruled out\b"],
    "hypothetical": [
        r"\bif\b", r"\bshould\b", r"\bcould\b", r"\bmay\b", r"\bmight\b", r"\bpossible\b", r"\bsuspected\b",
        r"\brule out\b", r"\bevaluate for\b"],
    "historical": [
        r"\bhistory of\b", r"\bhistory\b", r"\bpast\b", r"\bprevious\b", r"\bprior\b", r"\bformer\b",
        r"\bin the past\b"],
    "family": [
        r"\bfamily history\b", r"\bfamily\b", r"\bmother\b", r"\bfather\b", r"\bsibling\b", r"\bbrother\b",
        r"\bsister\b", r"\bgrandmother\b", r"\bgrandfather\b"],
}
ABBREVIATIONS_SHORT = {
    "pt": "patient", "pts": "patients", "hx": "history", "dx": "diagnosis", "tx": "treatment",
    "rx": "prescription", "sx": "symptoms", "c/o": "complains of", "w/": "with", "w/o": "without",
    "s/p": "status post", "b/l": "bilateral", "h/o": "history of", "f/u": "follow up",
}
SECTION_HEADERS = [
    "admission date", "discharge date", "date of birth", "sex", "service", "chief complaint", "allergies",
    "attending", "dictated by", "completed by",
]
LINE_HEADERS = ["Name", "Unit No", "Admission Date", "Discharge Date", "Date of Birth", "Sex"]
STOPWORDS_EN = [
    "a", "an", "the", "and", "or", "not", "but", "if", "then", "else", "for", "in", "on", "at", "by", "of", "to",
    "with", "without", "as", "is", "are", "was", "were", "be", "been", "it", "this", "that", "these", "those",
    "there", "here", "from", "which", "we", "you", "he", "she", "they", "them", "his", "her", "their", "what",
    "who", "whom", "how", "why", "when", "where", "do", "did", "does", "have", "has", "had", "i", "me", "my",
    "mine", "our", "ours", "your", "yours",
]
STOPWORDS_VI = [
    "và", "là", "của", "với", "trong", "một", "những", "các", "cho", "để", "có", "không", "nhưng", "vẫn", "đã",
    "đang", "sẽ", "này", "đó", "tôi", "mình", "anh", "chị", "ông", "bà",
]
# Cut points of the risk level (fixed values).
RISK_LEVELS = [(0.3, "Low"), (0.5, "Moderate"), (0.7, "Elevated")]
