"""Fixed word lists. The values are part of the defined results."""

from __future__ import annotations

# Texts that a delimited reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Role codes from most to least suspect; other codes rank last.
ROLE_RANK = {"PS": 0, "SS": 1, "C": 2}
OTHER_ROLE_RANK = 99

# Trade name -> generic name.
BRAND_TO_GENERIC = {
    "OZEMPIC": "SEMAGLUTIDE",
    "RYBELSUS": "SEMAGLUTIDE",
    "WEGOVY": "SEMAGLUTIDE",
    "TRULICITY": "DULAGLUTIDE",
    "BYETTA": "EXENATIDE",
    "BYDUREON": "EXENATIDE",
    "MOUNJARO": "TIRZEPATIDE",
    "JARDIANCE": "EMPAGLIFLOZIN",
    "FARXIGA": "DAPAGLIFLOZIN",
    "INVOKANA": "CANAGLIFLOZIN",
    "STEGLATRO": "ERTUGLIFLOZIN",
    "JANUVIA": "SITAGLIPTIN",
    "ONGLYZA": "SAXAGLIPTIN",
    "TRADJENTA": "LINAGLIPTIN",
    "NESINA": "ALOGLIPTIN",
    "ACTOS": "PIOGLITAZONE",
    "AVANDIA": "ROSIGLITAZONE",
    "AMARYL": "GLIMEPIRIDE",
    "GLUCOPHAGE": "METFORMIN",
    "GLUCOTROL": "GLIPIZIDE",
    "DIABETA": "GLYBURIDE",
    "MICRONASE": "GLYBURIDE",
    "DAONIL": "GLIBENCLAMIDE",
    "DIAMICRON": "GLICLAZIDE",
}

# First token of a name -> compound name.
SYNONYMS = {
    "OZEMPIC": "Semaglutide",
    "RYBELSUS": "Semaglutide",
    "WEGOVY": "Semaglutide",
    "TRULICITY": "Dulaglutide",
    "BYDUREON": "Exenatide",
    "BYETTA": "Exenatide",
    "MOUNJARO": "Tirzepatide",
    "JARDIANCE": "Empagliflozin",
    "FORXIGA": "Dapagliflozin",
    "FARXIGA": "Dapagliflozin",
    "INVOKANA": "Canagliflozin",
    "JANUVIA": "Sitagliptin",
    "TRADJENTA": "Linagliptin",
    "ONGLYZA": "Saxagliptin",
    "GLUCOPHAGE": "Metformin",
    "ACTOS": "Pioglitazone",
}

# Terms that put a name into the cohort (substring match).
COHORT_GENERICS = (
    "METFORMIN",
    "INSULIN", "GLARGINE", "DEGLUDEC", "DETEMIR", "LISPRO", "ASPART",
    "GLULISINE", "REGULAR INSULIN", "NPH",
    "SEMAGLUTIDE", "LIRAGLUTIDE", "DULAGLUTIDE", "EXENATIDE", "ALBIGLUTIDE",
    "TIRZEPATIDE",
    "EMPAGLIFLOZIN", "DAPAGLIFLOZIN", "CANAGLIFLOZIN", "ERTUGLIFLOZIN",
    "SITAGLIPTIN", "SAXAGLIPTIN", "LINAGLIPTIN", "ALOGLIPTIN", "VILDAGLIPTIN",
    "PIOGLITAZONE", "ROSIGLITAZONE",
    "ACARBOSE", "MIGLITOL", "VOGLIBOSE",
    "NATEGLINIDE", "REPAGLINIDE", "MITIGLINIDE",
    "GLIPIZIDE", "GLIMEPIRIDE", "GLYBURIDE", "GLIBENCLAMIDE", "GLICLAZIDE",
    "PRAMLINTIDE", "COLESEVELAM", "BROMOCRIPTINE",
)
COHORT_BRANDS = (
    "OZEMPIC", "RYBELSUS", "WEGOVY", "TRULICITY", "VICTOZA", "BYDUREON",
    "BYETTA", "MOUNJARO",
    "JARDIANCE", "FARXIGA", "INVOKANA", "STEGLATRO",
    "JANUVIA", "ONGLYZA", "TRADJENTA", "NESINA",
    "ACTOS", "AVANDIA",
    "AMARYL", "GLUCOPHAGE", "GLUCOTROL", "DIABETA", "MICRONASE", "DAONIL",
    "DIAMICRON",
)
COHORT_TERMS = COHORT_GENERICS + COHORT_BRANDS

# Route patterns, unanchored and applied to the upper-cased text.
ORAL_ROUTE = "ORAL|PO|BY MOUTH"
SUBCUTANEOUS_ROUTE = "SUBCUTANEOUS|SC|SUBCUT"

# Age bins, right-closed edges and their labels.
CONTEXT_AGE_BINS = ((-1, 39, 64, 200), ("age_<40", "age_40_64", "age_65p"))
CASE_AGE_BINS = ((-1, 18, 40, 65, 120), ("<18", "18-40", "40-65", "65+"))

# Numeric properties of a compound.
PROPERTIES = ("mol_weight", "logP", "TPSA", "HBD", "HBA")
