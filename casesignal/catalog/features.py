"""Case-level feature tables, drug-level metrics and labels."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.operators import labels
from casesignal.plans import casefeatures, drugmetrics

_ROLES = ("UNK", "PS", "SS", "C", "I")
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _first(c: str, expr: str) -> str:
    return f"arg_min({expr}, VERSION) FILTER (WHERE {expr} IS NOT NULL) AS {c}"


_BIN = """CASE WHEN AGE_YR > -1 AND AGE_YR <= 39 THEN 'age_<40' WHEN AGE_YR > 39 AND AGE_YR <= 64 THEN 'age_40_64'
    WHEN AGE_YR > 64 AND AGE_YR <= 200 THEN 'age_65p' END"""

_CONTEXT = {
    "p": f"""SELECT PRIMARYID, avg(AGE_YR) AS AGE_YR, max(coalesce(SERIOUS, 0)) AS serious,
        {_first('age_bin', _BIN)}, {_first('age_missing', 'CAST(AGE_YR IS NULL AS INT)')},
        {_first('sex', "coalesce(SEX, 'UNK')")}, {_first('reporter', "coalesce(I_F_COD, 'UNK')")},
        {_first('country', "coalesce(COUNTRY, 'UNK')")}, {_first('EVENT_DT', 'EVENT_DT')},
        {_first('REPT_DT', 'REPT_DT')} FROM demo_versions GROUP BY 1""",
    "e": "SELECT PRIMARYID, count(DISTINCT DRUGNAME) AS n_drugs, count(DISTINCT coalesce(ROUTE, 'UNK')) AS n_routes, "
    + ", ".join(
        f"count(DISTINCT CASE WHEN coalesce(ROLE_COD, 'UNK') = '{r}' THEN DRUGNAME END) AS role_{r.lower()}"
        for r in _ROLES
    )
    + " FROM drug GROUP BY 1",
    "o": "SELECT PRIMARYID, count(DISTINCT PT) AS num_adr_reported FROM reac GROUP BY 1",
}


@query(
    "context_features",
    a.with_ctes(
        "demo_versions drug reac",
        f"""SELECT coalesce(p.PRIMARYID, e.PRIMARYID) AS PRIMARYID, round(AGE_YR, 6) AS AGE_YR,
        CAST(serious AS BIGINT) AS serious, coalesce(age_bin, 'UNK') AS age_bin,
        CAST(age_missing AS BIGINT) AS age_missing, coalesce(sex, 'UNK') AS sex,
        coalesce(reporter, 'UNK') AS reporter, coalesce(country, 'UNK') AS country, EVENT_DT, REPT_DT,
        coalesce(n_drugs, 0) AS num_drugs_per_report, {', '.join(f'role_{r.lower()}' for r in _ROLES)},
        coalesce(n_routes, 0) AS num_route_types, CAST(coalesce(n_drugs, 0) >= 3 AS BIGINT) AS polypharmacy_ge3,
        num_adr_reported
        FROM p FULL JOIN e ON p.PRIMARYID = e.PRIMARYID
        LEFT JOIN o ON o.PRIMARYID = coalesce(p.PRIMARYID, e.PRIMARYID)""",
        **_CONTEXT,
    ),
)
def context_features(spark, sf):
    return casefeatures.context_features(
        a.demo_versions(spark, sf), a.drug(spark, sf), a.reac(spark, sf),
        order=("VERSION",), roles=_ROLES,
    )


_STD_NAME = a.sql_std("drug_name")
_KEYED_DIM = f"""SELECT {_STD_NAME} AS NAME_STD, mol_weight, logP, TPSA, HBD, HBA,
    CASE WHEN mechanism_tags = '' THEN [] ELSE string_split(mechanism_tags, ';') END AS tags FROM dim"""


def _stats_sql(stats: dict[str, str]) -> str:
    made = {"mean": "avg({0})", "max": "CAST(max({0}) AS DOUBLE)", "min": "CAST(min({0}) AS DOUBLE)",
            "sum": "CAST(coalesce(sum({0}), 0) AS DOUBLE)", "std": "stddev_samp({0})"}
    return ", ".join(
        f"round({made[s].format(p)}, 6) AS {p}_{s}" for p, kinds in stats.items() for s in kinds.split()
    )



_V1 = {"mol_weight": "mean max sum", "logP": "mean max min", "TPSA": "mean max sum", "HBD": "mean max sum", "HBA": "mean max sum"}
_V2 = {p: k + " std" for p, k in _V1.items()}
_TAG_SQL = ", ".join(
    f"CASE WHEN sum(len(tags)) > 0 THEN CAST(sum(len(list_filter(tags, lambda t: t = '{t}'))) AS BIGINT) END AS \"{t}\""
    for t in _TYPES
)


# max and min of whole-number properties are compared as fractions.
_INT_EXTREMES = ("HBD_max", "HBA_max")


def _as_fractions(df):
    return df.withColumns({c: F.col(c).cast("double") for c in _INT_EXTREMES})


_V1_CTES = {
    "kd": _KEYED_DIM,
    "coh": "SELECT g.*, kd.* FROM generic g JOIN kd ON g.GENERIC_STD = kd.NAME_STD",
    "f": f"""SELECT PRIMARYID, count(GENERIC_STD) AS n_diab_records, count(DISTINCT GENERIC_STD) AS n_diab_unique,
        CAST(count(DISTINCT GENERIC_STD) >= 2 AS BIGINT) AS is_multi_drug, {_stats_sql(_V1)}, {_TAG_SQL}
        FROM coh GROUP BY 1""",
    "adr": "SELECT PRIMARYID, count(*) AS n FROM reac GROUP BY 1",
}


@query(
    "case_features_v1",
    a.with_ctes(
        "generic dim reac demo",
        """SELECT f.*, coalesce(adr.n, 0) AS ADR_count, CAST(coalesce(adr.n, 0) >= 2 AS BIGINT) AS y_multiADR,
        AGE AS age, SEX AS sex FROM f LEFT JOIN adr USING (PRIMARYID) LEFT JOIN demo USING (PRIMARYID)""",
        **_V1_CTES,
    ),
)
def case_features_v1(spark, sf):
    return _as_fractions(v1(spark, sf))


def v1(spark, sf):
    return casefeatures.features_v1(
        a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf), a.demo(spark, sf), brands=a.BRANDS,
        tag_values=_TYPES,
    )


_V2_CTES = {
    "kd": _KEYED_DIM,
    "coh": "SELECT g.*, kd.* FROM generic g JOIN kd ON g.GENERIC_STD = kd.NAME_STD",
    "al": """SELECT PRIMARYID, count(DRUG_STD) AS n_total_records, count(DISTINCT DRUG_STD) AS n_total_unique,
        CAST(sum(CASE WHEN upper(ROLE_COD) = 'PS' THEN 1 ELSE 0 END) AS BIGINT) AS n_ps_records,
        round(avg(CAST(regexp_matches(coalesce(upper(ROUTE), ''), 'ORAL|PO|BY MOUTH') AS INT)), 6) AS is_oral,
        round(avg(CAST(regexp_matches(coalesce(upper(ROUTE), ''), 'SUBCUTANEOUS|SC|SUBCUT') AS INT)), 6) AS is_sc
        FROM generic GROUP BY 1""",
    "f": f"""SELECT PRIMARYID, count(GENERIC_STD) AS n_diab_records, count(DISTINCT GENERIC_STD) AS n_diab_unique,
        CAST(count(DISTINCT GENERIC_STD) >= 2 AS BIGINT) AS is_multi_diab, {_stats_sql(_V2)},
        round(max(logP) - min(logP), 6) AS logP_range, round(max(TPSA) - avg(TPSA), 6) AS TPSA_range,
        round(max(HBD) - avg(HBD), 6) AS HBD_range, round(max(HBA) - avg(HBA), 6) AS HBA_range,
        round(max(mol_weight) - avg(mol_weight), 6) AS mol_weight_range, {_TAG_SQL}
        FROM coh GROUP BY 1""",
    "adr": "SELECT PRIMARYID, count(*) AS n FROM reac GROUP BY 1",
}
_V2_BODY = """SELECT al.* {all_but}, f.* EXCLUDE (PRIMARYID, n_diab_records, n_diab_unique, is_multi_diab),
    coalesce(n_diab_records, 0) AS n_diab_records, coalesce(f.n_diab_unique, 0) AS n_diab_unique,
    coalesce(is_multi_diab, 0) AS is_multi_diab,
    coalesce(adr.n, 0) AS ADR_count, CAST(coalesce(adr.n, 0) >= 2 AS BIGINT) AS y_multiADR,
    round(f.n_diab_unique / nullif(n_total_unique, 0), 6) AS ratio_diab_total_unique,
    round({ps} / nullif(n_total_records, 0), 6) AS ps_ratio,
    round(ln(1 + n_total_unique), 6) AS ln_total_unique, round(ln(1 + f.n_diab_unique), 6) AS ln_diab_unique
    {extra}
    FROM al LEFT JOIN f USING (PRIMARYID) LEFT JOIN adr USING (PRIMARYID) LEFT JOIN demo USING (PRIMARYID)"""
_AGE_BIN = """CASE WHEN AGE > -1 AND AGE <= 18 THEN '<18' WHEN AGE > 18 AND AGE <= 40 THEN '18-40'
    WHEN AGE > 40 AND AGE <= 65 THEN '40-65' WHEN AGE > 65 AND AGE <= 120 THEN '65+' END"""


@query(
    "case_features_v2",
    a.with_ctes(
        "generic dim reac demo",
        _V2_BODY.format(all_but="", ps="n_ps_records", extra=f", AGE AS age, SEX AS sex, {_AGE_BIN} AS age_bin"),
        **_V2_CTES,
    ),
)
def case_features_v2(spark, sf):
    return _as_fractions(v2(spark, sf))


def v2(spark, sf):
    return casefeatures.features_v2(
        a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf), a.demo(spark, sf), brands=a.BRANDS,
        tag_values=_TYPES,
    )


@query(
    "case_features_v2_minimal",
    a.with_ctes(
        "generic dim reac demo",
        _V2_BODY.format(
            all_but="""REPLACE (0::BIGINT AS n_ps_records, CAST(NULL AS DOUBLE) AS is_oral,
            CAST(NULL AS DOUBLE) AS is_sc)""",
            ps="0",
            extra="",
        ),
        **_V2_CTES,
    ),
)
def case_features_v2_minimal(spark, sf):
    """Without demographics, role and route columns."""
    out = casefeatures.features_v2(
        a.drug(spark, sf).drop("ROLE_COD", "ROUTE"), a.reac(spark, sf), a.dim(spark, sf),
        role=None, route=None, brands=a.BRANDS, tag_values=_TYPES,
    )
    return _as_fractions(out)


# --- drug-level metrics ----------------------------------------------------

_TERMS = "|".join(a.TERMS)
_METRICS = {
    "hits": f"""SELECT * FROM named WHERE regexp_matches(coalesce(DRUG_STD, ''), '{_TERMS}') AND ROLE_COD = 'PS'""",
    "adr": "SELECT PRIMARYID, count(*) AS n FROM reac GROUP BY 1",
    "m": """SELECT DRUG_STD, count(DISTINCT h.PRIMARYID) AS n_reports, CAST(coalesce(sum(adr.n), 0) AS BIGINT) AS total_adr
        FROM hits h LEFT JOIN adr USING (PRIMARYID) GROUP BY 1""",
    "dv": """SELECT DRUG_STD, count(DISTINCT PT) AS unique_PT_count FROM hits LEFT JOIN reac USING (PRIMARYID) GROUP BY 1""",
    "metrics": f"""SELECT m.DRUG_STD AS DRUGNAME_STD, n_reports, total_adr,
        CASE WHEN n_reports > 0 THEN total_adr / n_reports END AS mean_ADR_per_case, unique_PT_count,
        ordinal, drug_name, mol_weight, logP, TPSA, HBD, HBA, ATC, mechanism_tags
        FROM m JOIN dv USING (DRUG_STD) LEFT JOIN dim ON {_STD_NAME} = m.DRUG_STD""",
    "mapped_m": """SELECT m.*, DRUGNAME_STD AS NAME_STD, coalesce(generic, DRUGNAME_STD) AS NAME_STD_MAP,
        coalesce(generic, DRUGNAME_STD) IN (SELECT """
    + _STD_NAME
    + """ FROM dim) AS known FROM metrics m LEFT JOIN brands ON brand = DRUGNAME_STD""",
}
_METRIC_COLUMNS = """DRUGNAME_STD, n_reports, total_adr, round(mean_ADR_per_case, 6) AS mean_ADR_per_case, unique_PT_count,
    CAST(ordinal AS BIGINT) AS ordinal, drug_name, round(mol_weight, 6) AS mol_weight, round(logP, 6) AS logP,
    round(TPSA, 6) AS TPSA, CAST(HBD AS BIGINT) AS HBD, CAST(HBA AS BIGINT) AS HBA, ATC, mechanism_tags"""


def metrics(spark, sf):
    return drugmetrics.drug_metrics(
        a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf), terms=a.TERMS
    )


def _metrics_sql(body: str) -> str:
    return a.with_ctes("named reac dim brands", body, **_METRICS)


@query("drug_metrics", _metrics_sql(f"SELECT {_METRIC_COLUMNS} FROM metrics"))
def drug_metrics(spark, sf):
    return drugmetrics.by_reports(metrics(spark, sf))


@query(
    "split_matched",
    _metrics_sql(f"SELECT {_METRIC_COLUMNS}, NAME_STD, NAME_STD_MAP, NAME_STD_MAP AS GENERIC_STD FROM mapped_m WHERE known"),
)
def split_matched(spark, sf):
    return drugmetrics.split_matched(metrics(spark, sf), a.dim(spark, sf), mapping=a.BRANDS)[0]


@query(
    "split_unmatched",
    _metrics_sql("SELECT DISTINCT DRUGNAME_STD, NAME_STD FROM mapped_m WHERE NOT known"),
)
def split_unmatched(spark, sf):
    return drugmetrics.split_matched(metrics(spark, sf), a.dim(spark, sf), mapping=a.BRANDS)[1]


def _first_prop(p: str) -> str:
    value = f"CAST({p} AS DOUBLE)" if p in ("HBD", "HBA") else p
    cast = "CAST({} AS BIGINT)" if p in ("HBD", "HBA") else "round({}, 6)"
    return cast.format(f"arg_min({value}, DRUGNAME_STD) FILTER (WHERE {p} IS NOT NULL)") + f" AS {p}"


@query(
    "rollup_generic",
    _metrics_sql(
        f"""SELECT *, round(CASE WHEN n_reports > 0 THEN total_adr / n_reports END, 6) AS mean_ADR_per_case FROM
        (SELECT NAME_STD_MAP AS GENERIC_STD, CAST(sum(n_reports) AS BIGINT) AS n_reports,
        CAST(sum(total_adr) AS BIGINT) AS total_adr, round(avg(unique_PT_count), 6) AS unique_PT_count,
        {', '.join(_first_prop(p) for p in ('mol_weight', 'logP', 'TPSA', 'HBD', 'HBA'))}
        FROM mapped_m WHERE known GROUP BY 1)"""
    ),
)
def rollup_generic(spark, sf):
    clean, _ = drugmetrics.split_matched(metrics(spark, sf), a.dim(spark, sf), mapping=a.BRANDS)
    return drugmetrics.rollup_generic(clean)


# --- labels ----------------------------------------------------------------


@query(
    "outcome_label",
    a.with_ctes(
        "demo reac",
        """SELECT PRIMARYID, coalesce(n, 0) AS ADR_count, CAST(coalesce(n, 0) >= 2 AS BIGINT) AS y_multiADR
        FROM demo LEFT JOIN (SELECT PRIMARYID, count(*) AS n FROM reac GROUP BY 1) USING (PRIMARYID)""",
    ),
)
def outcome_label(spark, sf):
    """Outcome count per case, 0 without outcomes, and the label count >= 2."""
    counts = labels.outcome_counts(a.reac(spark, sf), "PRIMARYID")
    return labels.with_multi_label(a.demo(spark, sf).select("PRIMARYID"), counts, "PRIMARYID")


@query(
    "multi_vs_single",
    a.with_ctes(
        "reac",
        """SELECT PRIMARYID, count(DISTINCT PT) AS n_labels, CAST(count(DISTINCT PT) >= 2 AS BIGINT) AS y
        FROM reac WHERE PT IN (SELECT PT FROM (SELECT PT, count(DISTINCT PRIMARYID) AS n FROM reac
            WHERE PT IS NOT NULL GROUP BY 1 ORDER BY n DESC, PT LIMIT 6)) GROUP BY 1""",
    ),
)
def multi_vs_single(spark, sf):
    return labels.multi_vs_single(a.reac(spark, sf), "PRIMARYID", "PT", 6)


@query(
    "class_balance",
    a.with_ctes(
        "scored",
        "SELECT CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, round(avg(y), 6) AS pos_share FROM scored",
    ),
)
def class_balance(spark, sf):
    return labels.class_balance(a.scored(spark, sf), "y")
