"""Raw tables to safety signals, and the model tables on the way."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import Dimension, check_size
from casesignal.functions import scalars
from casesignal.functions.vocab import ROLE_RANK, SYNONYMS
from casesignal.operators import cohort, labels, names, relate, signals


@dataclass(frozen=True)
class ModelTables:
    """x: merged rows with properties; y: distinct (case, outcome); merged."""

    x: DataFrame
    y: DataFrame
    merged: DataFrame


def mapped_exposures(
    drug: DataFrame,
    dim: DataFrame | Dimension,
    name: str = "DRUGNAME",
    role: str = "ROLE_COD",
    dim_name: str = "drug_name",
    ordinal: str | None = None,
    synonyms: Mapping[str, str] = SYNONYMS,
    out: str = "drug_mapped",
) -> DataFrame:
    """Suspect and concomitant rows that resolve, with the resolved name.

    The role filter runs before the resolution, so it reaches the scan.
    """
    return names.resolve_names(
        cohort.keep_roles(drug, role), name, dim, dim_name, ordinal, synonyms, out,
        keep_unmatched=False,
    )


def model_tables(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    dim: DataFrame | Dimension,
    case_id: str = "PRIMARYID",
    name: str = "DRUGNAME",
    role: str = "ROLE_COD",
    outcome: str = "PT",
    dim_name: str = "drug_name",
    ordinal: str | None = None,
    synonyms: Mapping[str, str] = SYNONYMS,
    demo_columns: tuple[str, ...] = ("AGE", "AGE_COD", "SEX"),
    report_date: str = "FDA_DT",
) -> ModelTables:
    """Case x exposure x outcome rows with demographics and properties."""
    dim = check_size(dim)
    mapped = mapped_exposures(drug, dim, name, role, dim_name, ordinal, synonyms)
    pairs = relate.pair_with_outcomes(mapped, reac, case_id, "drug_mapped", outcome)
    date = scalars.parse_date(F.col(report_date))
    dated = demo.select(
        case_id,
        *demo_columns,
        scalars.year_of(date).alias("YEAR"),
        scalars.quarter_of(date).alias("QTR"),
    )
    merged = relate.attach(pairs, dated, case_id)
    x = relate.attach_dimension(merged, dim, "drug_mapped", dim_name)
    # The outcomes of the mapped cases are those of the merged rows; no need to
    # pair them with the exposures first.
    y = relate.restrict_to(labels.long_labels(reac, case_id, outcome), mapped, case_id)
    return ModelTables(x, y, merged)


def aligned_features(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    dim: DataFrame | Dimension,
    case_id: str = "PRIMARYID",
    name: str = "DRUGNAME",
    role: str = "ROLE_COD",
    outcome: str = "PT",
    dim_name: str = "drug_name",
    ordinal: str | None = None,
    synonyms: Mapping[str, str] = SYNONYMS,
    demo_columns: tuple[str, ...] = ("AGE", "AGE_COD", "SEX"),
    report_date: str = "FDA_DT",
) -> DataFrame:
    """One feature row per labelled case: its picked exposure with
    demographics and properties.

    The rows that :func:`labels.align_xy` takes out of X, made without pairing
    exposures and outcomes. A case counts if its picked exposure has one of the
    roles of the model and the case has an outcome.
    """
    dim = check_size(dim)
    resolved = names.resolve_names(
        drug, name, dim, dim_name, ordinal, synonyms, keep_unmatched=False
    )
    in_model = F.max(F.col(role).isin(list(ROLE_RANK)).cast("int")) == 1
    per_name = resolved.groupBy(case_id, "drug_mapped").agg(
        F.min(cohort.role_rank(F.col(role))).alias("__rank"), in_model.alias("__in_model")
    )
    best = F.min(F.struct("__rank", "drug_mapped", "__in_model")).alias("__best")
    picked = (
        per_name.where(F.col(case_id).isNotNull())
        .groupBy(case_id)
        .agg(best)
        .where("__best.__in_model")
        .select(case_id, "__best.drug_mapped")
    )
    labelled = relate.restrict_to(picked, labels.long_labels(reac, case_id, outcome), case_id)
    date = scalars.parse_date(F.col(report_date))
    dated = demo.select(
        case_id,
        *demo_columns,
        scalars.year_of(date).alias("YEAR"),
        scalars.quarter_of(date).alias("QTR"),
    )
    joined = relate.attach(labelled, dated, case_id)
    return relate.attach_dimension(joined, dim, "drug_mapped", dim_name)


def safety_signals(
    drug: DataFrame,
    reac: DataFrame,
    dim: DataFrame | Dimension,
    case_id: str = "PRIMARYID",
    name: str = "DRUGNAME",
    role: str = "ROLE_COD",
    outcome: str = "PT",
    dim_name: str = "drug_name",
    ordinal: str | None = None,
    synonyms: Mapping[str, str] = SYNONYMS,
) -> DataFrame:
    """PRR and ROR of every resolved exposure and outcome seen together."""
    mapped = mapped_exposures(drug, dim, name, role, dim_name, ordinal, synonyms)
    counts = signals.contingency_from_sides(mapped, reac, case_id, "drug_mapped", outcome)
    return signals.prr_ror(counts)
