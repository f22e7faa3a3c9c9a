"""Validation of the star schema: four result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from viewtide.operators import quality as Q


def validate_semantic_model(processed: Mapping[str, DataFrame], raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Expectations, referential integrity, row-count reconciliation and their summary.

    Meant for stored tables. Over a model that is still a plan every check would rebuild its table.
    """
    expectations = Q.run_model_expectations(processed)
    integrity = Q.run_referential_integrity_checks(processed)
    reconciliation = Q.run_row_count_reconciliation(raw, processed)
    return {
        "gx_validation_results": expectations,
        "referential_integrity_checks": integrity,
        "row_count_reconciliation": reconciliation,
        "validation_summary": Q.build_validation_summary(expectations, integrity, reconciliation),
    }
