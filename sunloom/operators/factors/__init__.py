"""Factors: named groups of feature columns, as column expressions."""

from sunloom.operators.factors.registry import (
    FactorError,
    add_factors,
    column_name,
    executable_ids,
    needs_irradiance_history,
    resolve,
    selection_manifest,
)

__all__ = ["FactorError", "add_factors", "column_name", "executable_ids", "needs_irradiance_history", "resolve", "selection_manifest"]
