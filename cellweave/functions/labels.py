"""Labels of molecules: sentinels, kinds of entity, and label-building expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand for "no entity".
UNASSIGNED = ("-1", "UNASSIGNED", "DROP", "nan")


def is_unassigned(label: Column) -> Column:
    return label.isNull() | label.isin(*UNASSIGNED)


def entity_kind(label: Column) -> Column:
    """cell, partial, component, drop or unknown, from the label's text alone."""
    return F.when(label.isNull(), "unknown").when(label == "DROP", "drop").when(label.startswith("UNASSIGNED_"), "component").when(label.contains("-"), "partial").otherwise("cell")


def report_kind(label: Column) -> Column:
    """entity_kind for reports: sentinels are dropped before the text rules."""
    kind = F.when(label.isNull(), "unknown").when(label.isin("DROP", "UNASSIGNED", "-1"), "drop").when(label.startswith("UNASSIGNED_"), "pseudocell")
    return kind.when(label.contains("-"), "partial_cell").otherwise("whole_cell")


def is_whole_cell(label: Column) -> Column:
    return F.coalesce(report_kind(label) == "whole_cell", F.lit(False))


def is_partial_or_pseudocell(label: Column) -> Column:
    return F.coalesce(report_kind(label).isin("partial_cell", "pseudocell"), F.lit(False))


def clean_label(label: Column) -> Column:
    """Trimmed, without a trailing ``.0`` that a float id leaves."""
    return F.regexp_replace(F.trim(label.cast("string")), r"\.0$", "")
