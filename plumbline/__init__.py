"""Data-quality profiling, auditing and cleaning of Spark tables."""

from plumbline.operators.classify import classify_columns
from plumbline.operators.clean import clean
from plumbline.operators.profile import column_details, describe
from plumbline.plans.audit import AuditResult, audit, score_report
from plumbline.plans.compare import before_after
from plumbline.plans.scores import quick_score
from plumbline.sources.staging import drop_staged_tables, staged
from plumbline.sources.tables import export_csv, read_csv, read_table, write_csv, write_report

__all__ = [
    "AuditResult", "audit", "before_after", "classify_columns", "clean", "column_details", "describe",
    "drop_staged_tables", "export_csv", "quick_score", "read_csv", "read_table", "score_report", "staged", "write_csv", "write_report",
]
