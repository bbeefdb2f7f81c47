"""Whole jobs built from the operators."""

from .dashboard import dashboard_frames
from .ingest import ingest, manifest
from .materialize import materialize
from .reports import REPORTS, run_report
from .sql_reports import SQL_REPORTS

__all__ = ["REPORTS", "SQL_REPORTS", "dashboard_frames", "ingest", "manifest", "materialize", "run_report"]
