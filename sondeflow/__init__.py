"""Cleaning, profiling and analysis of wide sensor tables on Spark."""

from .schema import MEASURES, SEASONS, WEEKDAYS
from .session import configure, session

__all__ = ["MEASURES", "SEASONS", "WEEKDAYS", "configure", "session"]
