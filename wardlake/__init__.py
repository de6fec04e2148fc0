"""Cohort building, feature extraction and score evaluation for visit records on Spark."""

from .session import get_spark

__all__ = ["get_spark"]
