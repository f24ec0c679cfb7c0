"""Registered queries and their SQL."""

from mnemoflow.plans.oracle import ORACLE
from mnemoflow.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
