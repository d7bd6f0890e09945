"""Audit labelled text corpora and binary classifiers with Spark DataFrames."""

from corpaudit.roles import POSTING_ROLES, Roles
from corpaudit.session import build_session, checkpointed

__all__ = ["POSTING_ROLES", "Roles", "build_session", "checkpointed"]
