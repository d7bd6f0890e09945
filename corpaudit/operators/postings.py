"""Cleaning a posting table and deriving its engineered columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpaudit.functions.text import characters, combine, field_signature, or_default, presence, text_signature, word_count
from corpaudit.roles import POSTING_ROLES, Roles

PRESENCE_SOURCES = {
    "has_salary_range": "salary_range",
    "has_benefits": "benefits",
    "has_company_profile": "company_profile",
    "has_department": "department",
}


def with_presence(df: DataFrame) -> DataFrame:
    """0/1 flags from NULLs. A flag that exists is kept; one that cannot be derived is NULL."""
    flags = {}
    for flag, source in PRESENCE_SOURCES.items():
        if flag not in df.columns:
            flags[flag] = presence(F.col(source)) if source in df.columns else F.lit(None).cast("int")
    return df.withColumns(flags) if flags else df


def with_lengths(df: DataFrame, roles: Roles = POSTING_ROLES) -> DataFrame:
    """Characters and words of every text field."""
    fields = roles.present(df, roles.text)
    lengths = {f"{c}_length": characters(F.col(c)) for c in fields}
    return df.withColumns({**lengths, **{f"{c}_word_count": word_count(F.col(c)) for c in fields}})


def with_filled(df: DataFrame, roles: Roles = POSTING_ROLES, default: str = "") -> DataFrame:
    """NULL texts and categories replaced by the default."""
    names = roles.present(df, (*roles.text, *roles.categorical))
    return df.withColumns({c: or_default(F.col(c), default) for c in names})


def with_signatures(df: DataFrame, roles: Roles = POSTING_ROLES) -> DataFrame:
    """Field-wise and whole-text duplicate signatures."""
    fields = [F.col(c) for c in roles.present(df, roles.text)]
    return df.withColumns({"content_signature": field_signature(fields), "exact_signature": text_signature(fields)})


def prepared(df: DataFrame, roles: Roles = POSTING_ROLES) -> DataFrame:
    """A raw posting table with flags, lengths, filled texts, combined text and signatures."""
    roles.require_target(df)
    filled = with_filled(with_lengths(with_presence(df), roles), roles)
    combined = filled.withColumn("combined_text", combine([F.col(c) for c in roles.present(filled, roles.text)]))
    return with_signatures(combined, roles)
