"""Which column plays which part in a labelled corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


@dataclass(frozen=True)
class Roles:
    key: str
    target: str
    text: tuple[str, ...]
    categorical: tuple[str, ...]
    binary: tuple[str, ...] = ()
    lengths: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def require_target(self, df: DataFrame) -> DataFrame:
        """Fail before any job runs when the target column is absent."""
        if self.target not in df.columns:
            raise ValueError(f"Missing target column: {self.target}")
        return df

    def present(self, df: DataFrame, names: tuple[str, ...]) -> list[str]:
        return [name for name in names if name in df.columns]

    def discover_numeric(self, df: DataFrame) -> list[str]:
        """Numeric model inputs: every numeric column that is not key, target, text or category."""
        taken = {self.key, self.target, *self.text, *self.categorical}
        return [
            field.name
            for field in df.schema.fields
            if field.name not in taken and isinstance(field.dataType, NUMERIC_TYPES)
        ]


# The column names of the posting schema.
POSTING_ROLES = Roles(
    key="job_id",
    target="fraudulent",
    text=("title", "company_profile", "description", "requirements", "benefits"),
    categorical=(
        "location", "department", "employment_type", "required_experience",
        "required_education", "industry", "function",
    ),
    binary=(
        "telecommuting", "has_company_logo", "has_questions", "has_salary_range",
        "has_benefits", "has_company_profile", "has_department",
    ),
    lengths=(
        "title_length", "description_length", "requirements_length",
        "company_profile_length", "benefits_length", "title_word_count",
        "description_word_count", "requirements_word_count",
        "company_profile_word_count", "benefits_word_count",
    ),
    optional=("salary_range",),
)


def posting_schema(roles: Roles = POSTING_ROLES) -> T.StructType:
    """Explicit schema of the raw posting table (18 columns), for readers without inference."""
    fields = [T.StructField(roles.key, T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in (*roles.text, *roles.categorical, *roles.optional)]
    fields += [T.StructField(c, T.IntegerType()) for c in roles.binary[:3]]
    fields.append(T.StructField(roles.target, T.IntegerType()))
    return T.StructType(fields)
