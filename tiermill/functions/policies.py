"""Column masks and the regional row filter.

Each policy takes the set of roles of the caller and is resolved while the
plan is built, so the executors see a literal, a plain column, or a hash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXEC, ADMIN, FINANCE = "EXEC_VP", "PLATFORM_ADMIN", "FINANCE_ANALYST"
ANALYST, ML_ENGINEER = "GLOBAL_ANALYST", "ML_ENGINEER"

# Region each regional reader may see.
READER_REGION = {
    "SAP_EUROPE_READER": "EUROPE",
    "JDE_AMERICAS_READER": "AMERICAS",
    "QAD_EMEA_READER": "EMEA",
}

# Masked columns per source, and the policy bound to each.
BINDINGS = {
    "SAP": {"phone": "pii", "email": "email", "credit_limit": "financial"},
    "JDE": {"phone": "pii", "credit_limit": "financial"},
    "QAD": {"phone": "pii"},
}


def _any(roles: Iterable[str], *wanted: str) -> bool:
    return bool(set(roles) & set(wanted))


def mask_pii(value: Column, roles: Iterable[str]) -> Column:
    roles = set(roles)
    if _any(roles, EXEC, ADMIN):
        return value
    if _any(roles, ML_ENGINEER):
        return F.sha2(value, 256)
    return F.lit("***-MASKED-***")


def mask_email(value: Column, roles: Iterable[str]) -> Column:
    if _any(roles, EXEC, ADMIN):
        return value
    domain = F.split_part(F.coalesce(value, F.lit("@unknown")), F.lit("@"), F.lit(2))
    return F.concat(F.lit("****@"), domain)


def mask_financial(value: Column, roles: Iterable[str]) -> Column:
    return value if _any(roles, EXEC, FINANCE, ADMIN) else F.lit(-1)


POLICIES = {"pii": mask_pii, "email": mask_email, "financial": mask_financial}


def mask_table(df: DataFrame, bindings: dict[str, str], roles: Iterable[str]) -> DataFrame:
    """Replace each bound column by its masked form, keeping the type."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {
            name: POLICIES[policy](F.col(name), roles).cast(kinds[name]).alias(name)
            for name, policy in bindings.items()
            if name in kinds
        }
    )


def mask_sources(df: DataFrame, bindings: dict[str, dict[str, str]], roles: Iterable[str], source: str = "source_system") -> DataFrame:
    """``mask_table`` for rows of several sources, each under its own bindings, in one pass."""
    kinds, masked = dict(df.dtypes), {}
    for name, bound in bindings.items():
        for column, policy in bound.items():
            if column in kinds:
                value = POLICIES[policy](F.col(column), roles).cast(kinds[column])
                masked[column] = F.when(F.col(source) == name, value).otherwise(masked.get(column, F.col(column)))
    return df.withColumns(masked)


def visible_regions(roles: Iterable[str]) -> list[str] | None:
    """Regions the roles may read; ``None`` means every region."""
    roles = set(roles)
    if _any(roles, ADMIN, ANALYST, EXEC):
        return None
    return sorted(region for role, region in READER_REGION.items() if role in roles)


def row_access(df: DataFrame, roles: Iterable[str], column: str = "source_region") -> DataFrame:
    """Keep the rows of the visible regions; no grant means no row."""
    regions = visible_regions(roles)
    if regions is None:
        return df
    return df.where(F.col(column).isin(regions)) if regions else df.where(F.lit(False))


def readable_by(readers: dict[str, Iterable[str]], column: str = "source_region") -> Column:
    """Names of the readers (each with its roles) that ``row_access`` lets see a row, as an array."""
    names = []
    for name, roles in readers.items():
        regions = visible_regions(roles)
        names.append(F.lit(name) if regions is None else F.when(F.col(column).isin(regions), F.lit(name)))
    return F.array_compact(F.array(*names))
