"""Fixed values shared by the transforms."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# Conversion rates to USD, one row per currency.
FX_TO_USD = {
    "USD": Decimal("1.000000"),
    "EUR": Decimal("1.080000"),
    "GBP": Decimal("1.270000"),
    "CHF": Decimal("1.100000"),
    "CAD": Decimal("0.740000"),
    "AUD": Decimal("0.650000"),
    "JPY": Decimal("0.006700"),
    "CNY": Decimal("0.140000"),
    "INR": Decimal("0.012000"),
    "SGD": Decimal("0.740000"),
    "BRL": Decimal("0.200000"),
    "MXN": Decimal("0.059000"),
    "AED": Decimal("0.272000"),
    "SAR": Decimal("0.267000"),
    "ZAR": Decimal("0.054000"),
}

CURRENCY_NAMES = {
    "USD": "US Dollar",
    "EUR": "Euro",
    "GBP": "British Pound",
    "CHF": "Swiss Franc",
    "CAD": "Canadian Dollar",
    "AUD": "Australian Dollar",
    "JPY": "Japanese Yen",
    "CNY": "Chinese Yuan",
    "INR": "Indian Rupee",
    "SGD": "Singapore Dollar",
    "BRL": "Brazilian Real",
    "MXN": "Mexican Peso",
    "AED": "UAE Dirham",
    "SAR": "Saudi Riyal",
    "ZAR": "South African Rand",
}

# Currencies an order may carry, and those a European order may carry.
VALID_CURRENCIES = [
    "USD", "EUR", "GBP", "CHF", "CAD", "AUD", "JPY", "CNY", "INR",
    "SGD", "BRL", "MXN", "AED", "SAR", "ZAR", "SEK", "DKK",
]
EUROPE_CURRENCIES = ["EUR", "GBP", "CHF", "SEK", "DKK"]

# Region of each source system.
SOURCE_REGION = {"SAP": "EUROPE", "JDE": "AMERICAS", "QAD": "EMEA", "SALESFORCE": "GLOBAL"}

# Country rows (code, name, region, sub region, in GDPR scope, source).
COUNTRIES = [
    ("DEU", "Germany", "EUROPE", "DACH", True, "SAP"),
    ("GBR", "United Kingdom", "EUROPE", "UK and Ireland", True, "SAP"),
    ("FRA", "France", "EUROPE", "Western Europe", True, "SAP"),
    ("NLD", "Netherlands", "EUROPE", "Benelux", True, "SAP"),
    ("SWE", "Sweden", "EUROPE", "Nordics", True, "SAP"),
    ("ITA", "Italy", "EUROPE", "Southern Europe", True, "SAP"),
    ("ESP", "Spain", "EUROPE", "Southern Europe", True, "SAP"),
    ("CHE", "Switzerland", "EUROPE", "DACH", False, "SAP"),
    ("USA", "United States", "AMERICAS", "North America", False, "JDE"),
    ("CAN", "Canada", "AMERICAS", "North America", False, "JDE"),
    ("BRA", "Brazil", "AMERICAS", "Latin America", False, "JDE"),
    ("MEX", "Mexico", "AMERICAS", "Latin America", False, "JDE"),
    ("ARE", "UAE", "EMEA", "Gulf", False, "QAD"),
    ("SAU", "Saudi Arabia", "EMEA", "Gulf", False, "QAD"),
    ("ZAF", "South Africa", "EMEA", "Africa", False, "QAD"),
    ("IND", "India", "APAC", "South Asia", False, "QAD"),
    ("SGP", "Singapore", "APAC", "Southeast Asia", False, "QAD"),
]

# Region rows (hash text, region, sub region, country code, country, source).
REGION_ROWS = [
    ("EUROPE|DACH", "Europe", "DACH", "DEU", "Germany", "SAP"),
    ("EUROPE|UK", "Europe", "UK & Ireland", "GBR", "United Kingdom", "SAP"),
    ("EUROPE|BENELUX", "Europe", "Benelux", "NLD", "Netherlands", "SAP"),
    ("EUROPE|NORDICS", "Europe", "Nordics", "SWE", "Sweden", "SAP"),
    ("EUROPE|SOUTH", "Europe", "Southern EU", "ESP", "Spain", "SAP"),
    ("AMERICAS|US", "Americas", "United States", "USA", "United States", "JDE"),
    ("AMERICAS|CA", "Americas", "Canada", "CAN", "Canada", "JDE"),
    ("AMERICAS|LATAM", "Americas", "Latin America", "BRA", "Brazil", "JDE"),
    ("EMEA|GULF", "EMEA", "Gulf", "ARE", "UAE", "QAD"),
    ("EMEA|AFRICA", "EMEA", "Africa", "ZAF", "South Africa", "QAD"),
]

# Recoding that fits codes into ten characters.
INDUSTRY_CODES = {
    "DATA_CENTER": "DATACENTER",
    "HEALTHCARE": "HEALTHCR",
    "GOVERNMENT": "GOVT",
    "MANUFACTURING": "MANUFACT",
    "EDUCATION": "EDUCATN",
    "COLOCATION": "COLOC",
}
ORDER_TYPE_CODES = {
    "SPARE_PARTS": "SPARE",
    "RUSH_ORDER": "RUSH",
    "SERVICE_ORDER": "SERVICE",
}

# Text that a delimited file uses for a missing field.
NULL_TOKENS = ["NULL", "null", "", "N/A"]

OPEN_END = datetime(9999, 12, 31, 23, 59, 59)
DIM_DATE_START = date(2015, 1, 1)
DIM_DATE_DAYS = 5479
DATE_FLOOR = date(2010, 1, 1)
DIMENSIONS = ["COMPLETENESS", "UNIQUENESS", "VALIDITY", "ACCURACY", "CONSISTENCY", "TIMELINESS"]


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as an inline VALUES relation (no Python worker, known size)."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, (int, float, Decimal)):
            return str(value)
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    fields = [part.strip().split(" ", 1) for part in schema.split(";")]
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def currency_table(spark: SparkSession) -> DataFrame:
    """Fifteen currency rows; small by construction, so safe to broadcast."""
    return inline_table(
        spark,
        [(code, CURRENCY_NAMES[code], rate, True) for code, rate in FX_TO_USD.items()],
        "currency_code string; currency_name string; fx_to_usd decimal(10,6); is_active boolean",
    )


def country_table(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        COUNTRIES,
        "country_code string; country_name string; region string; sub_region string; "
        "is_eu_gdpr boolean; erp_system string",
    )
