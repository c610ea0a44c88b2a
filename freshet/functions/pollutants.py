"""The pollutant dictionary and the lookups that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.clock import SEASONS

# --- fixed values: unit constants ---
LITERS_PER_CUBICMETER = 1000.0
MICROGRAMS_PER_GRAM = 1_000_000.0
MILLIGRAMS_PER_GRAM = 1000.0
MILLIMETERS_PER_METER = 1000.0

# --- fixed values: pollutants of concern ---
# parameter, name in the facility data, name in the land-use data, units, group, headline
POLLUTANTS = (
    ("Aluminum (Al)", "Aluminum, Total", None, "ug/L", "A", False),
    ("Cadmium (Cd)", "Cadmium, Total", "Cadmium", "ug/L", "A", True),
    ("Copper (Cu)", "Copper, Total", "Copper", "ug/L", "A", True),
    ("Iron (Fe)", "Iron, Total", "Iron as Fe", "ug/L", "A", True),
    ("Lead (Pb)", "Lead, Total", "Lead", "ug/L", "A", True),
    ("Nickel (Ni)", "Nickel, Total", "Nickel", "ug/L", "A", True),
    ("Zinc (Zn)", "Zinc, Total", "Zinc", "ug/L", "A", True),
    ("Dissolved Chloride (Cl)", "Chloride, Dissolved", "Chloride", "mg/L", "B", False),
    ("Nitrate (N)", "Nitrogen, Nitrate (NO3) as N", "Nitrate as N", "mg/L", "B", True),
    ("Nitrate + Nitrite", "Nitrogen, Nitrite (NO2) + Nitrate (NO3) as N", "N02+NO3", "mg/L", "B", True),
    ("Total Kjeldahl Nitrogen (TKN)", "Kjeldahl nitrogen (TKN)", "Total Kjeldahl Nitrogen", "mg/L", "B", False),
    ("Orthophosphate (P)", "Phosphorus, orthophosphate as P", "Phosphate Ortho as P", "mg/L", "B", False),
    ("Total Phosphorus", "Phosphorus as P, Total", "Phosphorous as P", "mg/L", "B", True),
    ("Escherichia coli", "Escherichia coli", "E. Coli", "CFU/100 mL", "B", False),
    ("Total Oil & Grease", None, "Oil and Grease", "mg/L", "B", False),
    ("Total Suspended Solids", "Total suspended solids", "Total Suspended Solids", "mg/L", "A", True),
)

# --- fixed values: load units and the factor from concentration x m3 to load ---
LOADS_BY_UNITS = {
    "ug/L": ("g", LITERS_PER_CUBICMETER / MICROGRAMS_PER_GRAM),
    "mg/L": ("g", LITERS_PER_CUBICMETER / MILLIGRAMS_PER_GRAM),
    "CFU/100 mL": ("CFU", 10 * LITERS_PER_CUBICMETER),
}

# --- fixed values: spellings of one bacteria unit ---
BACTERIA_UNITS = "CFU/100 mL"
OWN_BACTERIA_SPELLINGS = ("CFU/100mL",)
EXTERNAL_BACTERIA_SPELLINGS = ("MPN/100 mL",)

_SCHEMA = (
    "parameter string, facility_name string, landuse_name string, "
    "conc_units string, load_units string, load_factor double, `group` string, headline boolean"
)
_FIELDS = [f.split()[0].strip("`") for f in _SCHEMA.split(", ")]


def _records() -> list[tuple]:
    return [
        (name, bmp, landuse, units, *LOADS_BY_UNITS[units], group, headline)
        for name, bmp, landuse, units, group, headline in POLLUTANTS
    ]


def pollutants(spark: SparkSession) -> DataFrame:
    """The dictionary as a DataFrame: sixteen rows, safe to broadcast."""
    return spark.createDataFrame(_records(), _SCHEMA)


def names(headline_only: bool = False) -> list[str]:
    return [p[0] for p in POLLUTANTS if p[5] or not headline_only]


def lookup(critcol: str, critval: object, valcol: str) -> object:
    """One attribute of the one pollutant whose ``critcol`` equals ``critval``."""
    hits = [r[_FIELDS.index(valcol)] for r in _records() if r[_FIELDS.index(critcol)] == critval]
    if len(hits) > 1:
        raise ValueError(f"{critcol}={critval!r} matches {len(hits)} pollutants")
    if not hits:
        raise LookupError(f"no pollutant with {critcol}={critval!r}")
    return hits[0]


def attribute(parameter: str, valcol: str, critcol: str = "parameter") -> Column:
    """Dictionary attribute as an expression; unknown parameters give null.

    The sixteen entries become literals of one CASE, so no join is planned.
    """
    crit, val = _FIELDS.index(critcol), _FIELDS.index(valcol)

    def literal(x: object) -> str:
        if x is None or isinstance(x, bool):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[x]
        return f"{x!r}D" if isinstance(x, float) else f"'{x}'"

    arms = [f"WHEN '{r[crit]}' THEN {literal(r[val])}" for r in _records() if r[crit] is not None]
    return F.expr(f"CASE {parameter} {' '.join(arms)} END")


def rename_external_parameter(df: DataFrame, critcol: str, paramcol: str = "parameter") -> DataFrame:
    """Map foreign parameter names to ours; unknown names become null."""
    return df.withColumn(paramcol, attribute(paramcol, "parameter", critcol))


def fix_units(df: DataFrame, spellings: tuple[str, ...], unitscol: str = "units") -> DataFrame:
    """Write every spelling of the bacteria unit the same way."""
    return df.withColumn(
        unitscol, F.when(F.col(unitscol).isin(*spellings), BACTERIA_UNITS).otherwise(F.col(unitscol))
    )


def keep_pollutants(df: DataFrame, paramcol: str = "parameter", headline_only: bool = False) -> DataFrame:
    """Rows of known pollutants; the name list is pushed to the scan."""
    return df.filter(F.col(paramcol).isin(*names(headline_only)))


def influent_template(spark: SparkSession) -> DataFrame:
    """Every pollutant in every season, with an empty influent median."""
    return pollutants(spark).select(
        "parameter",
        F.col("conc_units").alias("units"),
        F.explode(F.array(*[F.lit(s) for s in SEASONS])).alias("season"),
        F.lit(None).cast("double").alias("influent_median"),
    )
