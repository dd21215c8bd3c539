"""A messy mix-design source derived (by Spark) from ``orders``: spreadsheet-style
headers and text cells, written as CSV to the shared scratch folder, then scanned back.

Exercises the cleaning traps: line breaks / double spaces / degree and slash characters
in headers, an unknown extra column whose unit ``kg/m³`` escapes the rename map, and cells
``N\\A``, ``''``, ``' 7 '``, ``1e3``, ``1,000``, ``1d``, ``nan`` plus all-empty rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.session import scratch_dir
from mortar.sources.tables import RAW_FEATURES, TARGET, mix

# Spreadsheet headers of the source, keyed by canonical column.
MESSY_HEADERS = {
    "row_id": "Row ID",
    "flyash": "Flyash (kg/m3)",
    "ggbfs": "GGBFS  (kg/m3)",
    "curing_temp_c": "Curing temperature (°C)",
    "curing_time_hr": "Curing time (hr)",
    "na2sio3": "Na2SiO3 (kg/m3)",
    "naoh": "NaOH\n(kg/m3)",
    "na2sio3_naoh_ratio": "Na2SiO3/NaOH",
    "naoh_molarity": "Molarity of NaOH",
    "activator_binder_ratio": "Alkaline activator/binder ratio",
    "water": "Water",
    "sp": " SP ",
    "nca": "NCA (kg/m3)",
    "rca": "RCA (kg/m3)",
    "sand": "Sand (kg/m3)",
    "r_sand": "R-Sand (kg/m3)",
    TARGET: "Compressive strength (MPa)",
    "density": "Density (kg/m³)",
}

# Junk cells injected by row_id rule (modulus, remainder, text).
JUNK = {
    "flyash": (73, 6, "nan"),
    "water": (101, 5, "N\\A"),
    "sp": (103, 7, ""),
    "nca": (97, 3, " 7 "),
    "rca": (89, 4, "1e3"),
    "sand": (83, 2, "1,000"),
    "r_sand": (79, 1, "1d"),
    TARGET: (71, 9, "N\\A"),
}
EMPTY_ROW = (997, 500)


def dirty_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy table as strings (all columns), before it is written."""
    m = mix(spark, sf_dir)
    rid = F.col("row_id")
    empty = (rid % EMPTY_ROW[0]) == EMPTY_ROW[1]
    cols = [rid.cast("string").alias(MESSY_HEADERS["row_id"])]
    for c in RAW_FEATURES + [TARGET]:
        v = F.col(c).cast("string")
        if c in JUNK:
            mod, rem, text = JUNK[c]
            v = F.when(rid % mod == rem, F.lit(text)).otherwise(v)
        cols.append(F.when(empty, F.lit(None).cast("string")).otherwise(v).alias(MESSY_HEADERS[c]))
    dens = (F.lit(2000) + rid % 400).cast("string")
    cols.append(F.when(empty, F.lit(None).cast("string")).otherwise(dens).alias(MESSY_HEADERS["density"]))
    return m.select(*cols)


def write_dirty_csv(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    path = path or scratch_dir(spark, "dirty-mix")
    (dirty_mix(spark, sf_dir).write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "\"\"").csv(path))
    return path


def read_dirty_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1 scan: every cell as text; quoted multi-line headers allowed."""
    return (spark.read.option("header", True).option("multiLine", True).option("inferSchema", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
