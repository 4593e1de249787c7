"""Typed robot messages: codes to names, time stamps, flattening."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Integer codes of the messages' enumerations.
ENUMS = {
    "status_mic": {0: "DISABLED", 1: "READY", 2: "ACTIVE", 3: "UNKNOWN"},
    "status_speaker": {0: "DISABLED", 1: "READY", 2: "ACTIVE", 3: "UNKNOWN"},
    "status_camera": {0: "DISABLED", 1: "ENABLED"},
    "code_control": {0: "DISABLED", 1: "AI", 2: "JOYSTICK", 3: "TELEOPS"},
    "code_attitude": {0: "SITTING", 1: "STANDING"},
    "code_state": {0: "STILL", 1: "MOVING"},
    "hazard_type": {0: "BACKUP_LIMIT", 1: "BUMP", 2: "CLIFF", 3: "STALL", 4: "WHEEL_DROP", 5: "OBJECT_PROXIMITY"},
    "gps_status": {-1: "NO_FIX", 0: "FIX", 1: "SBAS_FIX", 2: "GBAS_FIX"},
    "gps_service": {1: "GPS", 2: "GLONASS", 4: "COMPASS", 8: "GALILEO"},
    "covariance_type": {0: "UNKNOWN", 1: "APPROXIMATED", 2: "DIAGONAL_KNOWN", 3: "KNOWN"},
    "point_datatype": {1: "INT8", 2: "UINT8", 3: "INT16", 4: "UINT16", 5: "INT32", 6: "UINT32", 7: "FLOAT32", 8: "FLOAT64"},
}


def decode_enum(code: Column, enum: str) -> Column:
    """The code's name, null for an unknown one."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ENUMS[enum].items())
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def decode_enums(df: DataFrame) -> DataFrame:
    """``<column>_name`` beside every column that is named like an enumeration."""
    return df.withColumns({f"{c}_name": decode_enum(F.col(c), c) for c in df.columns if c in ENUMS})


def normalise_header(df: DataFrame, header: str = "header") -> DataFrame:
    """``ts`` from the header's stamp, to the microsecond; the stamp itself stays."""
    stamp = F.col(header)["stamp"]
    return df.withColumn("ts", F.timestamp_micros(stamp["sec"].cast("long") * 1_000_000 + F.floor(stamp["nanosec"] / 1000)))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN, which means unmeasured, as null; in all float columns if none are named."""
    names = columns or tuple(c for c, t in df.dtypes if t in ("float", "double"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def explode_scan(scans: DataFrame) -> DataFrame:
    """One row per laser reading within range: its index, angle and distance."""
    rows = scans.select("*", F.posexplode("ranges").alias("i", "distance"))
    good = F.col("distance").between(F.col("range_min"), F.col("range_max")) & ~F.isnan("distance")
    return rows.where(good).withColumn("angle", F.col("angle_min") + F.col("i") * F.col("angle_increment")).drop("ranges")


def explode_hazards(vectors: DataFrame) -> DataFrame:
    """One row per hazard of a vector; an empty vector gives none."""
    return vectors.select("*", F.explode("detections").alias("hazard_")).select("*", "hazard_.*").drop("detections", "hazard_")
