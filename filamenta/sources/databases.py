"""Refinement databases (.db), read a file a row; a task opens each in memory."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the database and their STAR names.
COLUMNS = {
    "PSI": "rlnAnglePsi", "THETA": "rlnAngleTilt", "PHI": "rlnAngleRot", "XSHIFT": "rlnOriginX", "YSHIFT": "rlnOriginY",
    "DEFOCUS1": "rlnDefocusU", "DEFOCUS2": "rlnDefocusV", "DEFOCUS_ANGLE": "rlnDefocusAngle", "PHASE_SHIFT": "rlnPhaseShift", "LOGP": "rlnLogLikeliContribution",
    "X_POSITION": "rlnCoordinateX", "Y_POSITION": "rlnCoordinateY", "PIXEL_SIZE": "rlnImagePixelSize",
    "SPHERICAL_ABERRATION": "rlnSphericalAberration", "MICROSCOPE_VOLTAGE": "rlnVoltage", "AMPLITUDE_CONTRAST": "rlnAmplitudeContrast",
}


def read_refinement(spark: SparkSession, path: str, refinement: int = -1) -> DataFrame:
    """Particles of a refinement by its id, or counted back from the last (-1): rid, rlnImageName, rlnMicrographName and the STAR columns that the database has.

    Results go before the values that the particles were picked with. Positions and
    shifts become pixels, shifts with the other sign; phase shifts become degrees.
    """
    places = [*COLUMNS, "FILENAME"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                chosen = refinement if refinement >= 0 else db.execute("SELECT max(REFINEMENT_ID) FROM REFINEMENT_LIST").fetchone()[0] + 1 + refinement
                package = db.execute("SELECT REFINEMENT_PACKAGE_ASSET_ID FROM REFINEMENT_LIST WHERE REFINEMENT_ID = ?", (chosen,)).fetchone()[0]
                stack = db.execute("SELECT STACK_FILENAME FROM REFINEMENT_PACKAGE_ASSETS WHERE REFINEMENT_PACKAGE_ASSET_ID = ?", (package,)).fetchone()[0]
                picked = pd.read_sql_query(f"SELECT * FROM REFINEMENT_PACKAGE_CONTAINED_PARTICLES_{package}", db).set_index("POSITION_IN_STACK")
                if "PARENT_IMAGE_ASSET_ID" in picked:
                    names = dict(db.execute("SELECT IMAGE_ASSET_ID, FILENAME FROM IMAGE_ASSETS").fetchall())
                    picked["FILENAME"] = picked["PARENT_IMAGE_ASSET_ID"].map(names)
                result = pd.read_sql_query(f"SELECT * FROM REFINEMENT_RESULT_{chosen}_1", db).set_index("POSITION_IN_STACK")
                table = result.join(picked[[c for c in picked if c not in result]], how="outer").sort_index()
                out = pd.DataFrame({"rid": table.index, "rlnImageName": [f"{int(k):06d}@{stack}" for k in table.index]}, index=table.index)
                for c in places:
                    out[c] = table[c] if c in table else None
                yield out

    kinds = ", ".join(f"{c} {'string' if c == 'FILENAME' else 'double'}" for c in places)
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"rid long, rlnImageName string, {kinds}")
    size = F.col("PIXEL_SIZE")
    made = {"X_POSITION": F.round(F.col("X_POSITION") / size, 3), "Y_POSITION": F.round(F.col("Y_POSITION") / size, 3), "XSHIFT": -F.round(F.col("XSHIFT") / size, 3), "YSHIFT": -F.round(F.col("YSHIFT") / size, 3), "PHASE_SHIFT": F.round(F.degrees("PHASE_SHIFT"), 1)}
    return raw.select("rid", "rlnImageName", F.col("FILENAME").alias("rlnMicrographName"), *[made.get(c, F.col(c)).alias(name) for c, name in COLUMNS.items()])
