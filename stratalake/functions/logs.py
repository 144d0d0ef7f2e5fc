"""Patterns and small parsers of boring logs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of log lines and headers; capture group 1 unless said otherwise.
DEPTH = r"(\d{1,3}(?:\.\d+)?)\s*[-–to]{1,3}\s*(\d{1,3}(?:\.\d+)?)"
USCS = r"\b(GW-GM|GP-GM|SW-SM|SP-SM|SC-SM|GW|GP|GM|GC|SW|SP|SM|SC|ML|CL|OL|MH|CH|OH|PT)\b"
BLOWS = r"\b(\d{1,2})\s*[-/]\s*(\d{1,2})\s*[-/]\s*(\d{1,2})\b"
N_VALUE = r"(?i)\bN\s*[=:]\s*(\d{1,3})\b"
WATER = r"(?i)(?:groundwater|water\s+(?:table|level|encountered|at)|GWT)\D{0,15}(\d{1,3}(?:\.\d+)?)"
SAMPLE = r"(?i)\b(SS|ST|SPT|AU|CO|UD|GP|NQ|HQ|Shelby|Split[\s-]?spoon)\b"
ELEVATION = r"(?i)SURFACE\s+ELEVATION\s*[:.]?\s*(-?\d{1,4}(?:\.\d+)?)\s*(m|ft|meters|feet)?"
GROUND = r"(?i)GROUND\s+ELEVATION\s*[:.;]?\s*(-?\d{1,4}(?:[.,]\d+)?)"
NOUN = r"\b(GRAVEL|SAND|SILT|CLAY|PEAT|TOPSOIL|FILL)\b"
#: What an upper-case phrase that has a family holds.
SOIL = r"FILL|PEAT|ORGANIC|TOPSOIL|\b(?:GRAVEL|SAND|SILT|CLAY)\b"
TICK = r"^[~\-−]?\s*(\d{1,3})$"
SAMPLE_ID = r"^[A-Z]-?\d{1,2}$"
#: A whole word between separators that is a number, in whatever marks.
NUMBER = r"(?<![^|/\s])[.:\-]*(\d{1,3}(?:\.\d+)?)[.:\-]*(?![^|/\s])"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured text, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def soil_noun(up: Column) -> Column:
    """The soil that an upper-case phrase names first, or ''."""
    return F.regexp_extract(up, NOUN, 1)


def family_of(up: Column, noun: Column) -> Column:
    """Family of an upper-case phrase and its noun, or null.  Both are read many times over: let them be columns."""
    silty, clayey = up.contains("SILT"), up.contains("CLAY")

    def graded(letter: str) -> Column:
        return F.when(silty, letter + "M").when(clayey, letter + "C").otherwise(letter + "P")

    return (
        F.when(up.contains("FILL"), F.lit("FILL")).when(up.contains("PEAT") | up.contains("ORGANIC"), F.lit("PT")).when(up.contains("TOPSOIL"), F.lit("OL"))
        .when(noun == "SAND", graded("S")).when(noun == "GRAVEL", graded("G")).when(noun == "SILT", F.lit("ML"))
        .when(noun == "CLAY", F.when(up.contains("FAT") | up.contains("HIGH PLAST"), "CH").otherwise("CL"))
    )


def sureness(family: Column) -> Column:
    """How sure a family is, 0 if there is none."""
    return F.when(family == "FILL", 0.6).when(family.isin("PT", "OL"), 0.5).when(family.isNotNull(), 0.45).otherwise(0.0)


def soil_family(description: Column) -> Column:
    """struct(family, confidence) of a descriptive phrase; family null and confidence 0 if it names no soil."""
    up = F.upper(description)
    family = family_of(up, soil_noun(up))
    return F.struct(family.alias("family"), sureness(family).alias("confidence"))


def numbers_in(text: Column) -> Column:
    """array<double> of a box's numbers: comma is a decimal mark; | / and blanks separate; . : - are stripped; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ",", "."), F.lit(NUMBER), F.lit(1)).cast("array<double>")


def whole(values: Column) -> Column:
    """Blow increments as whole numbers; those of 100 and more do not count."""
    return F.transform(F.filter(values, lambda v: v < 100), lambda v: F.bround(v).cast("int"))


def spt_of_whole(ints: Column) -> Column:
    """N of whole increments: second and third, both of two, or the one."""
    n = F.size(ints)
    return F.when(n >= 3, F.get(ints, F.lit(1)) + F.get(ints, F.lit(2))).when(n == 2, F.get(ints, F.lit(0)) + F.get(ints, F.lit(1))).when(n == 1, F.get(ints, F.lit(0)))


def spt_from_increments(values: Column) -> Column:
    """N of blow increments (those of 100 and more do not count): second and third, both of two, or the one."""
    return spt_of_whole(whole(values))
