"""Names of laboratory tests as written: a panel, a single test, or not known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from claimloom.functions.fuzzy import sorted_ratio
from claimloom.functions.text import let

# Panels with their components, what a laboratory derives rather than bills, and how panels and tests are written.
PANELS = {
    "Liver Function Test": ("Bilirubin Total", "Bilirubin Direct", "SGOT", "SGPT", "Alkaline Phosphatase", "Total Protein", "Albumin"),
    "Kidney Function Test": ("Urea", "Creatinine", "Uric Acid", "Sodium", "Potassium", "Chloride"),
    "Complete Blood Count": ("Haemoglobin", "Total WBC Count", "RBC Count", "Platelet Count", "Packed Cell Volume", "Differential Count"),
    "Lipid Profile": ("Total Cholesterol", "Triglycerides", "HDL Cholesterol", "LDL Cholesterol", "VLDL Cholesterol"),
    "Thyroid Profile": ("T3", "T4", "TSH"),
    "Urine Routine and Microscopy": ("Urine Colour", "Urine pH", "Urine Protein", "Urine Sugar", "Urine Pus Cells", "Urine Epithelial Cells"),
    "HbA1c": ("HbA1c",),
    "Vitamin D": ("Vitamin D",),
    "Vitamin B12": ("Vitamin B12",),
    "Cortisol": ("Cortisol",),
    "Glucose Fasting and Post Prandial": ("Glucose Fasting", "Glucose Post Prandial"),
}
DERIVED = ("VLDL Cholesterol",)
PANEL_NAMES = {
    "Liver Function Test": ("lft", "liver function test", "liver function tests", "liver profile"),
    "Kidney Function Test": ("kft", "rft", "renal function test", "kidney function test"),
    "Complete Blood Count": ("cbc", "complete blood count", "haemogram", "hemogram", "cbc with esr"),
    "Lipid Profile": ("lipid profile", "lipid panel", "fasting lipid profile"),
    "Thyroid Profile": ("thyroid profile", "tft", "thyroid function test"),
    "Urine Routine and Microscopy": ("urine r/m", "urine rm", "urine routine", "urine routine and microscopy", "urine r/e"),
    "HbA1c": ("hba1c", "glycosylated haemoglobin", "glycated hemoglobin"),
    "Glucose Fasting and Post Prandial": (
        "plasma glucose f / pp", "plasma glucose f pp", "glucose f / pp", "glucose f pp", "glucose fasting f and post prandial pp", "blood sugar f / pp", "bsl f pp",
    ),
}
TEST_NAMES = {
    "SGPT": ("sgpt", "alt", "sgpt (alt)", "alanine aminotransferase"),
    "SGOT": ("sgot", "ast", "sgot (ast)", "aspartate aminotransferase"),
    "Alkaline Phosphatase": ("alkaline phosphatase", "alp"),
    "Bilirubin Total": ("bilirubin total", "total bilirubin", "bilirubin (total)"),
    "Bilirubin Direct": ("bilirubin direct", "direct bilirubin"),
    "Total Protein": ("total protein",),
    "Albumin": ("albumin",),
    "Urea": ("urea", "blood urea", "bun"),
    "Creatinine": ("creatinine", "serum creatinine"),
    "Uric Acid": ("uric acid",),
    "Sodium": ("sodium", "na"),
    "Potassium": ("potassium", "k"),
    "Chloride": ("chloride",),
    "Haemoglobin": ("haemoglobin", "hemoglobin", "hb"),
    "Total WBC Count": ("total wbc count", "wbc count", "tlc", "total leucocyte count"),
    "RBC Count": ("rbc count",),
    "Platelet Count": ("platelet count", "platelets"),
    "Packed Cell Volume": ("packed cell volume", "pcv", "haematocrit"),
    "Differential Count": ("differential count", "dlc", "differential leucocyte count"),
    "Total Cholesterol": ("total cholesterol", "cholesterol"),
    "Triglycerides": ("triglycerides", "tg"),
    "HDL Cholesterol": ("hdl", "hdl cholesterol"),
    "LDL Cholesterol": ("ldl", "ldl cholesterol"),
    "VLDL Cholesterol": ("vldl", "vldl cholesterol"),
    "T3": ("t3", "total t3"),
    "T4": ("t4", "total t4"),
    "TSH": ("tsh",),
    "HbA1c": ("hba1c",),
    "Urine Colour": ("urine colour", "urine color"),
    "Urine pH": ("urine ph",),
    "Urine Protein": ("urine protein", "urine albumin"),
    "Urine Sugar": ("urine sugar",),
    "Urine Pus Cells": ("urine pus cells", "pus cells"),
    "Urine Epithelial Cells": ("urine epithelial cells", "epithelial cells"),
    "Vitamin D": (
        "vitamin d", "vit d", "vitamin d3", "vit d3", "25 oh vitamin d", "25-oh vitamin d", "25 hydroxy vitamin d", "vitamin d (25-oh)", "vitamin d 25 oh", "25 oh vit d",
    ),
    "Vitamin B12": ("vitamin b12 cyanocobalamin", "vitamin b12", "cyanocobalamin", "b12"),
    "Cortisol": ("cortisol morning serum", "cortisol serum", "cortisol"),
    "Glucose Fasting": ("glucose fasting", "fasting glucose", "plasma glucose fasting", "fbs", "plasma glucose f", "blood sugar f"),
    "Glucose Post Prandial": ("glucose pp", "plasma glucose pp", "blood sugar pp", "glucose post prandial", "post prandial glucose", "ppbs"),
}
#: Words before a name, and when a test is to be done, written after it.
LEADS = ("test for ", "test:", "investigation:", "inv:", "adv:")
TIMING = (
    r"(?i)\s*\b(?:after\s+(?:a|an|\d+)\s+(?:day|days|week|weeks|month|months|year|years)|after\s+(?:breakfast|lunch|dinner|food|meals?)|in\s+(?:a|an|\d+)\s+(?:day|days|week|weeks|month|months)"
    r"|(?:x|for)\s+\d+\s+(?:day|days|week|weeks|month|months)|repeat(?:\s+(?:after|in)\s+\S+)?|on\s+review|if\s+required|s\s*o\s*s|prn|stat|urgent|asap|today|tomorrow|next\s+(?:visit|week|month)|follow\s*up|f\s*/\s*u)\b\s*$"
)
ASIDE, SEPARATOR = r"\([^)]*\)|\[[^\]]*\]", "\\s*[\u2014\u2013\u2012\u2212:|]\\s*|\\s+-\\s+"
MATCH = 86.0

PANEL_OF = {written: panel for panel, names in PANEL_NAMES.items() for written in names}
TEST_OF = {written: test for test, names in TEST_NAMES.items() for written in names}
MATCHED = StructType([StructField(x, StringType()) for x in ("kind", "name", "method")])


def normalise(raw: Column) -> Column:
    """The key that a written name is looked up by."""
    text = F.lower(F.trim(raw))
    for lead in LEADS:
        text = F.replace(text, F.lit(lead), F.lit(" "))
    text = F.replace(F.regexp_replace(text, r"[()\[\]{}.,;:*#<>]", " "), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@pandas_udf(MATCHED)
def _likest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The panel, or else the test, whose written form is most like a key, if like enough; callers pass distinct keys."""
    for keys in batches:
        found = []
        for key in keys:
            best = None
            for kind, names in (("panel", PANEL_OF), ("test", TEST_OF)):
                score, written = max(((sorted_ratio(key, w), w) for w in names), key=lambda x: x[0]) if key else (0.0, "")
                if best is None and score >= MATCH:
                    best = (kind, names[written], "fuzzy")
            found.append(best or (None, None, None))
        yield pd.DataFrame(found, columns=["kind", "name", "method"])


def lookup(key: Column, *, fuzzy: bool) -> Column:
    """struct(kind, name, method) of a key; null if it is none."""
    maps = [F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) for names in (PANEL_OF, TEST_OF)]
    told = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit("exact").alias("method"))
    panel, test = (F.try_element_at(m, key) for m in maps)
    exact = F.when(panel.isNotNull(), told("panel", panel)).when(test.isNotNull(), told("test", test))
    if not fuzzy:
        return exact
    like = _likest(F.when(exact.isNull(), key).otherwise(F.lit("")))
    return F.coalesce(exact, F.when(like["kind"].isNotNull(), like))


def candidates(raw: Column) -> Column:
    """The keys under which a name is looked up in turn: as written, without timing, without an aside, then its parts."""
    untimed = raw
    for _ in range(3):
        untimed = F.trim(F.regexp_replace(untimed, TIMING, ""))
    bare = F.regexp_replace(raw, ASIDE, " ")
    parts = lambda text: F.filter(F.split(text, SEPARATOR), lambda p: F.trim(p) != "")
    whole = [F.struct(F.lit(k).alias("step"), F.lit(0).alias("part"), normalise(x).alias("key")) for k, x in enumerate((raw, untimed, bare))]
    split = let(parts(bare), lambda p: F.when(F.size(p) >= 2, F.transform(p, lambda x, i: F.struct(F.lit(3).alias("step"), i.alias("part"), normalise(x).alias("key")))))
    return F.concat(F.array(*whole), F.coalesce(split, F.array().cast("array<struct<step: int, part: int, key: string>>")))
