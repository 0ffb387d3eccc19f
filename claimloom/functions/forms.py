"""Dosage forms, and whether a billed line is a medicine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings by form, forms and words of lines that aren't medicines.
SPELLINGS = {
    "tablet": ("tab", "tabs", "tablet", "tablets"),
    "capsule": ("cap", "caps", "capsule", "capsules"),
    "syrup": ("syp", "syrup", "susp", "suspension", "liquid"),
    "solution": ("solution",),
    "injection": ("inj", "injection", "vial", "ampoule"),
    "ointment": ("oint", "ointment"),
    "cream": ("cream",),
    "gel": ("gel",),
    "drops": ("drop", "drops"),
    "inhaler": ("inhaler", "rotacap", "respule"),
    "sachet": ("sachet", "powder"),
}
FORMS = {word: form for form, words in SPELLINGS.items() for word in words}
NON_MEDICINE_FORMS = ("other", "service", "consumable")
NON_MEDICINE_WORDS = (
    "delivery", "shipping", "courier", "handling", "service", "packing", "freight", "consultation", "registration", "convenience",
    "syringe", "needle", "glucometer", "lancet", "strip", "strips", "thermometer", "bandage", "gauze", "cotton", "mask", "gloves", "sanitizer", "sanitiser",
    "nebulizer", "nebuliser", "catheter", "diaper", "diapers", "wipes", "bp monitor", "oximeter", "crepe", "elastic",
    "soap", "shampoo", "lotion", "moisturizer", "moisturiser", "sunscreen", "toothpaste", "toothbrush", "talc", "powder puff", "lip balm", "face wash",
    "protein", "supplement", "multivitamin", "health drink", "nutrition", "sanitary", "napkin",
)


def normalise_form(raw: Column) -> Column:
    """The form that a spelling stands for; an unknown one stays, in lower case, and blank is null."""
    key = F.nullif(F.lower(F.trim(raw)), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FORMS.items() for x in pair)), key), key)


def classify_line(resolved: Column, name: Column, raw: Column, form: Column) -> Column:
    """medicine, non_medicine or unclassified: the dictionary decides first, then words anywhere in the text, then the form."""
    text, kind = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit("")))), normalise_form(form)
    worded = F.exists(F.array(*map(F.lit, NON_MEDICINE_WORDS)), lambda w: text.contains(w))
    return F.when(resolved, "medicine").when(worded | F.coalesce(kind.isin(*NON_MEDICINE_FORMS), F.lit(False)), "non_medicine").when(kind.isNotNull(), "medicine").otherwise("unclassified")


def outside_medicine(resolved: Column, form: Column) -> Column:
    """The coarser test that softens unmatched lines: a form of no medicine, or neither a name known nor a form stated."""
    kind = normalise_form(form)
    return F.coalesce(kind.isin(*NON_MEDICINE_FORMS), F.lit(False)) | (~resolved & kind.isNull())
