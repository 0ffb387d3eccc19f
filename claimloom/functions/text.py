"""Scalar functions on names, durations and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public standard's alphabet and format.
DIGITS36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is asked for."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise_name(name: Column) -> Column:
    """Upper case, punctuation as space, single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(name, r"""[-_.,/'"()\[\]]""", " ")), r"\s+", " "))


def gstin_check_digit(number: Column) -> Column:
    """The check character of the first 14 characters: products with 1 and 2 in turn, their base-36 digits summed."""
    value = lambda i: F.instr(F.lit(DIGITS36), F.substring(number, i, 1)) - 1
    product = lambda i: value(i) * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda a, i: a + F.floor(product(i) / 36).cast("int") + product(i) % 36)
    return F.substring(F.lit(DIGITS36), (36 - total % 36) % 36 + 1, F.lit(1))


def gstin_valid(number: Column) -> Column:
    """Whether a number as printed is well formed; null if none is printed."""
    return F.when(cleaned_gstin(number).isNotNull(), gstin_problem(number).isNull())


# Dosage-form and dosing words around a drug's name, and what a strength and a course look like as a token.
FORM_WORDS = ("TAB", "TABS", "TABLET", "TABLETS", "T", "CAP", "CAPS", "CAPSULE", "CAPSULES", "C", "SYP", "SYR", "SYRUP", "SUSP", "SUSPENSION", "INJ", "INJECTION", "OINT", "OINTMENT", "CREAM", "GEL", "DROP", "DROPS", "LOTION", "POWDER", "SACHET", "SOLUTION", "SPRAY", "INHALER", "ROTACAP", "RESPULE")
DOSING_WORDS = ("OD", "BD", "BID", "TDS", "TID", "QID", "QDS", "HS", "SOS", "PRN", "STAT", "AC", "PC", "NOCTE", "OM", "MANE", "PO", "IV", "IM", "SC", "ORAL")
STRENGTH_TOKEN, COURSE_TOKEN = r"^\d+(\.\d+)?(MG|MGS|G|GM|GMS|MCG|UG|ML|L|IU|%)?$", r"^X?\d+(/\d+)?[A-Z]*$"
# Words before a person's name, and the statutory state codes.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "master", "baby", "b/o", "c/o")
STATES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan",
    "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya",
    "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "25": "Daman and Diu",
    "26": "Dadra and Nagar Haveli", "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu",
    "34": "Puducherry", "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh",
}
DEFAULT_CURRENCY = "INR"


def clean_drug_string(raw: Column) -> Column:
    """The drug's name alone: without form and dosing words, strengths and courses."""
    tokens = F.split(normalise_name(F.regexp_replace(raw, "×", " x ")), " ")
    kept = F.filter(tokens, lambda t: ~t.isin(*FORM_WORDS, *DOSING_WORDS, "X") & ~t.rlike(STRENGTH_TOKEN) & ~t.rlike(COURSE_TOKEN))
    return F.array_join(kept, " ")


def label(name: Column, raw: Column) -> Column:
    """What to call a line: its name, or else the text it was read from; null only if both are blank."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(raw), F.lit("")))


def same_person(a: Column, b: Column) -> Column:
    """Whether two names share a word that isn't a title; a name of titles alone is no evidence against it. Null if one is missing."""
    words = lambda x: F.array_except(F.split(F.regexp_replace(F.lower(x), r"\.", " "), r"\s+"), F.array(*map(F.lit, (*TITLES, ""))))
    return F.when(a.isNotNull() & b.isNotNull(), (F.size(words(a)) == 0) | (F.size(words(b)) == 0) | F.arrays_overlap(words(a), words(b)))


def split_name(full: Column) -> Column:
    """struct(first, middle, last); a name of four words or more stays whole, as where to cut it isn't known."""
    text = F.trim(F.coalesce(full, F.lit("")))
    words = F.split(text, r"\s+")
    n = F.size(words)
    first = F.when(n <= 3, F.get(words, F.lit(0))).otherwise(text)
    middle, last = F.when(n == 3, F.get(words, F.lit(1))).otherwise(""), F.when(n.isin(2, 3), F.get(words, n - 1)).otherwise("")
    return F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"))


def currency(raw: Column) -> Column:
    """A code of three letters, upper case; anything else is the default."""
    code = F.upper(F.trim(raw))
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(DEFAULT_CURRENCY)


def cleaned_gstin(raw: Column) -> Column:
    """Without spaces and dashes, in upper case; null if nothing is printed."""
    return F.nullif(F.upper(F.regexp_replace(raw, r"[\s-]", "")), F.lit(""))


def state_of_code(number: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), F.substring(number, 1, 2))


def gstin_problem(raw: Column) -> Column:
    """length, pattern, state or check_digit, the first that fails; null for a number that is well formed or not printed."""
    number = cleaned_gstin(raw)
    failed = F.when(F.length(number) != 15, "length").when(~number.rlike(GSTIN), "pattern").when(state_of_code(number).isNull(), "state")
    return F.when(number.isNotNull(), failed.when(F.substring(number, 15, 1) != gstin_check_digit(number), "check_digit"))


def state_in_address(address: Column) -> Column:
    """The one state that an address names; null if it names none or several."""
    names = F.array(*(F.lit(x) for x in sorted(set(STATES.values()))))
    found = F.filter(names, lambda s: F.upper(address).contains(F.upper(s)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def licence_printed(raw: Column) -> Column:
    """Whether a licence number is there; its format isn't judged."""
    return F.length(F.trim(F.coalesce(raw, F.lit("")))) > 0


def row_key(prescribed: Column, billed: Column, *, tests: bool = False) -> Column:
    """The name of a row of the report, by which decisions find it."""
    alone = ("rxt-", "bt-") if tests else ("rx-only-", "bill-only-")
    return F.when(prescribed.isNotNull() & billed.isNotNull(), F.concat(prescribed, F.lit("-"), billed)).when(prescribed.isNotNull(), F.concat(F.lit(alone[0]), prescribed)).otherwise(F.concat(F.lit(alone[1]), billed))
