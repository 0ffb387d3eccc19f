"""Rules on a scan's documents as such: names, dates, runs, identifiers, lines that are no medicines, schedules and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import forms, text
from claimloom.functions.fuzzy import token_set_ratio
from claimloom.operators.pairing import same_line
from claimloom.operators.resolution import schedule_of
from claimloom.operators.rules import told, unavailable, unstable

#: The likeness below which two patients are different, and schedules that need a prescription.
SAME_PATIENT, PRESCRIBED = 75.0, ("H", "H1", "X")


def patient_names(scans: DataFrame) -> DataFrame:
    """Patients of prescription and bill that aren't alike; blank on either side can't be checked. Distinct pairs alone are compared."""
    blank = (F.coalesce(F.trim("rx_patient"), F.lit("")) == "") | (F.coalesce(F.trim("bill_patient"), F.lit("")) == "")
    both = scans.where(~blank)
    scored = both.select("rx_patient", "bill_patient").distinct().where(token_set_ratio("rx_patient", "bill_patient") < SAME_PATIENT)
    unlike = both.join(scored, ["rx_patient", "bill_patient"])
    return told(unlike, "PATIENT_NAME_MISMATCH", "warning").union(unavailable(scans.where(blank), "patient name"))


def date_order(scans: DataFrame) -> DataFrame:
    """Dates whose order of day and month was assumed."""
    documents = F.filter(F.array(F.when(F.col("rx_assumed"), "prescription"), F.when(F.col("bill_assumed"), "bill")), lambda x: x.isNotNull())
    return told(scans.where(F.coalesce("rx_assumed", F.lit(False)) | F.coalesce("bill_assumed", F.lit(False))), "DATE_ORDER_ASSUMED", "info", detail=F.to_json(F.struct(documents.alias("documents"))))


def item_counts(scans: DataFrame) -> DataFrame:
    """Documents of which the runs counted different numbers of lines, and those read once, where that can't be told."""
    each = scans.select("scan_id", F.explode(F.array(F.struct(F.lit("prescription").alias("document"), F.col("rx_runs").alias("runs")), F.struct(F.lit("bill").alias("document"), F.col("bill_runs").alias("runs")))).alias("d")).select("scan_id", "d.*")
    counts = F.filter(F.split(F.coalesce("runs", F.lit("")), ","), lambda x: x != "")
    name = F.to_json(F.struct("document"))
    return told(each.where(unstable(F.col("runs"))), "ITEM_COUNT_UNSTABLE", "critical", detail=name).union(unavailable(each.where(F.size(counts) < 2), F.concat("document", F.lit(" item-count stability"))))


def identifiers(scans: DataFrame) -> DataFrame:
    """Tax numbers that aren't well formed or name another state than the address does, and bills without a licence number."""
    number, problem = text.cleaned_gstin(F.col("gstin")), text.gstin_problem(F.col("gstin"))
    home, named = text.state_of_code(number), text.state_in_address(F.col("address"))
    rows = scans.select("scan_id", "licence_no", number.alias("number"), problem.alias("problem"), home.alias("home"), named.alias("named"))
    wrong = told(rows.where("problem IS NOT NULL"), "GSTIN_INVALID", "warning", detail=F.to_json(F.struct(F.col("problem").alias("reason"))))
    elsewhere = told(rows.where("number IS NOT NULL AND problem IS NULL AND home <> named"), "GSTIN_STATE_MISMATCH", "info", detail=F.to_json(F.struct(F.col("home").alias("gstin_state"), F.col("named").alias("address_state"))))
    return reduce(DataFrame.union, (unavailable(rows.where("number IS NULL"), "GSTIN format"), wrong, elsewhere, told(rows.where(~text.licence_printed(F.col("licence_no"))), "LICENCE_ABSENT", "warning")))


def outside_medicine() -> Column:
    """Whether a billed line is no medicine."""
    return forms.classify_line(F.col("salt").isNotNull(), F.col("drug_name"), F.col("raw_text"), F.col("form")) == "non_medicine"


def non_medicine(bill: DataFrame) -> DataFrame:
    """Billed lines that are no medicines; a line with a salt is resolved."""
    return told(bill.where(outside_medicine()), "NON_MEDICINE_ITEM", "info", bill=F.col("item_id"))


def schedule_unbacked(alone: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Billed lines without a prescription whose salt is sold on one only; the strictest schedule of the salt counts."""
    known = schedule_of(alone.where(F.col("salt").isNotNull()), dictionary)
    return told(known.where(F.col("schedule").isin(*PRESCRIBED)), "SCHEDULE_H_UNBACKED", "critical", bill=F.col("item_id"), detail=F.to_json(F.struct("schedule")))


def class_conflicts(pairs: DataFrame, rx: DataFrame, bill: DataFrame) -> DataFrame:
    """Pairs with a name that was matched by likeness only and whose therapeutic classes differ; lines carry method and therapeutic_class."""
    r, b = rx.alias("r"), bill.alias("b")
    both = pairs.alias("p").join(r, (F.col("p.scan_id") == F.col("r.scan_id")) & same_line("p.rx_item", "r.item_id")).join(b, (F.col("p.scan_id") == F.col("b.scan_id")) & same_line("p.bill_item", "b.item_id"))
    doubtful = F.col("r.salt").isNotNull() & F.col("b.salt").isNotNull() & ((F.col("r.method") == "fuzzy") | (F.col("b.method") == "fuzzy")) & (F.col("r.therapeutic_class") != F.col("b.therapeutic_class"))
    return told(both.where(doubtful).select("p.scan_id", "rx_item", "bill_item"), "SALT_DIFFERENT_CLASS", "critical", F.col("rx_item"), F.col("bill_item"))


def illegible(verdicts: DataFrame) -> DataFrame:
    """What an inconclusive verdict adds to the findings."""
    return told(verdicts.where("verdict = 'inconclusive'"), "ILLEGIBLE_RX", "info")


#: The order of findings: what the stages of the engine find, one after the other.
STAGES = (
    ("STRENGTH_MISMATCH", "STRENGTH_UNIT_UNSTATED", "FORM_MISMATCH", "BRAND_SUBSTITUTION", "SALT_DIFFERENT_CLASS", "QUANTITY_SHORT", "QUANTITY_EXCESS", "QUANTITY_AMBIGUOUS", "strength", "dosage form", "quantity"),
    ("RX_NOT_BILLED", "BILL_NOT_PRESCRIBED", "SCHEDULE_H_UNBACKED", "billed-counterpart", "prescription-counterpart"),
    ("TEST_UNRESOLVED", "TEST_NOT_BILLED", "PANEL_PARTIAL", "TEST_NOT_PRESCRIBED", "TEST_DUPLICATE", "test billing", "test authorisation", "repeat test billing"),
    ("TEST_BILLED_NOT_REPORTED", "TEST_REPORTED_NOT_BILLED", "TEST_REPORTED_NOT_ORDERED", "REPORT_PATIENT_MISMATCH", "REPORT_DATE_ANOMALY", "billed against reported", "reported against ordered", "report timing", "reported tests"),
    ("DUPLICATE_THERAPY", "PATIENT_NAME_MISMATCH", "DATE_ANOMALY", "DATE_ORDER_ASSUMED", "ITEM_COUNT_UNSTABLE", "duplicate-therapy", "patient name", "document date", "prescription item-count stability", "bill item-count stability"),
    ("DUPLICATE_BILL", "POSSIBLE_RESUBMISSION", "EARLY_REPEAT", "LICENCE_INCONSISTENT", "scan history", "duplicate bill", "early repeat"),
    ("LINE_TOTAL_MISMATCH", "SUBTOTAL_MISMATCH", "GRAND_TOTAL_MISMATCH", "TAX_INCLUSIVE_PRICING", "line arithmetic", "subtotal", "grand total"),
    ("EXPIRED_ITEM", "EXPIRY_NEAR", "expiry"),
    ("GSTIN_INVALID", "GSTIN_STATE_MISMATCH", "LICENCE_ABSENT", "NON_MEDICINE_ITEM", "GSTIN format"),
    ("LOW_CONFIDENCE_FIELD",),
    ("ILLEGIBLE_RX",),
)


def in_order(findings: DataFrame) -> DataFrame:
    """Findings with `seq`, from 1 on in each scan: by stage, then by the line they are about, then by code."""
    from pyspark.sql import Window

    stage = F.create_map(*(F.lit(x) for k, names in enumerate(STAGES) for name in names for x in (name, k)))
    about = F.coalesce("prescribed_ref", "billed_ref")
    by = Window.partitionBy("scan_id").orderBy(F.try_element_at(stage, F.coalesce("check_name", "rule_code")), about, "billed_ref", "rule_code", "check_name", "detail")
    return findings.withColumn("seq", F.row_number().over(by))
