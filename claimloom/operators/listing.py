"""Who sees which scans, filters of the list, and counts beside it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(scans: DataFrame, user: int, *, admin: bool = False) -> DataFrame:
    """All scans for an admin, else the user's own."""
    return scans if admin else scans.where(F.col("employee_number") == user)


def filtered(scans: DataFrame, *, review: str | None = None, name: str | None = None, bill_no: str | None = None, since: date | None = None, until: date | None = None) -> DataFrame:
    """Scans that meet every given condition; names and numbers by parts in either case, days inclusive."""
    part = lambda column, text: F.lower(column).contains(text.lower())
    conditions: list[Column] = []
    if review is not None:
        conditions.append(F.col("review_status") == review)
    if name is not None:
        conditions.append(part("employee_name", name))
    if bill_no is not None:
        conditions.append(part("bill_no", bill_no))
    if since is not None:
        conditions.append(F.col("created_on") >= F.lit(since))
    if until is not None:
        conditions.append(F.col("created_on") <= F.lit(until))
    for condition in conditions:
        scans = scans.where(condition)
    return scans


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def review_progress(scans: DataFrame, year: Column, wanted: str) -> DataFrame:
    """Waiting and open scans of all time; reviewed ones and their amounts in one allowance year."""
    done = (F.col("review_status") == "reviewed") & (year == wanted)
    return scans.agg(
        F.count_if(F.col("review_status") == "submitted").alias("pending"),
        F.count_if(F.col("review_status") == "under_review").alias("in_progress"),
        F.count_if(done).alias("reviewed"),
        F.coalesce(F.sum(F.when(done, F.col("claimed_amount"))), F.lit(0)).cast("decimal(18,2)").alias("claimed"),
    )


def uncertified(states: DataFrame) -> DataFrame:
    """(employee_number, uncertified, scans): how many scans of each employee they haven't certified."""
    return states.groupBy("employee_number").agg(F.count_if(F.col("certified_at").isNull()).alias("uncertified"), F.count("*").alias("scans"))
