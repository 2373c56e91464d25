"""Amount and date of a promise to pay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecall.functions.values import ascii_digits, parse_number
from duecall.vocabulary import PROMISE_LABELS


def without_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def amount_number(amount: Column) -> Column:
    return parse_number(without_commas(amount))


def ground_amount(whole: Column, transcript: Column) -> Column:
    """The whole amount when its digits occur in the transcript, else null."""
    return F.when(
        whole.isNotNull(), F.when(without_commas(transcript).contains(whole), whole)
    )


def reference_date(current_date: Column) -> Column:
    """DATE of a reference written as year-month-day, null when it is no real date."""
    shaped = current_date.rlike(r"^0*[1-9][0-9]{0,3}-[0-9]{1,2}-[0-9]{1,2}\z")
    return F.when(shaped, F.try_to_date(current_date, "y-M-d"))


_LAST_DATE = "9999-12-31"


def _days_after(reference: Column, days: int) -> Column:
    last_start = F.date_sub(F.lit(_LAST_DATE).cast("date"), days)
    return F.when(reference <= last_start, F.date_add(reference, days).cast("string"))


def resolve_relative_date(
    date: Column, spoken: Column, reference: Column, current_date: Column
) -> Column:
    """'parso' is two days after the reference; 'kal' moves a date left at the reference.

    ``spoken`` is the transcript in lower case, ``reference`` the DATE of ``current_date``.
    """
    return (
        F.when(spoken.contains("parso"), _days_after(reference, 2))
        .when(spoken.contains("kal") & (date == current_date), _days_after(reference, 1))
        .otherwise(date)
    )


def extract_iso_date(text: Column) -> Column:
    """First year-month-day before the time part; null when there is none."""
    day_part = F.when(text.contains("T"), F.substring_index(text, "T", 1)).otherwise(
        F.substring_index(text, " ", 1)
    )
    return F.nullif(
        F.regexp_extract(day_part, r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", 0), F.lit("")
    )


def month_end(iso: Column) -> Column:
    """Last DATE of the month of an ISO date text; null when there is no such month."""
    first_day = F.concat(F.substring(ascii_digits(iso), 1, 8), F.lit("01"))
    return F.last_day(F.try_to_date(first_day, "yyyy-MM-dd"))


def cap_month_end(iso: Column, last: Column) -> Column:
    """A day past ``last``, the ``month_end``, becomes it; an impossible month becomes null."""
    day = F.substring(ascii_digits(iso), 9, 2).try_cast("int")
    return F.when(
        last.isNotNull(), F.when(day > F.dayofmonth(last), last.cast("string")).otherwise(iso)
    )


def is_promise(payment_label: Column) -> Column:
    """Promise details exist only beside a label that promises money."""
    return payment_label.isin(PROMISE_LABELS)
