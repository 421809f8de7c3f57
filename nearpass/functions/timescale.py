"""Calendar dates, Julian dates and time scales as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JD_UNIX_EPOCH = 2440587.5
#: Linear TCB-TDB rate, its reference JD, and the epoch J2010.0 of observation times.
TCB_RATE = 1.550519768e-8
TCB_REFERENCE_JD = 2443144.5003725
JD_J2010 = 2455197.5
TT_MINUS_TAI_S = 32.184
#: First UTC day and TAI-UTC in seconds from that day on.
LEAP_SECONDS = (
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14),
    ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19),
    ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24),
    ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29),
    ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34),
    ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
)


def _day_jd(day: str) -> float:
    from datetime import date

    return (date.fromisoformat(day) - date(1970, 1, 1)).days + JD_UNIX_EPOCH


def tai_minus_utc_s(jd_utc: Column) -> Column:
    """Leap seconds in force at a UTC Julian date; ten before 1972."""
    chain = F.lit(10.0)
    for day, seconds in LEAP_SECONDS:
        chain = F.when(jd_utc >= _day_jd(day), F.lit(float(seconds))).otherwise(chain)
    return chain


def utc_to_tdb(jd_utc: Column) -> Column:
    """UTC to TDB, taking TDB as TT (they differ by less than 2 ms)."""
    return jd_utc + (tai_minus_utc_s(jd_utc) + TT_MINUS_TAI_S) / 86400.0


def tdb_to_utc(jd_tdb: Column) -> Column:
    """Inverse of ``utc_to_tdb``; each leap second is looked up at its TDB instant."""
    chain = F.lit((10.0 + TT_MINUS_TAI_S) / 86400.0)
    for day, seconds in LEAP_SECONDS:
        offset = (seconds + TT_MINUS_TAI_S) / 86400.0
        chain = F.when(jd_tdb >= _day_jd(day) + offset, F.lit(offset)).otherwise(chain)
    return jd_tdb - chain


def tcb_to_tdb(jd_tcb: Column) -> Column:
    return jd_tcb - TCB_RATE * (jd_tcb - TCB_REFERENCE_JD)


def tdb_to_tcb(jd_tdb: Column) -> Column:
    return (jd_tdb - TCB_RATE * TCB_REFERENCE_JD) / (1.0 - TCB_RATE)


def gaia_epoch_to_tdb(days: Column) -> Column:
    """Days since J2010.0 TCB to a TDB Julian date."""
    return tcb_to_tdb(days + JD_J2010)


def timestamp_to_jd(ts: Column) -> Column:
    return F.unix_micros(ts) / 86_400_000_000.0 + JD_UNIX_EPOCH


def jd_to_date(jd: Column) -> Column:
    """Calendar day of a Julian date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(jd - JD_UNIX_EPOCH).cast("int"))


def jd_to_iso_date(jd_tdb: Column) -> Column:
    """ISO day in UTC of a TDB Julian date."""
    return F.date_format(jd_to_date(tdb_to_utc(jd_tdb)), "yyyy-MM-dd")


def decimal_year_to_jd(year: Column) -> Column:
    """A year plus the elapsed share of that year; days counted from 1 January 0 h."""
    whole = F.floor(year).cast("int")
    start = F.try_to_timestamp(F.concat(F.lpad(whole.cast("string"), 4, "0"), F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    leap = ((whole % 4 == 0) & (whole % 100 != 0)) | (whole % 400 == 0)
    return timestamp_to_jd(start) + (year - whole) * F.when(leap, 366.0).otherwise(365.0)


def parse_event_jd(text: Column) -> Column:
    """UTC Julian date of ``yyyy-MM-dd``, ``yyyy-MM-ddTHH:mm`` or a decimal year; else null.

    Outer white space is ignored; impossible days and any other notation give null.
    """
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), timestamp_to_jd(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd"))))
        .when(bare.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"), timestamp_to_jd(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm"))))
        .when(bare.rlike(r"^\d{4}\.\d+$"), decimal_year_to_jd(bare.try_cast("double")))
    )
