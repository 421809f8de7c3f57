"""Observation and published-table readers with their checks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.functions.timescale import decimal_year_to_jd, timestamp_to_jd
from nearpass.schema import require
from nearpass.session import list_files

#: Fixed value: solar mass in kg, for masses printed in 1e-10 solar masses.
SUN_KG = 1.98847e30


def load_observations(spark: SparkSession, path: str, columns: tuple[str, ...] = ("number_mp", "epoch", "ra", "dec")) -> DataFrame:
    """A Parquet observation table in lower case; a missing local path or column is an error."""
    if not list_files(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.parquet(path)
    return require(rows.toDF(*[c.lower() for c in rows.columns]), *columns)


def window_of(rows: DataFrame, numbers: DataFrame | None, start: float, end: float, reject: str | None = None) -> DataFrame:
    """Observations of wanted bodies in a window; rows flagged as rejected are left out.

    The flag may be a boolean or text. The bodies come as a table and are a semi join, so the
    list may be of any length.
    """
    out = rows.where(F.col("epoch").between(start, end))
    if reject and reject in rows.columns:
        flag = F.lower(F.col(reject).cast("string"))
        out = out.where(flag.isNull() | (flag == "false"))
    return out if numbers is None else out.join(numbers.select(F.col("number").alias("number_mp")).distinct(), "number_mp", "left_semi")


def key_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Gap-free inclusive key ranges for a partitioned fetch."""
    width = max(1, -(-(high - low + 1) // parts))
    return [(k, min(k + width - 1, high)) for k in range(low, high + 1, width)]


def read_keyed(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A JDBC table read in key ranges by parallel tasks, with the rows that have no key as one more."""
    ranges = [f"{key} BETWEEN {a} AND {b}" for a, b in key_ranges(low, high, parts)] + [f"{key} IS NULL"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=options)


def max_key(rows: DataFrame, key: str, default: int) -> DataFrame:
    return rows.agg(F.coalesce(F.max(key), F.lit(default)).alias("max_key"))


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Published tables under each other by column name, with their name in ``source_table``."""
    out = None
    for name, df in tables.items():
        named = df.withColumn("source_table", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


class _Tables(HTMLParser):
    """Cells of all tables of a page, by table and row; a row or cell left open ends with the next."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
        self.open = tag in ("td", "th") or (self.open and tag not in ("table", "tr"))

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data: str) -> None:
        if self.open and self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data


def html_tables(pages: DataFrame, page: str, text: str, skip: int = 2) -> DataFrame:
    """``page, table, row, cells``: the rows of all tables of HTML pages after ``skip`` heading rows each.

    No-break spaces count as blanks, and runs of blanks as one; an empty cell is null. A null page has no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, source in zip(frame["_page"], frame["_text"], strict=True):
                parser = _Tables()
                parser.feed(source)
                parser.close()
                for k, rows in enumerate(parser.tables):
                    out += [(name, k, i, [" ".join(c.split()) or None for c in cells]) for i, cells in enumerate(rows[skip:])]
            yield pd.DataFrame(out, columns=["page", "table", "row", "cells"])

    given = pages.where(F.col(text).isNotNull()).select(F.col(page).cast("string").alias("_page"), F.col(text).alias("_text"))
    return given.mapInPandas(run, "page string, table int, row int, cells array<string>")


def masses(rows: DataFrame, key: str, mass: str, order: str) -> DataFrame:
    """``key, mass_kg`` of masses in 1e-10 Suns; of several entries the first in ``order``."""
    kg = F.col(mass).try_cast("double") * 1e-10 * SUN_KG
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.where(F.col(key).isNotNull()).withColumn("_r", rank).where("_r = 1").select(key, kg.alias("mass_kg"))


def tolerant_date(text: Column) -> tuple[Column, Column]:
    """Julian date and precision (``day``, ``month``, ``year``) of a possibly partial date.

    No-break spaces count as blanks; a month stands for its middle, a year for its.
    """
    bare = F.trim(F.regexp_replace(text, " ", " "))
    day = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), timestamp_to_jd(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd"))))
    month = F.when(bare.rlike(r"^\d{4}-\d{2}$"), timestamp_to_jd(F.try_to_timestamp(F.concat(bare, F.lit("-15")), F.lit("yyyy-MM-dd"))))
    year = F.when(bare.rlike(r"^\d{4}$"), decimal_year_to_jd(bare.try_cast("double") + 0.5))
    jd = F.coalesce(day, month, year)
    return jd, F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year")
