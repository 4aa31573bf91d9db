"""Categories of changes: which part of a record an operation touches, and how far numbers
moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import magnitude
from treeloom.operators.script import edit_ops

# Fields of each category, in order of precedence. A * at the end of a name
# would stand for any ending.
CATEGORIES = {
    "political": ("government_type", "legislature", "upper_house", "lower_house", "leader_title1", "leader_name1", "leader_title2", "leader_name2", "leader_title3", "leader_name3", "leader_title4", "leader_name4", "leader_title5", "leader_name5", "leaders"),
    "economic": ("GDP_PPP", "GDP_PPP_year", "GDP_PPP_per_capita", "GDP_PPP_rank", "GDP_nominal", "GDP_nominal_year", "GDP_nominal_per_capita", "GDP_nominal_rank", "currency", "currency_code", "Gini", "Gini_year", "Gini_change"),
    "demographic": ("population_estimate", "population_estimate_year", "population_census", "population_census_year", "population_density_km2", "demonym", "ethnic_groups", "ethnic_groups_year", "religion", "religion_year"),
    "geographic": ("area_km2", "area_rank", "percent_water", "capital", "largest_city", "coordinates", "time_zone", "utc_offset", "drives_on"),
    "cultural": ("official_languages", "languages", "languages_type", "languages2", "languages2_type", "native_name", "national_motto", "national_anthem"),
    "development": ("HDI", "HDI_year", "HDI_change", "HDI_rank"),
    "international": ("calling_code", "cctld", "iso3166code"),
    "historical": ("established", "established_event1", "established_date1", "established_event2", "established_date2", "established_event3", "established_date3", "established_event4", "established_date4", "established_event5", "established_date5"),
}
OTHER = "other"


def category(field: str | Column, categories: dict[str, Sequence[str]] | None = None) -> Column:
    """The first category one of whose names or prefixes fits, else ``other``."""
    field = F.col(field) if isinstance(field, str) else field
    out = None
    for name, entries in (CATEGORIES if categories is None else categories).items():
        fits = field.isin([x for x in entries if not x.endswith("*")])
        for x in entries:
            if x.endswith("*"):
                fits = fits | field.startswith(x[:-1])
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return F.lit(OTHER) if out is None else out.otherwise(OTHER)


def categorised(scripts: DataFrame, categories: dict | None = None) -> DataFrame:
    """Operations with ``category``, and the ``magnitude`` of relabels between numbers."""
    ops = edit_ops(scripts).withColumn("category", category("field", categories))
    return ops.withColumn("magnitude", F.when(F.col("op_type") == "relabel", magnitude("label", "new_label")))


def change_summary(scripts: DataFrame, categories: dict | None = None, shown: int = 10) -> DataFrame:
    """For each pair and category: operations of each kind, the first few of them, whether
    there are more, and where the category first appears in the script."""
    ops = categorised(scripts, categories)
    number = lambda kind: F.count_if(F.col("op_type") == kind).alias(f"{kind}s")
    change = F.struct("op_seq", "op_type", "field", "label", "node_type", F.when(F.col("op_type") == "relabel", F.col("label")).alias("from_val"), F.col("new_label").alias("to_val"), "magnitude")
    grouped = ops.groupBy("src", "dst", "algorithm", "category").agg(F.count(F.lit(1)).alias("count"), *map(number, ("insert", "delete", "relabel")), F.min("op_seq").alias("first_seq"), F.sort_array(F.collect_list(change)).alias("changes"))
    return grouped.withColumn("truncated", F.col("count") > shown).withColumn("changes", F.slice("changes", 1, shown))
