"""Column expressions over raw product category paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    CATEGORY_ALIASES,
    CATEGORY_PLACEHOLDERS,
    FUNNEL_CATEGORIES,
    FUNNEL_MERGED_CATEGORIES,
)

LEVELS = ["main_category", "sub_category", "subsub_category"]


def lookup(key: Column, table: dict) -> Column:
    """Value of `key` in a small constant table, null when absent."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def clean_path(raw: Column, placeholder: str = "Unavailable") -> Column:
    """Normalised category path: placeholders, edge slashes, the `Home/` root, then aliases."""
    path = raw
    for token in CATEGORY_PLACEHOLDERS:
        path = F.replace(path, F.lit(token), F.lit(placeholder))
    path = F.regexp_replace(path, r"/\z", "")
    path = F.regexp_replace(path, "^Home/", "")
    path = F.regexp_replace(path, "^/", "")
    return F.coalesce(lookup(path, CATEGORY_ALIASES), path)


def path_levels(path: Column) -> dict[str, Column]:
    """First three levels of a cleaned path; a level that does not exist is `Other`."""
    parts = F.split(path, "/")
    return {name: F.coalesce(F.get(parts, F.lit(i)), F.lit("Other")) for i, name in enumerate(LEVELS)}


def category_levels(raw: Column, placeholder: str = "Unavailable") -> dict[str, Column]:
    return path_levels(clean_path(raw, placeholder))


def main_category(raw: Column, blank_as_other: bool = True) -> Column:
    """Top level of a raw path; the blank left by a bare `Home` counts as `Other` by default."""
    top = path_levels(clean_path(raw))["main_category"]
    return F.when(top == "", "Other").otherwise(top) if blank_as_other else top


def funnel_category(raw: Column) -> Column:
    """Coarse category of the conversion funnel, matched on the raw path."""
    label = F
    for name, fragments, names in FUNNEL_CATEGORIES:
        tests = [raw.contains(fragment) for fragment in fragments]
        if names:
            tests.append(raw.isin(names))
        condition = tests[0]
        for test in tests[1:]:
            condition = condition | test
        label = label.when(condition, name)
    return label.otherwise("Other")


def merged_funnel_category(raw: Column) -> Column:
    """Main category of the product funnel, with the minor categories folded into `Other`."""
    top = main_category(raw)
    return F.when(top.isin(FUNNEL_MERGED_CATEGORIES), "Other").otherwise(top)
