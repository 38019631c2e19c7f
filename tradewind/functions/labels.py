"""Column expressions that assign labels."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ACTION_LABELS, ACTIONS_OUTSIDE_FUNNEL, PRICE_STEPS, WEEKDAYS


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def action_label(action: Column) -> Column:
    """Funnel stage of an action code, null for a code without a stage."""
    label = F
    for code, name in ACTION_LABELS.items():
        label = label.when(action == code, name)
    return label.otherwise(None)


def in_funnel(action: Column) -> Column:
    """Three-valued: a null action is neither in nor out, so a filter drops it."""
    return ~action.isin(ACTIONS_OUTSIDE_FUNNEL)


def stage_rank(label: Column) -> Column:
    rank = F
    for position, name in enumerate(ACTION_LABELS.values()):
        rank = rank.when(label == name, F.lit(position))
    return rank.otherwise(None)


def tier(value: Column, tiers: list[tuple]) -> Column:
    """Label of an inclusive range, first match wins; null falls to the last tier."""
    label = F
    for name, low, high in tiers[:-1]:
        label = label.when(value < high if low is None else value.between(low, high), name)
    return label.otherwise(tiers[-1][0])


def visitor_category(visit_number: Column) -> Column:
    """Bins 0-1, 2-5 and above 5, closed on the right."""
    return (
        F.when(visit_number.between(0, 1), "First-time")
        .when((visit_number > 1) & (visit_number <= 5), "Occasional")
        .when(visit_number > 5, "Frequent")
    )


def season(month: Column, hemisphere: Column) -> Column:
    """Season of a month number in a hemisphere; `Unknown` where the hemisphere is."""
    quarter = (month % 12 / 3).cast("int")
    names = ["Winter", "Spring", "Summer", "Autumn"]
    north = F.get(F.array(*[F.lit(n) for n in names]), quarter)
    south = F.get(F.array(*[F.lit(n) for n in names[2:] + names[:2]]), quarter)
    return (
        F.when(hemisphere == "north", north)
        .when(hemisphere == "south", south)
        .when(hemisphere == "equator", "Summer")
        .otherwise("Unknown")
    )


def keyword_category(text: Column, cold: list[str], outdoor: list[str]) -> Column:
    """Case-sensitive keyword class; the cold list wins, null text is `Other`."""
    return (
        F.when(any_of([text.contains(word) for word in cold]), "Cold-Related")
        .when(any_of([text.contains(word) for word in outdoor]), "Outdoor-Related")
        .otherwise("Other")
    )


def weekday_name(day: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in WEEKDAYS]), F.weekday(day))


def price_step(demand: Column, competition: Column) -> Column:
    step = F
    for demand_name, row in PRICE_STEPS.items():
        for competition_name, value in row.items():
            step = step.when((demand == demand_name) & (competition == competition_name), F.lit(value))
    return step.otherwise(F.lit(0.0))
