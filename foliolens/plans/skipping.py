"""Literal filters that let the Parquet scan pass over row groups by their statistics."""

from functools import reduce

from pyspark.sql import Column, functions as F

MAX_INTERVALS = 256


def intervals(values: list, most: int = MAX_INTERVALS) -> list[tuple]:
    """At most ``most`` closed intervals that hold all ``values`` (numbers or strings).

    Of numbers the widest gaps are left out; strings, which have no distance, are cut into runs of
    equal length.
    """
    ordered = sorted(set(values))
    if len(ordered) <= most:
        starts = range(len(ordered))
    elif isinstance(ordered[0], str):
        starts = [i * len(ordered) // most for i in range(most)]
    else:
        widest = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])[:most - 1]
        starts = [0, *sorted(widest)]
    ends = [*list(starts)[1:], len(ordered)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(starts, ends)]


def within(column: str, places: list[tuple]) -> Column:
    """The column lies in one of the closed intervals ``places``: a test that reaches the scan. It may let
    values between the wanted ones through, so an exact test has to follow."""
    tests = [(F.col(column) >= low) & (F.col(column) <= high) for low, high in places]
    while len(tests) > 1:  # pairwise, so that the tree stays shallow
        tests = [reduce(Column.__or__, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)
