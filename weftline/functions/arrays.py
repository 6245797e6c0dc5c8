"""Array expressions that stay linear, or nearly so, in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used, inside other lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    """value as a generated column: the optimiser does not write its expression into each later use, as it does with a projected one."""
    return F.explode(F.array(value))


def starts_of(lengths: Column) -> Column:
    """Where each part begins, given all parts' lengths: running sums without the part itself.

    Appending to an array copies it, so sums are kept in runs of about the square root of the
    array's length: inside each run, and over the runs.
    """

    def running(numbers: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(numbers, begin, lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")))

    def sums(all_lengths: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_lengths).cast("double"))).cast("int")
        return let(size, lambda n: let(runs(all_lengths, n), lambda r: let(running(F.transform(r, lambda x: x["at"]))["found"], lambda before: F.flatten(F.transform(r, lambda x, k: F.transform(x["found"], lambda s: (s + F.get(before, k)).cast("int")))))))

    def runs(all_lengths: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(all_lengths) - 1) / n).cast("int")), lambda k: running(F.slice(all_lengths, k * n + 1, n)))

    return let(lengths, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(F.array().cast("array<int>")))
