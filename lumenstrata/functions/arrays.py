"""Array expressions that Spark lacks, composed of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32


def running_sum(values: Column, inclusive: bool = True) -> Column:
    """Prefix sums of an array of longs.

    Summed in blocks of blocks: what is copied for each element is bounded by
    the block, and by a thirty-second of the array for the blocks' own sums.
    """
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    steps = lambda a, start: F.aggregate(a, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    pairs = F.arrays_zip(blocks.alias("b"), steps(F.transform(blocks, total), zero).alias("o"))
    sums = F.transform(F.filter(pairs, lambda z: z["b"].isNotNull()), lambda z: F.slice(steps(z["b"], z["o"]), 2 if inclusive else 1, F.size(z["b"])))
    return F.flatten(sums)
