"""Keyed permutations of 0 to n - 1 as column expressions: K distinct of N without a product, a shuffle without a sort.

A place is written in two digits, of bases a and b with n <= a * b < n + a; rounds of a Feistel network add to one digit, modulo its base, a hash of the other, so the whole is one to
one on a * b places. Where it leads to n or beyond, it is applied again (cycle walking): at most a * b - n times, as a cycle comes back to its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Steps of a walk. Past n = 4,096 a walk so long has a probability below 64 ** -64; it raises.
LONGEST_WALK = 64


def draw(key: Column, n: Column) -> Column:
    """The first 15 hex digits of sha1, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long"), n)


def permuted(place: Column, n: Column, key: Column) -> Column:
    """The place's image among 0 to n - 1, under the permutation that the key names. place must be below n."""
    n, place, key = n.cast("long"), place.cast("long"), key.cast("string")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(x: Column) -> Column:
        state = F.struct(F.floor(x / b).alias("l"), F.pmod(x, b).alias("r"))

        def turn(s: Column, k: Column) -> Column:
            said = lambda digit: F.concat_ws("|", key, k.cast("string"), digit.cast("string"))
            left = F.when(k % 2 == 0, F.pmod(s["l"] + draw(said(s["r"]), a), a)).otherwise(s["l"])
            right = F.when(k % 2 == 1, F.pmod(s["r"] + draw(said(s["l"]), b), b)).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["l"] * b + s["r"])

    steps = F.sequence(F.lit(0).cast("long"), F.least(a * b - n, F.lit(LONGEST_WALK).cast("long")))
    # -1 before the first step
    walked = F.aggregate(steps, F.lit(-1).cast("long"), lambda x, _: F.when(x < 0, network(place)).when(x >= n, network(x)).otherwise(x))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk is too long")))
