"""Per-key results where a few keys hold most rows.

Everything comes from histograms whose bins merge. The first has a bin for each length of a value in bits; its bins'
counts, sums and extremes, added up, are those of the key. Order statistics come by distributed exact selection: the bin
that holds the wanted rank is an open interval, and each round counts the values of every open interval into at most
2**bits bins and keeps the one that holds the rank, until the interval is a single value. No value of a key is ever gathered, so a key with a third
of all rows costs the same as any other third of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.session import materialize

#: Interval tables up to this many rows (about 60 bytes each) are broadcast, larger ones meet the rows salted.
BROADCAST_ROWS = 200_000
#: Places of keys in the order in which heavy ones are selected, by hash; keys may share one.
PLACES = 2**31 - 1
#: Salts of larger ones at least; more where the session has more shuffle partitions.
SALTS = 16


def key_profile(
    df: DataFrame,
    key: Column,
    value: Column,
    probs: Sequence[float] = (0.5,),
    sums: dict[str, Column] | None = None,
    bits: int = 10,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(key, n_rows, n_values, first, last, q0, q1, ... and one column per entry of sums), one row per key.

    q_i is the exact discrete quantile of the non-null values: the value of rank ceil(p * n), at least 1. Values are
    64-bit integers. A null key is a key; a key without values has null first, last and quantiles; an empty table
    gives no rows; ties and repeated rows count each. Names of the input's columns don't matter.
    """
    sums = sums or {}
    base = df.select(key.alias("key"), value.cast("long").alias("v"), *[c.cast("long").alias(f"s{i}") for i, c in enumerate(sums.values())])
    # The first histogram has a bin for each length of a value in bits, below and above zero, and one for null.
    length = F.length(F.bin("v"))
    size = F.when(F.col("v") < 0, -F.length(F.bin(F.bitwise_not("v")))).otherwise(length)
    hist = materialize(
        base.groupBy("key", F.when(F.col("v").isNotNull(), size).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))]
        ),
        "histogram",
    )
    per_key = materialize(
        hist.groupBy("key").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
            F.min("lo").alias("first"),
            F.max("hi").alias("last"),
            *[F.sum(f"s{i}").alias(n) for i, n in enumerate(sums)],
        ),
        "keys",
    )
    if not probs:
        return per_key
    base = base.select("key", "v")
    ranks = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n_values"))).cast("long") for p in probs])
    wanted = per_key.filter("n_values > 0").select(F.col("key").alias("k"), F.posexplode(ranks).alias("q", "rank"))
    bins = hist.filter("bin is not null").withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bin")))  # at most 128 rows a key
    hit = bins.join(wanted, bins["key"].eqNullSafe(wanted["k"])).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    open_ = materialize(hit.select("key", "q", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi"), "intervals")
    done = []
    while True:
        done.append(open_.filter("lo = hi").select("key", "q", F.col("lo").alias("at")))
        rest = open_.filter("lo < hi")
        n = rest.count()  # one number
        if not n:
            break
        open_ = materialize(_refine(base, rest, n, bits, broadcast_rows), "intervals")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("q") == i, F.col("at"))).alias(f"q{i}") for i in range(len(probs))])
    k = per_key.withColumnRenamed("key", "k")
    out = k.join(wide, k["k"].eqNullSafe(wide["key"]), "left")
    return out.select(k["k"].alias("key"), "n_rows", "n_values", "first", "last", *[f"q{i}" for i in range(len(probs))], *sums)


def _refine(base: DataFrame, intervals: DataFrame, n: int, bits: int, broadcast_rows: int) -> DataFrame:
    """One round: the bin of each interval that holds its rank, with the rank counted from the bin's start."""
    s = intervals.select(
        F.col("key").alias("k"), "q", "rank", "lo", "hi", F.greatest(F.lit(0), F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - bits).cast("int").alias("shift")
    )
    rows = base.filter("v is not null")
    if n <= broadcast_rows:
        joined = rows.join(F.broadcast(s), rows["key"].eqNullSafe(s["k"]) & F.col("v").between(F.col("lo"), F.col("hi")))
    else:
        salts = max(SALTS, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")
        s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("row_salt", salt)
        joined = rows.join(s, rows["key"].eqNullSafe(s["k"]) & (F.col("row_salt") == F.col("salt")) & F.col("v").between(F.col("lo"), F.col("hi")))
    counts = joined.groupBy("k", "q", "rank", "lo", "hi", "shift", F.expr("shiftright(v, shift)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("k", "q").orderBy("bin")  # at most 2**bits rows
    upto = counts.withColumn("upto", F.sum("n").over(w))
    hit = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    start = F.expr("shiftleft(bin, shift)")
    return hit.select(
        F.col("k").alias("key"),
        "q",
        (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
        F.greatest("lo", start).alias("lo"),
        F.least("hi", start + (F.expr("shiftleft(1L, shift)") - 1)).alias("hi"),
    )


def heavy_keys(profile: DataFrame, percent: int) -> DataFrame:
    """Keys of a profile that hold at least ``percent`` percent of all rows, the null key's rows counting among them."""
    total = profile.agg(F.sum("n_rows")).first()[0] or 0  # one number
    return profile.filter(F.col("key").isNotNull() & (F.col("n_rows") * 100 >= F.lit(total * percent)))


def selected_heavy_keys(df: DataFrame, key: Column, percent: int, bits: int = 10, places: int = PLACES) -> DataFrame:
    """(key, n_rows) of the keys that hold at least ``percent`` percent of all rows, the null key's rows counting among
    them, by exact selection: no table of all keys is made.

    With the rows in the order of their keys' places, a key with so many rows covers one of the ranks that lie half as
    far apart. The places at these ranks are selected; only keys there, a bounded number of places, are counted.
    ``places`` is a power of two less one.
    """
    base = df.select(key.alias("key"))
    place = F.when(F.col("key").isNotNull(), F.xxhash64("key").bitwiseAND(F.lit(places)))
    ranks = -(-200 // percent)
    profile = key_profile(base, F.lit(0), place, [i / ranks for i in range(1, ranks + 1)], bits=bits).first()  # one row
    total = profile["n_rows"] if profile else 0
    at = sorted({profile[f"q{i}"] for i in range(ranks)} - {None}) if profile else []
    counts = base.filter(place.isin(at)).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") * 100 >= F.lit(total * percent))


__all__ = ["heavy_keys", "key_profile", "selected_heavy_keys"]
