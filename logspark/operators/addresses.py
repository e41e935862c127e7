"""Distinct client addresses, exactly, from bitmaps.

A dotted IPv4 address in its usual spelling is a number below 2**32, hence one bit in
one of 131,072 bitmaps of 4 kB. Tasks combine their bits before the exchange, which
carries bitmaps and no addresses; bitmaps of several days or runs are combined with OR,
so their union needs no second look at the lines. Whatever else stands for a client
counts as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def address_number(ip: Column) -> Column:
    """1 to 2**32 for a dotted IPv4 address without leading zeros, else NULL."""
    parts = F.split(ip, "[.]")
    number = sum((parts[i].cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(1).cast("bigint"))
    return F.when(ip.rlike(rf"\A(?:{_OCTET}[.]){{3}}{_OCTET}\z"), number)


def address_bitmaps(rows: DataFrame, by: tuple[str, ...] = (), ip: str = "ip") -> DataFrame:
    """``(*by, bucket, bitmap)``: the IPv4 addresses that occur, a state that can be kept and merged."""
    numbered = rows.select(*by, address_number(F.col(ip)).alias("_number")).where("_number IS NOT NULL")
    return numbered.groupBy(*by, F.bitmap_bucket_number("_number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The union of the bitmaps of each group."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bits(bitmaps: DataFrame) -> DataFrame:
    """One row ``ipv4``: the number of addresses in the bitmaps, one of a bucket."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0).cast("long")).alias("ipv4"))


def distinct_addresses(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """One row ``(ipv4, other, unique_ips)``; NULLs do not count."""
    other = rows.where(address_number(F.col(ip)).isNull()).agg(F.count_distinct(ip).alias("other"))
    both = bits(address_bitmaps(rows, (), ip)).unionByName(other, allowMissingColumns=True)
    both = both.agg(F.max("ipv4").alias("ipv4"), F.max("other").alias("other"))
    return both.withColumn("unique_ips", F.col("ipv4") + F.col("other"))
