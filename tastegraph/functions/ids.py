"""Typed node ids and hashes, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastegraph import config


def user_node(user_id: Column) -> Column:
    return F.concat(user_id, F.lit(config.USER_SUFFIX))


def business_node(business_id: Column) -> Column:
    return F.concat(business_id, F.lit(config.BUSINESS_SUFFIX))


def label_node(label: Column) -> Column:
    return F.md5(label.cast("binary"))


def poly_hash(text: Column) -> Column:
    """Polynomial hash of the code points, kept to 31 bits at each step.

    Reducing modulo a power of two commutes with the arithmetic, so the running
    value never leaves a bigint.
    """
    return F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: (acc * config.HASH_BASE + F.ascii(ch)).bitwiseAND(F.lit(config.HASH_MASK)),
    )


def poly_bucket(text: Column, buckets: int = config.HASH_BUCKETS) -> Column:
    return poly_hash(text) % buckets


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a digest, from 1-based ``start``, as a bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
