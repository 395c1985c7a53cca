"""Column expressions for category and friend strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points a Unicode-aware strip removes.
WHITESPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)

# Replacements applied to a category string, in this order. The
# last one deletes every pair of spaces, so "x &y" becomes "xy".
CATEGORY_REPLACEMENTS = [("&", " "), ("/", " "), ("(", ""), (")", ""), ("  ", "")]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def clean_labels(categories: Column, keep_empty: bool = True) -> Column:
    """Cleaned labels of a comma-separated category string; null stays null.

    An empty string holds one empty label, which ``keep_empty=False`` removes.
    """
    cleaned = categories
    for old, new in CATEGORY_REPLACEMENTS:
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    labels = F.transform(F.split(cleaned, ","), lambda label: F.lower(strip(label)))
    return labels if keep_empty else F.array_remove(labels, "")


def friend_ids(friends: Column) -> Column:
    """Stripped pieces of a comma-separated friend string."""
    return F.transform(F.split(friends, ","), strip)


def num_friends(friends: Column) -> Column:
    """Number of comma pieces; ``'None'`` and the empty string count as one."""
    return F.size(F.split(friends, ",")).cast("bigint")


def years_on_site(since: Column, as_of: int) -> Column:
    return (F.lit(as_of) - F.substring(since, 1, 4).cast("int")).cast("bigint")
