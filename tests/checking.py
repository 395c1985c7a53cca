"""Exact comparison of a Spark result with a DuckDB result."""

import math


def _value(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark_df, con, sql):
    """None when both hold the same rows under the same column names."""
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    found = [tuple(row) for row in spark_df.collect()]
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}"
    left, right = _sorted_rows(spark_df.columns, found), _sorted_rows(names, expected)
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first: {different[0]}"
    return None
