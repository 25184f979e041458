from pyspark.sql import Column, functions as F


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)
