"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as Python's strip() knows it, in a form that Java and RE2 read alike.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
TOKEN = r"[\p{L}\p{N}_]+"


def strip(c: Column | str) -> Column:
    """Without white space at the ends, of any script."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokenize(c: Column | str) -> Column:
    """Words of two characters or more, case kept, repeats kept."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(c: Column | str) -> Column:
    """The vector over its norm, as doubles; a zero vector stays zero."""
    c = F.col(c) if isinstance(c, str) else c
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group, from 1.  Scores are rounded to 9 decimals before ranking, so
    that the order of summation cannot turn it; ties go to the smaller ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(score), 9).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def ordered_join(order: Column | list[Column], text: Column | str, separator: str) -> Column:
    """Aggregate: the texts of a group joined in the given order."""
    order = order if isinstance(order, list) else [order]
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(text) if isinstance(text, str) else text.alias("t"))))
    name = text if isinstance(text, str) else "t"
    return F.array_join(F.transform(rows, lambda r: r[name]), separator)
