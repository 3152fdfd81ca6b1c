"""Token-set similarity of names, and the blocking that finds all similar pairs without comparing every two."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 95


def normalised(name: str | None) -> list[str]:
    """Sorted distinct tokens: ASCII only, other marks than letters, digits and _ become spaces, lower case."""
    ascii_only = (name or "").encode("ascii", "ignore").decode()
    return sorted(set(re.sub(r"\W", " ", ascii_only).lower().split()))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """100 times the share of characters that a common subsequence covers, rounded; 0 when either is empty."""
    if not a or not b:
        return 0
    return round(200 * common_length(a, b) / (len(a) + len(b)))


def token_set_ratio(a: str | None, b: str | None) -> int:
    """The best ratio among the shared tokens and either side's shared-then-own tokens; 100 when one side's tokens include the other's."""
    x, y = normalised(a), normalised(b)
    if not x or not y:
        return 0
    both = [t for t in x if t in y]
    shared = " ".join(both)
    left = " ".join([*both, *(t for t in x if t not in y)])
    right = " ".join([*both, *(t for t in y if t not in x)])
    return max(ratio(shared, left), ratio(shared, right), ratio(left, right))


def token_set_ratio_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y)], dtype="int32")

    return run(a, b)


def tokens_column(c: Column) -> Column:
    """normalised() as a column expression."""
    ascii_only = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(ascii_only, r"\W", " ")), r"\s+"), lambda t: t != "")))


def subset_pairs(names: DataFrame, col: str = "name") -> DataFrame:
    """small, big: different names of which one's tokens are all among the other's (the case that scores 100).

    Joined on the small side's rarest token, so that a common token gathers no pairs of its own.
    """
    own = names.select(F.col(col).alias("name")).where("name is not null").distinct().withColumn("tokens", tokens_column(F.col("name"))).where(F.size("tokens") > 0)
    each = own.select("name", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    key = each.join(often, "token").groupBy("name").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    small = own.join(key, "name").select(F.col("name").alias("small"), F.col("tokens").alias("s"), "token")
    big = own.join(each, "name").select(F.col("name").alias("big"), F.col("tokens").alias("b"), "token")
    return small.join(big, "token").where((F.col("small") != F.col("big")) & (F.size(F.array_except("s", "b")) == 0)).select("small", "big").distinct()


def _grams(c: Column) -> Column:
    """Distinct character pairs of the sorted tokens, space-joined between marks."""
    s = F.concat(F.lit("\u0002"), F.array_join(c, " "), F.lit("\u0003"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))


def similar_pairs(names: DataFrame, col: str = "name", threshold: int = THRESHOLD) -> DataFrame:
    """name1, name2 (name1 < name2), score: all pairs of different names with score >= threshold.

    Candidates share a token, or (when they share none) nearly all their text: their lengths differ by a tenth at most and they
    share a character pair. A pair without a shared character pair has no common subsequence long enough, unless the names
    are so short that one change already breaks the threshold.
    """
    own = names.select(F.col(col).alias("name")).where("name is not null").distinct().withColumn("tokens", tokens_column(F.col("name"))).where(F.size("tokens") > 0)
    own = own.withColumn("text", F.array_join("tokens", " "))
    token = own.select("name", F.explode("tokens").alias("key"))
    gram = own.select("name", F.length("text").alias("n"), F.explode(_grams(F.col("tokens"))).alias("key"))
    a, b = token.select(F.col("name").alias("name1"), "key"), token.select(F.col("name").alias("name2"), "key")
    by_token = a.join(b, "key").where("name1 < name2").select("name1", "name2")
    slack = (200.0 - (threshold - 0.5)) / (threshold - 0.5)  # longest / shortest at this score
    a, b = gram.select(F.col("name").alias("name1"), F.col("n").alias("n1"), "key"), gram.select(F.col("name").alias("name2"), F.col("n").alias("n2"), "key")
    by_gram = a.join(b, "key").where(f"name1 < name2 and n1 <= {slack} * n2 and n2 <= {slack} * n1").select("name1", "name2")
    pairs = by_token.unionByName(by_gram).distinct()
    return pairs.withColumn("score", token_set_ratio_column(F.col("name1"), F.col("name2"))).where(F.col("score") >= threshold)
