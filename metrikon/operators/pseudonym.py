"""Pseudonyms by salted hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pseudo_id


def mapping(df: DataFrame, site: str, prefix: str, key: str, salt: str, digits: int = 8) -> DataFrame:
    """(site, key, PSEUDO_ID): to be kept apart from the tables."""
    return df.select(F.col(site), F.col(key), pseudo_id(F.col(prefix), F.col(key).cast("string"), salt, digits).alias("PSEUDO_ID")).distinct()


def pseudonymise(df: DataFrame, prefix: str, key: str, salt: str, digits: int = 8) -> DataFrame:
    """The table with PSEUDO_ID first and without its key."""
    rest = [c for c in df.columns if c != key]
    return df.select(pseudo_id(F.col(prefix), F.col(key).cast("string"), salt, digits).alias("PSEUDO_ID"), *rest)


def collisions(pairs: DataFrame, key: str) -> DataFrame:
    """Pseudonyms that stand for more than one key; short hashes have some among many keys."""
    return pairs.groupBy("PSEUDO_ID").agg(F.countDistinct(key).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails the query that uses it if a key occurs twice, null among them: the check runs as part of the plan."""
    counted = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"))
    text = F.concat(F.lit("duplicate key: "), F.concat_ws(",", *(F.coalesce(F.col(f"_k{i}").cast("string"), F.lit("null")) for i in range(len(keys)))))
    checked = counted.where(F.when(F.col("_n") > 1, F.raise_error(text).cast("boolean")).otherwise(True))
    return df.join(checked, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")
