"""Token search over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.codes import SOCIETY_CODES


def query_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.sub("[^a-z0-9]+", " ", query.lower()).split(" ") if t]


def search(catalog: DataFrame, query: str, limit: int | None = 80, text: str = "search_text") -> DataFrame:
    """Rows whose normalised text has every token of the query as a substring, in order of name and key; ``limit`` is a result page."""
    hay = X.search_norm(F.col(text))
    found = catalog.where(X.matches_all(hay, query_tokens(query)))
    return found.orderBy("name", "sku").limit(limit) if limit else found


def expand_prefix(dimension: DataFrame, query: str, name: str, least: int = 2) -> DataFrame:
    """Codes of a dimension whose normalised name starts with the query; shorter queries than ``least`` match nothing."""
    q = " ".join(query_tokens(query))
    return dimension.where(X.search_norm(F.col(name)).startswith(q) & F.lit(len(q) >= least))


def society_codes(spark: SparkSession) -> DataFrame:
    """code and label of every distillery of the society: a fixed, small dimension."""
    return spark.createDataFrame([tuple(line.split(" ", 1)) for line in SOCIETY_CODES.strip().splitlines()], "code string, label string")


def search_with_codes(catalog: DataFrame, dimension: DataFrame, query: str, code: str = "code", name: str = "label") -> DataFrame:
    """Rows that have every token of the query (priority 0), and those whose name has a code that the query's prefix expands to (priority 1); each row once, by its first reason.

    One scan without a shuffle: the dimension's codes are matched by a join whose right
    side is reduced to the query's codes. A query without tokens finds nothing.
    """
    tokens = query_tokens(query)
    codes = expand_prefix(dimension, query, name).select(F.col(code).alias("code_")).where("code_ is not null").distinct().withColumn("by_code_", F.lit(True))
    # A name without a code gives an empty one, which no row of the dimension may stand for.
    coded = catalog.withColumn("code_", F.nullif(F.regexp_extract("name", r"([0-9]{1,3})\.[0-9]{1,4}", 1), F.lit("")))
    direct = X.matches_all(X.search_norm(F.col("search_text")), tokens) if tokens else F.lit(False)
    found = coded.join(codes, "code_", "left").withColumn("priority", F.when(direct, 0).when(F.col("by_code_"), 1))
    return found.where("priority is not null").select(*catalog.columns, "priority")
