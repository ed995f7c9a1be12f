"""BPE encoding and decoding of a table's texts (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with array<int> ids_col. Null and empty texts: empty arrays. All rows and other columns stay."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([bpe.coder(vocabulary).ids(x) for x in batch], index=batch.index, dtype=object)

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with string text_col, decoded from ids_col. Null and empty arrays: empty texts."""

    @F.pandas_udf("string")
    def text(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in arrays:
            yield pd.Series(["".join(bpe.decode(bpe.coder(vocabulary), [[] if x is None else x])) for x in batch], index=batch.index, dtype=object)

    return df.withColumn(text_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row; ids and texts stay in blocks inside the worker. Null or empty
    texts: 0 tokens. Repeated rows give repeated results. No shuffle."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([bpe.digests(vocabulary, x) for x in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("_out")).select(id_col, "_out.*")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
