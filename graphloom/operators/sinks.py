"""Sinks: N-Triples, N-Quads, Turtle, chunks with a manifest, Parquet tables. All are written by Spark's own writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.triples import ntriples_line, turtle_blocks


def write_ntriples(triples: DataFrame, path: str, graphs: bool = False, compression: str = "none") -> None:
    triples.select(ntriples_line(graphs).alias("value")).write.option("compression", compression).text(path)


def write_by_graph(triples: DataFrame, path: str) -> None:
    """A folder for each graph."""
    triples.select("g", ntriples_line(False).alias("value")).write.partitionBy("g").text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Grouped by subject, subjects in order within and across files; each file starts with the prefixes."""
    rows = turtle_blocks(triples, prefixes).repartitionByRange("s").sortWithinPartitions("s")
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items()))

    # the writer puts the prefixes before the first row of a file, so each file stands alone
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows.select(F.when(first, F.concat(F.lit(head), F.col("block"))).otherwise(F.col("block")).alias("value")).write.text(path)


def write_chunks(lines: DataFrame, path: str, lines_per_chunk: int) -> None:
    """``value`` lines in files of at most ``lines_per_chunk``, each with line count and bytes in ``_manifest``."""
    spark = lines.sparkSession
    lines.write.option("maxRecordsPerFile", lines_per_chunk).text(path)
    written = spark.read.text(path).select(F.input_file_name().alias("file"), (F.octet_length("value") + 1).alias("bytes"))
    manifest(written).coalesce(1).write.json(f"{path}/_manifest")


def manifest(rows: DataFrame, key: str = "file") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.option("compression", "snappy").parquet(f"{path}/{name}")


def run_log(counts: DataFrame) -> str:
    """Triples by graph as JSON; ``counts`` has a row for each graph of a run, i.e. for each module."""
    return json.dumps({r["g"]: r["n"] for r in counts.orderBy("g").collect()})
