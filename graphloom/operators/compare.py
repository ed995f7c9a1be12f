"""Comparing graphs, and graphs with the facts they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, normal_number
from graphloom.operators.model import OPM
from graphloom.operators.triples import COLUMNS, OBJECT, difference

GENERATED, SCHEMA_VALUE = "http://www.w3.org/ns/prov#generatedAtTime", ("http://schema.org/value", "https://schema.org/value")
EXPRESS, LISTS = "https://w3id.org/express#", "https://w3id.org/list#"


def renamed(triples: DataFrame, names: DataFrame) -> DataFrame:
    """``triples`` with subjects and objects of ``names`` (old, new) replaced."""
    rows = triples.join(names.select(F.col("old").alias("s"), F.col("new").alias("_s")), "s", "left")
    rows = rows.join(names.select(F.col("old").alias("o"), F.lit("iri").alias("o_kind"), F.col("new").alias("_o")), ["o", "o_kind"], "left")
    return rows.withColumns({"s": F.coalesce("_s", "s"), "o": F.coalesce("_o", "o")}).select(*COLUMNS)


def normalized(triples: DataFrame, base: str | None = None, ignored: tuple[str, ...] = (), states: bool = True, scalars: bool = False) -> DataFrame:
    """``triples`` in a form that two runs share: ``base`` replaced, ``ignored`` predicates left out, numbers in their plainest
    form; ``states`` are named after the property they belong to, and their time is left out of account; ``scalars`` and
    lists are named after what they hold."""
    if base:
        at = lambda c: F.replace(F.col(c), F.lit(base), F.lit("urn:compare-base:"))
        triples = triples.withColumns({"s": at("s"), "p": at("p"), "o": F.when(F.col("o_kind") == "iri", at("o")).otherwise(F.col("o"))})
    rows = triples.where(~F.col("p").isin(*ignored)) if ignored else triples
    if states or scalars:
        rows = rows.withColumn("o", F.when(F.col("o_kind") == "literal", normal_number(F.col("o"), F.col("o_dt"))).otherwise(F.col("o")))
    if scalars:
        rows = _scalars(rows)
        rows = _lists(rows)
    if states:
        owner = rows.where((F.col("p") == OPM + "hasPropertyState") & (F.col("o_kind") == "iri")).groupBy(F.col("o").alias("old")).agg(F.concat(F.lit("urn:compare-state:"), F.min("s")).alias("new"))
        rows = renamed(rows, owner)
        timed = F.col("p") == GENERATED
        rows = rows.withColumns({"o": F.when(timed, "normalized").otherwise(F.col("o")), "o_dt": F.when(timed, "").otherwise(F.col("o_dt")), "p": F.when(F.col("p").isin(*SCHEMA_VALUE), OPM + "value").otherwise(F.col("p"))})
    return rows.select(*COLUMNS).distinct()


def _scalars(rows: DataFrame) -> DataFrame:
    """Nodes with a type and a value are named after both."""
    holds = F.col("p").startswith(EXPRESS)
    per = rows.where(holds | (F.col("p") == RDF_TYPE)).groupBy("s").agg(F.min(F.when(F.col("p") == RDF_TYPE, F.col("o"))).alias("t"), F.min(F.when(holds, F.struct("p", *OBJECT))).alias("v"))
    names = per.where("t IS NOT NULL AND v IS NOT NULL").select(F.col("s").alias("old"), F.concat_ws(":", F.lit("urn:compare-scalar"), "t", "v.p", "v.o", "v.o_dt").alias("new"))
    return renamed(rows, names)


def _lists(rows: DataFrame) -> DataFrame:
    """List nodes are named after the contents from there to the end, found from the end backwards: each round names the
    nodes whose successor has a name, so there are as many as the longest list has nodes; a ring stays as it is."""
    per = rows.groupBy("s").agg(
        F.min(F.when((F.col("p") == RDF_TYPE) & F.col("o").endswith("_List"), F.col("o"))).alias("t"), F.min(F.when(F.col("p") == LISTS + "hasContents", F.col("o"))).alias("c"), F.min(F.when(F.col("p") == LISTS + "hasNext", F.col("o"))).alias("n")
    )
    nodes = per.where("t IS NOT NULL AND c IS NOT NULL").checkpoint()
    name = lambda rest: F.concat(F.lit("urn:compare-list:"), F.sha1(F.concat_ws("|", "t", "c", rest)))
    done = nodes.where("n IS NULL").select(F.col("s").alias("old"), name(F.lit("nil")).alias("new")).checkpoint()
    front = done
    while True:
        front = nodes.join(front.select(F.col("old").alias("n"), F.col("new").alias("_next")), "n").select(F.col("s").alias("old"), name(F.col("_next")).alias("new")).checkpoint()
        if front.isEmpty():
            return renamed(rows, done)
        done = done.union(front)


def compare(left: DataFrame, right: DataFrame, bases: tuple[str | None, str | None] = (None, None), **options) -> DataFrame:
    """Triples that one of two graphs has and the other lacks, after ``normalized``, with side: left or right."""
    return difference(normalized(left, bases[0], **options), normalized(right, bases[1], **options))


def counts(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, expected, found, ok) of every class that ``facts`` (name, expected) or the graph has: typed subjects against
    what the source holds."""
    found = triples.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("name")).agg(F.count_distinct("s").alias("found"))
    both = facts.join(found, "name", "full").select("name", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("ok", F.col("expected") == F.col("found"))


def spot_check(triples: DataFrame, expected: DataFrame, sample: int, seed: int = 42) -> DataFrame:
    """``expected`` (s, p, o) rows of a sample by hash, at most ``sample``, with found: whether the graph has them."""
    some = expected.select("s", "p", "o").distinct().orderBy(F.xxhash64(F.lit(seed), "s", "p", "o"), "s", "p", "o").limit(sample)
    have = triples.where("o_kind = 'iri'").select("s", "p", "o").distinct().withColumn("found", F.lit(True))
    return some.join(have, ["s", "p", "o"], "left").select("s", "p", "o", F.coalesce("found", F.lit(False)).alias("found"))


def quantities(a: DataFrame, b: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(guid, name, a, b, difference, ok) of quantities (guid, name, value) of two sources; difference is relative to ``b``,
    null where one is missing, and ok is then false."""
    rows = a.select("guid", "name", F.col("value").alias("a")).join(b.select("guid", "name", F.col("value").alias("b")), ["guid", "name"], "full")
    gap = F.when(F.col("b") != 0, F.abs(F.col("a") - F.col("b")) / F.abs(F.col("b"))).otherwise(F.abs(F.col("a") - F.col("b")))
    return rows.withColumn("difference", gap).withColumn("ok", F.coalesce(F.col("difference") <= threshold, F.lit(False)))


def geometry_coverage(elements: DataFrame, representations: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(id, entity_name, status, reason): whether an element has geometry. representations: id, item (null for one without
    items). No representation, none of its items known, or all well."""
    known = representations.groupBy("id").agg(F.count("*").alias("n"), F.count("item").alias("items"), F.sum(F.col("item").isin(*supported).cast("int")).alias("known"))
    rows = elements.select("id", "entity_name").join(known, "id", "left")
    reason = F.when(F.col("n").isNull(), "no representation").when(F.col("items") == 0, "no items").when(F.coalesce("known", F.lit(0)) == 0, "unsupported items")
    return rows.select("id", "entity_name", F.when(reason.isNull(), "has geometry").otherwise("missing").alias("status"), reason.alias("reason"))


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("entity_name", "status", "reason").agg(F.count("*").alias("n"))


def _has(c: Column, text: str) -> Column:
    return F.coalesce(c.contains(text), F.lit(False))


def name_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on a clean-up of sets (set, name): members before and after, names with characters outside ASCII, names in
    segments."""
    n = before.agg(F.count("*").alias("before"), F.sum(F.col("name").rlike(r"[^\x00-\x7F]").cast("int")).cast("long").alias("non_ascii"), F.sum((_has(F.col("name"), ":") | _has(F.col("name"), "/")).cast("int")).cast("long").alias("segmented"))
    return n.crossJoin(F.broadcast(after.agg(F.count("*").alias("after"))))  # a row each
