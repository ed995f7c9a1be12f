"""The triples table: s, s_kind, p, o, o_kind, o_dt, o_lang, g; absent datatype, language and graph are empty strings, so
equality is plain equality on all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, compact_iri, escape_literal, lit_or

COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g")
OBJECT = ("o", "o_kind", "o_dt", "o_lang")


def iri(value: Column | str) -> Column:
    return _object(value, "iri")


def bnode(value: Column | str) -> Column:
    return _object(value, "bnode")


def literal(value: Column | str, datatype: str = "", language: str = "") -> Column:
    """A language wins over a datatype."""
    return _object(lit_or(value).cast("string"), "literal", "" if language else datatype, language)


def _object(value: Column | str, kind: str, dt: str = "", lang: str = "") -> Column:
    return F.struct(lit_or(value).alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit(lang).alias("o_lang"))


def expand(rows: DataFrame, subject: Column, pairs: list[tuple[str | Column, Column]], s_kind: str = "iri", graph: Column | str = "") -> DataFrame:
    """One triple per row and (predicate, object) with a non-null object and subject: one scan, one explode."""
    each = F.array(*[F.struct(lit_or(p).alias("p"), o.alias("v")) for p, o in pairs])
    out = rows.select(subject.alias("s"), lit_or(graph).alias("g"), F.explode(each).alias("e"))
    out = out.select("s", F.lit(s_kind).alias("s_kind"), F.col("e.p").alias("p"), *[F.col(f"e.v.{c}").alias(c) for c in OBJECT], "g")
    return out.where("s is not null and o is not null").select(*COLUMNS)


def about(subject: Column, pairs: list[tuple[str | Column, Column]]) -> list[Column]:
    """Triples of one subject, for ``exploded``."""
    return [F.struct(subject.alias("s"), lit_or(p).alias("p"), o.alias("v")) for p, o in pairs]


def exploded(rows: DataFrame, each: list[Column], more: Column | None = None) -> DataFrame:
    """The triples ``each`` row has, of several subjects (see ``about``; ``more``: an array of such), where subject and object
    are not null: one scan, one explode, whatever their number."""
    every = F.array(*each) if more is None else F.concat(F.array(*each), more)
    out = rows.select(F.explode(every).alias("e")).select(F.col("e.s").alias("s"), F.lit("iri").alias("s_kind"), F.col("e.p").alias("p"), *[F.col(f"e.v.{c}").alias(c) for c in OBJECT], F.lit("").alias("g"))
    return out.where("s is not null and o is not null").select(*COLUMNS)


def typed(rows: DataFrame, subject: Column, cls: str, graph: Column | str = "") -> DataFrame:
    return expand(rows, subject, [(RDF_TYPE, iri(cls))], graph=graph)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both ways: rows of one multiset that the other lacks, with ``side`` left or right."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return a.distinct().subtract(b).isEmpty()


def is_isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Equal sets of triples; blank nodes are compared by name."""
    return is_subset(a, b) and is_subset(b, a)


def matching(triples: DataFrame, s=None, p=None, o=None, g=None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o), ("g", g)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def without(triples: DataFrame, s=None, p=None, o=None, g=None) -> DataFrame:
    return triples.exceptAll(matching(triples, s, p, o, g))


def rename(triples: DataFrame, names: dict[str, str], columns: tuple[str, ...] = ("p",)) -> DataFrame:
    """Replace IRIs in the given columns. A mapping document's names are few: they go into the plan as a map."""
    if not names:
        return triples
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    for c in columns:
        to = F.coalesce(F.element_at(table, F.col(c)), F.col(c))
        triples = triples.withColumn(c, F.when(F.col("o_kind") == "iri", to).otherwise(F.col(c)) if c == "o" else to)
    return triples


def counts_by_graph(triples: DataFrame) -> DataFrame:
    return triples.groupBy("g").agg(F.count("*").alias("n"))


def distinct_objects(triples: DataFrame) -> DataFrame:
    """Objects differ if their kind, datatype or language do."""
    return triples.groupBy("s", "p").agg(F.count_distinct(F.struct(*OBJECT)).alias("n"))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the one with the greatest ``order``: an aggregation with map-side combination, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_r.{k}") for k in rows.columns])


def object_rank() -> Column:
    return F.when(F.col("o_kind") != "literal", 0).when(F.col("o_dt") == "", 1).otherwise(2)


def ordered(triples: DataFrame) -> DataFrame:
    return triples.orderBy("s", "p", object_rank(), "o", "o_dt")


def term_text(kind: str | Column, value: Column, dt: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), escape_literal(value), F.lit('"'), F.when(lang != "", F.concat(F.lit("@"), lang)).when(dt != "", F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise(""))
    return F.when(lit_or(kind) == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(lit_or(kind) == "bnode", F.concat(F.lit("_:"), value)).otherwise(quoted)


def ntriples_line(with_graph: bool = False) -> Column:
    none = F.lit("")
    parts = [term_text(F.col("s_kind"), F.col("s"), none, none), F.concat(F.lit("<"), F.col("p"), F.lit(">")), term_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))]
    line = F.concat_ws(" ", *parts)
    if with_graph:
        line = F.when(F.col("g") != "", F.concat(line, F.lit(" <"), F.col("g"), F.lit(">"))).otherwise(line)
    return F.concat(line, F.lit(" ."))


def turtle_blocks(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """s, block: a Turtle statement for each subject, predicates in order, objects of a predicate joined by commas, equal
    triples once. A subject's triples must fit in one row."""
    name = lambda c: compact_iri(c, prefixes)
    value = F.when(F.col("o_kind") == "iri", name(F.col("o"))).when(F.col("o_dt").startswith("http"), F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"^^'), name(F.col("o_dt")))).otherwise(term_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")))
    rows = triples.select("s", "s_kind", "p", object_rank().alias("rank"), "o", "o_dt", value.alias("text")).distinct()
    per = rows.groupBy("s", "s_kind", "p").agg(F.array_sort(F.collect_list(F.struct("rank", "o", "o_dt", "text"))).alias("objects"))
    per = per.select("s", "s_kind", "p", F.concat(F.when(F.col("p") == RDF_TYPE, "a").otherwise(name(F.col("p"))), F.lit(" "), F.array_join(F.transform("objects", lambda x: x["text"]), ", ")).alias("text"))
    out = per.groupBy("s", "s_kind").agg(F.array_sort(F.collect_list(F.struct("p", "text"))).alias("parts"))
    subject = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), F.col("s"))).otherwise(name(F.col("s")))
    return out.select("s", F.concat(subject, F.lit(" "), F.array_join(F.transform("parts", lambda x: x["text"]), " ;\n    "), F.lit(" .")).alias("block"))


def chunk_of_lines(lines: DataFrame, order: list[Column | str], chunk: int) -> DataFrame:
    """Lines with their number and chunk. Numbers run over ranges: counts of each range are summed on the side, so no
    task gets all lines."""
    return numbered(lines, order).withColumn("chunk", F.floor(F.col("line_no") / chunk).cast("long"))


def chunk_of_bytes(lines: DataFrame, order: list[Column | str], most: int, column: str = "value") -> DataFrame:
    """Lines with the chunk they fall in: a line is in the chunk of ``most`` bytes that holds its first byte, line ends
    counted. Sums run over ranges, as numbers do."""
    parts = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).withColumn("_n", F.octet_length(column).cast("long") + 1)
    parts = parts.persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = parts.groupBy("_p").agg(F.sum("_n").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0))).select("_p", "_b")
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_o", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(sizes), "_p")
    return rows.withColumn("chunk", F.floor((F.col("_b") + F.col("_o")) / most).cast("long")).drop("_p", "_i", "_n", "_b", "_o")


def used_prefixes(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(prefix) of those whose namespace an IRI of the triples is compacted with."""
    terms = triples.select(F.explode(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")), F.when(F.col("o_dt") != "", F.col("o_dt")))).alias("t")).where("t IS NOT NULL")
    short = compact_iri(F.col("t"), prefixes)
    return terms.select(F.when(~short.startswith("<"), F.substring_index(short, ":", 1)).alias("prefix")).where("prefix IS NOT NULL").distinct()


def as_triples(quads: DataFrame) -> DataFrame:
    """Quads without their graph; a literal with a language gets the datatype of such literals, and loses the tag."""
    tagged = F.col("o_lang") != ""
    return quads.withColumns({"o_dt": F.when(tagged, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(F.col("o_dt")), "o_lang": F.lit(""), "g": F.lit("")}).select(*COLUMNS)


def numbered(lines: DataFrame, order: list[Column | str]) -> DataFrame:
    """``lines`` with line_no from 0 in global ``order``, by a range-partitioned sort and per-partition counts."""
    parts = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = parts.persist()
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return parts.join(F.broadcast(before), "_p").withColumn("line_no", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")
