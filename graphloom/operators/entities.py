"""Every argument of every STEP entity as triples.

``full``: scalars are nodes of their own with their type and value, one node for each type and value (its IRI is a hash, so
equal ones meet without a shared counter); lists are chains of nodes with contents and successor. ``projected``: scalars are
literals, lists a sequence or, where their range is no list, plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD, XSD_BOOLEAN, XSD_INTEGER, fnv1a64, pascal_name, value_to_string
from graphloom.operators.topology import with_checkpoints
from graphloom.operators.triples import COLUMNS, OBJECT, iri, literal

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
VALUE = "struct<k:string,t:string,v:string>"


@dataclass(frozen=True)
class Names:
    """Namespaces: of entities and their properties, of scalar values, of lists."""

    own: str = "http://example.org/entities#"
    express: str = "https://w3id.org/express#"
    lists: str = "https://w3id.org/list#"


def arguments(entities: DataFrame) -> DataFrame:
    """(id, entity_name, pos, k, t, v): each argument's kind, type and value as text or JSON."""
    args = F.from_json("args", f"array<{VALUE}>")
    return entities.select("id", "entity_name", F.posexplode(args).alias("pos", "a")).select("id", "entity_name", "pos", "a.k", "a.t", "a.v")


def _plain(k: Column, t: Column, v: Column) -> dict[str, Column]:
    """Kind, type and value of a scalar; a typed value is what it holds, with its type."""
    inner = F.from_json(v, VALUE)
    typed = k == "typed"
    return {"k": F.when(typed, inner["k"]).otherwise(k), "t": F.when(typed, t), "v": F.when(typed, inner["v"]).otherwise(v)}


def predicates(args: DataFrame, known: DataFrame) -> DataFrame:
    """``args`` with predicate and range: those of ``known`` (entity_name, pos, predicate, range), else arg_N and none."""
    rows = args.join(known.select("entity_name", "pos", "predicate", "range"), ["entity_name", "pos"], "left")
    return rows.withColumn("predicate", F.coalesce("predicate", F.concat(F.lit("arg_"), F.col("pos") + 1)))


def _scalar(k: Column, v: Column) -> Column:
    """A literal, null for what is no scalar."""
    double = literal(value_to_string(v.try_cast("double")), XSD + "double")
    return F.when(k.isin("string", "enum", "binary"), literal(v)).when(k == "int", literal(v, XSD_INTEGER)).when(k == "bool", literal(v, XSD_BOOLEAN)).when(k == "real", double)


# Predicate of a scalar by its kind.
HOLDS = {"string": "hasString", "enum": "hasString", "binary": "hasString", "int": "hasInteger", "real": "hasDouble", "bool": "hasBoolean"}


def _with_objects(rows: DataFrame, base: str, mode: str, subjects: DataFrame) -> DataFrame:
    """``rows`` (k, t, v, range) with o: an object, null if there is none, and with node, cls for a scalar's own node."""
    own = subjects.select(F.col("id").alias("_ref"), F.col("iri").alias("_iri"))
    rows = rows.withColumn("_ref", F.when(F.col("k") == "ref", F.col("v").try_cast("bigint"))).join(own, "_ref", "left")
    cls, text = F.coalesce(pascal_name(F.col("t")), F.col("range")), _scalar(F.col("k"), F.col("v"))
    if mode == "projected":
        rows = rows.withColumns({"cls": F.lit(None).cast("string"), "node": F.lit(None).cast("string")})
        return rows.withColumn("o", F.when(F.col("_iri").isNotNull(), iri(F.col("_iri"))).otherwise(text))
    rows = rows.withColumns({"_text": text, "cls": F.when(text.isNotNull(), cls)})
    node = F.concat(F.lit(base.rstrip("/") + "/"), F.col("cls"), F.lit("_"), fnv1a64(F.concat_ws("|", "cls", "_text.o_dt", "_text.o")))
    rows = rows.withColumn("node", F.when(F.col("cls").isNotNull(), node))
    return rows.withColumn("o", F.when(F.col("_iri").isNotNull(), iri(F.col("_iri"))).when(F.col("node").isNotNull(), iri(F.col("node"))))


def _triples(rows: DataFrame, s: Column, p: Column, o: str = "o") -> DataFrame:
    out = rows.select(s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), *[F.col(f"{o}.{c}").alias(c) for c in OBJECT], F.lit("").alias("g"))
    return out.where("s IS NOT NULL AND o IS NOT NULL").select(*COLUMNS)


def emit(entities: DataFrame, known: DataFrame, base: str, mode: str = "full", names: Names = Names()) -> DataFrame:
    """Triples of entities (id, entity_name, args) with ``known`` predicates and ranges (see ``predicates``); a range that ends
    in _List makes its lists nodes, whose items have the range before that ending. References to entities that are not there
    and values without a type or range make no triple in ``full`` mode. Lists within lists are nodes of their own."""
    subjects = entities.select("id", "entity_name", F.concat(F.lit(base.rstrip("/") + "/"), pascal_name(F.col("entity_name")), F.lit("_"), F.col("id")).alias("iri"))
    out = _triples(subjects.withColumn("o", iri(F.concat(F.lit(names.own), pascal_name(F.col("entity_name"))))), F.col("iri"), F.lit(RDF_TYPE))
    args = predicates(arguments(entities), known).where("k NOT IN ('null', 'derived')").join(subjects.select("id", "iri"), "id").withColumnRenamed("iri", "s")
    args = args.withColumn("p", F.concat(F.lit(names.own), F.col("predicate")))
    listed = F.coalesce(F.col("range").endswith("_List"), F.lit(False))
    items = F.from_json("v", f"array<{VALUE}>")
    lists = args.where("k = 'list'").withColumn("items", items).where(F.size("items") > 0)
    bare = F.forall("items", lambda x: x["k"].isin("ref", "typed") if mode == "full" else x["k"] != "list")
    # plain items: the value of a reference keeps the range, a typed one has its own type
    flat = lists.where(~listed & bare).select("id", "s", "p", F.explode("items").alias("a"), "range").select("id", "s", "p", "a.k", "a.t", "a.v", F.when(F.col("a.k") == "typed", F.lit(None).cast("string")).otherwise(F.col("range")).alias("range"))
    scalars = args.where("k <> 'list'").select("id", "s", "p", "k", "t", "v", "range").union(flat)
    chains = lists.where(listed | ~bare).select("s", "p", "items", F.coalesce("range", F.lit("Value_List")).alias("cls"), F.concat_ws("_", F.lit("list"), "id", "pos").alias("path"))
    while not chains.isEmpty():  # a round for each level of lists in lists
        nodes, scalar_items, chains = _chain(chains, base, mode, names)
        out = out.union(nodes)
        scalars = scalars.union(scalar_items)
    done = _with_objects(scalars.withColumns(_plain(F.col("k"), F.col("t"), F.col("v"))), base, mode, subjects)
    if mode == "full":  # three kinds of triples read them, and hashes are dear
        with_checkpoints(entities.sparkSession)
        done = done.select("s", "p", "k", "cls", "node", "o", F.col("_text").alias("ov")).checkpoint()
    out = out.union(_triples(done, F.col("s"), F.col("p")))
    if mode == "full":
        own = done.where("node IS NOT NULL").withColumns({"ot": iri(F.concat(F.lit(names.own), F.col("cls")))})
        holds = F.lit("")
        for kind, local in HOLDS.items():
            holds = F.when(F.col("k") == kind, names.express + local).otherwise(holds)
        out = out.union(_triples(own, F.col("node"), F.lit(RDF_TYPE), "ot").distinct()).union(_triples(own, F.col("node"), holds, "ov").distinct())
    return out


def _chain(chains: DataFrame, base: str, mode: str, names: Names) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of lists (s, p, items, cls, path): the triples of their nodes, their scalar items, the lists inside them."""
    at = lambda n: F.concat(F.lit(base.rstrip("/") + "/"), F.col("cls"), F.lit("_"), fnv1a64(F.concat_ws("_", F.col("path"), n)))
    item = F.when(F.col("cls").endswith("_List"), F.regexp_replace("cls", "_List$", ""))
    rows = chains.select("s", "p", "cls", "path", F.size("items").alias("n"), F.posexplode("items").alias("pos", "a"))
    heads = chains.select("s", "p", iri(at(F.lit(0))).alias("o"))
    if mode == "projected":
        out = _triples(heads, F.col("s"), F.col("p")).union(_triples(chains.select(at(F.lit(0)).alias("s"), iri(RDF + "Seq").alias("o")), F.col("s"), F.lit(RDF_TYPE)))
        node, p = at(F.lit(0)), F.concat(F.lit(RDF + "_"), F.col("pos") + 1)
    else:
        own = rows.withColumns({"_n": at(F.col("pos")), "ot": iri(F.concat(F.lit(names.own), F.col("cls"))), "on": F.when(F.col("pos") + 1 < F.col("n"), iri(at(F.col("pos") + 1)))})
        out = _triples(heads, F.col("s"), F.col("p")).union(_triples(own, F.col("_n"), F.lit(RDF_TYPE), "ot")).union(_triples(own, F.col("_n"), F.lit(names.lists + "hasNext"), "on"))
        node, p = at(F.col("pos")), F.lit(names.lists + "hasContents")
    inside = rows.select(node.alias("s"), p.alias("p"), "a.k", "a.t", "a.v", item.alias("range"), F.concat_ws("_", "path", "pos").alias("path"))
    nested = inside.where("k = 'list'").withColumn("items", F.from_json("v", f"array<{VALUE}>")).where(F.size("items") > 0)
    scalars = inside.where("k NOT IN ('list', 'null', 'derived')").select(F.lit(None).cast("bigint").alias("id"), "s", "p", "k", "t", "v", "range")
    return out, scalars, nested.select("s", "p", "items", F.coalesce("range", F.lit("Value_List")).alias("cls"), "path")


def same_as(entities: DataFrame, things: DataFrame, base: str) -> DataFrame:
    """Links of things (id, iri) to their entities' nodes."""
    twin = F.concat(F.lit(base.rstrip("/") + "/"), pascal_name(F.col("entity_name")), F.lit("_"), F.col("id"))
    return _triples(things.join(entities.select("id", "entity_name"), "id").withColumn("o", iri(twin)), F.col("iri"), F.lit("http://www.w3.org/2002/07/owl#sameAs"))
