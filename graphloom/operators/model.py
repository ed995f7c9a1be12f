"""The building model as tables, from STEP entities, and the triples made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_INTEGER, canonical_decimal, fnv1a64, percent_token
from graphloom.operators.triples import COLUMNS, expand, iri, last_wins, literal
from graphloom.sources.step import argument, references

# Entity names of the spatial structure, and the names of their levels.
SPATIAL = {"IFCPROJECT": "project", "IFCSITE": "site", "IFCBUILDING": "building", "IFCBUILDINGSTOREY": "storey", "IFCSPACE": "space"}
BOT, OPM, PROPS = "https://w3id.org/bot#", "https://w3id.org/opm#", "https://w3id.org/props#"
# Predicate by the levels of parent and child.
LEVELS = {("project", "site"): "containsZone", ("site", "building"): "hasBuilding", ("building", "storey"): "hasStorey", ("storey", "space"): "hasSpace"}


def route(rows: DataFrame, name: Column, classes: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``cls``: the first of ``classes`` whose test holds, else null."""
    out = F.lit(None).cast("string")
    for cls, test in reversed(classes):
        out = F.when(test, cls).otherwise(out)
    return rows.withColumn("cls", out)


def shadowed(own: DataFrame, inherited: DataFrame) -> DataFrame:
    """(object, name, value) of an object's own sets and of those of its type whose name it has not itself; nameless sets
    are always inherited."""
    names = own.select("object", "name").where("name is not null").distinct()
    return own.select("object", "name", "value").union(inherited.join(names, ["object", "name"], "left_anti").select("object", "name", "value")).distinct()


def spatial_nodes(entities: DataFrame) -> DataFrame:
    level = F.create_map(*[F.lit(x) for pair in SPATIAL.items() for x in pair])
    return entities.where(F.col("entity_name").isin(*SPATIAL)).select("id", F.element_at(level, F.col("entity_name")).alias("level"), argument(0).alias("guid"), argument(2).alias("name"), argument(3).alias("description"))


def elements(entities: DataFrame, names: list[str]) -> DataFrame:
    return entities.where(F.col("entity_name").isin(*names)).select("id", "entity_name", argument(0).alias("guid"), argument(2).alias("name"), argument(3).alias("description"), argument(4).alias("object_type"), argument(7).alias("tag"))


def aggregates(entities: DataFrame) -> DataFrame:
    rel = entities.where(F.col("entity_name").isin("IFCRELAGGREGATES", "IFCRELNESTS"))
    return rel.select(argument(4, "ref").alias("parent"), F.explode(references(5)).alias("child"))


def containment(entities: DataFrame) -> DataFrame:
    """(element, structure); of several structures the one of the relation with the highest id."""
    rel = entities.where("entity_name = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select(F.col("id").alias("rel"), argument(5, "ref").alias("structure"), F.explode(references(4)).alias("element"))
    return last_wins(rel, ["element"], F.col("rel")).select("element", "structure")


def pairs_of(entities: DataFrame, name: str, one: int, other: int, names: tuple[str, str]) -> DataFrame:
    """A relation of two single references, e.g. voids (4, 5), fills (4, 5), space boundaries (4, 5)."""
    return entities.where(F.col("entity_name") == name).select(argument(one, "ref").alias(names[0]), argument(other, "ref").alias(names[1]))


def defined_by(entities: DataFrame, name: str = "IFCRELDEFINESBYPROPERTIES") -> DataFrame:
    rel = entities.where(F.col("entity_name") == name)
    return rel.select(F.explode(references(4)).alias("object"), argument(5, "ref").alias("definition"))


def property_values(entities: DataFrame) -> DataFrame:
    """(pset, pset_name, name, value) of single values, value as text."""
    psets = entities.where("entity_name = 'IFCPROPERTYSET'").select(F.col("id").alias("pset"), argument(2).alias("pset_name"), F.explode(references(4)).alias("prop"))
    single = entities.where("entity_name = 'IFCPROPERTYSINGLEVALUE'").select(F.col("id").alias("prop"), argument(0).alias("name"), F.coalesce(F.get_json_object("args", "$[2].v.v"), F.get_json_object("args", "$[2].v")).alias("value"))
    return psets.join(single, "prop").select("pset", "pset_name", "name", "value")


def node_iri(base: str, kind: Column, guid: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), kind, F.lit("_"), percent_token(guid))


def hierarchy(nodes: DataFrame, edges: DataFrame, levels: dict[tuple[str, str], str] = LEVELS) -> DataFrame:
    """(parent, child, predicate) of edges between nodes (id, level) of neighbouring levels; others are dropped."""
    out = F.lit(None).cast("string")
    for (a, b), p in levels.items():
        out = F.when((F.col("a") == a) & (F.col("b") == b), p).otherwise(out)
    rows = edges.join(nodes.select(F.col("id").alias("parent"), F.col("level").alias("a")), "parent").join(nodes.select(F.col("id").alias("child"), F.col("level").alias("b")), "child")
    return rows.select("parent", "child", out.alias("predicate")).where("predicate is not null").distinct()


def value_literal(value: Column, measure: Column) -> Column:
    """Object of a typed value; null for blanks and for positive measures that are not positive."""
    text = F.trim(value)
    number = text.try_cast("double")
    whole = text.rlike(r"^[+-]?\d+$")
    bad = (text == "") | (text == "-1.#IND") | (measure.contains("POSITIVE") & (number <= 0))
    kind = lambda v, dt: F.struct(v.alias("o"), F.lit("literal").alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit("").alias("o_lang"))
    return F.when(~F.coalesce(bad, F.lit(True)), F.when(whole, kind(text, XSD_INTEGER)).when(number.isNotNull(), kind(canonical_decimal(number), XSD_DECIMAL)).when(text.isin("true", "false"), kind(text, XSD_BOOLEAN)).otherwise(kind(text, "")))


def opm(rows: DataFrame, base: str, generated: str) -> DataFrame:
    """Triples of property values: rows of (subject, set_name, name, value): link, type, label, state, its type, its time
    and its value. Values equal to their name, blank or null make none."""
    rows = rows.where("value is not null and trim(value) <> '' and trim(value) <> trim(name)")
    key = F.concat_ws("|", "name", "set_name", "subject")
    rows = rows.withColumns({"_p": F.concat(F.lit(base.rstrip("/") + "/p_"), fnv1a64(key)), "_s": F.concat(F.lit(base.rstrip("/") + "/s_"), fnv1a64(F.concat_ws("|", key, "value")))})
    links = expand(rows, F.col("subject"), [(F.concat(F.lit(PROPS), percent_token(F.col("name"))), iri(F.col("_p")))])
    props = expand(rows, F.col("_p"), [(RDF_TYPE, iri(OPM + "Property")), ("http://www.w3.org/2000/01/rdf-schema#label", literal(F.col("name"))), (OPM + "hasPropertyState", iri(F.col("_s")))])
    states = expand(rows, F.col("_s"), [(RDF_TYPE, iri(OPM + "CurrentPropertyState")), ("http://www.w3.org/ns/prov#generatedAtTime", literal(generated, "http://www.w3.org/2001/XMLSchema#dateTime")), ("https://schema.org/value", value_literal(F.col("value"), F.lit("")))])
    return links.union(props).union(states).distinct()


def unpivot(rows: DataFrame, subject: Column, attributes: dict[str, str]) -> DataFrame:
    """One triple for each non-blank attribute: column to predicate."""
    return expand(rows, subject, [(p, F.when((F.col(c).cast("string") != ""), literal(F.col(c)))) for c, p in attributes.items()])


def building_graph(entities: DataFrame, base: str, element_names: list[str]) -> DataFrame:
    """Typed nodes and elements, the hierarchy and what storeys and spaces contain."""
    nodes, edges = spatial_nodes(entities), aggregates(entities)
    things = elements(entities, element_names)
    name = nodes.select("id", "level", node_iri(base, F.col("level"), F.col("guid")).alias("iri"))
    cls = F.create_map(*[F.lit(x) for pair in {"project": "Zone", "site": "Site", "building": "Building", "storey": "Storey", "space": "Space"}.items() for x in pair])
    own = things.select("id", node_iri(base, F.lower(F.substring("entity_name", 4, 100)), F.col("guid")).alias("iri"))
    out = expand(name, F.col("iri"), [(RDF_TYPE, iri(F.concat(F.lit(BOT), F.element_at(cls, F.col("level")))))]).union(expand(own, F.col("iri"), [(RDF_TYPE, iri(BOT + "Element"))]))
    levels = hierarchy(nodes, edges).join(name.select(F.col("id").alias("parent"), F.col("iri").alias("s")), "parent").join(name.select(F.col("id").alias("child"), F.col("iri").alias("c")), "child")
    out = out.union(expand(levels, F.col("s"), [(F.concat(F.lit(BOT), F.col("predicate")), iri(F.col("c")))]))
    held = containment(entities).join(name.select(F.col("id").alias("structure"), F.col("iri").alias("s")), "structure").join(own.select(F.col("id").alias("element"), F.col("iri").alias("c")), "element")
    return out.union(expand(held, F.col("s"), [(BOT + "containsElement", iri(F.col("c")))])).select(*COLUMNS)


# The alphabet of compressed ids.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def compress_guid(uuid: str) -> str:
    """UUID to 22 characters: 2 bits, then 21 groups of 6."""
    n = int(uuid.replace("-", ""), 16)
    return "".join(ALPHABET[n >> 6 * k & 63] for k in range(21, -1, -1))


def expand_guid(token: str) -> str:
    n = 0
    for ch in token:
        n = n << 6 | ALPHABET.index(ch)
    if len(token) != 22 or n >> 128:
        raise ValueError(f"no compressed id: {token}")
    h = f"{n:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
