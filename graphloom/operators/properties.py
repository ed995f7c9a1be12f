"""Triples of properties and quantities: property sets of objects, their values as states, units, standard attributes, and
what a match adds to them.

Tables: objects (object, subject, guid, cls), links (object, set), sets (set, set_guid, set_name), members (set, pos, item),
values (item, name, kind, value, measure, unit), where a property with several values has a row for each with ``n``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import MEASURES, QUANTITY_UNITS, RDF_TYPE, XSD, canonical_decimal, fnv1a64, local_name, lookup, measure_unit, norm_key, percent_token, signature, unit_iri
from graphloom.operators.model import OPM, PROPS, node_iri, value_literal
from graphloom.operators.triples import COLUMNS, about, expand, exploded, first_wins, iri, literal

LABEL, COMMENT = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#comment"
OBJECT_PROPERTY = "http://www.w3.org/2002/07/owl#ObjectProperty"
GENERATED, VALUE, HAS_UNIT = "http://www.w3.org/ns/prov#generatedAtTime", "https://schema.org/value", "http://qudt.org/schema/qudt/unit"
GEO = "http://www.opengis.net/ont/geosparql#"


@dataclass(frozen=True)
class MatchNames:
    """Namespaces of what a match adds: its own vocabulary, classes and properties of the dictionary."""

    meta: str = "http://example.org/match#"
    classes: str = "http://example.org/dictionary/class/"
    props: str = "http://example.org/dictionary/prop/"


def unit_table(units: DataFrame, assigned: DataFrame) -> DataFrame:
    """(unit_type, unit_iri) of the assigned units that have an IRI; of several of one type the one with the highest id.
    units: unit, kind (si or conversion), unit_type, prefix, unit_name; assigned: unit."""
    rows = units.join(assigned.select("unit").distinct(), "unit").select("unit", "unit_type", unit_iri(F.col("kind"), F.col("unit_name"), F.col("prefix")).alias("unit_iri"))
    rows = rows.where("unit_type IS NOT NULL AND unit_iri IS NOT NULL")
    return rows.groupBy("unit_type").agg(F.max_by("unit_iri", "unit").alias("unit_iri"))


def with_units(rows: DataFrame, units: DataFrame, by_type: DataFrame) -> DataFrame:
    """``rows`` (unit, measure, entity) with unit_iri: that of the unit a value names, else the assigned one of its measure,
    or of its kind of quantity; null if there is none. A named unit without an IRI leaves it null."""
    own = units.select("unit", unit_iri(F.col("kind"), F.col("unit_name"), F.col("prefix")).alias("_own"))
    quantity = lookup(QUANTITY_UNITS, F.col("entity"))
    kinds = by_type.select(F.col("unit_type").alias("_type"), F.col("unit_iri").alias("_assigned")).where(F.col("_type").isin(*{k for _, k in MEASURES}))
    out = rows.join(own, "unit", "left").withColumn("_type", F.coalesce(quantity, measure_unit(F.col("measure")))).join(kinds, "_type", "left")
    return out.withColumn("unit_iri", F.when(F.col("unit").isNotNull(), F.col("_own")).otherwise(F.col("_assigned"))).drop("_own", "_type", "_assigned")


def deduplicated_sets(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` without those whose normalised name and values another member of the set has before them."""
    mark = values.groupBy("item").agg(F.concat_ws("|", norm_key(F.first("name")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", signature(F.col("kind"), F.col("value"), F.col("measure")).alias("s")))), lambda x: x["s"]), "|")).alias("_mark"))
    rows = members.join(mark, "item", "left").withColumn("_mark", F.coalesce("_mark", F.concat(F.lit("unknown|"), F.col("item"))))
    return first_wins(rows, ["set", "_mark"], ["pos"]).select(*members.columns)


def set_contents(members: DataFrame, values: DataFrame) -> DataFrame:
    """(set, content): sorted ``name=value`` of all members, joined by |. Sets with equal contents are one in the compact form."""
    rows = members.join(values, "item").select("set", F.concat_ws("=", norm_key(F.col("name")), signature(F.col("kind"), F.col("value"), F.col("measure"))).alias("pair"))
    return rows.groupBy("set").agg(F.array_join(F.array_sort(F.collect_list("pair")), "|").alias("content"))


def object_values(objects: DataFrame, links: DataFrame, sets: DataFrame, members: DataFrame, values: DataFrame) -> DataFrame:
    """One row for each object, set, member and value, with ``o``: the value as an object of a triple. Values that are blank,
    not positive where they must be, or equal to their name make none."""
    rows = objects.join(links, "object").join(sets, "set").join(members, ["set"]).join(values, "item")
    measure = F.coalesce(F.col("measure"), F.lit(""))
    rows = rows.withColumn("v", value_literal(F.when(F.col("value").isNotNull(), F.col("value")), measure))
    return rows.where(F.col("v").isNotNull() & (F.trim("value") != F.trim("name")))


def _hashed(base: str, mark: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/{mark}_"), fnv1a64(F.concat_ws("|", *parts)))


def states(rows: DataFrame, base: str, generated: str, namespace: str = PROPS) -> DataFrame:
    """Triples of property values (subject, guid, set_guid, set_name, name, v, unit_iri): the object's link, the property with
    its label, its state with time, value and unit. IRIs are hashes of name, set and object, and of the value for states, so
    the same input gives the same IRIs and repeated rows the same triples."""
    name = local_name(F.col("name"))
    key = (name, F.col("set_guid"), F.col("guid"))
    label = F.concat_ws(":", F.nullif(F.coalesce("set_name", F.lit("")), F.lit("")), "name")
    rows = rows.withColumns({"_n": name, "_p": _hashed(base, "p", *key), "_s": _hashed(base, "s", *key, F.col("v.o")), "_l": label})
    link = about(F.col("subject"), [(F.concat(F.lit(namespace), F.col("_n")), iri(F.col("_p")))])
    return exploded(rows, link + _stated() + _timed(generated)).distinct()


def _stated() -> list[Column]:
    return about(F.col("_p"), [(RDF_TYPE, iri(OPM + "Property")), (LABEL, literal(F.col("_l"))), (OPM + "hasPropertyState", iri(F.col("_s")))])


def _timed(generated: str) -> list[Column]:
    unit = F.when(F.col("unit_iri").isNotNull(), iri(F.col("unit_iri")))
    return about(F.col("_s"), [(RDF_TYPE, iri(OPM + "CurrentPropertyState")), (GENERATED, literal(generated, XSD + "dateTime")), (VALUE, F.col("v")), (HAS_UNIT, unit)])


def match_triples(rows: DataFrame, base: str, generated: str, names: MatchNames = MatchNames(), container: str = "containsProperty", compact: bool = False, shared: bool = False) -> DataFrame:
    """Triples of matched property values: rows of ``object_values`` with unit_iri and what ``matching.ladder`` found (status,
    method, code, candidates, confidence), and set_code (of ``matching.resolve_classes``) and content (of ``set_contents``).

    The object has the set and the property, the set contains the property (``container``), the property has its dictionary
    code as a type or its candidates, its state and label, and unless ``compact`` how it was matched. ``shared``: sets with
    equal contents, and properties with equal set name, name and value, are one node; a distinct on triples leaves their
    definitions once, whatever the number of objects."""
    m = names.meta
    name = local_name(F.col("name"))
    own = (name, F.col("set_guid"), F.col("guid"))
    common = (name, F.coalesce("set_name", F.lit("")), F.col("v.o"))
    root = base.rstrip("/")
    if shared:
        ids = {"_set": _hashed(base, "cps", F.coalesce("set_name", F.lit("")), F.col("content")), "_p": _hashed(base, "cp", *common), "_s": _hashed(base, "cs", *common)}
    else:
        ids = {"_set": F.concat(F.lit(f"{root}/{'qs' if container == 'containsQuantity' else 'ps'}_"), percent_token(F.col("set_guid"))), "_p": _hashed(base, "p", *own), "_s": _hashed(base, "s", *own, F.col("v.o"))}
    rows = rows.withColumns(ids).withColumn("_l", F.concat_ws(":", F.coalesce("set_name", F.lit("")), "name"))
    kind = "QuantitySet" if container == "containsQuantity" else "PropertySet"
    each = about(F.col("subject"), [(m + f"has{kind}", iri(F.col("_set"))), (m + "hasProperty", iri(F.col("_p")))])
    custom = F.when(F.col("set_code").isNotNull(), iri(F.concat(F.lit(names.classes), F.col("set_code")))).otherwise(iri(m + f"Custom{kind}"))
    each += about(F.col("_set"), [(RDF_TYPE, iri(m + kind)), (RDF_TYPE, custom), (LABEL, F.when(F.col("set_name") != "", literal(F.col("set_name")))), (m + container, iri(F.col("_p")))])
    each += about(F.col("_p"), [(RDF_TYPE, F.when(F.col("code").isNotNull(), iri(F.concat(F.lit(names.props), F.col("code")))))]) + _stated()
    if not compact:
        confidence = F.when(F.col("confidence").isNotNull(), literal(F.format_string("%.4f", F.col("confidence")), XSD + "decimal"))
        known = iri(F.when(F.col("status") == "unmapped", m + "CustomProperty").otherwise(m + "Property"))
        each += about(F.col("_p"), [(RDF_TYPE, known), (m + "mappingStatus", iri(F.concat(F.lit(m), F.initcap("status")))), (m + "matchingMethod", literal(F.col("method"))), (m + "matchingConfidence", confidence)])
    candidate = lambda c: about(F.col("_p"), [(m + "candidateProperty", iri(F.concat(F.lit(names.props), c)))])[0]
    return exploded(rows, each + _timed(generated), F.transform("candidates", candidate)).distinct()


# Standard attributes by column, their local names and datatypes (d: double with the length unit, i: integer).
NODE_ATTRIBUTES = (
    ("guid", "globalIdIfcRoot", ""), ("name", "nameIfcRoot", ""), ("description", "descriptionIfcRoot", ""), ("object_type", "objectTypeIfcObject", ""), ("long_name", "longNameIfcSpatialElement", ""),
    ("elevation", "elevationIfcBuildingStorey", "d"), ("ref_elevation", "refElevationIfcSite", "d"), ("elevation_of_ref_height", "elevationOfRefHeightIfcBuilding", "d"), ("elevation_of_terrain", "elevationOfTerrainIfcBuilding", "d"),
)
ELEMENT_ATTRIBUTES = (
    ("guid", "globalIdIfcRoot", ""), ("name", "nameIfcRoot", ""), ("description", "descriptionIfcRoot", ""), ("object_type", "objectTypeIfcObject", ""), ("tag", "batid", ""),
    ("overall_height", "overallHeight", "d"), ("overall_width", "overallWidth", "d"), ("number_of_risers", "numberOfRiserIfcStairFlight", "i"), ("number_of_treads", "numberOfTreadsIfcStairFlight", "i"),
    ("riser_height", "riserHeightIfcStairFlight", "d"), ("tread_length", "treadLengthIfcStairFlight", "d"),
)
OLD_LONG_NAME = "longNameIfcSpatialStructureElement"


def attributes(rows: DataFrame, listed=ELEMENT_ATTRIBUTES, version: str = "IFC4") -> DataFrame:
    """(subject, guid, name, v, lengthy) of the standard attributes that ``rows`` (subject, guid, entity_name and their columns)
    have: one scan, one explode. Empty descriptions make none; heights and widths of doors and windows, and long names in the
    oldest version, have names of their own."""
    entity = F.initcap(F.substring(F.lower("entity_name"), 4, 100)) if "entity_name" in rows.columns else F.lit("")
    out = []
    for column, local, kind in listed:
        if column not in rows.columns:
            continue
        c = F.col(column)
        name = F.lit(OLD_LONG_NAME if column == "long_name" and version == "IFC2X3" else local)
        if column in ("overall_height", "overall_width"):
            name = F.when(entity.isin("Door", "Window"), F.concat(name, F.lit("Ifc"), entity)).otherwise(name)
        text = c.cast("string") if kind != "d" else canonical_decimal(c.cast("double"))
        value = literal(text, {"": "", "d": XSD + "double", "i": XSD + "integer"}[kind])
        keep = c.isNotNull() & (c != "") if column == "description" else c.isNotNull()
        out.append(F.when(keep, F.struct(name.alias("name"), value.alias("v"), F.lit(kind == "d").alias("lengthy"))))
    return rows.select("subject", "guid", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("a")).select("subject", "guid", "a.*")


def attribute_triples(found: DataFrame, base: str, generated: str, length_unit: str | None = None, namespace: str = PROPS, declared: bool = True) -> DataFrame:
    """Triples of ``attributes``: the link, the property and its state, as ``states`` has them, under ``namespace``; with
    ``declared`` each predicate once as an object property with a comment."""
    unit = F.when(F.col("lengthy"), F.lit(length_unit).cast("string"))
    key = (F.col("name"), F.col("guid"), F.col("guid"))
    rows = found.withColumns({"_p": _hashed(base, "p", *key), "_s": _hashed(base, "s", *key, F.col("v.o")), "_l": F.col("name"), "unit_iri": unit})
    predicate = F.concat(F.lit(namespace), F.col("name"))
    out = exploded(rows, about(F.col("subject"), [(predicate, iri(F.col("_p")))]) + _stated() + _timed(generated))
    if declared:
        used = found.select("name").distinct()
        out = out.union(expand(used, predicate, [(RDF_TYPE, iri(OBJECT_PROPERTY)), (COMMENT, literal(F.concat(F.lit("IFC standard attribute "), F.col("name"))))]))
    return out.distinct()


def surface_wkt() -> Column:
    """A box (x_min .. z_max) as a closed surface of six faces."""
    at = {f"{x}{k}": canonical_decimal(F.col(f"{x}_{side}")) for x in "xyz" for k, side in ((0, "min"), (1, "max"))}
    # the corners of each face, as bits of x, y and z
    faces = ((0b000, 0b100, 0b110, 0b010), (0b001, 0b011, 0b111, 0b101), (0b000, 0b001, 0b101, 0b100), (0b100, 0b101, 0b111, 0b110), (0b110, 0b111, 0b011, 0b010), (0b010, 0b011, 0b001, 0b000))
    corner = lambda b: F.concat_ws(" ", at[f"x{b >> 2 & 1}"], at[f"y{b >> 1 & 1}"], at[f"z{b & 1}"])
    rings = [F.concat(F.lit("(("), F.concat_ws(", ", *[corner(b) for b in (*face, face[0])]), F.lit("))")) for face in faces]
    return F.concat(F.lit("POLYHEDRALSURFACE Z ("), F.concat_ws(", ", *rings), F.lit(")"))


def box_triples(objects: DataFrame, boxes: DataFrame, wkts: DataFrame, base: str, has_box: str = "http://example.org/geometry#hasBoundingBox") -> DataFrame:
    """Geometry of objects (object, subject, guid) that have a text of their own (wkts: object, wkt) or else a box (boxes:
    object, x_min .. z_max) that is no point."""
    sizes = [F.abs(F.col(f"{x}_max") - F.col(f"{x}_min")) for x in "xyz"]
    some = boxes.where((sizes[0] > 2.220446049250313e-16) | (sizes[1] > 2.220446049250313e-16) | (sizes[2] > 2.220446049250313e-16)).select("object", surface_wkt().alias("box"))
    rows = objects.join(some.join(wkts.select("object", "wkt"), "object", "full"), "object").withColumn("text", F.coalesce("wkt", "box"))
    rows = rows.withColumn("_g", node_iri(base, F.lit("geometry"), F.col("guid")))
    own = expand(rows, F.col("subject"), [(has_box, iri(F.col("_g")))])
    return own.union(expand(rows, F.col("_g"), [(RDF_TYPE, iri(GEO + "Geometry")), (GEO + "asWKT", literal(F.col("text"), GEO + "wktLiteral"))])).select(*COLUMNS)


OMG = "https://w3id.org/omg#"


def geometry_links(things: DataFrame, base: str) -> DataFrame:
    """Each thing (subject, guid) has a geometry node of its own."""
    node = node_iri(base, F.lit("geometry"), F.col("guid"))
    return exploded(things, about(F.col("subject"), [(OMG + "hasGeometry", iri(node))]) + about(node, [(RDF_TYPE, iri(OMG + "Geometry"))]))


def product_types(elements: DataFrame, declared: DataFrame, namespace: str) -> DataFrame:
    """Types of elements (subject, product, predefined) in a vocabulary that declares only some classes (name): the product's
    class, and with a predefined type ``Product-TYPE`` too; classes that are not declared, and types of products that are
    not, make none. NOTDEFINED and USERDEFINED are no types."""
    known = elements.where("product IS NOT NULL").join(declared.select(F.col("name").alias("product")).distinct(), "product", "left_semi")
    typed = F.when(~F.col("predefined").isin("NOTDEFINED", "USERDEFINED"), F.concat_ws("-", "product", "predefined"))
    names = known.select("subject", F.explode(F.filter(F.array("product", typed), lambda x: x.isNotNull())).alias("name"))
    return expand(names.join(declared.select("name").distinct(), "name", "left_semi"), F.col("subject"), [(RDF_TYPE, iri(F.concat(F.lit(namespace), F.col("name"))))])
