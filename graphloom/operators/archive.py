"""Tables of a columnar archive of a model: entities, properties, quantities, relationships, and meshes with their buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def typed_value(kind: Column, value: Column, measured: Column) -> dict[str, Column]:
    """PropType, ValueString, ValueReal and ValueInt of a value: kinds string, enum, bool, int, real; ``measured``: it is of a
    measure's type. What a type has no use for is null or zero."""
    real, whole, true = value.try_cast("double"), value.try_cast("int"), value.isin("true", "T")
    text, number = kind.isin("string", "enum"), kind.isin("int", "real")
    name = F.when(kind.isNull(), "null").when(number & measured, "measure").when(kind == "int", "integer").when(kind == "bool", "boolean").when(measured & (kind == "enum"), "unknown").when(kind.isin("real", "string", "enum"), kind).otherwise("unknown")
    return {
        "PropType": name,
        "ValueString": F.when(text & (name != "unknown"), value).when(kind == "bool", true.cast("string")),
        "ValueReal": F.when(number, F.coalesce(real, F.lit(0.0))).when(kind == "bool", true.cast("double")).otherwise(F.lit(0.0)),
        "ValueInt": F.when(kind == "int", F.coalesce(whole, F.lit(0))).when(kind == "bool", true.cast("int")).otherwise(F.lit(0)),
    }


def entities_table(rows: DataFrame, full: bool = True) -> DataFrame:
    """rows: id, guid, entity_name, has_geometry; ids and GUIDs alone unless ``full``."""
    own = [F.col("id").cast("long").alias("ExpressId"), F.col("guid").alias("GlobalId")]
    return rows.select(*own, *([F.col("entity_name").alias("Type"), F.col("has_geometry").alias("HasGeometry")] if full else []))


def properties_table(links: DataFrame, sets: DataFrame, members: DataFrame, values: DataFrame) -> DataFrame:
    """links: object, set; sets: set, set_guid, set_name; members: set, item; values: item, name, kind, value, measure."""
    rows = links.join(sets, "set").join(members, "set").join(values, "item")
    split = typed_value(F.col("kind"), F.col("value"), F.coalesce(F.col("measure"), F.lit("")) != "")
    return rows.select(F.col("object").alias("EntityId"), F.col("set_name").alias("PsetName"), F.col("set_guid").alias("PsetGlobalId"), F.col("name").alias("PropName"), *[c.alias(n) for n, c in split.items()])


def quantities_table(links: DataFrame, sets: DataFrame, members: DataFrame, quantities: DataFrame) -> DataFrame:
    """quantities: item, name, entity_name, value (double; null counts as zero)."""
    rows = links.join(sets, "set").join(members, "set").join(quantities, "item")
    return rows.select(F.col("object").alias("EntityId"), F.col("set_name").alias("QsetName"), F.col("name").alias("QuantityName"), F.col("entity_name").alias("QuantityType"), F.coalesce(F.col("value"), F.lit(0.0)).alias("Value"))


def relationships_table(relations: dict[str, DataFrame]) -> DataFrame:
    """relations: name of a kind to its pairs, two columns, source first."""
    out = None
    for name, pairs in relations.items():
        a, b = pairs.columns
        part = pairs.select(F.col(a).cast("long").alias("SourceId"), F.col(b).cast("long").alias("TargetId"), F.lit(name).alias("RelType"), F.lit(0).cast("long").alias("RelId"))
        out = part if out is None else out.unionByName(part)
    return out


def world(point: Column, matrix: Column) -> Column:
    """struct<x, y, z> of a point under a 4 by 4 matrix, array<double> by columns."""
    at = lambda row: sum((F.get(matrix, F.lit(4 * k + row)) * point[c] for k, c in enumerate("xyz")), F.get(matrix, F.lit(12 + row)))
    return F.struct(*[at(k).alias(c) for k, c in enumerate("xyz")])


def turned(normal: Column, matrix: Column) -> Column:
    """struct<x, y, z> of a direction under the matrix, of length one; one of no length stays as it is."""
    at = [sum((F.get(matrix, F.lit(4 * k + row)) * normal[c] for k, c in enumerate("xyz")), F.lit(0.0)) for row in range(3)]
    length = F.sqrt(at[0] * at[0] + at[1] * at[1] + at[2] * at[2])
    return F.struct(*[F.when(length > 0, v / length).otherwise(normal[c]).alias(c) for v, c in zip(at, "xyz")])


def mesh_tables(vertices: DataFrame, triangles: DataFrame) -> dict[str, DataFrame]:
    """VertexBuffer, IndexBuffer and Meshes of vertices (id, pos, point, normal) and triangles (id, pos, a, b, c: positions of
    the mesh's vertices): rows in the order of id and position, with pos there; a mesh's starts are running sums over meshes."""
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    sizes = count(vertices, "VertexCount").join(count(triangles, "IndexCount"), "id", "full").na.fill(0, ["VertexCount", "IndexCount"])
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # one row a mesh
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    meshes = sizes.select(F.col("id").cast("long").alias("ExpressId"), start("VertexCount").alias("VertexStart"), "VertexCount", start("IndexCount").alias("IndexStart"), "IndexCount")
    at = meshes.select(F.col("ExpressId").alias("id"), "VertexStart", "IndexStart")
    point = lambda c, names: [F.col(f"{c}.{x}").cast("float").alias(n) for x, n in zip("xyz", names)]
    buffer = vertices.join(at, "id").select((F.col("VertexStart") + F.col("pos")).alias("Row"), *point("point", "XYZ"), *point("normal", ("NormalX", "NormalY", "NormalZ")))
    index = triangles.join(at, "id").select((F.col("IndexStart") + F.col("pos")).alias("Row"), *[F.col(x).cast("long").alias(f"Index{k}") for k, x in enumerate("abc")])
    return {"VertexBuffer": buffer, "IndexBuffer": index, "Meshes": meshes}


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, Snappy-compressed; buffers in the order of their rows."""
    for name, df in tables.items():
        rows = df.repartitionByRange("Row").sortWithinPartitions("Row").drop("Row") if "Row" in df.columns else df
        rows.write.option("compression", "snappy").parquet(f"{path}/{name}.parquet")
