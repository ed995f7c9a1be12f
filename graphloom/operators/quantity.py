"""Quantities: audits, gates, units, mesh measures and accuracy reports."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import compressed_guid, relative_error, unit_error, uuid5
from graphloom.operators.triples import numbered


def audit_missing(objects: DataFrame, expected: DataFrame, present: DataFrame) -> DataFrame:
    """(object, name) that the object's class asks for and no set of it has, names compared without case. A class
    without a list of its own takes that of its name without StandardCase or ElementedCase at the end.
    objects: object, cls; expected: cls, name; present: object, name."""
    known = expected.select("cls").distinct()
    plain = F.regexp_replace("cls", "(?i)(StandardCase|ElementedCase)$", "")
    listed = objects.join(known.withColumn("_has", F.lit(True)), "cls", "left").withColumn("cls", F.when(F.col("_has"), F.col("cls")).otherwise(plain)).drop("_has")
    asked = listed.join(expected, "cls").select("object", "name", F.lower("name").alias("_k"))
    return asked.join(present.select("object", F.lower("name").alias("_k")).distinct(), ["object", "_k"], "left_anti").select("object", "name")


def gate(rows: DataFrame, value: str = "value", net: str = "net", gross: str = "gross") -> DataFrame:
    """``rows`` with ``verdict``: not finite, not positive, net above gross, or accepted."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    over = F.coalesce(F.col(net) > F.col(gross) * (1 + 1e-9), F.lit(False))
    return rows.withColumn("verdict", F.when(~finite, "not finite").when(v <= 0, "not positive").when(over, "net above gross").otherwise("accepted"))


def unit_scales(units: DataFrame) -> DataFrame:
    """(kind, scale, conflict) of unit assignments (kind, scale): one scale, or a conflict."""
    out = units.groupBy("kind").agg(F.min("scale").alias("low"), F.max("scale").alias("high"))
    return out.select("kind", F.when(F.col("low") == F.col("high"), F.col("low")).alias("scale"), (F.col("low") != F.col("high")).alias("conflict"))


def nearest_rank(values: Column, n: Column, p: float) -> Column:
    """Of a sorted array, the element at round((n - 1) * p)."""
    return F.element_at(values, (F.floor((n - 1) * p + 0.5) + 1).cast("int"))


def report(comparisons: DataFrame, by: str, tolerance: float = 0.01) -> DataFrame:
    """Per ``by``: attempted, computed, coverage, within tolerance, median and 95th percentile (nearest rank) of
    ``relative_error`` (null where nothing was computed).

    Ranks without a window over a group: equal errors are counted first, with map-side combination; the rows with an error
    at a wanted rank are found on running counts of ranges of errors, so no task sorts a whole group."""
    counts = comparisons.groupBy(by).agg(F.count("*").alias("attempted"), F.count("relative_error").alias("computed"), F.sum((F.col("relative_error") <= tolerance).cast("int")).alias("within"))
    ranks = counts.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.floor((F.col("computed") - 1) * p + 0.5)).alias("rank")) for n, p in (("median", 0.5), ("p95", 0.95))])).alias("q")).select(by, "q.*")
    values = comparisons.where("relative_error IS NOT NULL").groupBy(by, "relative_error").agg(F.count("*").alias("n"))
    at = at_ranks(values, by, "relative_error", ranks).groupBy(by).pivot("name", ["median", "p95"]).agg(F.first("relative_error"))
    out = counts.join(at, by, "left")
    return out.select(by, "attempted", "computed", (F.col("computed") / F.col("attempted")).alias("coverage"), F.coalesce(F.col("within") / F.nullif(F.col("computed"), F.lit(0)), F.lit(0.0)).alias("within_share"), "median", "p95")


def at_ranks(values: DataFrame, by: str, value: str, ranks: DataFrame) -> DataFrame:
    """(by, name, value) of counted ``values`` (by, value, n) at the 0-based ``ranks`` (by, name, rank): values go into
    ranges of about the square root of their number; the range that holds a rank is found on the ranges' counts, and only
    its values are ranked."""
    total = values.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.ceil(F.sqrt(F.count("*"))).alias("_k"))
    rows = values.join(total, by)
    spread = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(F.lit(1.0))
    rows = rows.withColumn("_range", F.least(F.floor((F.col(value) - F.col("_low")) / spread * F.col("_k")), F.col("_k") - 1)).select(by, value, "n", "_range")
    sizes = rows.groupBy(by, "_range").agg(F.sum("n").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    wanted = sizes.join(ranks, by).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))).select(by, "_range", "name", (F.col("rank") - F.col("_before")).alias("_rest"))
    inside = Window.partitionBy(by, "_range", "name").orderBy(value)
    near = rows.join(wanted, [by, "_range"]).withColumn("_upto", F.sum("n").over(inside))
    return near.where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("n") <= F.col("_rest"))).select(by, "name", value)


def _cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _vertex(k: int) -> tuple:
    return tuple(F.col(f"v{k}.{x}") for x in "xyz")


def mesh_measures(triangles: DataFrame) -> DataFrame:
    """Per element of triangles (element_id, v0, v1, v2: x, y, z): volume by signed tetrahedra, area, the shadow on each
    axis plane, and extents. Everything is a sum, minimum or maximum, so it is combined before the shuffle."""
    a, b, c = _vertex(0), _vertex(1), _vertex(2)
    u, v = tuple(y - x for x, y in zip(a, b)), tuple(y - x for x, y in zip(a, c))
    n = _cross(u, v)
    bc = _cross(b, c)
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    aggs = [F.abs(F.sum((a[0] * bc[0] + a[1] * bc[1] + a[2] * bc[2]) / 6)).alias("volume"), F.sum(area).alias("area"), F.count("*").alias("triangles")]
    for k, x in enumerate("xyz"):
        aggs += [F.sum(F.abs(n[k]) / 4).alias(f"shadow_{x}"), (F.max(F.greatest(a[k], b[k], c[k])) - F.min(F.least(a[k], b[k], c[k]))).alias(f"extent_{x}")]
    return triangles.groupBy("element_id").agg(*aggs)


def sound(measures: DataFrame) -> DataFrame:
    """Measures with ``sound``: on every axis the volume is at most shadow times extent."""
    ok = F.lit(True)
    for x in "xyz":
        ok = ok & (F.col("volume") <= F.col(f"shadow_{x}") * F.col(f"extent_{x}") * (1 + 1e-6))
    return measures.withColumn("sound", ok)


def edge_incidence(faces: DataFrame) -> DataFrame:
    """Per element of faces (element_id, a, b, c: vertex ids): closed (each edge in two faces) and oriented (once each
    way)."""
    edges = faces.select("element_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("c").alias("y")), F.struct(F.col("c").alias("x"), F.col("a").alias("y")))).alias("e"))
    edges = edges.select("element_id", F.least("e.x", "e.y").alias("low"), F.greatest("e.x", "e.y").alias("high"), (F.col("e.x") < F.col("e.y")).cast("int").alias("forward"))
    per = edges.groupBy("element_id", "low", "high").agg(F.count("*").alias("n"), F.sum("forward").alias("forward"))
    return per.groupBy("element_id").agg(F.count("*").alias("edges"), F.bool_and(F.col("n") == 2).alias("closed"), F.bool_and((F.col("n") == 2) & (F.col("forward") == 1)).alias("oriented"))


def without_inner_faces(triangles: DataFrame) -> DataFrame:
    """``triangles`` without those whose three corners another triangle of the element has too: walls inside a body, which
    are no surface. Volumes do not change, as the two are counted with opposite signs."""
    corners = F.array_sort(F.array("v0", "v1", "v2"))
    rows = triangles.withColumn("_face", F.xxhash64(corners))
    twice = rows.groupBy("element_id", "_face").agg(F.count("*").alias("_n")).where("_n > 1").select("element_id", "_face")
    return rows.join(twice, ["element_id", "_face"], "left_anti").select(*triangles.columns)


#: Faces of an element that are labelled in one piece, in one task; elements of more go through rounds of joins.
PIECE = 1 << 18


def _labelled(faces: pa.Table) -> pa.Table:
    """Parts and vertices of whole elements, whose faces lie one after another."""
    ids = faces.column("element_id").combine_chunks()
    first = np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])
    of, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    corners = [(pc.fill_null(c, 0).to_numpy(), c.is_valid().to_numpy()) for c in (faces.column(x) for x in "abc")]
    ends = []
    for (x, x_is), (y, y_is) in ((corners[0], corners[1]), (corners[1], corners[2]), (corners[0], corners[2])):
        both = x_is & y_is
        ends.append((of[both], x[both], y[both]))
    of, x, y = (np.concatenate(z) for z in zip(*ends))
    points, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    nodes, at = np.unique(np.concatenate([of, of]) * len(points) + at, return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(x):  # roots hang under the least root next to them, until no edge joins two
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    of = nodes // max(len(points), 1)
    vertices = np.bincount(of, minlength=len(starts))
    parts = np.bincount(of[label == np.arange(len(nodes))], minlength=len(starts))
    out = pa.table({"element_id": ids.take(pa.array(starts)), "parts": pa.array(parts, pa.int64()), "vertices": pa.array(vertices, pa.int64())})
    return out.filter(pa.array(vertices > 0))


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_labelled`` over faces in the order of their elements; the last element of a batch may go on in the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        ids = rows.column("element_id").combine_chunks()
        last = int(pc.index(pc.equal(ids, ids[-1]), True).as_py())
        if last:
            yield from _labelled(rows.slice(0, last)).to_batches()
        held = rows.slice(last)
    if held is not None:
        yield from _labelled(held).to_batches()


def parts(faces: DataFrame, piece: int = PIECE) -> DataFrame:
    """(element_id, parts, vertices): connected parts of each element's mesh. faces: element_id, a, b, c (vertex ids).

    The faces go to their element's place once, in its order, and are labelled there; those of elements with more than
    ``piece`` faces, if there are any, by rounds of joins instead."""
    faces = faces.where("element_id IS NOT NULL").select("element_id", *[F.col(x).cast("long").alias(x) for x in "abc"])
    large = faces.groupBy("element_id").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("element_id").checkpoint()
    some = not large.isEmpty()
    small = faces.join(large, "element_id", "left_anti") if some else faces
    kind = faces.schema["element_id"].dataType.simpleString()
    out = small.repartition("element_id").sortWithinPartitions("element_id").mapInArrow(_in_pieces, f"element_id {kind}, parts long, vertices long")
    return out.unionByName(_parts_in_rounds(faces.join(large, "element_id", "left_semi"))) if some else out


def _parts_in_rounds(faces: DataFrame) -> DataFrame:
    """Labels spread over edges, each vertex taking the least of its neighbours' and its label's label, until none changes;
    rounds are checkpointed and grow with the logarithm of the longest way."""
    points = [F.col(x) for x in "abc"]
    pairs = F.array(*[F.struct(points[i].alias("x"), points[j].alias("y")) for i, j in ((0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0))])
    edges = faces.select("element_id", F.explode(pairs).alias("e")).select("element_id", "e.x", "e.y").distinct().checkpoint()
    label = edges.groupBy("element_id", "x").agg(F.min("y").alias("m")).select("element_id", "x", F.least("x", "m").alias("l")).checkpoint()
    while True:
        near = edges.join(label.select("element_id", F.col("x").alias("y"), "l"), ["element_id", "y"]).groupBy("element_id", "x").agg(F.min("l").alias("n"))
        own = label.join(near, ["element_id", "x"]).select("element_id", "x", "l", F.least("l", "n").alias("n"))
        jump = own.select("element_id", F.col("x").alias("n"), F.col("n").alias("j"))
        new = own.join(jump, ["element_id", "n"], "left").select("element_id", "x", F.least("n", F.coalesce("j", "n")).alias("new"), "l").checkpoint()
        label = new.select("element_id", "x", F.col("new").alias("l"))
        if new.where("new <> l").isEmpty():
            break
    return label.groupBy("element_id").agg(F.count_distinct("l").alias("parts"), F.count("*").alias("vertices"))


def trusted(measures: DataFrame, incidence: DataFrame, components: DataFrame) -> DataFrame:
    """``measures`` with ``proved``: one closed, oriented part whose volume its shadows can hold."""
    rows = sound(measures).join(incidence.select("element_id", "closed", "oriented"), "element_id", "left").join(components.select("element_id", "parts"), "element_id", "left")
    return rows.withColumn("proved", F.coalesce(F.col("closed") & F.col("oriented") & (F.col("parts") == 1) & F.col("sound"), F.lit(False)))


def profile_metrics(kind: Column, d: Column) -> Column:
    """struct<area, perimeter, min_span, max_span> of a profile of ``kind`` with its dimensions ``d`` (array<double>, in the
    order of the schema), null for unknown kinds or where a dimension needed is null. Fillets are left out."""
    x = lambda k: F.get(d, F.lit(k))
    or_else = lambda k, other: F.coalesce(x(k), other)
    zero, pi = F.lit(0.0), F.lit(math.pi)
    plus = lambda c: F.greatest(c, zero)
    a, b, c, e = x(0), x(1), x(2), x(3)
    flanged = 2 * b * e + plus(a - 2 * e) * c  # two flanges of width b and thickness e, a web of thickness c over depth a
    foot, top = or_else(1, a), or_else(3, zero)
    inner = lambda width, wall: plus(width - 2 * wall)
    low, high = (lambda *v: F.least(*v)), (lambda *v: F.greatest(*v))
    # kind: area, perimeter, least and greatest span
    formulas = {
        "RECTANGLE": (a * b, 2 * (a + b), low(a, b), high(a, b)),
        "ROUNDEDRECTANGLE": (a * b - (4 - pi) * or_else(2, zero) ** 2, 2 * (a + b) - 8 * or_else(2, zero) + 2 * pi * or_else(2, zero), low(a, b), high(a, b)),
        "RECTANGLEHOLLOW": (a * b - inner(a, c) * inner(b, c), 2 * (a + b), low(a, b), high(a, b)),
        "CIRCLE": (pi * a * a, 2 * pi * a, 2 * a, 2 * a),
        "CIRCLEHOLLOW": (pi * (a * a - plus(a - b) ** 2), 2 * pi * a, 2 * a, 2 * a),
        "ELLIPSE": (pi * a * b, pi * (3 * (a + b) - F.sqrt((3 * a + b) * (a + 3 * b))), 2 * low(a, b), 2 * high(a, b)),
        "ISHAPE": (2 * a * e + plus(b - 2 * e) * c, 2 * (a + b) + 2 * (a - c), low(a, b), high(a, b)),
        "ASYMMETRICISHAPE": (a * e + or_else(5, a) * or_else(6, e) + plus(b - e - or_else(6, e)) * c, 2 * b + a + or_else(5, a) + 2 * plus(a - c), low(a, or_else(5, a), b), high(a, or_else(5, a), b)),
        "TSHAPE": (b * e + plus(a - e) * c, 2 * (a + b) - c, low(a, b), high(a, b)),
        "LSHAPE": (c * (a + foot - c), 2 * (a + foot), c, high(a, foot)),
        "USHAPE": (flanged, 2 * (a + b) + 2 * plus(b - c), low(a, b), high(a, b)),
        "ZSHAPE": (flanged, 2 * (a + 2 * b), low(c, e), high(a, 2 * b)),
        "CSHAPE": (c * plus(a + 2 * b + 2 * top - 4 * c), 2 * (a + b), c, high(a, b)),
        "TRAPEZIUM": ((a + b) * c / 2, a + b + F.sqrt(top**2 + c * c) + F.sqrt((a - b - top) ** 2 + c * c), low(c, low(a, b)), high(c, high(a, b))),
    }
    out = F.lit(None).cast("struct<area:double,perimeter:double,min_span:double,max_span:double>")
    for name, values in formulas.items():
        whole = F.lit(True)
        for v in values:
            whole = whole & v.isNotNull()
        out = F.when((kind == name) & whole, F.struct(*[v.cast("double").alias(n) for v, n in zip(values, ("area", "perimeter", "min_span", "max_span"))])).otherwise(out)
    return out


def polygon_metrics(outline: Column, holes: Column) -> Column:
    """The same of a polygon, array<struct<x, y>>, less its holes (array of such): area by the shoelace formula, the length
    of the outline, its extents."""
    around = lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda u, v: F.sqrt((u["x"] - v["x"]) ** 2 + (u["y"] - v["y"]) ** 2))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    spans = [F.array_max(along) - F.array_min(along) for along in (F.transform(outline, lambda q: q["x"]), F.transform(outline, lambda q: q["y"]))]
    area = shoelace(outline) - total(F.transform(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), shoelace))
    return F.struct(F.greatest(area, F.lit(0.0)).alias("area"), F.when(F.size(outline) >= 3, total(around(outline))).otherwise(F.lit(0.0)).alias("perimeter"), F.least(*spans).alias("min_span"), F.greatest(*spans).alias("max_span"))


def composed(parts: DataFrame, key: str) -> DataFrame:
    """Metrics of profiles made of several (key, p: their metrics): areas and perimeters add, spans are the least and greatest."""
    return parts.where("p IS NOT NULL").groupBy(key).agg(F.struct(F.sum("p.area").alias("area"), F.sum("p.perimeter").alias("perimeter"), F.min("p.min_span").alias("min_span"), F.max("p.max_span").alias("max_span")).alias("p"))


def extrusion(profile: Column, depth: Column, direction: Column) -> Column:
    """struct<volume, lateral_area, total_area, height, depth> of a profile swept by ``depth`` along ``direction`` (struct<x,
    y, z>; null: upright): the height is the part across the profile. Null without a positive depth or where the sweep lies
    in the profile's plane."""
    z = F.coalesce(direction["z"], F.lit(1.0))
    length = F.coalesce(F.sqrt(direction["x"] ** 2 + direction["y"] ** 2 + direction["z"] ** 2), F.lit(1.0))
    cosine = F.abs(z / F.when(length >= 1e-12, length))
    ok = profile.isNotNull() & (depth > 0) & (depth < float("inf")) & (cosine >= 1e-12)
    lateral, height = profile["perimeter"] * depth, depth * cosine
    return F.when(ok, F.struct((profile["area"] * height).alias("volume"), lateral.alias("lateral_area"), (lateral + 2 * profile["area"]).alias("total_area"), height.alias("height"), depth.alias("depth")))


# Classes whose reference view is the plan, that carry along an axis, and that lie flat.
PLAN = ("IFCSLAB", "IFCSLABELEMENTEDCASE", "IFCSLABSTANDARDCASE", "IFCROOF", "IFCPLATE", "IFCPLATESTANDARDCASE", "IFCCOVERING", "IFCFOOTING", "IFCSPACE", "IFCRAMP")
BARS = ("IFCBEAM", "IFCCOLUMN", "IFCMEMBER", "IFCPILE", "IFCFOOTING")
WALLS, FLAT = ("IFCWALL", "IFCWALLSTANDARDCASE"), ("IFCSLAB", "IFCROOF", "IFCPLATE", "IFCCOVERING")


def rules() -> list[tuple[str, Column, Column, int]]:
    """(quantity, condition, value, tier) over a row of an element: cls (upper case), voided, inline_height, mesh (proved,
    volume, area, footprint, extents, box_area, box_round, fills) and sweep (parts, volume, p, total_area, height, depth).
    Of several that apply, the highest tier's value stands."""
    cls, m, w, p = F.col("cls"), F.col("mesh"), F.col("sweep"), F.col("sweep.p")
    solid, single = ~F.col("voided"), F.col("sweep.parts") == 1
    proved = m["proved"] & solid
    plan = cls.isin(*PLAN) & (m["footprint"] > 0)
    small = F.least(m["extent_x"], m["extent_y"], m["extent_z"])
    box = plan & (m["box_area"] > 0) & (F.abs(m["footprint"] - m["box_area"]) / m["box_area"] < 1e-3)
    wall_height = F.coalesce(F.col("inline_height"), w["height"])
    span = p["min_span"] * p["max_span"]
    rectangle = (span > 0) & (F.abs(p["area"] - span) / span < 1e-9)
    return [
        ("NetVolume", proved, m["volume"], 1), ("GrossVolume", proved, m["volume"], 1), ("NetSurfaceArea", m["area"] > 0, m["area"], 1),
        ("GrossFootprintArea", plan & solid, m["footprint"], 1), ("NetFootprintArea", plan, m["footprint"], 1), ("GrossArea", plan & solid, m["footprint"], 1), ("NetArea", plan, m["footprint"], 1),
        ("Width", plan & (m["extent_z"] <= small), m["extent_z"], 1), ("Perimeter", box, m["box_round"], 1), ("Height", cls.isin(*WALLS) & (m["extent_z"] > 0), m["extent_z"], 1), ("Depth", m["fills"], small, 1),
        ("Length", cls.isin(*BARS) & single, w["depth"], 2), ("GrossSurfaceArea", cls.isin(*BARS) & single, w["total_area"], 2),
        ("Height", cls.isin(*WALLS) & single, wall_height, 2), ("GrossFootprintArea", cls.isin(*WALLS) & single, p["area"], 2), ("NetFootprintArea", cls.isin(*WALLS) & single & solid, p["area"], 2),
        ("GrossSideArea", cls.isin(*WALLS) & single & rectangle, p["max_span"] * wall_height, 2),
        ("Depth", cls.isin(*FLAT) & single, w["height"], 2), ("GrossArea", cls.isin(*FLAT) & single, p["area"], 2), ("Perimeter", cls.isin(*FLAT) & single, p["perimeter"], 2),
        ("Height", (cls == "IFCSPACE") & single, w["height"], 2), ("GrossFloorArea", (cls == "IFCSPACE") & single, p["area"], 2), ("GrossPerimeter", (cls == "IFCSPACE") & single, p["perimeter"], 2),
        ("GrossVolume", solid & (w["parts"] >= 1), w["volume"], 2), ("NetVolume", solid & (w["parts"] >= 1), w["volume"], 2),
    ]


def computed(elements: DataFrame, missing: DataFrame) -> DataFrame:
    """(object, name, value, tier) of the ``missing`` quantities (object, name) that a rule gives for ``elements`` (object
    and the columns of ``rules``): one scan, one explode."""
    each = [F.when(F.coalesce(test, F.lit(False)) & value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(tier).alias("tier"))) for name, test, value, tier in rules()]
    rows = elements.select("object", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("q")).select("object", "q.*")
    best = rows.groupBy("object", "name").agg(F.max_by(F.struct("value", "tier"), "tier").alias("b"))
    return best.select("object", "name", "b.value", "b.tier").join(missing.select("object", "name").distinct(), ["object", "name"], "left_semi")


def existing_sets(links: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object, set_name, set): the set that quantities of ``wanted`` (object, set_name) go into: the last of the object's sets
    with that name, without case and outer space, else its first one that is only called BaseQuantities, else null.
    links: object, set, pos; sets: set, name."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    have = links.join(sets, "set").select("object", "set", "pos", plain("name").alias("_name"))
    rows = wanted.join(have, "object", "left").withColumn("_same", F.col("_name") == plain("set_name"))
    exact, bare = F.max_by("set", F.when(F.col("_same"), F.col("pos"))), F.min_by("set", F.when(F.col("_name") == "basequantities", F.col("pos")))
    return rows.groupBy("object", "set_name").agg(F.coalesce(exact, bare).alias("set"))


#: A namespace of this package's own.
SET_NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_URL, "http://example.org/computed-sets"))
# Entity of a quantity by the end of its name.
KINDS = (("Volume", "IFCQUANTITYVOLUME", 3), ("Area", "IFCQUANTITYAREA", 2))


def quantity_kind(name: Column) -> tuple[Column, Column]:
    """(entity name, dimension) of a quantity."""
    entity, dimension = F.lit("IFCQUANTITYLENGTH"), F.lit(1)
    for end, of, n in KINDS:
        entity, dimension = F.when(name.endswith(end), of).otherwise(entity), F.when(name.endswith(end), n).otherwise(dimension)
    return entity, dimension


def declared(value: Column, dimension: Column, geometry: Column, unit: Column) -> Column:
    """A value in units of the geometry (metres each) as the model declares it (SI units each)."""
    return value * F.pow(geometry, dimension) / unit


def checked(values: DataFrame) -> DataFrame:
    """``values`` (object, name, value) with verdict: see ``gate``; NetVolume is held against the object's GrossVolume."""
    gross = values.where("name = 'GrossVolume'").groupBy("object").agg(F.max("value").alias("gross"))
    rows = values.join(gross, "object", "left").withColumn("net", F.when(F.col("name") == "NetVolume", F.col("value")))
    return gate(rows).drop("net", "gross")


def inject(accepted: DataFrame, targets: DataFrame, objects: DataFrame, next_id: int, namespace: str = SET_NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """(quantities, sets) to add: ids after ``next_id`` in the order of object and name; a set for each object and set name
    that has none yet, whose GUID is a name-based UUID of both, so every run gives the same.
    accepted: object, set_name, name, value; targets: of ``existing_sets``; objects: object, guid."""
    rows = accepted.join(targets, ["object", "set_name"], "left").join(objects.select("object", "guid"), "object")
    new = rows.where("set IS NULL").select("object", "set_name", "guid").distinct()
    new = numbered(new, [F.col("object"), F.col("set_name")]).select("object", "set_name", (F.col("line_no") + next_id).alias("new_set"), compressed_guid(uuid5(namespace, F.concat_ws("|", "guid", "set_name"))).alias("set_guid"))
    first = next_id + new.count()
    numbers = numbered(rows, [F.col("object"), F.col("set_name"), F.col("name")]).withColumn("id", F.col("line_no") + first)
    out = numbers.join(new.select("object", "set_name", "new_set"), ["object", "set_name"], "left")
    quantities = out.select("id", "object", F.coalesce("set", "new_set").alias("set"), quantity_kind(F.col("name"))[0].alias("entity_name"), "name", "value")
    return quantities, new.select(F.col("new_set").alias("set"), "object", F.col("set_name").alias("name"), "set_guid", F.lit("Computed").alias("method"))


def compared(authored: DataFrame, values: DataFrame, factor: float = 1.0) -> DataFrame:
    """``authored`` (object, name, authored) with the computed value, relative error and whether it looks like a mistaken
    unit; null where nothing was computed."""
    rows = authored.join(values.select("object", "name", F.col("value").alias("computed")), ["object", "name"], "left")
    return rows.withColumns({"relative_error": relative_error(F.col("authored"), F.col("computed")), "unit_error": unit_error(F.col("authored"), F.col("computed"), F.lit(factor))})


def shoelace(points: Column) -> Column:
    """Area of a polygon, array<struct<x, y>>."""
    n = F.size(points)
    turn = lambda k: F.element_at(points, k)["x"] * F.element_at(points, k % n + 1)["y"] - F.element_at(points, k % n + 1)["x"] * F.element_at(points, k)["y"]
    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, k: acc + turn(k))) / 2).otherwise(F.lit(0.0))
