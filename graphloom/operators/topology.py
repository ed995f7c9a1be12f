"""Closures, spatial joins and the relations between spaces and elements."""

from __future__ import annotations

import tempfile
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_checkpoints(spark) -> None:
    """Loops cut their lineage by checkpoints, in the folder that ``spark.checkpoint.dir`` names; only a local master without
    that setting gets a folder of this machine."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="graphloom-"))


def closure(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of every node reachable from ``roots`` (root) over ``edges`` (parent, child), at its least depth.

    Breadth first, one join a level, until a level is empty; nodes seen before end their branch, so cycles do. A level
    beyond ``most_depth``, if given, is an error. Each level is checkpointed, and what was seen every 16 levels, for which
    the session needs a checkpoint folder."""
    edges = edges.select("parent", "child").distinct().checkpoint()
    found = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct().checkpoint()
    front, seen = found, found
    for depth in count(1):
        new = front.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        front = new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        if most_depth is not None and depth > most_depth:
            raise RuntimeError(f"closure goes on beyond depth {most_depth}")
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = seen.checkpoint()
    return seen.where("depth > 0")


def closure_sql(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of a recursive query over edges without cycles: one for each way from a root to a node. Levels are joined
    and checkpointed until one is empty, as the recursive query of Spark ends with an error at a million rows or a hundred
    levels. Cycles are an error: a root that comes back to itself, or a way of more steps than there are parents."""
    with_checkpoints(spark)
    edges = edges.select("parent", "child").checkpoint()
    front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    most, out = edges.select("parent").distinct().count(), None
    for depth in count(1):
        front = front.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).checkpoint()
        if out is not None and front.isEmpty():
            return out
        if depth > most and not front.isEmpty() or not front.where("root = node").isEmpty():
            raise RuntimeError("closure_sql needs edges without cycles")
        out = front if out is None else out.unionByName(front)


AXES = ("x", "y", "z")


def _overlap(axis: str, tol: float) -> Column:
    return F.least(F.col(f"a.{axis}_max"), F.col(f"b.{axis}_max")) - F.greatest(F.col(f"a.{axis}_min"), F.col(f"b.{axis}_min")) > tol


def _gap(axis: str) -> Column:
    return F.greatest(F.col(f"a.{axis}_min"), F.col(f"b.{axis}_min")) - F.least(F.col(f"a.{axis}_max"), F.col(f"b.{axis}_max"))


#: Members of a shape in one list; two lists are expanded in one task.
LIST = 1024


def spatial_pairs(boxes: DataFrame, cell: tuple[float, float, float] | None = None, tol: float = 1e-6) -> DataFrame:
    """(a, b, kind) with a < b of boxes that intersect on all axes by more than ``tol``, or touch: a gap of at most ``tol``
    (or an overlap of at most that) on one axis and an overlap on the two others.

    Boxes are dealt into the cells of a grid that they reach; a pair is judged in the one cell that holds the lower corner
    of its common part, so no pair comes twice and nothing is deduplicated. A box goes whole to the cell of its own lower
    corner, and to other cells it reaches; in a cell, pairs of two boxes that both came from elsewhere are never the ones
    to judge there unless their corners say so, which the join tests before anything else. A cell should be about twice a
    box in size (the default takes twice the mean extents: one aggregation), so that a box reaches eight at most.

    Boxes of equal corners are judged as one shape, each pair of shapes once. Members of a shape come in lists of at most
    LIST; lists meet by their shapes alone and are expanded last, so copies cost what they add to the result, and those of
    one shape are dealt to as many tasks as they have lists."""
    if cell is None:
        means = boxes.agg(*[F.avg(F.col(f"{x}_max") - F.col(f"{x}_min")).alias(x) for x in AXES]).first()
        cell = tuple(max(2 * (means[x] or 0.0), 1e-3) for x in AXES)
    corners = [f"{x}_{end}" for x in AXES for end in ("min", "max")]
    at = F.floor((F.row_number().over(Window.partitionBy("shape").orderBy("id")) - 1) / LIST)
    # text, as Spark deals rows by doubles only after it normalises them, so not as they were asked to be dealt; no -0.0
    shape = F.concat_ws(" ", *[(F.col(c) + 0).cast("string") for c in corners])
    lists = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in corners)).select("id", *corners, shape.alias("shape")).withColumn("at", at)
    lists = lists.groupBy("shape", "at").agg(F.collect_list("id").alias("ids"), *[F.any_value(c).alias(c) for c in corners])
    shapes = lists.groupBy("shape").agg((F.max("at") + 1).alias("n"), *[F.any_value(c).alias(c) for c in corners])
    own = shapes.withColumns({f"l{x}": F.floor((F.col(f"{x}_min") - tol) / c) for x, c in zip(AXES, cell)})
    dealt = own
    for x, c in zip(AXES, cell):
        dealt = dealt.withColumn(f"c{x}", F.explode(F.sequence(F.col(f"l{x}"), F.floor((F.col(f"{x}_max") + tol) / c))))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = [F.col(f"a.c{x}") == F.col(f"b.c{x}") for x in AXES]
    # the greater of the two lower corners' cells
    home = [F.col(f"a.c{x}") == F.greatest(F.col(f"a.l{x}"), F.col(f"b.l{x}")) for x in AXES]
    pairs = a.join(b, reduce(lambda p, q: p & q, [*same, F.col("a.shape") <= F.col("b.shape"), *home]))
    over = [_overlap(x, tol) for x in AXES]
    meets = [F.abs(_gap(x)) <= tol for x in AXES]
    touch = (meets[0] & over[1] & over[2]) | (over[0] & meets[1] & over[2]) | (over[0] & over[1] & meets[2])
    kind = F.when(over[0] & over[1] & over[2], "intersects").when(touch, "touches")
    judged = pairs.select(F.col("a.shape").alias("left"), F.col("b.shape").alias("right"), F.col("a.n").alias("ln"), F.col("b.n").alias("rn"), kind.alias("kind")).where("kind is not null")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    judged = judged.withColumn("same", F.col("left") == F.col("right")).withColumn("li", every("ln")).withColumn("ri", every("rn"))
    judged = judged.where(~F.col("same") | (F.col("li") <= F.col("ri"))).select("left", "li", "right", "ri", "same", "kind")
    met = judged.join(lists.select(F.col("shape").alias("left"), F.col("at").alias("li"), F.col("ids").alias("i")), ["left", "li"])
    # a number of partitions that is asked for stays: a few lists are many pairs, and would be put together into one task
    n = max(64, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(n, "right", "ri").join(lists.select(F.col("shape").alias("right"), F.col("at").alias("ri"), F.col("ids").alias("j")), ["right", "ri"])
    met = met.select("same", "kind", "j", F.explode("i").alias("i")).select("same", "kind", "i", F.explode("j").alias("j"))
    met = met.where((F.col("i") < F.col("j")) | (~F.col("same") & (F.col("i") > F.col("j"))))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "kind")


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def adjacent_spaces(boundaries: DataFrame) -> DataFrame:
    """(a, b) both ways of spaces that share an element; boundaries: space, element, external (boolean); pairs that are
    external on both sides don't count."""
    rows = boundaries.where("element is not null").groupBy("space", "element").agg(F.min("external").alias("external"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.element") == F.col("b.element")) & (F.col("a.space") < F.col("b.space"))).where(~(F.col("a.external") & F.col("b.external")))
    pairs = pairs.select(F.col("a.space").alias("a"), F.col("b.space").alias("b")).distinct()
    return pairs.union(pairs.select("b", "a"))


# Kinds of relations, in the order they sort in.
EDGES = ("ContainsZone", "ContainsElement", "AdjacentElement", "AdjacentZone", "HasSubElement", "IntersectingElement", "InterfaceOf")
EDGE = "source long, target long, kind string, derived_from string"


def _edge(rows: DataFrame, source: str, target: str, kind: str, derived_from: str) -> DataFrame:
    return rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.lit(derived_from).alias("derived_from"))


def _known(rows: DataFrame, column: str, things: DataFrame) -> DataFrame:
    return rows.join(things.select(F.col("id").alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def hosts(voids: DataFrame, fills: DataFrame) -> DataFrame:
    """(host, element): what fills an opening, and what the opening is in. voids: rel, element, opening; fills: opening,
    element. Of several that an opening is in, the relation with the highest id tells."""
    last = voids.groupBy("opening").agg(F.max_by("element", "rel").alias("host"))
    return fills.select("opening", "element").join(last, "opening").select("host", "element")


def relations(nodes: DataFrame, elements: DataFrame, aggregates: DataFrame, boundaries: DataFrame, contained: DataFrame, voids: DataFrame, fills: DataFrame) -> DataFrame:
    """All relations (EDGE) between spatial ``nodes`` (id) and ``elements`` (id), each with both ends known.

    aggregates: parent, child; boundaries: space, element (may be null), external (boolean); contained: element, structure;
    voids and fills: see ``hosts``. Zones and their parts, spaces and what bounds them, spaces that share such an element
    (both ways), hosts and what fills their openings, structures and what they contain."""
    zones = _known(_known(aggregates, "parent", nodes), "child", nodes)
    bounds = _known(_known(boundaries.where("element IS NOT NULL"), "space", nodes), "element", elements)
    hosted = _known(_known(hosts(voids, fills), "host", elements), "element", elements)
    inside = _known(_known(contained, "structure", nodes), "element", elements)
    out = _edge(zones, "parent", "child", EDGES[0], "aggregates").union(_edge(inside, "structure", "element", EDGES[1], "containment"))
    out = out.union(_edge(bounds, "space", "element", EDGES[2], "space boundary")).union(_edge(adjacent_spaces(bounds), "a", "b", EDGES[3], "space boundary"))
    return out.union(_edge(hosted, "host", "element", EDGES[4], "voids and fills")).distinct()


def in_order(edges: DataFrame) -> DataFrame:
    """Edges by source, target, kind and origin."""
    rank = F.array_position(F.array(*[F.lit(k) for k in EDGES]), F.col("kind"))
    return edges.orderBy("source", "target", rank, "derived_from")


def sub_elements(elements: DataFrame, aggregates: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child) of elements made of elements, and of hosts and what fills their openings, once each."""
    own = _known(_known(aggregates.select("parent", "child"), "parent", elements), "child", elements)
    return own.union(edges.where(F.col("kind") == EDGES[4]).select("source", "target")).distinct()


def with_geometry(edges: DataFrame, found: DataFrame, known: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates): ``edges`` and what geometry adds to them. found: source, target, kind; known: id of all things.

    Confirmed (``exact``) relations become edges, and the sources of InterfaceOf are things of their own; unconfirmed ones
    stay candidates. A relation whose ends are not known is dropped, one that is there already adds nothing."""
    ends = _known(found.select("source", "target", "kind").distinct(), "target", known)
    if exact:
        ends = _known(ends.where(F.col("kind") != EDGES[6]), "source", known).select("source", "target", "kind").unionByName(ends.where(F.col("kind") == EDGES[6]))
    else:
        ends = _known(ends, "source", known).select("source", "target", "kind")
    new = ends.select("source", "target", "kind", F.lit("exact geometry" if exact else "boxes").alias("derived_from"))
    if not exact:
        return edges, new
    return edges.unionByName(new.join(edges.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti").select("source", "target", "kind", "derived_from")), new.limit(0)


# Classes whose parts count as contained with them, and classes that a storey contains through its spaces.
WHOLES, THROUGH_SPACES = ("IFCROOF", "IFCSTAIR", "IFCRAILING"), ("IFCMEMBER", "IFCRAILING", "IFCSTAIRFLIGHT")


def contained_closure(contained: DataFrame, elements: DataFrame, aggregates: DataFrame) -> DataFrame:
    """(structure, element): what is contained, and all parts of those roofs, stairs and railings. elements: id, entity_name."""
    whole = elements.where(F.col("entity_name").isin(*WHOLES)).select(F.col("id").alias("element"))
    roots = contained.join(whole, "element", "left_semi").select(F.col("element").alias("root")).distinct()
    edges = _known(_known(aggregates.select("parent", "child"), "parent", elements), "child", elements)
    below = closure(edges, roots).select(F.col("root").alias("element"), F.col("node").alias("part"))
    return contained.select("structure", "element").union(contained.join(below, "element").select("structure", F.col("part").alias("element"))).distinct()


def through_spaces(nodes: DataFrame, elements: DataFrame, aggregates: DataFrame, contained: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(structure, element): members, railings and stair flights that a storey has through its spaces, as they contain or are
    bounded by them. nodes: id, level; contained: structure, element; boundaries: space, element."""
    of = lambda level, name: nodes.where(F.col("level") == level).select(F.col("id").alias(name))
    spaces = aggregates.join(of("storey", "parent"), "parent").join(of("space", "child"), "child").select(F.col("parent").alias("structure"), F.col("child").alias("space"))
    held = contained.select(F.col("structure").alias("space"), "element").union(boundaries.where("element IS NOT NULL").select("space", "element")).distinct()
    some = elements.where(F.col("entity_name").isin(*THROUGH_SPACES)).select(F.col("id").alias("element"))
    return spaces.join(held, "space").join(some, "element", "left_semi").select("structure", "element").distinct()


def subjects(ids: DataFrame, nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, iri) of ``ids`` (id): that of the spatial node, else of the element; without either, none. nodes, elements: id, iri."""
    rows = ids.select("id").distinct().join(nodes.select("id", F.col("iri").alias("_n")), "id", "left").join(elements.select("id", F.col("iri").alias("_e")), "id", "left")
    return rows.select("id", F.coalesce("_n", "_e").alias("iri")).where("iri IS NOT NULL")


def interface_ids(contacts: DataFrame) -> DataFrame:
    """(interface, left, right, kind) of contacts (left, right, distance): closer than -tol intersecting, up to tol touching;
    the interface's id is a hash of the pair, so two pairs do not share one."""
    pair = contacts.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "distance")
    kind = F.when(F.col("distance") < -1e-6, "IntersectingElement").when(F.col("distance") <= 1e-6, "AdjacentElement")
    rows = pair.groupBy("left", "right").agg(F.min("distance").alias("distance")).withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select(F.xxhash64("left", "right").alias("interface"), "left", "right", "kind")
