"""Class expressions over a triples table, compiled to semi, anti and grouped joins. One pass, no fixpoint.

The universe is every subject and every IRI object; an answer is the part of a set that are subjects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE
from graphloom.operators.triples import COLUMNS, OBJECT

THING = "http://www.w3.org/2002/07/owl#Thing"


@dataclass(frozen=True)
class Named:
    iri: str


@dataclass(frozen=True)
class Intersection:
    parts: tuple


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Complement:
    part: object


@dataclass(frozen=True)
class Some:
    p: str
    part: object


@dataclass(frozen=True)
class Every:
    p: str
    part: object


@dataclass(frozen=True)
class HasValue:
    p: str
    o: str
    o_kind: str = "iri"
    o_dt: str = ""
    o_lang: str = ""


@dataclass(frozen=True)
class Cardinality:
    """kind: exact, min or max distinct objects."""

    p: str
    kind: str
    n: int


class Reasoner:
    """``keep``: every part of an expression scans the triples, so they are cached, in memory or on disk; ``close`` drops
    them."""

    def __init__(self, triples: DataFrame, keep: bool = True) -> None:
        self.triples = triples = triples.persist() if keep else triples
        self.subjects = triples.select("s").distinct()
        self.universe = triples.select("s").union(triples.where("o_kind = 'iri'").select(F.col("o").alias("s"))).distinct()

    def close(self) -> None:
        self.triples.unpersist()

    def _of(self, p: str) -> DataFrame:
        return self.triples.where(F.col("p") == p)

    def members(self, e) -> DataFrame:
        """Distinct s of the universe in the class expression ``e``."""
        if isinstance(e, Named):
            if e.iri == THING:
                return self.universe
            return self._of(RDF_TYPE).where((F.col("o") == e.iri) & (F.col("o_kind") == "iri")).select("s").distinct()
        if isinstance(e, Intersection):
            if not e.parts:
                return self.universe.limit(0)
            out = self.members(e.parts[0])
            for part in e.parts[1:]:
                out = out.join(self.members(part), "s", "left_semi")
            return out
        if isinstance(e, Union):
            out = self.universe.limit(0)
            for part in e.parts:
                out = out.union(self.members(part))
            return out.distinct()
        if isinstance(e, Complement):
            return self.universe.join(self.members(e.part), "s", "left_anti")
        if isinstance(e, Some):
            values = self._of(e.p).where("o_kind <> 'literal'")
            if e.part != Named(THING):
                values = values.join(self.members(e.part).select(F.col("s").alias("o")), "o", "left_semi")
            return values.select("s").distinct()
        if isinstance(e, Every):
            if e.part == Named(THING):
                return self.universe
            inside = self.members(e.part).select(F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
            violating = self._of(e.p).join(inside, ["o", "o_kind"], "left_anti").select("s")
            return self.universe.join(violating, "s", "left_anti")
        if isinstance(e, HasValue):
            same = [F.col(c) == getattr(e, c) for c in OBJECT]
            return self._of(e.p).where(same[0] & same[1] & same[2] & same[3]).select("s").distinct()
        if isinstance(e, Cardinality):
            counts = self._of(e.p).groupBy("s").agg(F.count_distinct(F.struct(*OBJECT)).alias("n"))
            n = F.coalesce("n", F.lit(0))
            test = {"exact": n == e.n, "min": n >= e.n, "max": n <= e.n}[e.kind]
            if e.kind == "min" and e.n > 0:  # absent subjects cannot pass
                return counts.where(test).select("s")
            return self.universe.join(counts, "s", "left").where(test).select("s")
        raise TypeError(f"no class expression: {e!r}")

    def answer(self, e) -> DataFrame:
        return self.members(e).join(self.subjects, "s", "left_semi")

    def infer(self, rules: dict[str, object]) -> DataFrame:
        """Type triples of the rules' classes that are not asserted."""
        out = self.triples.limit(0).select(*COLUMNS)
        for cls, e in rules.items():
            new = self.answer(e).join(self.members(Named(cls)), "s", "left_anti")
            rows = new.select("s", F.lit("iri").alias("s_kind"), F.lit(RDF_TYPE).alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"), F.lit("").alias("g"))
            out = out.union(rows)
        return out


@dataclass
class Alignment:
    """Renames of properties and classes. Equivalences go both ways; sub-relations forward, and back if the parent has that
    one child. Later entries of a document win; ``fill`` adds only what is missing."""

    properties: dict[str, str]
    classes: dict[str, str]

    @staticmethod
    def of(equivalent_properties=(), sub_properties=(), equivalent_classes=(), sub_classes=()) -> Alignment:
        def table(equivalent, sub) -> dict[str, str]:
            out: dict[str, str] = {}
            kids: dict[str, set] = {}
            for child, parent in sub:
                kids.setdefault(parent, set()).add(child)
            for a, b in equivalent:
                out[a], out[b] = b, a
            for child, parent in sub:
                out[child] = parent
                if len(kids[parent]) == 1:
                    out[parent] = child
            return out

        return Alignment(table(equivalent_properties, sub_properties), table(equivalent_classes, sub_classes))

    def fill(self, other: Alignment) -> Alignment:
        return Alignment(other.properties | self.properties, other.classes | self.classes)

    def changed(self, triples: DataFrame) -> DataFrame:
        """The triples that a rename changes, renamed: predicates, and classes that are objects of rdf:type."""

        def to(names: dict[str, str], c):
            return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c) if names else F.lit(None).cast("string")

        p, o = to(self.properties, F.col("p")), F.when((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"), to(self.classes, F.col("o")))
        out = triples.withColumns({"_p": p, "_o": o}).where("_p is not null or _o is not null")
        return out.withColumns({"p": F.coalesce("_p", "p"), "o": F.coalesce("_o", "o")}).select(*COLUMNS)


def single_children(edges: DataFrame) -> DataFrame:
    """(parent, child) of parents with one child (edges: child, parent): the sub-relations that also hold backwards."""
    return edges.groupBy("parent").agg(F.min("child").alias("child"), F.count_distinct("child").alias("_n")).where("_n = 1").select("parent", "child")


def postprocess(triples: DataFrame, alignment: Alignment, rules: dict[str, object]) -> DataFrame:
    """What alignment changes, and what the rules infer over the triples and those."""
    mapped = alignment.changed(triples)
    return mapped.union(Reasoner(triples.union(mapped)).infer(rules))
