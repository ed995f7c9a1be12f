"""Declarative mappings from tables to triples: an AST, a reader for mapping documents, and a compiler to DataFrames.

A triples map is one scan; all its predicate-object maps become one explode; a reference to another map is an equi-join on
stringified keys. Null or empty values make no triple (``best_effort``) or stop the run (``strict``)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, REGISTRY, url_encode
from graphloom.operators.triples import COLUMNS, OBJECT
from graphloom.sources.turtle import Turtle

RR, RML, QL = "http://www.w3.org/ns/r2rml#", "http://w3id.org/rml/", "http://semweb.mmlab.be/ns/ql#"
OLD_RML = "http://semweb.mmlab.be/ns/rml#"


@dataclass(frozen=True)
class Term:
    """One of constant, template, reference or function; kind: iri, literal or bnode (None: iri for a constant or template,
    literal for a reference)."""

    constant: str | None = None
    template: str | None = None
    reference: str | None = None
    function: tuple | None = None
    kind: str | None = None
    datatype: str = ""
    language: str = ""

    @property
    def term_kind(self) -> str:
        return self.kind or ("literal" if self.language or self.datatype or self.reference is not None or self.function else "iri")


@dataclass(frozen=True)
class Ref:
    """Subjects of another map; ``conditions``: (child, parent) references. Without conditions, every parent row; of the
    same source, the same row (``same_row``)."""

    parent: str
    conditions: tuple[tuple[str, str], ...] = ()
    same_row: bool = False


@dataclass(frozen=True)
class PredicateObject:
    predicates: tuple[Term, ...]
    objects: tuple = ()
    graph: Term | None = None


@dataclass(frozen=True)
class TriplesMap:
    name: str
    source: str
    subject: Term
    classes: tuple[str, ...] = ()
    pairs: tuple[PredicateObject, ...] = ()
    graph: Term | None = None
    iterator: str | None = None


@dataclass
class Compiler:
    """``sources``: name of a logical source to its DataFrame, or a function that loads it."""

    maps: list[TriplesMap]
    sources: dict[str, DataFrame] | Callable[[TriplesMap], DataFrame]
    base: str = ""
    strict: bool = False
    _loaded: dict[str, DataFrame] = field(default_factory=dict)

    def rows(self, m: TriplesMap) -> DataFrame:
        if m.name not in self._loaded:
            self._loaded[m.name] = self.sources(m) if callable(self.sources) else self.sources[m.source]
        return self._loaded[m.name]

    # -- terms: arrays of strings, so that several values mean several terms

    def _values(self, df: DataFrame, reference: str) -> Column:
        kind = dict(df.dtypes).get(reference)
        c = F.col(f"`{reference}`") if kind else F.col(".".join(f"`{x}`" for x in reference.split(".")))
        if kind and kind.startswith("array"):
            found = F.transform(c, lambda x: x.cast("string"))
        else:
            found = F.array(c.cast("string"))
        found = F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
        if self.strict:
            found = F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit(f"no value for {reference}")).cast("array<string>"))
        return found

    def _texts(self, df: DataFrame, t: Term) -> Column:
        if t.constant is not None:
            return F.array(F.lit(t.constant))
        if t.reference is not None:
            return self._values(df, t.reference)
        if t.function is not None:
            name, *args = t.function
            first = lambda a: F.get(self._values(df, a.reference), F.lit(0)) if a.reference is not None else F.lit(a.constant)
            return F.filter(F.array(REGISTRY[name](*map(first, args))), lambda x: x.isNotNull())
        parts = re.split(r"(?<!\\)\{([^}]*)\}", t.template)
        if len(parts) == 1:
            raise ValueError(f"a template without a placeholder: {t.template}")
        out = F.array(F.lit(parts[0]))
        for reference, rest in zip(parts[1::2], parts[2::2]):
            out = _extended(out, F.transform(self._values(df, reference), url_encode), rest)
        return out

    def _iri(self, c: Column) -> Column:
        """Absolute if it has ``://`` or starts with urn:, else resolved against the base; null if it is no IRI."""
        root = re.match(r"[a-z]+://[^/]*", self.base)
        full = F.when(c.contains("://") | c.startswith("urn:"), c).when(c.startswith("/"), F.concat(F.lit(root[0] if root else ""), c)).otherwise(F.concat(F.lit(self.base), c))
        return F.when(~full.rlike(r'[\x00-\x20<>"{}|\\^`]'), full)

    def terms(self, df: DataFrame, t: Term) -> Column:
        """array<struct<o, o_kind, o_dt, o_lang>>."""
        kind = t.term_kind
        values = F.transform(self._texts(df, t), lambda x: F.struct((self._iri(x) if kind == "iri" else x).alias("o"), F.lit(kind).alias("o_kind"), F.lit("" if kind != "literal" or t.language else t.datatype).alias("o_dt"), F.lit(t.language if kind == "literal" else "").alias("o_lang")))
        if self.strict and kind == "iri":
            return F.transform(values, lambda x: F.when(x["o"].isNotNull(), x).otherwise(F.raise_error(F.lit("not an IRI")).cast(_OBJECT_TYPE)))
        return F.filter(values, lambda x: x["o"].isNotNull())

    def subjects(self, df: DataFrame, m: TriplesMap) -> Column:
        t = m.subject if m.subject.kind or m.subject.reference is None else Term(reference=m.subject.reference, kind="iri")
        return self.terms(df, t)

    def _graph(self, df: DataFrame, t: Term | None) -> Column:
        return F.coalesce(F.get(self.terms(df, Term(t.constant, t.template, t.reference, kind="iri")), F.lit(0))["o"], F.lit("")) if t else F.lit("")

    # -- maps

    def compile(self, m: TriplesMap) -> DataFrame:
        df = self.rows(m)
        own = self._graph(df, m.graph)
        groups = [F.transform(F.array(*[F.lit(c) for c in m.classes]), lambda c: F.struct(F.lit(RDF_TYPE).alias("p"), c.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"), own.alias("g"))).cast(_EDGE_TYPE)] if m.classes else []
        joins = []
        for po in m.pairs:
            g = self._graph(df, po.graph) if po.graph else own
            for p in po.predicates:
                ps = self.terms(df, Term(p.constant, p.template, p.reference, kind="iri"))
                for o in po.objects:
                    if isinstance(o, Ref):
                        joins.append((ps, o, g))
                        continue
                    os = self.terms(df, o)
                    groups.append(_paired(ps, os, g))
        s = self.subjects(df, m)
        out = []
        if groups:
            rows = df.select(F.explode(_crossed(s, F.concat(*groups))).alias("_t"))
            out.append(rows.select(*[F.col("_t")[c].alias(c) for c in COLUMNS]))
        for ps, ref, g in joins:
            out.append(self._joined(df, s, ps, ref, g))
        result = out[0]
        for part in out[1:]:
            result = result.union(part)
        return result.select(*COLUMNS)

    def _joined(self, df: DataFrame, s: Column, ps: Column, ref: Ref, g: Column) -> DataFrame:
        parent = next(x for x in self.maps if x.name == ref.parent)
        pdf = self.rows(parent)
        if ref.same_row:
            both = df.select(s.alias("_s"), ps.alias("_p"), g.alias("g"), self.subjects(df, parent).alias("_o"))
        else:
            child = df.select(s.alias("_s"), ps.alias("_p"), g.alias("g"), *[F.col(f"`{c}`").cast("string").alias(f"_k{k}") for k, (c, _) in enumerate(ref.conditions)])
            other = pdf.select(self.subjects(pdf, parent).alias("_o"), *[F.col(f"`{p}`").cast("string").alias(f"_k{k}") for k, (_, p) in enumerate(ref.conditions)])
            # without conditions the document asks for every parent
            both = child.join(other, [f"_k{k}" for k in range(len(ref.conditions))]) if ref.conditions else child.crossJoin(other)
        rows = both.select(F.explode(_crossed(F.col("_s"), _paired(F.col("_p"), F.col("_o"), F.col("g")))).alias("_t"))
        return rows.select(*[F.col("_t")[c].alias(c) for c in COLUMNS])


    def run(self, distinct: bool = True) -> DataFrame:
        """All maps, as a set of triples; without ``distinct`` as they come, which needs no shuffle."""
        out = None
        for m in self.maps:
            part = self.compile(m)
            out = part if out is None else out.union(part)
        return out.distinct() if distinct else out


def _crossed(subjects: Column, edges: Column) -> Column:
    """Every subject with every edge."""
    row = lambda s, e: F.struct(s["o"].alias("s"), s["o_kind"].alias("s_kind"), e["p"].alias("p"), *[e[c].alias(c) for c in OBJECT], e["g"].alias("g"))
    return F.flatten(F.transform(subjects, lambda s: F.transform(edges, lambda e: row(s, e))))


def _extended(texts: Column, values: Column, rest: str) -> Column:
    """Every text followed by every value and ``rest``."""
    return F.flatten(F.transform(texts, lambda a: F.transform(values, lambda b: F.concat(a, b, F.lit(rest)))))


def _paired(ps: Column, os: Column, g: Column) -> Column:
    """Every predicate with every object."""
    return F.flatten(F.transform(ps, lambda a: F.transform(os, lambda b: F.struct(a["o"].alias("p"), *[b[c].alias(c) for c in OBJECT], g.alias("g"))))).cast(_EDGE_TYPE)


_EDGE_TYPE = "array<struct<p:string,o:string,o_kind:string,o_dt:string,o_lang:string,g:string>>"
_OBJECT_TYPE = "struct<o:string,o_kind:string,o_dt:string,o_lang:string>"


def read_document(text: str) -> list[TriplesMap]:
    """A mapping document in Turtle, in either vocabulary: names are compared without their namespace."""
    doc = Turtle(text)
    spaces = (RML, RR, OLD_RML)

    def all_of(s: str, *names: str):
        return [o for name in names for space in spaces for o in doc.values(s, space + name)]

    def one_of(s: str, *names: str) -> str | None:
        found = all_of(s, *names)
        return found[0][1] if found else None

    def term(node: tuple[str, str, str, str]) -> Term:
        s = node[1]
        if all_of(s, "functionValue"):
            raise ValueError("functions in mapping documents aren't read")
        constant = all_of(s, "constant")
        kind = one_of(s, "termType")
        kind = {"IRI": "iri", "Literal": "literal", "BlankNode": "bnode"}[re.split("[#/]", kind)[-1]] if kind else None
        if constant:
            return Term(constant=constant[0][1], kind=kind or constant[0][0], datatype=constant[0][2], language=constant[0][3])
        dt, lang = one_of(s, "datatype", "datatypeMap") or "", one_of(s, "language") or ""
        template, reference = one_of(s, "template"), one_of(s, "reference", "column")
        if template is None and reference is None:
            raise ValueError("a term map needs a constant, template or reference")
        return Term(template=template, reference=None if template else reference, kind=kind, datatype=dt, language=lang)

    def constant(o: tuple[str, str, str, str]) -> Term:
        return Term(constant=o[1], kind=o[0], datatype=o[2], language=o[3])

    def terms(s: str, short: str, long: str) -> list[Term]:
        return [constant(o) for o in all_of(s, short)] + [term(o) for o in all_of(s, long)]

    out = []
    subjects = dict.fromkeys(s for s, p, _ in doc.triples if p in {x + "logicalSource" for x in spaces} | {RR + "logicalTable"})
    for s in subjects:
        source = one_of(s, "logicalSource", "logicalTable")
        maps = all_of(s, "subjectMap")
        short = all_of(s, "subject")
        if not maps and not short:
            raise ValueError(f"{s} has no subject map")
        sm = maps[0][1] if maps else None
        pairs = []
        for po in all_of(s, "predicateObjectMap"):
            objects: list = [constant(o) for o in all_of(po[1], "object")]
            for o in all_of(po[1], "objectMap"):
                if parent := one_of(o[1], "parentTriplesMap"):
                    objects.append(Ref(parent, tuple((one_of(c[1], "child"), one_of(c[1], "parent")) for c in all_of(o[1], "joinCondition"))))
                else:
                    objects.append(term(o))
            graphs = terms(po[1], "graph", "graphMap")
            pairs.append(PredicateObject(tuple(terms(po[1], "predicate", "predicateMap")), tuple(objects), graphs[0] if graphs else None))
        graphs = terms(sm, "graph", "graphMap") if sm else []
        out.append(TriplesMap(s, one_of(source, "source", "tableName") or "", term(maps[0]) if maps else constant(short[0]), tuple(o[1] for o in all_of(sm, "class")) if sm else (), tuple(pairs), graphs[0] if graphs else None, one_of(source, "iterator")))
    return out
