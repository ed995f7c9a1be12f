"""Program documents: a small Turtle reader for the driver (mappings, alignments, rules), and N-Triples / N-Quads tables.

Not a bulk reader: bulk RDF comes as N-Triples or N-Quads lines, which Spark splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD
from graphloom.operators.reason import Alignment, Cardinality, Complement, Every, HasValue, Intersection, Named, Some, Union

RDF, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"
TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:[\w.-]*\w)"""
    r"""|(?P<name>[A-Za-z][\w.-]*\w?:[\w.%-]*[\w%-]|[A-Za-z][\w-]*:|:[\w.%-]*[\w%-]|:)|(?P<word>true|false|a|PREFIX|BASE|GRAPH|prefix|base|graph)\b|(?P<mark>[.;,\[\](){}])""",
    re.S,
)
ESCAPE = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: ESCAPE.get(m[1]) or chr(int(m[1][1:], 16)), s)


class Turtle:
    """``triples``: (s, p, o); s and p strings (blank nodes start with _:), o (kind, value, datatype, language)."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.k, self.prefixes, self.base, self.n, self.triples = 0, {}, "", 0, []
        self.graphs: list[str] = []
        while self.k < len(self.tokens):
            self._graph()
            self.graphs += [""] * (len(self.triples) - len(self.graphs))

    def _next(self, expect: str | None = None) -> tuple[str, str]:
        if self.k >= len(self.tokens):
            raise ValueError("the document ends inside a statement")
        kind, text = self.tokens[self.k]
        if expect and text != expect:
            raise ValueError(f"{expect!r} expected, found {text!r}")
        self.k += 1
        return kind, text

    def _peek(self) -> str:
        return self.tokens[self.k][1] if self.k < len(self.tokens) else ""

    @property
    def quads(self) -> list[tuple[str, str, tuple, str]]:
        """(s, p, o, graph), the graph empty outside of any."""
        return [(*t, g) for t, g in zip(self.triples, self.graphs)]

    def _graph(self) -> None:
        """A statement, or statements in braces with or without a name before them (TriG)."""
        ahead = [t for _, t in self.tokens[self.k : self.k + 3]]
        word = ahead[0].upper() == "GRAPH"
        if not ("{" in ahead[:1] or word or "{" in ahead[1:2]):
            self._statement()
            return
        self.k += word
        name = "" if self._peek() == "{" else self._term()[1]
        self._next("{")
        before = len(self.triples)
        while self._peek() != "}":
            self._statement(inside=True)
        self._next("}")
        self.graphs += [""] * (before - len(self.graphs)) + [name] * (len(self.triples) - before)

    def _statement(self, inside: bool = False) -> None:
        word = self._peek().lower()
        if word in ("@prefix", "prefix", "@base", "base"):
            self._next()
            name = self._next()[1][:-1] if "prefix" in word else None
            iri = self._resolve(self._next()[1])
            if name is None:
                self.base = iri
            else:
                self.prefixes[name] = iri
            if word[0] == "@":
                self._next(".")
            return
        alone = self._peek() == "["
        subject = self._term()
        if not (alone and self._peek() == "."):
            self._pairs(subject[1])
        if not (inside and self._peek() == "}"):
            self._next(".")

    def _resolve(self, text: str) -> str:
        iri = unescape(text[1:-1])
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def _pairs(self, s: str) -> None:
        while self._peek() not in (".", "]", "}"):
            p = self._term()
            while True:
                self.triples.append((s, p[1], self._term()))
                if self._peek() != ",":
                    break
                self._next()
            while self._peek() == ";":
                self._next()

    def _blank(self) -> str:
        self.n += 1
        return f"_:b{self.n}"

    def _term(self) -> tuple[str, str, str, str]:
        kind, text = self._next()
        if kind == "iri":
            return "iri", self._resolve(text), "", ""
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return "iri", self.prefixes[prefix] + local, "", ""
        if kind == "bnode":
            return "bnode", text, "", ""
        if text == "a":
            return "iri", RDF_TYPE, "", ""
        if text in ("true", "false"):
            return "literal", text, XSD + "boolean", ""
        if kind == "num":
            return "literal", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), ""
        if kind in ("str", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.k < len(self.tokens) and self.tokens[self.k][0] == "at":
                return "literal", value, "", self._next()[1][1:]
            if self._peek() == "^^":
                self._next()
                return "literal", value, self._term()[1], ""
            return "literal", value, "", ""
        if text == "[":
            node = self._blank()
            self._pairs(node)
            self._next("]")
            return "bnode", node, "", ""
        if text == "(":
            items = []
            while self._peek() != ")":
                items.append(self._term())
            self._next(")")
            node = ("iri", RDF + "nil", "", "")
            for item in reversed(items):
                name = self._blank()
                self.triples += [(name, RDF + "first", item), (name, RDF + "rest", node)]
                node = ("bnode", name, "", "")
            return node
        raise ValueError(f"no term: {text!r}")

    def values(self, s: str, p: str) -> list[tuple[str, str, str, str]]:
        return [o for a, b, o in self.triples if a == s and b == p]

    def one(self, s: str, p: str) -> str | None:
        found = self.values(s, p)
        return found[0][1] if found else None

    def items(self, node: str) -> list[tuple[str, str, str, str]]:
        """Members of an rdf:List; a malformed list is an error."""
        out, seen = [], set()
        while node != RDF + "nil":
            first, rest = self.values(node, RDF + "first"), self.one(node, RDF + "rest")
            if len(first) != 1 or rest is None or node in seen:
                raise ValueError("malformed list")
            seen.add(node)
            out.append(first[0])
            node = rest
        return out


def class_expression(doc: Turtle, node: tuple[str, str, str, str]):
    kind, name, _, _ = node
    if kind == "iri":
        return Named(name)
    for p, make in (("intersectionOf", Intersection), ("unionOf", Union)):
        if (head := doc.one(name, OWL + p)) is not None:
            return make(tuple(class_expression(doc, x) for x in doc.items(head)))
    if found := doc.values(name, OWL + "complementOf"):
        return Complement(class_expression(doc, found[0]))
    p = doc.one(name, OWL + "onProperty")
    if p is None:
        raise ValueError(f"unknown class expression {name}")
    for key, make in (("someValuesFrom", Some), ("allValuesFrom", Every)):
        if found := doc.values(name, OWL + key):
            return make(p, class_expression(doc, found[0]))
    if found := doc.values(name, OWL + "hasValue"):
        kind, value, dt, lang = found[0]
        return HasValue(p, value, kind, dt, lang)
    if doc.one(name, OWL + "onClass") is not None:
        raise ValueError(f"qualified cardinality {name}: counts of values of one class aren't known")
    for key, how in (("cardinality", "exact"), ("minCardinality", "min"), ("maxCardinality", "max")):
        if (n := doc.one(name, OWL + key)) is not None:
            return Cardinality(p, how, int(n))
    raise ValueError(f"unknown restriction {name}")


def rules(doc: Turtle) -> tuple[dict[str, object], list[str]]:
    """Named class to expression of every equivalentClass with a blank node; what cannot be read is a warning."""
    out, warnings = {}, []
    for s, p, o in doc.triples:
        if p == OWL + "equivalentClass" and o[0] == "bnode" and not s.startswith("_:"):
            try:
                out[s] = class_expression(doc, o)
            except ValueError as e:
                warnings.append(f"{s}: {e}")
    return out, warnings


RDFS, ALIGN = "http://www.w3.org/2000/01/rdf-schema#", "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"


def alignment(doc: Turtle, ontology: Turtle | None = None) -> Alignment:
    """Renames of an alignment document: equivalences both ways, sub-relations forward, and back where the parent has that
    one child, cells that name two entities as properties; with an ontology's own, which fill what is missing."""

    def named(p: str) -> list[tuple[str, str]]:
        return [(s, o[1]) for s, q, o in doc.triples if q == p and o[0] == "iri" and not s.startswith("_:")]

    cells = [(a, b) for s in dict.fromkeys(s for s, p, _ in doc.triples if p == ALIGN + "entity1") if (a := doc.one(s, ALIGN + "entity1")) and (b := doc.one(s, ALIGN + "entity2"))]
    own = Alignment.of(named(OWL + "equivalentProperty"), named(RDFS + "subPropertyOf"), named(OWL + "equivalentClass"), named(RDFS + "subClassOf"))
    own = Alignment(own.properties | dict(cells), own.classes)
    return own.fill(alignment(ontology)) if ontology else own


NT = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    """A text with its character escapes read, those by number too."""
    hold = "\uffff"  # no character, so no text has it
    for a, b in (("\\\\", hold), ('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
        c = F.replace(c, F.lit(a), F.lit(b))

    def character(x: Column) -> Column:
        """The character of an escape; beyond 16 bits, as two units."""
        point = F.conv(F.substring(x, 3, 8), 16, 10).cast("bigint")
        high = F.concat(F.hex(F.floor((point - 0x10000) / 0x400) + 0xD800), F.hex((point - 0x10000) % 0x400 + 0xDC00))
        return F.decode(F.unhex(F.when(point < 0x10000, F.lpad(F.hex(point), 4, "0")).otherwise(high)), "UTF-16BE")

    escape = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
    hits, gaps = F.regexp_extract_all(c, F.lit(escape), F.lit(0)), F.split(c, escape, -1)
    both = F.zip_with(gaps, F.concat(F.transform(hits, character), F.array(F.lit(""))), lambda gap, x: F.concat(gap, x))
    return F.replace(F.when(c.rlike(escape), F.array_join(both, "")).otherwise(c), F.lit(hold), F.lit("\\"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines that ``read_lines`` cannot read: neither a statement, nor blank, nor a comment."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(~F.col("value").rlike(NT) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_lines(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """N-Triples or N-Quads files as triples; comments and blank lines are left out. Any other line that is no statement ends
    the run, unless ``skip_unreadable``: then ``unreadable`` gives those lines."""
    m = lambda k: F.regexp_extract("value", NT, k)
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    fits = F.col("value").rlike(NT)
    if skip_unreadable:
        lines = lines.where(fits)
    else:
        lines = lines.select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.substring("value", 1, 200))).cast("string")).alias("value"))
    rows = lines.select(m(1).alias("a"), m(2).alias("p"), m(3).alias("c"), m(4).alias("g"))
    kind = lambda c: F.when(F.col(c).startswith("<"), "iri").when(F.col(c).startswith("_:"), "bnode").otherwise("literal")
    bare = lambda c: F.when(F.col(c).startswith("<"), F.regexp_extract(c, "^<(.*)>$", 1)).otherwise(F.substring(c, 3, 1 << 30))
    text = F.regexp_extract("c", r'^"((?:[^"\\]|\\.)*)"', 1)
    text = unescaped(text)
    dt, lang = F.regexp_extract("c", r'"\^\^<([^>]*)>$', 1), F.regexp_extract("c", r'"@([A-Za-z0-9-]+)$', 1)
    lit = kind("c") == "literal"
    return rows.select(
        bare("a").alias("s"), kind("a").alias("s_kind"), "p", F.when(lit, text).otherwise(bare("c")).alias("o"), kind("c").alias("o_kind"),
        F.when(lit, dt).otherwise("").alias("o_dt"), F.when(lit, lang).otherwise("").alias("o_lang"), "g",
    )
