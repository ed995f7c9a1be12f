"""Sources, documents, mappings, reasoning, model, quantities, sinks, modules and streams on small inputs."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import terms as T
from graphloom.operators import archive, compare, entities, matching, model, properties, quantity, reason, sinks, topology
from graphloom.operators import triples as G
from graphloom.plans import mapping, modules
from graphloom.sources import records, step, turtle
from graphloom.streaming import graph as stream

E = "http://e.org/"
TRIPLE = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, g string"


def graph(spark, *rows):
    """(s, p, o): o starting with E is an IRI; (value, datatype) a literal."""
    full = []
    for s, p, o in rows:
        value, dt = o if isinstance(o, tuple) else (o, "")
        full.append((E + s, "iri", T.RDF_TYPE if p == "a" else E + p, value, "iri" if value.startswith("http") else "literal", dt, "", ""))
    return spark.createDataFrame(full, TRIPLE)


def names(df):
    return {r[0].removeprefix(E) for r in df.collect()}


def test_fnv1a64(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return f"{h:016x}"

    texts = ["", "a", "foobar", "Ümläut 漢字", "x" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fnv1a64(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: plain(t) for t in texts}


def test_decimals_and_slices(spark):
    rows = [(1.0, "1"), (-0.0, "0"), (0.1 + 0.2, "0.3"), (2.50, "2.5"), (100.0, "100"), (-1e-12, "0")]
    got = spark.createDataFrame(rows, "x double, want string").select(T.canonical_decimal(F.col("x")).alias("v"), "want").collect()
    assert all(r["v"] == r["want"] for r in got)
    cut = spark.createDataFrame([("abcdef",), ("ab",), ("äöüß",)], "t string").select(T.slice_text(F.col("t"), 1, 4).alias("v")).collect()
    assert [r["v"] for r in cut] == ["bcd", None, "öüß"]


TTL = """
@prefix ex: <http://e.org/> . @base <http://base.org/> .
ex:a a ex:B ; ex:p "x\\n\\u00e9"@de, 'y'^^ex:t, 5, 1.5, true ; ex:q [ ex:r <rel> ] . # comment
ex:l ex:items ( ex:a "b" ) .
[] ex:alone \"\"\"long "text\"\"\" .
"""


def test_turtle():
    doc = turtle.Turtle(TTL)
    assert doc.values(E + "a", E + "p") == [("literal", "x\né", "", "de"), ("literal", "y", E + "t", ""), ("literal", "5", T.XSD_INTEGER, ""), ("literal", "1.5", T.XSD_DECIMAL, ""), ("literal", "true", T.XSD_BOOLEAN, "")]
    assert doc.one(doc.one(E + "a", E + "q"), E + "r") == "http://base.org/rel"
    assert [x[1] for x in doc.items(doc.one(E + "l", E + "items"))] == [E + "a", "b"]
    for bad in ("ex:a ex:b ex:c .", "@prefix ex: <http://e.org/> . ex:a ex:b", "<a> <b> <c> <d> ."):
        with pytest.raises(ValueError):
            turtle.Turtle(bad)


RULES = """
@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix ex: <http://e.org/> .
ex:Parent owl:equivalentClass [ owl:onProperty ex:kid ; owl:someValuesFrom ex:Person ] .
ex:Lone owl:equivalentClass [ owl:intersectionOf ( ex:Person [ owl:complementOf ex:Parent0 ] [ owl:onProperty ex:kid ; owl:maxCardinality 0 ] ) ] .
ex:Odd owl:equivalentClass [ owl:oneOf ( ex:a ) ] .
"""


def test_rules_and_reasoner(spark):
    rules, warnings = turtle.rules(turtle.Turtle(RULES))
    assert set(rules) == {E + "Parent", E + "Lone"} and len(warnings) == 1
    t = graph(spark, ("ann", "a", E + "Person"), ("bob", "a", E + "Person"), ("ann", "kid", E + "bob"), ("cat", "kid", E + "dog"), ("ann", "age", ("5", "")), ("bob", "age", ("5", T.XSD_INTEGER)), ("ann", "age", ("5", T.XSD_INTEGER)))
    r = reason.Reasoner(t)
    assert {(x["s"], x["o"]) for x in r.infer(rules).collect()} == {(E + "ann", E + "Parent"), (E + "bob", E + "Lone")}
    p = lambda e: names(r.answer(e))
    assert p(reason.HasValue(E + "age", "5", "literal")) == {"ann"} and p(reason.HasValue(E + "age", "5", "literal", T.XSD_INTEGER)) == {"ann", "bob"}
    assert p(reason.Cardinality(E + "age", "exact", 2)) == {"ann"} and p(reason.Cardinality(E + "age", "max", 0)) == {"cat"} and p(reason.Cardinality(E + "age", "min", 0)) == {"ann", "bob", "cat"}
    assert p(reason.Intersection(())) == set() and p(reason.Union(())) == set()
    assert p(reason.Every(E + "kid", reason.Named(E + "Person"))) == {"ann", "bob"} and p(reason.Every(E + "age", reason.Named(reason.THING))) == {"ann", "bob", "cat"}
    # dog is no subject, but a value that is no person
    assert p(reason.Some(E + "kid", reason.Complement(reason.Named(E + "Person")))) == {"cat"} and p(reason.Some(E + "age", reason.Named(reason.THING))) == set()


def test_alignment(spark):
    a = reason.Alignment.of(equivalent_properties=[("p", "q")], sub_properties=[("c1", "one"), ("c1x", "two"), ("c2x", "two")], sub_classes=[("K", "L")])
    assert a.properties == {"p": "q", "q": "p", "c1": "one", "one": "c1", "c1x": "two", "c2x": "two"} and a.classes == {"K": "L", "L": "K"}
    assert a.fill(reason.Alignment({"p": "z", "n": "m"}, {})).properties["p"] == "q"
    t = graph(spark, ("x", "kid", E + "y"), ("x", "a", E + "K"), ("x", "other", E + "K"))
    b = reason.Alignment({E + "kid": E + "child"}, {E + "K": E + "L"})
    out = reason.postprocess(t, b, {E + "Has": reason.Some(E + "child", reason.Named(reason.THING))})
    assert {(r["p"], r["o"]) for r in out.collect()} == {(E + "child", E + "y"), (T.RDF_TYPE, E + "L"), (T.RDF_TYPE, E + "Has")}


def test_mapping_document(spark, tmp_path):
    (tmp_path / "people.csv").write_text("Id,Name,Age,Tag\n1,Alice Smith,30,a\n2,,25,b\n")
    doc = f"""@prefix rr: <{mapping.RR}> . @prefix rml: <{mapping.OLD_RML}> . @prefix ex: <{E}> .
    ex:m rml:logicalSource [ rml:source "people.csv" ] ; rr:subjectMap [ rr:template "{E}p/{{Name}}/{{Id}}" ; rr:class ex:P ; rr:graph ex:g ] ;
      rr:predicateObjectMap [ rr:predicate ex:age, ex:years ; rr:objectMap [ rml:reference "Age" ] ; rr:object "c" ] ."""
    maps = mapping.read_document(doc)
    rows = records.read_records(spark, str(tmp_path / "people.csv"))
    assert dict(rows.dtypes) == dict.fromkeys(("Id", "Name", "Age", "Tag"), "string")
    out = mapping.Compiler(maps, {"people.csv": rows}).run().collect()
    assert {r["s"] for r in out} == {E + "p/Alice%20Smith/1"} and {r["g"] for r in out} == {E + "g"}
    assert {(r["p"], r["o"]) for r in out} == {(T.RDF_TYPE, E + "P")} | {(E + p, o) for p in ("age", "years") for o in ("30", "c")}
    with pytest.raises(Exception, match="no value for Name"):
        mapping.Compiler(maps, {"people.csv": rows}, strict=True).run().collect()
    with pytest.raises(ValueError, match="no subject map"):
        mapping.read_document(f'@prefix rml: <{mapping.OLD_RML}> . <http://x> rml:logicalSource [ rml:source "a" ] .')
    fn = mapping.TriplesMap("f", "people.csv", mapping.Term(template=E + "{Id}"), pairs=(mapping.PredicateObject((mapping.Term(constant=E + "n"),), (mapping.Term(function=("toUpperCase", mapping.Term(reference="Name"))),)),))
    assert [r["o"] for r in mapping.Compiler([fn], {"people.csv": rows}).run().collect()] == ["ALICE SMITH"]


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"items": [{"id": 1, "t": ["p", "q"]}, {"id": 2, "t": []}]}}))
    assert [r["id"] for r in records.read_json(spark, str(tmp_path / "a.json"), "$.x.items[*]").collect()] == [1, 2]
    (tmp_path / "b.xml").write_text('<r><e k="1"><n>A</n></e><e k="2"><n>B</n><n>C</n></e></r>')
    got = records.read_xml(spark, str(tmp_path / "b.xml"), "e").collect()
    assert [r["@k"] for r in got] == ["1", "2"]
    assert records.sniff("a.tsv") == "csv" and records.sniff("x", " [1]") == "json" and records.sniff("x", "<a>") == "xml" and records.sniff("x", "a,b") == "csv"
    assert records.formulation("http://semweb.mmlab.be/ns/ql#JSONPath") == "json"


IFC = """ISO-10303-21;
HEADER; FILE_DESCRIPTION((''),'2;1'); FILE_NAME('n;x','t',(''),(''),'','',''); FILE_SCHEMA(('IFC4')); ENDSEC;
DATA;
#1=IFCPROJECT('0000000000000000000001',$,'Pro;ject',$,$,$,$,(#9),#8);
#2=IFCSITE('0000000000000000000002',$,'It''s \\X2\\00E9\\X0\\',$,$,$,$,$,.ELEMENT.,$,$,0.,$,$);
#3=IFCBUILDING('0000000000000000000003',$,'B',$,$,$,$,$,.ELEMENT.,$,$,$);
#4=IFCBUILDINGSTOREY('0000000000000000000004',$,'S',$,$,$,$,$,.ELEMENT.,1.5E0);
#5=IFCWALL('0000000000000000000$05',$,'W',$,$,$,$,'tag',*);
#6=IFCRELAGGREGATES('r1',$,$,$,#1,(#2));
#7=IFCRELAGGREGATES('r2',$,$,$,#2,(#3));
#10=IFCRELAGGREGATES('r3',$,$,$,#3,(#4));
#11=IFCRELCONTAINEDINSPATIALSTRUCTURE('r4',$,$,$,(#5),#4);
#12=IFCPROPERTYSINGLEVALUE('Fire',$,IFCLABEL('F30'),$);
#13=IFCPROPERTYSET('ps',$,'Pset',$,(#12));
#14=IFCRELDEFINESBYPROPERTIES('r5',$,$,$,(#5),#13);
#15=IFCX(.T.,.F.,-3,(1,(2.5,#3)),IFCLENGTHMEASURE(2.),@@,'a');
#15=IFCX('last');
ENDSEC;
END-ISO-10303-21;
"""


def test_step(spark, tmp_path):
    (tmp_path / "m.ifc").write_text(IFC)
    e = step.read_step(spark, str(tmp_path / "m.ifc")).cache()
    assert e.count() == 13 and step.schema_version(IFC) == "IFC4"
    assert [v["k"] for v in step.parse_arguments(".T.,.F.,-3,(1,(2.5,#3)),IFCL(2.),'a',$,*,.X.")] == ["bool", "bool", "int", "list", "typed", "string", "null", "derived", "enum"]
    assert [v["k"] for v in step.parse_arguments("@@,1")] == ["int"]
    assert json.loads(e.where("id = 15").first()["args"]) == [{"k": "string", "v": "last"}]
    nodes = {r["id"]: (r["level"], r["name"]) for r in model.spatial_nodes(e).collect()}
    assert nodes == {1: ("project", "Pro;ject"), 2: ("site", "It's é"), 3: ("building", "B"), 4: ("storey", "S")}
    t = model.building_graph(e, "http://b.org", ["IFCWALL"]).collect()
    short = {(r["s"].rpartition("/")[2], r["p"].rpartition("#")[2], r["o"].rpartition("/")[2].rpartition("#")[2]) for r in t}
    assert ("storey_0000000000000000000004", "containsElement", "wall_0000000000000000000%2405") in short
    assert ("building_0000000000000000000003", "hasStorey", "storey_0000000000000000000004") in short and ("wall_0000000000000000000%2405", "type", "Element") in short
    assert [tuple(r) for r in model.property_values(e).collect()] == [(13, "Pset", "Fire", "F30")]
    assert [tuple(r) for r in model.defined_by(e).collect()] == [(5, 13)]


def test_guid_codec():
    u = str(uuid.UUID(int=0x1234567890ABCDEF1234567890ABCDEF))
    assert model.expand_guid(model.compress_guid(u)) == u and len(model.compress_guid(u)) == 22
    with pytest.raises(ValueError):
        model.expand_guid("z" * 22)


def test_value_literals(spark):
    rows = [("5", "", "5", T.XSD_INTEGER), ("2.50", "", "2.5", T.XSD_DECIMAL), ("true", "", "true", T.XSD_BOOLEAN), (" x ", "", "x", ""), ("", "", None, None), ("-1.#IND", "", None, None), ("0", "IFCPOSITIVELENGTHMEASURE", None, None)]
    for r in spark.createDataFrame(rows, "v string, m string, o string, dt string").select(model.value_literal(F.col("v"), F.col("m")).alias("x"), "o", "dt").collect():
        assert (r["x"]["o"], r["x"]["o_dt"]) == (r["o"], r["dt"]) if r["x"] else r["o"] is None


def test_closure_with_cycle(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(10, 3)], "parent int, child int")
    got = {(r["node"], r["depth"]) for r in topology.closure(edges, spark.createDataFrame([(0,)], "root int")).collect()}
    assert got == {(k, k) for k in range(1, 11)}


def test_closure_of_a_long_chain(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges, roots = spark.createDataFrame([(k, k + 1) for k in range(103)], "parent int, child int").coalesce(1), spark.createDataFrame([(0,)], "root int")
    assert {(r["node"], r["depth"]) for r in topology.closure(edges, roots).collect()} == {(k, k) for k in range(1, 104)}
    with pytest.raises(RuntimeError, match="depth 3"):
        topology.closure(edges, roots, most_depth=3)


def test_boxes(spark):
    rows = [(1, 0, 2), (2, 1, 3), (3, 2, 4), (4, 5, 6)]
    df = spark.createDataFrame([(i, float(a), float(b), 0.0, 1.0, 0.0, 1.0) for i, a, b in rows], "id int, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double")
    assert {tuple(r) for r in topology.spatial_pairs(df, (1.0, 1.0, 1.0)).collect()} == {(1, 2, "intersects"), (2, 3, "intersects"), (1, 3, "touches")}


def test_meshes(spark):
    corner = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    faces = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    at = lambda k: tuple(map(float, corner[k]))
    tri = spark.createDataFrame([(7, at(a), at(b), at(c)) for a, b, c in faces], "element_id int, v0 struct<x:double,y:double,z:double>, v1 struct<x:double,y:double,z:double>, v2 struct<x:double,y:double,z:double>")
    m = quantity.sound(quantity.mesh_measures(tri)).first()
    assert m["volume"] == pytest.approx(1 / 6) and m["area"] == pytest.approx(1.5 + 3**0.5 / 2) and m["sound"] and m["shadow_x"] == pytest.approx(0.5)
    f = spark.createDataFrame([(7, *x) for x in faces] + [(8, *faces[0])], "element_id int, a int, b int, c int")
    assert {r["element_id"]: (r["closed"], r["oriented"]) for r in quantity.edge_incidence(f).collect()} == {7: (True, True), 8: (False, False)}
    area = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)],)], "p array<struct<x:double,y:double>>").select(quantity.shoelace(F.col("p"))).first()[0]
    assert area == 6.0


def test_gate_and_matching(spark):
    rows = [(float("nan"), 1.0, 2.0), (0.0, 1.0, 2.0), (1.0, 3.0, 2.0), (1.0, 2.0, 2.0), (None, 1.0, 1.0)]
    assert [r["verdict"] for r in quantity.gate(spark.createDataFrame(rows, "value double, net double, gross double")).collect()] == ["not finite", "not positive", "net above gross", "accepted", "not finite"]
    assert matching.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and matching.jaro_winkler("", "a") == 0
    q = spark.createDataFrame([(1, "wall", "netarea"), (2, "wall", "netarae"), (3, "door", "netarea")], "id int, cls string, key string")
    i = spark.createDataFrame([("wall", "netarea", "A"), ("wall", "netareas", "B"), ("wall", "zzz", "C")], "cls string, key string, code string")
    got = {(r["id"], r["code"]) for r in matching.fuzzy(q, i, ties=0.02).collect()}
    assert (1, "A") in got and (2, "A") in got and not any(x == 3 for x, _ in got)


def test_close_keys_are_those_of_the_plain_similarity():
    r = random.Random(3)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    for start in ("", "Customer#00", "ab"):
        for n in (1, 2, 5, 9):
            keys = sorted({start + word(n, "abc01") for _ in range(60)})
            known = matching.Keys(keys)
            for key in [*keys[:5], *(start + word(r.randrange(1, 10), "abc01") for _ in range(10)), word(4, "abcC"), "C", "\U0001f600b"]:
                for least in (0.5, 0.8, 0.94):
                    rows, scores = known.close_to(key, least)
                    want = {k: s for k in keys if (s := round(matching.jaro_winkler(key, k), 12)) >= least}
                    assert {keys[i]: s for i, s in zip(rows.tolist(), scores.tolist())} == pytest.approx(want)


def test_sinks_round_trip(spark, tmp_path):
    rows = [("http://a", "iri", "http://p", 'q"\n\\x', "literal", "", "en", "http://g"), ("b1", "bnode", "http://p", "5", "literal", T.XSD_INTEGER, "", ""), ("http://a", "iri", "http://p", "http://o", "iri", "", "", "")]
    t = spark.createDataFrame(rows, TRIPLE)
    sinks.write_ntriples(t, str(tmp_path / "nq"), graphs=True, compression="gzip")
    back = turtle.read_lines(spark, str(tmp_path / "nq"))
    assert G.is_isomorphic(t, back)
    sinks.write_turtle(t.where("s_kind = 'iri'"), str(tmp_path / "ttl"), {"x": "http://x/"})
    text = "".join(p.read_text() for p in (tmp_path / "ttl").glob("part-*"))
    assert len(turtle.Turtle(text).triples) == 2
    sinks.write_chunks(spark.range(10).selectExpr("cast(id as string) AS value").coalesce(1), str(tmp_path / "c"), 4)
    found = [json.loads(x) for p in (tmp_path / "c" / "_manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["lines"] for x in found) == [2, 4, 4] and sum(x["bytes"] for x in found) == 20
    assert json.loads(sinks.run_log(G.counts_by_graph(t))) == {"": 2, "http://g": 1}
    sinks.write_by_graph(t.where("g <> ''"), str(tmp_path / "g"))
    assert len(list((tmp_path / "g").glob("g=*"))) == 1


def test_set_operations(spark):
    t = graph(spark, ("x", "p", E + "y"), ("x", "p", E + "y"), ("x", "q", ("1", "")))
    assert G.without(t, p=E + "p").count() == 1 and G.matching(t, s=E + "x").count() == 3
    assert {r["p"] for r in G.rename(t, {E + "p": E + "r", E + "y": E + "z"}, ("p", "o")).collect()} == {E + "r", E + "q"}
    assert sorted(r["side"] for r in G.difference(t, t.distinct()).collect()) == ["left"]
    assert [r["n"] for r in G.first_wins(t.withColumn("n", F.lit(1)), ["s"], ["p"]).collect()] == [1]
    assert [r["p"] for r in G.ordered(t).collect()] == [E + "p", E + "p", E + "q"]


def test_modules(spark):
    t = graph(spark, ("x", "p", E + "y"))
    made = []
    all_of = [
        modules.Module("clean", "preprocess", lambda m: m | {"clean": True}),
        modules.Module("one", "produce", lambda m: t, requires=("clean",)),
        modules.Module("two", "produce", lambda m: 1 / 0, may_fail=True),
        modules.Module("post", "postprocess", lambda x: x.union(x), requires=("one",)),
        modules.Module("out", "export", lambda x: made.append(x.count()), requires=("one",)),
        modules.Module("bad", "produce", lambda m: t, conflicts=("one",)),
        modules.Module("loop", "produce", lambda m: t, requires=("loop",)),
        modules.Module("early", "preprocess", lambda m: m, requires=("one",)),
    ]
    assert [m.name for m in modules.resolve(all_of, ["out", "post", "two"])] == ["clean", "one", "two", "post", "out"]
    out, errors = modules.run(all_of, ["out", "post", "two"], {})
    assert made == [2] and set(errors) == {"two"} and {r["g"] for r in out.collect()} == {"one"}
    for wanted in (["bad", "one"], ["loop"], ["early"], ["none"]):
        with pytest.raises(ValueError):
            modules.resolve(all_of, wanted)


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    twice = events.union(events)
    twice.repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    t = G.expand(source.withColumn("ts", F.col("ts").cast("timestamp")), F.concat(F.lit(E), F.col("event_id")), [(E + "type", G.literal(F.col("event_type")))])
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), *[F.lit("").alias(c) if c not in ("s", "o") else F.col("event_id" if c == "s" else "event_type").cast("string").alias(c) for c in G.COLUMNS])
    assert t.isStreaming
    out = stream.into_memory(stream.deduplicated(rows, "ts", "10000 days"), "deduplicated", str(tmp_path / "cp"))
    assert out.count() == events.count()


def test_guids_and_names(spark):
    names = ["", "a", "Wall|Qto", "Ümläut 漢字"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(quantity.SET_NAMESPACE, F.col("n")).alias("u")).withColumn("t", T.compressed_guid(F.col("u"))).withColumn("b", T.expanded_guid(F.col("t"))).collect()
    for r in got:
        assert r["u"] == str(uuid.uuid5(uuid.UUID(quantity.SET_NAMESPACE), r["n"])) == r["b"] and r["t"] == model.compress_guid(r["u"])
    odd = spark.createDataFrame([("x",), ("0" * 22,), ("z" * 22,), (str(uuid.UUID(int=5)).upper(),)], "t string").select(T.expanded_guid(F.col("t")).alias("e"), T.canonical_guid(F.col("t")).alias("c")).collect()
    assert [r["e"] for r in odd] == [None, str(uuid.UUID(int=0)), None, None] and [r["c"] for r in odd] == ["x", "0" * 22, "z" * 22, model.compress_guid(str(uuid.UUID(int=5)))]
    rows = [("Fire Rating", "fireRating"), ("IS EXTERNAL", "IS%5FEXTERNAL"), ("9 lives", "lives"), ("9-A", "p_9%2DA"), ("", "value"), ("Höhe über NN", "hoeheUeberNN"), ("is-External 2", "isExternal"), ("日", "p_%5CX2%5C65E5%5CX0%5C")]
    for r in spark.createDataFrame(rows, "n string, want string").select(T.local_name(F.col("n")).alias("got"), "want", "n").collect():
        assert r["got"] == r["want"], r["n"]
    keys = [("Čapek Şişli", "capeksisli"), ("ﬁre ½ ＡＢＣ", "fire12abc"), ("Größe", "groesse"), ("漢字", ""), ("ōā㎏", "oakg")]
    assert all(r["k"] == r["want"] for r in spark.createDataFrame(keys, "n string, want string").select(T.norm_key(F.col("n")).alias("k"), "want").collect())
    shown = spark.createDataFrame([("a\x01\x85\"\n",)], "t string").select(T.escape_controls(F.col("t"))).first()[0]
    assert shown == 'a\\u0001\\u0085\\"\\n'


def test_profiles_and_variants(spark):
    base = matching.Profile("base", prop_aliases={"a": "x", "b": "y"}, set_prop_aliases={"s": {"p": "one"}}, least=0.9)
    top = matching.Profile("top", prop_aliases={"b": "z"}, set_prop_aliases={"s": {"q": "two"}})
    got = matching.inherited({"base": (base, None), "top": (top, "base")}, "top")
    assert (got.name, got.prop_aliases, got.set_prop_aliases, got.least) == ("top", {"a": "x", "b": "z"}, {"s": {"p": "one", "q": "two"}}, 0.9)
    for broken in ({"a": (base, "a")}, {"a": (base, "b")}):
        with pytest.raises(ValueError):
            matching.inherited(broken, "a")
    rows = spark.createDataFrame([("bsdPset_X Fire Rating",), ("Group::Sub/Net Area",), (" ",), ("a|b",)], "n string")
    got = [r["v"] for r in rows.select(matching.variants(F.col("n"), F.lit(None).cast("string"), segments=True).alias("v")).collect()]
    assert got == [["bsdpsetxfirerating", "firerating", "rating"], ["groupsubnetarea", "subnetarea", "netarea", "area"], [], ["ab", "b"]]


def test_ladder_on_odd_rows(spark):
    index = spark.createDataFrame([("wall", "common", "firerating", "F"), ("wall", "common", "netarea", "N"), ("door", "other", "netarea", "M")], "cls string, pset string, prop string, code string")
    rows = [(1, "IFC4", "Wall", "Common", "Fire Rating"), (1, "IFC4", "Wall", "Common", "Fire Rating"), (2, None, None, None, None), (3, "IFC4", "Wall", "x", "Fire Ratnig"), (4, "IFC4", "Window", "x", "NetArea"), (5, "IFC4", "Window", "x", "Fire Ratnig")]
    asked = spark.createDataFrame(rows, "id int, schema string, cls string, pset string, prop string").withColumn("note", F.lit("kept"))
    got = sorted((r["id"], r["status"], r["method"], r["code"], r["candidates"]) for r in matching.ladder(asked, index).collect())
    assert got == [(1, "mapped", "exact_class_pset_prop", "F", [])] * 2 + [(2, "unmapped", "unmapped", None, []), (3, "normalized", "fuzzy", "F", []), (4, "ambiguous", "ambiguous_prop", None, ["M", "N"]), (5, "unmapped", "unmapped", None, [])]
    assert matching.ladder(asked.limit(0), index).count() == 0 and {r["status"] for r in matching.ladder(asked, index.limit(0)).collect()} == {"unmapped"}
    hard = matching.Profile(hard={"ifc4|wall|common|firerating": "H"})
    assert {(r["code"], r["method"]) for r in matching.ladder(asked.where("id = 1"), index, hard).collect()} == {("H", "hard_override")}


def test_json_paths(spark, tmp_path):
    doc = {"a": {"list": [{"id": 1, "n": {"id": 9}}, {"id": 2, "n": {"id": 8}}], "one": {"id": 3}}, "odd key": [[1, 2], [3]]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    read = lambda p: sorted(tuple(r) for r in records.read_json(spark, str(tmp_path / "d.json"), p).collect())
    assert [r[0] for r in read("$.a.list[*]")] == [1, 2] == [r[0] for r in read("$.a['list']")]
    assert read("$.a.list[1].id") == [(2,)] and read("$.a.list[-1].id") == [(2,)] and read("$.a.one") == [(3,)]
    assert read("$..id") == [(1,), (2,), (3,), (8,), (9,)] and read("$['odd key'][*][*]") == [(1,), (2,), (3,)]
    assert read("$.a.list[?(@.id >= 2)].n.id") == [(8,)] and read("$.none.x") == []
    for bad in ("a.b", "$.a[", "$.a[?(@.x ~ 1)]"):
        with pytest.raises(ValueError):
            records.path_steps(bad)
    rows = spark.createDataFrame([(1, '{"x": [{"k": "a"}, {"k": "b"}]}'), (2, "no json"), (3, None)], "id int, t string")
    assert sorted(tuple(r) for r in records.json_column(rows, "t", "struct<x:array<struct<k:string>>>", "$.x[*]").collect()) == [(1, "a"), (1, "b")]


def test_xml_paths(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<c xmlns="http://n"><b k="1"><t>A</t><t>B</t><e/></b><x><b k="2">text<t>C</t></b></x></c>')
    read = lambda p: records.read_xml(spark, str(tmp_path / "d.xml"), p).collect()
    direct = read("/c/b")
    assert len(direct) == 1 and direct[0]["@k"] == "1" and direct[0]["t"] == ["A", "B"] and direct[0]["e"] == "" and direct[0]["_name"] == "b"
    assert {r["@k"] for r in read("/c//b")} == {"1", "2"} and [r["_text"] for r in read("/c/x/b[@k='2']")] == ["text"] and len(read("/*")) == 1


def test_sources_of_documents(spark, tmp_path):
    assert records.with_source("rml:source 'data.csv' ; 'input.csv'", "real.csv") == "rml:source 'real.csv' ; 'input.csv'" and records.with_source("source.xml", "my-source.xml") == "source.xml"
    (tmp_path / "p.csv").write_text("a,b\n1,\n")
    assert [tuple(r) for r in records.open_source(spark, {"source": str(tmp_path / "p.csv"), "formulation": "http://x/ql#CSV"}).collect()] == [("1", None)]
    (tmp_path / "p.json").write_text('{"r": [{"a": 1}]}')
    assert records.open_source(spark, {"source": str(tmp_path / "p.json"), "iterator": "$.r[*]"}).first()["a"] == 1
    for bad in ({}, {"source": "http://x/y.csv"}, {"source": "x", "endpoint": "http://s"}):
        with pytest.raises(ValueError):
            records.open_source(spark, bad)


def test_trig_and_alignment_documents():
    doc = turtle.Turtle("@prefix e: <http://e/> . e:a e:b e:c . e:g { e:x e:y e:z , 1 . e:k e:l [ e:m 2 ] } GRAPH <http://h> { e:q a e:r . } { e:o e:o e:o }")
    assert [(s[9:], g) for s, _, _, g in doc.quads if s.startswith("http")] == [("a", ""), ("x", "http://e/g"), ("x", "http://e/g"), ("k", "http://e/g"), ("q", "http://h"), ("o", "")]
    head = "@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix al: <http://knowledgeweb.semanticweb.org/heterogeneity/alignment#> . @prefix e: <http://e/> . "
    own = turtle.Turtle(head + "e:p o:equivalentProperty e:q . e:c r:subPropertyOf e:d . e:K o:equivalentClass e:L . e:M o:equivalentClass [ o:unionOf ( e:K ) ] . [] al:entity1 e:u ; al:entity2 e:v .")
    more = turtle.Turtle(head + "e:p o:equivalentProperty e:z . e:s r:subClassOf e:t . e:s2 r:subClassOf e:t .")
    a = turtle.alignment(own, more)
    short = lambda names: {k[9:]: v[9:] for k, v in names.items()}
    assert short(a.properties) == {"p": "q", "q": "p", "c": "d", "d": "c", "u": "v", "z": "p"} and short(a.classes) == {"K": "L", "L": "K", "s": "t", "s2": "t"}
    limited, warnings = turtle.rules(turtle.Turtle(head + "e:X o:equivalentClass [ o:onProperty e:p ; o:minQualifiedCardinality 1 ; o:onClass e:K ] ."))
    assert not limited and len(warnings) == 1


def test_unreadable_lines_are_no_silence(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://a> <http://p> "caf\\u00e9 \\\\u0041 \\U0001F600" .\n# note\n\n<http://a> broken\n')
    with pytest.raises(Exception, match="no statement"):
        turtle.read_lines(spark, str(tmp_path / "a.nt")).collect()
    assert [r["o"] for r in turtle.read_lines(spark, str(tmp_path / "a.nt"), skip_unreadable=True).collect()] == ["café \\u0041 \U0001f600"]
    assert [r["value"] for r in turtle.unreadable(spark, str(tmp_path / "a.nt")).collect()] == ["<http://a> broken"]


def test_entities_with_nested_lists_and_loose_references(spark):
    args = json.dumps([{"k": "list", "v": [{"k": "list", "v": [{"k": "int", "v": 1}]}, {"k": "list", "v": [{"k": "int", "v": 2}]}]}, {"k": "ref", "v": 99}, {"k": "string", "v": "x ] [ \" y"}, {"k": "null", "v": None}])
    e = spark.createDataFrame([(7, "IFCA", args)], "id long, entity_name string, args string")
    known = spark.createDataFrame([("IFCA", 0, "grid", "Row_List_List"), ("IFCA", 2, "text", "Label")], "entity_name string, pos int, predicate string, range string")
    full = entities.emit(e, known, "http://b").collect()
    kinds = [r["o"].rpartition("#")[2] for r in full if r["p"] == T.RDF_TYPE]
    assert sorted(kinds) == ["IfcA", "Label", "Row", "Row", "Row_List", "Row_List", "Row_List_List", "Row_List_List"] and not any("99" in r["o"] for r in full)
    assert [r["o"] for r in full if r["p"].endswith("hasString")] == ['x ] [ " y'] and sum(r["p"].endswith("hasNext") for r in full) == 1
    plain = entities.emit(e, known, "http://b", "projected").collect()
    assert sorted(r["o"] for r in plain if r["o_kind"] == "literal") == ["1", "2", 'x ] [ " y'] and sum(r["o"].endswith("#Seq") for r in plain) == 3


def test_fuzzy_rows_are_compared_only_where_an_id_has_several_keys(spark):
    i = spark.createDataFrame([("c", "abcdefgh", "1"), ("c", "abcdefgh", "2"), ("d", "abcdefgh", "1")], "cls string, key string, code string")
    once = spark.createDataFrame([(1, "c", "abcdefgh"), (1, "c", "abcdefgh"), (2, "c", "abcdefgx")], "id int, cls string, key string")
    got = matching.fuzzy(once, i)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2")]
    twice = once.union(spark.createDataFrame([(1, "d", "abcdefgh"), (2, None, "abcdefgh"), (3, "c", "")], once.schema))
    assert sorted(tuple(r)[:2] for r in matching.fuzzy(twice, i).collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2")]


def test_closure_by_ways_has_no_most_rows_or_levels(spark):
    """More than a million rows, more than a hundred levels; ways that meet come once each; a cycle is an error."""
    topology.with_checkpoints(spark)
    wide = spark.range(1_100_000).select(F.lit(0).alias("parent"), (F.col("id") + 1).alias("child"))
    roots = spark.createDataFrame([(0,)], "root int")
    assert topology.closure_sql(spark, wide, roots).count() == 1_100_000
    chain = spark.createDataFrame([(k, k + 1) for k in range(105)] + [(0, 2)], "parent int, child int")
    got = sorted((r["node"], r["depth"]) for r in topology.closure_sql(spark, chain, roots).collect())
    assert got == sorted([(k, k) for k in range(1, 106)] + [(k, k - 1) for k in range(2, 106)])
    for edges in ([(0, 1), (1, 0)], [(0, 1), (1, 2), (2, 1)]):
        with pytest.raises(RuntimeError):
            topology.closure_sql(spark, spark.createDataFrame(edges, "parent int, child int"), roots)


def test_fnv1a64_evaluates_its_text_once(spark):
    """Not in every step over its bytes: with texts made from JSON that was most of the time of full entities."""
    df = spark.createDataFrame([("foobar",), (None,), ("",)], "t string").select(T.fnv1a64(F.reverse("t")).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert [r["h"] for r in df.collect()][1:] == ["cbf29ce484222325"] * 2


def test_spatial_pairs_judge_equal_boxes_once(spark):
    """Copies take part as one shape in the grid, and all of their pairs come out, once each."""
    r = random.Random(5)
    some = [(float(r.randrange(4)), float(r.randrange(4)), float(r.randrange(3))) for _ in range(12)]
    rows = [(k, x, x + 1, y, y + 2, z, z + 1.5) for k, (x, y, z) in enumerate(r.choice(some) for _ in range(150))] + [(200, 0.0, 0.0, 0.0, 2.0, 0.0, 1.5), (201, 0.0, 0.0, 0.0, 2.0, 0.0, 1.5), (202, None, 1.0, 0.0, 2.0, 0.0, 1.5)]
    got = topology.spatial_pairs(spark.createDataFrame(rows, "id long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double"), (1.0, 2.0, 2.0))
    want = []
    for a in rows[:-1]:
        for b in rows[:-1]:
            over = [min(a[k + 1], b[k + 1]) - max(a[k], b[k]) for k in (1, 3, 5)]
            if a[0] < b[0] and (all(o > 1e-6 for o in over) or sum(o > 1e-6 for o in over) == 2 and min(map(abs, over)) <= 1e-6):
                want.append((a[0], b[0], "intersects" if min(over) > 1e-6 else "touches"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()


def test_touching_pairs_of_flat_copies(spark, sf):
    """A flat box touches its copies; the query of touching parts deals shapes, not parts, into the grid."""
    rows = [(k, 0.0, 0.0, 0.0, 2.0, 0.0, 2.0) for k in range(3)] + [(3, 1.0, 2.0, 0.0, 2.0, 0.0, 2.0)]
    flat = spark.createDataFrame(rows, "id long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double")
    assert sorted(tuple(r) for r in topology.spatial_pairs(flat, (1.0, 1.0, 1.0)).collect()) == [(0, 1, "touches"), (0, 2, "touches"), (1, 2, "touches")]
    assert "Aggregate" in queries.QUERIES["spatial_bbox_touch"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_box_are_dealt_to_several_tasks(spark, monkeypatch):
    """Members of two shapes that touch meet list by list, each pair once; no number of members makes it one task."""
    monkeypatch.setattr(topology, "LIST", 10)
    rows = [(k, 0.0 if k % 2 else -0.0, 1.0, 0.0, 2.0, 0.0, 2.0) for k in range(0, 75)] + [(k, 1.0, 2.0, 0.0, 2.0, 0.0, 2.0) for k in range(75, 120)]
    got = topology.spatial_pairs(spark.createDataFrame(rows, "id long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double"), (1.0, 2.0, 2.0))
    parts = {tuple(r) for r in got.select("a", "b", "kind").collect()}
    assert parts == {(a, b, "touches" if a < 75 <= b else "intersects") for a in range(120) for b in range(a + 1, 120)} and got.count() == 120 * 119 // 2
    for kind in ("touches", "intersects"):
        tasks = got.where(F.col("kind") == kind).select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
        assert len(tasks) > 2


def test_keys_meet_only_groups_that_can_hold_their_best(monkeypatch):
    """Of all pairs of names a few are compared, and the result is that of the plain similarity, however the work is cut."""
    met, similar = [], matching._similar
    monkeypatch.setattr(matching, "_similar", lambda a, x, least: met.append(a.shape[1]) or similar(a, x, least))
    names = [f"Customer#{k:09d}" for k in range(0, 60000, 20)]
    asked = [n if k % 3 == 0 else n[:10] + n[11:] for k, n in enumerate(names)]
    rows, others, scores = matching.Keys(names).best_for(matching.Keys(asked, 64), 0.94, 0.02, 3)
    assert sum(met) < len(names) * len(asked) / 10
    for k in (0, 1, 1500, 2999):
        every = {j: round(matching.jaro_winkler(asked[k], n), 12) for j, n in enumerate(names)}
        want = {j: s for j, s in every.items() if s >= 0.94 and s + 0.02 >= max(every.values())}
        assert dict(zip(others[rows == k].tolist(), scores[rows == k].tolist())) == pytest.approx(want)
    r = random.Random(7)
    for letters, start in (("ab", ""), ("abc01", "Customer#"), ("ab\u00e9\u4e2d\U0001f600", "x")):
        left, right = (sorted({start + "".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(120)}) for _ in range(2))
        for least, ties, most in ((0.5, 0.1, 3), (0.8, 0.0, 1), (0.94, 0.02, 0)):
            monkeypatch.setattr(matching.Keys, "BOUNDED", r.choice([1, 70, 1 << 20]))
            monkeypatch.setattr(matching.Keys, "PAIRS", r.choice([3, 100]))
            found = matching.Keys(right, r.choice([1, 3])).best_for(matching.Keys(left, 2), least, ties, most)
            got = {(left[i], right[j]): s for i, j, s in zip(*(x.tolist() for x in found))}
            want = {}
            for k in left:
                every = {(k, o): s for o in right if abs(len(k) - len(o)) <= most and (s := round(matching.jaro_winkler(k, o), 12)) >= least}
                want |= {p: s for p, s in every.items() if s + ties >= max(every.values())}
            assert len(found[0]) == len(got) and got == pytest.approx(want)


def test_fuzzy_lists_of_ids_and_codes(spark, monkeypatch):
    """Lists are cut and expanded whole, nulls among them; codes of several keys count with their best score."""
    monkeypatch.setattr(matching, "LIST", 2)
    q = spark.createDataFrame([(k, "c", "abcdefgh") for k in range(5)] + [(None, "c", "abcdefgh")], "id int, cls string, key string")
    i = spark.createDataFrame([("c", "abcdefgh", str(k)) for k in range(5)] + [("c", "abcdefgh", None), ("c", "abcdefgx", "y")], "cls string, key string, code string")
    got = [(r["id"], r["code"]) for r in matching.fuzzy(q, i, least=0.9, ties=0.001).collect()]
    assert sorted(got, key=repr) == sorted([(a, b) for a in [*range(5), None] for b in ["0", "1", "2", "3", "4", None]], key=repr)
    both = i.union(spark.createDataFrame([("c", "abcdefgx", "0")], i.schema))
    rows = [tuple(r) for r in matching.fuzzy(q.where("id = 1"), both, least=0.9, ties=0.2, places=3).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "0", 1.0), (1, "1", 1.0), (1, "2", 1.0), (1, "3", 1.0), (1, "4", 1.0), (1, None, 1.0), (1, "y", 0.95)], key=repr)


def test_fuzzy_customers_leave_the_last_join_as_they_are(spark, sf):
    got = queries.QUERIES["match_fuzzy_blocked"](spark, sf)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert got.count() == got.distinct().count()


def test_mesh_parts_of_small_elements_are_not_spread_over_rounds(spark):
    """Each row goes to its element once: no table of edges is checkpointed; large elements, and odd ids, give the same."""
    topology.with_checkpoints(spark)
    random.seed(4)
    rows = [(f"e{random.randrange(300)}", *(random.choice([*range(40), None]) for _ in "abc")) for _ in range(3000)] + [("big", k, k + 1, k + 1) for k in range(500)] + [(None, 1, 2, 3), ("none", None, None, 7)]
    f = spark.createDataFrame(rows, "element_id string, a int, b int, c int")
    want = {}
    for e in {r[0] for r in rows if r[0]}:
        label = {}
        for _, a, b, c in (r for r in rows if r[0] == e):
            for x, y in ((a, b), (b, c), (a, c)):
                if x is not None and y is not None:
                    p, q = label.setdefault(x, x), label.setdefault(y, y)
                    p, q = label[x], label[y]
                    label = {k: p if v == q else v for k, v in label.items()}
        if label:
            want[e] = (len(set(label.values())), len(label))
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    size = lambda: store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(store).getLength()
    before = size()
    assert {r[0]: tuple(r[1:]) for r in quantity.parts(f).collect()} == want
    assert size() - before < 20_000
    assert {r[0]: tuple(r[1:]) for r in quantity.parts(f, piece=100).collect()} == want


def test_quantities_of_polygons_meshes_and_sets(spark, tmp_path):
    topology.with_checkpoints(spark)
    square = lambda a, n: [(a, a), (a + n, a), (a + n, a + n), (a, a + n)]
    df = spark.createDataFrame([(square(0.0, 4.0), [square(1.0, 1.0), square(2.5, 1.0)])], "o array<struct<x:double,y:double>>, h array<array<struct<x:double,y:double>>>")
    assert tuple(df.select(quantity.polygon_metrics(F.col("o"), F.col("h")).alias("p")).first()[0]) == (14.0, 16.0, 4.0, 4.0)
    f = spark.createDataFrame([(1, k, k + 1, k + 2) for k in range(0, 40)] + [(1, 100, 101, 102), (2, 1, 2, 3)], "element_id int, a int, b int, c int")
    assert {tuple(r) for r in quantity.parts(f).collect()} == {(1, 2, 45), (2, 1, 3)}
    values = spark.createDataFrame([(1, "GrossVolume", 2.0), (1, "NetVolume", 3.0), (2, "NetVolume", 3.0), (3, "Width", -1.0)], "object long, name string, value double")
    assert {(r["object"], r["name"]): r["verdict"] for r in quantity.checked(values).collect()} == {(1, "GrossVolume"): "accepted", (1, "NetVolume"): "net above gross", (2, "NetVolume"): "accepted", (3, "Width"): "not positive"}
    objects = spark.createDataFrame([("w", "IfcWallStandardCase"), ("s", "IfcSlab")], "object string, cls string")
    expected = spark.createDataFrame([("IfcWall", "Height"), ("IfcWall", "Length")], "cls string, name string")
    assert {tuple(r) for r in quantity.audit_missing(objects, expected, spark.createDataFrame([("w", "HEIGHT")], "object string, name string")).collect()} == {("w", "Length")}


def test_reports_on_skewed_groups(spark):
    r = random.Random(1)
    rows = [("big", r.choice([0.0, 0.5, r.random()])) for _ in range(500)] + [("one", 0.25), ("none", None), ("same", 0.1), ("same", 0.1)]
    got = {x["k"]: x for x in quantity.report(spark.createDataFrame(rows, "k string, relative_error double"), "k").collect()}
    for k in ("big", "one", "same"):
        e = sorted(v for g, v in rows if g == k)
        assert (got[k]["median"], got[k]["p95"]) == tuple(e[int((len(e) - 1) * p + 0.5)] for p in (0.5, 0.95))
    assert got["none"]["median"] is None and got["none"]["computed"] == 0


def test_graphs_in_a_form_two_runs_share(spark):
    topology.with_checkpoints(spark)
    OPM, P = model.OPM, "http://e.org/"

    def run(state, time, n):
        return [(P + "p", OPM + "hasPropertyState", state, "iri", ""), (state, "http://www.w3.org/ns/prov#generatedAtTime", time, "literal", ""), (state, "http://schema.org/value", n, "literal", T.XSD + "double")]

    make = lambda rows: spark.createDataFrame([(s, "iri", p, o, k, dt, "", "") for s, p, o, k, dt in rows], TRIPLE)
    a, b = make(run(P + "s1", "2001", "1.50")), make(run(P + "s9", "2002", "1.5"))
    assert compare.compare(a, b).count() == 0 and compare.compare(a, make(run(P + "s9", "2002", "1.6"))).count() == 2
    cells = lambda names: [row for k, n in enumerate(names) for row in [(n, T.RDF_TYPE, P + "X_List", "iri", ""), (n, "https://w3id.org/list#hasContents", f"v{k}", "literal", "")] + ([(n, "https://w3id.org/list#hasNext", names[k + 1], "iri", "")] if k + 1 < len(names) else [])]
    assert compare.compare(make(cells(["a", "b", "c"])), make(cells(["x", "y", "z"])), scalars=True).count() == 0
    assert compare.compare(make(cells(["a", "b", "c"])), make(cells(["x", "y"])), scalars=True).count() > 0
    facts = spark.createDataFrame([("http://e.org/p", "q", "r")], "s string, p string, o string")
    assert [r["found"] for r in compare.spot_check(a, facts, 5).collect()] == [False]


def test_archive_tables(spark, tmp_path):
    rows = [(1, "string", "a", ""), (2, "real", "1.5", "IFCM"), (3, "int", "4", ""), (4, "bool", "true", ""), (5, None, None, None), (6, "enum", "X", "")]
    split = archive.typed_value(F.col("k"), F.col("v"), F.coalesce(F.col("m"), F.lit("")) != "")
    got = {r["i"]: tuple(r)[1:] for r in spark.createDataFrame(rows, "i int, k string, v string, m string").select("i", *[c.alias(n) for n, c in split.items()]).collect()}
    assert got == {1: ("string", "a", 0.0, 0), 2: ("measure", None, 1.5, 0), 3: ("integer", None, 4.0, 4), 4: ("boolean", "true", 1.0, 1), 5: ("null", None, 0.0, 0), 6: ("enum", "X", 0.0, 0)}
    m = [0.0, 2.0, 0.0, 0.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 10.0, 20.0, 30.0, 1.0]
    df = spark.createDataFrame([((1.0, 0.0, 0.0), m)], "p struct<x:double,y:double,z:double>, m array<double>")
    moved = df.select(archive.world(F.col("p"), F.col("m")).alias("w"), archive.turned(F.col("p"), F.col("m")).alias("t")).first()
    assert tuple(moved["w"]) == (10.0, 22.0, 30.0) and tuple(moved["t"]) == (0.0, 1.0, 0.0)
    v = spark.createDataFrame([(i, k, (float(i), float(k), 0.0), (0.0, 0.0, 1.0)) for i in (2, 1) for k in range(3)], "id int, pos int, point struct<x:double,y:double,z:double>, normal struct<x:double,y:double,z:double>")
    tri = spark.createDataFrame([(2, 0, 0, 1, 2), (1, 0, 0, 1, 2)], "id int, pos int, a int, b int, c int")
    archive.write(archive.mesh_tables(v, tri), str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x" / "VertexBuffer.parquet")).coalesce(1)
    assert [(r["X"], r["Y"]) for r in back.collect()] == [(1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0)]


def test_prefixes_quads_and_byte_chunks(spark):
    t = graph(spark, ("x", "p", E + "y"))
    assert {r[0] for r in G.used_prefixes(t, {"e": E, "q": "http://q/"}).collect()} == {"e"}
    q = spark.createDataFrame([("http://a", "iri", "http://p", "x", "literal", "", "en", "http://g")], TRIPLE)
    assert tuple(G.as_triples(q).first())[5:] == ("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "", "")
    lines = spark.createDataFrame([(chr(97 + k) * 4,) for k in range(10)], "value string")
    assert sorted((r["value"][0], r["chunk"]) for r in G.chunk_of_bytes(lines, ["value"], 12).collect()) == [(chr(97 + k), 5 * k // 12) for k in range(10)]


def test_sets_and_interfaces(spark):
    values = spark.createDataFrame([(1, "Fire Rating", "string", "F", "", 0), (2, "fire-rating", "string", "F", "", 0), (3, "FireRating", "string", "G", "", 0)], "item int, name string, kind string, value string, measure string, n int")
    members = spark.createDataFrame([(10, 0, 1), (10, 1, 2), (10, 2, 3), (10, 3, 99), (11, 0, 2)], "set int, pos int, item int")
    assert sorted(tuple(r) for r in properties.deduplicated_sets(members, values).collect()) == [(10, 0, 1), (10, 2, 3), (10, 3, 99), (11, 0, 2)]
    assert {r["set"]: r["content"] for r in properties.set_contents(members, values).collect()} == {10: "firerating=s:F|firerating=s:F|firerating=s:G", 11: "firerating=s:F"}
    contacts = spark.createDataFrame([(1, 2, -0.5), (2, 1, 0.0), (3, 4, 0.0), (5, 6, 1.0)], "left long, right long, distance double")
    assert {(r["left"], r["right"], r["kind"]) for r in topology.interface_ids(contacts).collect()} == {(1, 2, "IntersectingElement"), (3, 4, "AdjacentElement")}
