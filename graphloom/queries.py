"""Queries over the test tables, one for each operator, with SQL that gives the same rows. A query's SQL stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import matching, model, quantity, reason, topology
from graphloom.operators import triples as G
from graphloom.sources import records
from graphloom.plans.mapping import Compiler, PredicateObject, Ref, Term, TriplesMap, read_document

B = "http://example.org/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables(dict):
    """Tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.read = lambda name: table(spark, sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.read(name)
        return df


#: SQL of a triple's object columns.
IRI_SQL = "'iri' AS o_kind, '' AS o_dt, '' AS o_lang, '' AS g"
LIT_SQL = "'literal' AS o_kind, '' AS o_dt, '' AS o_lang, '' AS g"
TYPE = T.RDF_TYPE


def dt_sql(dt: str) -> str:
    return f"'literal' AS o_kind, '{dt}' AS o_dt, '' AS o_lang, '' AS g"


# --- mappings

CUSTOMER_MAP = f"""
@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://w3id.org/rml/> .
@prefix ex: <{B}> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:customers rml:logicalSource [ rml:source "customer" ] ;
  rr:subjectMap [ rr:template "{B}customer/{{c_custkey}}" ; rr:class ex:Customer ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rml:reference "c_name" ] ] ;
  rr:predicateObjectMap [ rr:predicate ex:nation ; rr:objectMap [ rr:template "{B}nation/{{c_nationkey}}" ] ] ;
  rr:predicateObjectMap [ rr:predicate ex:key ; rr:objectMap [ rml:reference "c_custkey" ; rr:datatype xsd:integer ] ] ;
  rr:predicateObjectMap [ rr:predicate ex:segment ; rr:objectMap [ rml:reference "c_mktsegment" ; rr:language "en" ] ] .
"""


@query(f"""
    SELECT '{B}customer/' || c_custkey AS s, 'iri' AS s_kind, '{TYPE}' AS p, '{B}Customer' AS o, {IRI_SQL} FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, 'iri', '{B}name', c_name, {LIT_SQL} FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, 'iri', '{B}nation', '{B}nation/' || c_nationkey, {IRI_SQL} FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, 'iri', '{B}key', c_custkey::VARCHAR, {dt_sql(T.XSD_INTEGER)} FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, 'iri', '{B}segment', c_mktsegment, 'literal', '', 'en', '' FROM customer""")
def rml_project_customer(spark, sf_dir):
    return Compiler(read_document(CUSTOMER_MAP), Tables(spark, sf_dir)).run()


@query(f"""
    SELECT DISTINCT '{B}part/' || p_partkey AS s, 'iri' AS s_kind, p, o, {LIT_SQL} FROM part,
        LATERAL (SELECT unnest(['{B}brand', '{B}kind', '{B}label']) AS p), LATERAL (SELECT unnest([p_brand, p_type]) AS o)""")
def rml_multi_pom_explode(spark, sf_dir):
    each = PredicateObject(tuple(Term(constant=B + x) for x in ("brand", "kind", "label")), (Term(reference="p_brand"), Term(reference="p_type")))
    return Compiler([TriplesMap("parts", "part", Term(template=B + "part/{p_partkey}"), pairs=(each,))], Tables(spark, sf_dir)).run()


CUSTOMERS = TriplesMap("customers", "customer", Term(template=B + "customer/{c_custkey}"), (B + "Customer",))


def joined_map(name: str, source: str, subject: str, predicate: str, parent: str, *conditions: tuple[str, str], **more) -> TriplesMap:
    return TriplesMap(name, source, Term(template=subject), pairs=(PredicateObject((Term(constant=predicate),), (Ref(parent, conditions, **more),)),))


@query(f"SELECT '{B}order/' || o_orderkey AS s, 'iri' AS s_kind, '{B}placedBy' AS p, '{B}customer/' || c_custkey AS o, {IRI_SQL} FROM orders JOIN customer ON o_custkey = c_custkey")
def rml_join_orders_customer(spark, sf_dir):
    maps = [joined_map("orders", "orders", B + "order/{o_orderkey}", B + "placedBy", "customers", ("o_custkey", "c_custkey")), CUSTOMERS]
    return Compiler(maps, Tables(spark, sf_dir)).compile(maps[0])


@query(f"SELECT '{B}line/' || a.l_orderkey || '-' || a.l_linenumber AS s, 'iri' AS s_kind, '{B}ships' AS p, '{B}supply/' || b.l_partkey || '/' || b.l_suppkey AS o, {IRI_SQL} FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def rml_join_multikey(spark, sf_dir):
    maps = [joined_map("lines", "lineitem", B + "line/{l_orderkey}-{l_linenumber}", B + "ships", "supply", ("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")), TriplesMap("supply", "lineitem", Term(template=B + "supply/{l_partkey}/{l_suppkey}"))]
    return Compiler(maps, Tables(spark, sf_dir)).compile(maps[0])


@query(f"SELECT '{B}region/' || r_regionkey AS s, 'iri' AS s_kind, '{B}sees' AS p, '{B}nation/' || n_nationkey AS o, {IRI_SQL} FROM region, nation")
def rml_crossjoin_region(spark, sf_dir):
    maps = [joined_map("regions", "region", B + "region/{r_regionkey}", B + "sees", "nations"), TriplesMap("nations", "nation", Term(template=B + "nation/{n_nationkey}"))]
    return Compiler(maps, Tables(spark, sf_dir)).compile(maps[0])


@query(f"SELECT '{B}nation/' || n_nationkey AS s, 'iri' AS s_kind, '{B}within' AS p, '{B}area/' || n_regionkey AS o, {IRI_SQL} FROM nation")
def rml_same_row(spark, sf_dir):
    maps = [joined_map("nations", "nation", B + "nation/{n_nationkey}", B + "within", "areas", same_row=True), TriplesMap("areas", "nation", Term(template=B + "area/{n_regionkey}"))]
    return Compiler(maps, Tables(spark, sf_dir)).compile(maps[0])


def chain_maps() -> list[TriplesMap]:
    return [
        joined_map("orders", "orders", B + "order/{o_orderkey}", B + "placedBy", "customers", ("o_custkey", "c_custkey")),
        joined_map("customers", "customer", B + "customer/{c_custkey}", B + "inNation", "nations", ("c_nationkey", "n_nationkey")),
        joined_map("nations", "nation", B + "nation/{n_nationkey}", B + "inRegion", "regions", ("n_regionkey", "r_regionkey")),
        TriplesMap("regions", "region", Term(template=B + "region/{r_regionkey}"), (B + "Region",), (PredicateObject((Term(constant=B + "name"),), (Term(reference="r_name"),)),)),
    ]


CHAIN_SQL = f"""
    SELECT '{B}order/' || o_orderkey AS s, 'iri' AS s_kind, '{B}placedBy' AS p, '{B}customer/' || c_custkey AS o, {IRI_SQL} FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT '{B}customer/' || c_custkey, 'iri', '{B}inNation', '{B}nation/' || n_nationkey, {IRI_SQL} FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT '{B}nation/' || n_nationkey, 'iri', '{B}inRegion', '{B}region/' || r_regionkey, {IRI_SQL} FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT '{B}region/' || r_regionkey, 'iri', '{TYPE}', '{B}Region', {IRI_SQL} FROM region
    UNION ALL SELECT '{B}region/' || r_regionkey, 'iri', '{B}name', r_name, {LIT_SQL} FROM region"""


@query(CHAIN_SQL)
def rml_chain_join(spark, sf_dir):
    return Compiler(chain_maps(), Tables(spark, sf_dir)).run()


@query(f"SELECT '{B}nation/' || n_nationkey AS s, 'iri' AS s_kind, '{B}name' AS p, n_name AS o, 'literal' AS o_kind, '' AS o_dt, '' AS o_lang, '{B}graph/' || n_regionkey AS g FROM nation")
def rml_graph_map(spark, sf_dir):
    m = TriplesMap("nations", "nation", Term(template=B + "nation/{n_nationkey}"), pairs=(PredicateObject((Term(constant=B + "name"),), (Term(reference="n_name"),)),), graph=Term(template=B + "graph/{n_regionkey}"))
    return Compiler([m], Tables(spark, sf_dir)).run()


@query(f"SELECT 'e' || event_id AS s, 'bnode' AS s_kind, '{B}type' AS p, event_type AS o, {LIT_SQL} FROM events")
def rml_termtype_bnode(spark, sf_dir):
    m = TriplesMap("events", "events", Term(template="e{event_id}", kind="bnode"), pairs=(PredicateObject((Term(constant=B + "type"),), (Term(reference="event_type"),)),))
    return Compiler([m], Tables(spark, sf_dir)).run()


@query("""
    WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://other.net/' || p_partkey WHEN 1 THEN '/root' || p_partkey WHEN 2 THEN '#frag' || p_partkey ELSE 'rel' || p_partkey END AS r FROM part)
    SELECT p_partkey, CASE WHEN contains(r, '://') THEN r WHEN starts_with(r, '/') THEN 'http://base.org' || r ELSE 'http://base.org/dir/' || r END AS iri FROM v""")
def rml_base_iri(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, F.concat(F.lit("http://other.net/"), k)).when(k % 4 == 1, F.concat(F.lit("/root"), k)).when(k % 4 == 2, F.concat(F.lit("#frag"), k)).otherwise(F.concat(F.lit("rel"), k)).alias("r"))
    found = Compiler([], {}, base="http://base.org/dir/").terms(rows, Term(reference="r", kind="iri"))
    return rows.select("p_partkey", F.explode(found).alias("t")).select("p_partkey", F.col("t.o").alias("iri"))


@query(f"SELECT DISTINCT '{B}' || p_brand || '/' || t AS s, 'iri' AS s_kind, '{TYPE}' AS p, '{B}Tag' AS o, {IRI_SQL} FROM (SELECT url_encode(p_brand) AS p_brand, url_encode(unnest(string_split(p_name, ' '))) AS t FROM part) WHERE t <> ''")
def rml_multivalue_template(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ").alias("tag"))
    return Compiler([TriplesMap("tags", "tags", Term(template=B + "{p_brand}/{tag}"), (B + "Tag",))], {"tags": rows}).run()


@query(f"SELECT '{B}event/' || event_id AS s, 'iri' AS s_kind, '{B}k' AS p, json_extract_string(props, '$.k') AS o, {dt_sql(T.XSD_INTEGER)} FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def rml_json_reference(spark, sf_dir):
    rows = records.json_column(table(spark, sf_dir, "events").select("event_id", "props"), "props", "struct<k:string>")
    m = TriplesMap("events", "events", Term(template=B + "event/{event_id}"), pairs=(PredicateObject((Term(constant=B + "k"),), (Term(reference="k", datatype=T.XSD_INTEGER),)),))
    return Compiler([m], {"events": rows}).run()


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def xml_xpath_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


LINE_POMS = {"quantity": "l_quantity", "price": "l_extendedprice", "flag": "l_returnflag", "status": "l_linestatus"}


@query("SELECT p, count(*) AS n, sum(length(s))::BIGINT AS characters FROM (SELECT '" + B + "line/' || l_orderkey || '-' || l_linenumber AS s, unnest(['" + TYPE + "', '" + "', '".join(B + k for k in LINE_POMS) + "']) AS p FROM lineitem) GROUP BY p")
def rml_map_lineitem(spark, sf_dir):
    """The mapping benchmark: five triples a line."""
    m = TriplesMap("lines", "lineitem", Term(template=B + "line/{l_orderkey}-{l_linenumber}"), (B + "Line",), tuple(PredicateObject((Term(constant=B + k),), (Term(reference=c),)) for k, c in LINE_POMS.items()))
    made = Compiler([m], Tables(spark, sf_dir)).compile(m)
    return made.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.char_length("s").cast("long")).alias("characters"))


@query()
def rml_map_lineitem_whole(spark, sf_dir):
    """The same triples with their distinct subjects, and a sum of hashes that needs every subject, predicate, object and
    datatype. No SQL has this hash; tested on a small table."""
    m = TriplesMap("lines", "lineitem", Term(template=B + "line/{l_orderkey}-{l_linenumber}"), (B + "Line",), tuple(PredicateObject((Term(constant=B + k),), (Term(reference=c),)) for k, c in LINE_POMS.items()))
    made = Compiler([m], Tables(spark, sf_dir)).compile(m)
    return made.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.sum(F.xxhash64("s", "p", "o", "o_dt").cast("decimal(38,0)")).alias("content"))


# --- scalar functions, over whole texts

def scalar(name: str, build: Callable, sql: str, source: str = "part", key: str = "p_partkey", column: str = "p_name") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, build(F.col(column)).alias("v"))

    query(f"SELECT {key}, {sql.format(c=column)} AS v FROM {source}", name)(run)


DOC = ("documents", "doc_id", "text")
scalar("fn_upper", lambda c: F.upper(F.replace(c, F.lit("ß"), F.lit("ss"))), "upper(replace({c}, 'ß', 'ss'))", *DOC)
scalar("fn_lower", F.lower, "lower({c})", *DOC)
scalar("fn_trim", lambda c: T.trim_unicode(F.concat(F.lit(" \n\t"), c, F.lit("\t "))), "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')", *DOC)
scalar("fn_replace", lambda c: T.REGISTRY["replace"](c, F.lit("th"), F.lit("<>")), "replace({c}, 'th', '<>')", *DOC)
scalar("fn_split", lambda c: F.array_join(T.split_literal(c, "."), "|"), "array_to_string(string_split({c}, '.'), '|')", *DOC)
scalar("fn_concat", lambda c: T.REGISTRY["concat"](c, F.lit("-"), c), "concat({c}, '-', {c})")
scalar("fn_substring", lambda c: T.slice_text(c, 2, 6), "CASE WHEN strlen({c}) >= 6 THEN substr({c}, 3, 4) END", *DOC)
scalar("fn_length", lambda c: F.octet_length(c).cast("long"), "strlen({c})", *DOC)
scalar("fn_contains", lambda c: T.REGISTRY["contains"](c, F.lit("the")), "contains({c}, 'the')::VARCHAR", *DOC)
scalar("fn_starts_with", lambda c: T.REGISTRY["startsWith"](c, F.lit("Th")), "starts_with({c}, 'Th')::VARCHAR", *DOC)
scalar("fn_ends_with", lambda c: T.REGISTRY["endsWith"](c, F.lit(".")), "ends_with({c}, '.')::VARCHAR", *DOC)
scalar("fn_equal", lambda c: T.REGISTRY["equal"](c, F.lit("en")), "({c} = 'en')::VARCHAR", "documents", "doc_id", "lang")
scalar("fn_not_equal", lambda c: T.REGISTRY["notEqual"](c, F.lit("en")), "({c} <> 'en')::VARCHAR", "documents", "doc_id", "lang")
scalar("fn_is_null", lambda c: T.REGISTRY["isNull"](F.nullif(c, F.lit("en"))), "(nullif({c}, 'en') IS NULL)::VARCHAR", "documents", "doc_id", "lang")
scalar("fn_slugify", T.slugify, "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')", *DOC)
scalar("fn_urlencode", T.url_encode, "url_encode({c})", *DOC)
scalar("fn_value_to_string", T.value_to_string, "({c}::BIGINT)::VARCHAR", "lineitem", "l_orderkey", "l_quantity")
scalar("fn_canonical_decimal", lambda c: T.canonical_decimal(c / 7, 6), "regexp_replace(regexp_replace(printf('%.6f', {c} / 7), '0+$', ''), '\\.$', '')", "lineitem", "l_orderkey", "l_extendedprice")
scalar("fn_percent_token", T.percent_token, "replace(replace(replace(url_encode({c}), '.', '%2E'), '-', '%2D'), '~', '%7E')", *DOC)
scalar("fn_norm_key", T.norm_key, "lower(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace({c}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')), '[^A-Za-z0-9]', '', 'g'))", *DOC)
scalar("fn_escape_literal", T.escape_literal, "replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')", *DOC)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ex:part_' || p_partkey ELSE '<http://unknown.net/part_' || p_partkey || '>' END AS v FROM part")
def fn_compact_iri(spark, sf_dir):
    c = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit(B)).otherwise(F.lit("http://unknown.net/")), F.lit("part_"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", T.compact_iri(c, {"ex": B, "e": "http://example"}).alias("v"))


@query("SELECT p_partkey, round(p_size * pow(10.0, (CASE p_partkey % 3 WHEN 0 THEN -3 WHEN 1 THEN 0 ELSE 3 END) * (1 + p_partkey % 2)), 9) AS v FROM part")
def fn_si_scale(spark, sf_dir):
    k = F.col("p_partkey")
    prefix = F.when(k % 3 == 0, "MILLI").when(k % 3 == 1, "").otherwise("KILO")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_size") * T.si_scale(prefix, 1 + k % 2), 9).alias("v"))


@query()
def fn_random(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", T.REGISTRY["random"]().alias("v"))


@query()
def fn_uuid(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", T.REGISTRY["uuid"]().alias("v"))


# --- alignment and reasoning, over a graph of orders, customers and nations

def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    order, customer, nation = F.concat(F.lit(B + "order/"), F.col("o_orderkey")), F.concat(F.lit(B + "customer/"), F.col("c_custkey")), F.concat(F.lit(B + "nation/"), F.col("n_nationkey"))
    a = G.expand(t["orders"], order, [(TYPE, G.iri(B + "Order")), (B + "placedBy", G.iri(F.concat(F.lit(B + "customer/"), F.col("o_custkey")))), (B + "status", G.literal(F.col("o_orderstatus")))])
    b = G.expand(t["customer"], customer, [(TYPE, G.iri(B + "Customer")), (B + "inNation", G.iri(F.concat(F.lit(B + "nation/"), F.col("c_nationkey")))), (B + "segment", G.literal(F.col("c_mktsegment")))])
    c = G.expand(t["nation"], nation, [(TYPE, G.iri(B + "Nation")), (B + "inRegion", G.iri(F.concat(F.lit(B + "region/"), F.col("n_regionkey"))))])
    d = G.expand(t["orders"], F.concat(F.lit(B + "customer/"), F.col("o_custkey")), [(B + "placed", G.iri(order))])
    e = G.expand(t["lineitem"], F.concat(F.lit(B + "order/"), F.col("l_orderkey")), [(B + "flag", G.literal(F.col("l_returnflag")))]).distinct()
    return a.union(b).union(c).union(d).union(e)


OC = f"'{B}order/' || o_orderkey"
CC = f"'{B}customer/' || c_custkey"
NC = f"'{B}nation/' || n_nationkey"
#: All subjects of the graph: also customers that only placed orders and orders that only have lines.
SUBJECTS_SQL = f"(SELECT {OC} AS s FROM orders UNION SELECT {CC} FROM customer UNION SELECT {NC} FROM nation UNION SELECT '{B}customer/' || o_custkey FROM orders UNION SELECT '{B}order/' || l_orderkey FROM lineitem)"
N, I = reason.Named, reason.Intersection
EXPRESSIONS = {
    "owl_named": (N(B + "Customer"), f"SELECT {CC} AS s FROM customer"),
    "owl_intersection": (I((N(B + "Order"), reason.HasValue(B + "status", "F", "literal"), reason.HasValue(B + "flag", "R", "literal"))), f"SELECT {OC} AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "owl_union": (reason.Union((N(B + "Nation"), reason.HasValue(B + "status", "O", "literal"))), f"SELECT {NC} AS s FROM nation UNION SELECT {OC} FROM orders WHERE o_orderstatus = 'O'"),
    "owl_complement": (reason.Complement(N(B + "Order")), f"SELECT s FROM {SUBJECTS_SQL} WHERE s NOT IN (SELECT {OC} FROM orders)"),
    "owl_some": (reason.Some(B + "placed", N(B + "Order")), f"SELECT DISTINCT '{B}customer/' || o_custkey AS s FROM orders"),
    "owl_some_nested": (reason.Some(B + "placedBy", I((N(B + "Customer"), reason.Some(B + "inNation", reason.HasValue(B + "inRegion", B + "region/1"))))), f"SELECT {OC} AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"),
    "owl_all": (I((N(B + "Customer"), reason.Every(B + "placed", reason.HasValue(B + "status", "F", "literal")))), f"SELECT {CC} AS s FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')"),
    "owl_has_value": (reason.HasValue(B + "segment", "BUILDING", "literal"), f"SELECT {CC} AS s FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "owl_card_exact": (I((N(B + "Order"), reason.Cardinality(B + "flag", "exact", 2))), f"SELECT {OC} AS s FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2) ON o_orderkey = l_orderkey"),
    "owl_card_min": (reason.Cardinality(B + "placed", "min", 3), f"SELECT '{B}customer/' || o_custkey AS s FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 3"),
    "owl_card_max": (I((N(B + "Customer"), reason.Cardinality(B + "placed", "max", 1))), f"SELECT {CC} AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <= 1"),
}
for _name, (_e, _sql) in EXPRESSIONS.items():
    query(_sql, _name)(lambda spark, sf_dir, e=_e: reason.Reasoner(order_graph(spark, sf_dir)).answer(e))


@query(f"SELECT '{B}customer/' || o_custkey AS s, '{B}Customer' AS o FROM orders WHERE '{B}customer/' || o_custkey NOT IN (SELECT {CC} FROM customer) GROUP BY ALL UNION ALL SELECT '{B}customer/' || o_custkey, '{B}Regular' FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 5")
def owl_infer_new_only(spark, sf_dir):
    rules = {B + "Customer": reason.Some(B + "placed", N(reason.THING)), B + "Regular": reason.Cardinality(B + "placed", "min", 5)}
    return reason.Reasoner(order_graph(spark, sf_dir)).infer(rules).select("s", "o")


@query(f"""
    SELECT {OC} AS s, '{B}customer' AS p, '{B}customer/' || o_custkey AS o FROM orders
    UNION ALL SELECT {CC}, '{TYPE}', '{B}Client' FROM customer
    UNION ALL SELECT {NC}, '{B}partOf', '{B}region/' || n_regionkey FROM nation""")
def align_rename_changed_only(spark, sf_dir):
    a = reason.Alignment.of(equivalent_properties=[(B + "placedBy", B + "customer")], sub_properties=[(B + "inRegion", B + "partOf"), (B + "elsewhere", B + "partOf")], equivalent_classes=[(B + "Customer", B + "Client")])
    return a.changed(order_graph(spark, sf_dir)).select("s", "p", "o")


@query("SELECT p_brand || '-' || p_size AS parent, min(p_type) AS child FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def align_single_child_reverse(spark, sf_dir):
    return reason.single_children(table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("parent"), F.col("p_type").alias("child")))


# --- model

@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'order' WHEN value > 50 THEN 'large' WHEN event_type LIKE 'c%' THEN 'c' END AS cls FROM events")
def model_classify_route(spark, sf_dir):
    tests = [("order", F.col("event_type") == "purchase"), ("large", F.col("value") > 50), ("c", F.col("event_type").startswith("c"))]
    return model.route(table(spark, sf_dir, "events"), F.col("event_type"), tests).select("event_id", "cls")


@query("""
    WITH own AS (SELECT p_partkey AS object, CASE WHEN p_partkey % 3 = 0 THEN 'size' ELSE 'price' END AS name, p_size::VARCHAR AS value FROM part),
    inherited AS (SELECT p_partkey AS object, unnest(['size', 'brand', NULL]) AS name, p_brand AS value FROM part)
    SELECT DISTINCT * FROM (SELECT * FROM own UNION ALL SELECT i.* FROM inherited i WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.object = i.object AND o.name = i.name))""")
def model_type_shadowing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("object"), F.when(F.col("p_partkey") % 3 == 0, "size").otherwise("price").alias("name"), F.col("p_size").cast("string").alias("value"))
    inherited = part.select(F.col("p_partkey").alias("object"), F.explode(F.array(F.lit("size"), F.lit("brand"), F.lit(None).cast("string"))).alias("name"), F.col("p_brand").alias("value"))
    return model.shadowed(own, inherited)


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def model_last_wins(spark, sf_dir):
    return G.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT s_suppkey AS s, unnest(['label', 'hasPropertyState', 'generatedAtTime', 'value', 'name', 'Property', 'CurrentPropertyState']) AS p FROM supplier) GROUP BY p")
def props_opm_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(B + "supplier/"), F.col("s_suppkey")).alias("subject"), F.lit("main").alias("set_name"), F.lit("name").alias("name"), F.col("s_name").alias("value"))
    made = model.opm(rows, B, "2000-01-01T00:00:00Z")
    last = lambda c: F.regexp_extract(c, "[^/#]+$", 0)
    return made.select(F.when(F.col("p") == TYPE, last("o")).otherwise(last("p")).alias("p"), "s").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query(f"SELECT {CC} AS s, '{B}name' AS p, c_name AS o FROM customer UNION ALL SELECT {CC}, '{B}segment', c_mktsegment FROM customer WHERE c_mktsegment <> '' UNION ALL SELECT {CC}, '{B}nation', c_nationkey::VARCHAR FROM customer")
def props_unpivot(spark, sf_dir):
    return model.unpivot(table(spark, sf_dir, "customer"), F.concat(F.lit(B + "customer/"), F.col("c_custkey")), {"c_name": B + "name", "c_mktsegment": B + "segment", "c_nationkey": B + "nation"}).select("s", "p", "o")


@query("""
    SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child, 'hasNation' AS predicate FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey, 'hasCustomer' FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT 'c' || c_custkey, 'o' || o_orderkey, 'hasOrder' FROM customer JOIN orders ON o_custkey = c_custkey""")
def bot_hierarchy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = {"region": ("r", "r_regionkey"), "nation": ("n", "n_nationkey"), "customer": ("c", "c_custkey"), "orders": ("o", "o_orderkey")}
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    nodes, edges = None, None
    for level, (k, c) in keys.items():
        part = t[level].select(name(k, c).alias("id"), F.lit(level).alias("level"))
        nodes = part if nodes is None else nodes.union(part)
    for a, b, fk, source in (("r", "n", "n_regionkey", "nation"), ("n", "c", "c_nationkey", "customer"), ("c", "o", "o_custkey", "orders")):
        part = t[source].select(name(a, fk).alias("parent"), name(b, keys[source][1]).alias("child"))
        edges = part if edges is None else edges.union(part)
    levels = {("region", "nation"): "hasNation", ("nation", "customer"): "hasCustomer", ("customer", "orders"): "hasOrder"}
    return model.hierarchy(nodes, edges, levels)


PART_OF = """
    WITH RECURSIVE e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1),
    walk(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN e ON e.parent = w.node)
    SELECT root, node, depth FROM walk WHERE depth > 0"""


def part_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child")), part.select(F.col("p_partkey").alias("root"))


@query(PART_OF)
def bot_closure(spark, sf_dir):
    """What every part is made of, by the loop that knows cycles and has no depth."""
    topology.with_checkpoints(spark)
    return topology.closure(*part_of(spark, sf_dir))


@query(PART_OF)
def bot_closure_all_parts(spark, sf_dir):
    """The same by a loop that gives a row for each way, as the recursive query does."""
    return topology.closure_sql(spark, *part_of(spark, sf_dir))


@query("""
    WITH b AS (SELECT l_suppkey AS space, l_partkey AS element, bool_and(l_returnflag = 'R') AS external FROM lineitem GROUP BY ALL),
    p AS (SELECT DISTINCT x.space AS a, y.space AS b FROM b x JOIN b y ON x.element = y.element AND x.space < y.space AND NOT (x.external AND y.external))
    SELECT a, b FROM p UNION ALL SELECT b, a FROM p""")
def topo_adjacent_zone(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("space"), F.col("l_partkey").alias("element"), (F.col("l_returnflag") == "R").alias("external"))
    return topology.adjacent_spaces(rows)


@query("SELECT l_orderkey AS opening, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS host FROM lineitem GROUP BY l_orderkey")
def topo_host_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("opening"), F.col("l_partkey").alias("host"), "l_linenumber")
    return G.last_wins(rows, ["opening"], F.struct("l_linenumber", "host")).select("opening", "host")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 10).cast("double")
    z = (k % 7).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), size.alias("x_min"), (size + 1).alias("x_max"), price.alias("y_min"), (price + 2).alias("y_max"), z.alias("z_min"), (z + 2).alias("z_max"))


BOX_SQL = "WITH b AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, floor(p_retailprice / 10) AS y, (p_partkey % 7)::DOUBLE AS z FROM part), p AS (SELECT a.id AS a, b.id AS b, least(a.x, b.x) + 1 - greatest(a.x, b.x) AS ox, least(a.y, b.y) + 2 - greatest(a.y, b.y) AS oy, least(a.z, b.z) + 2 - greatest(a.z, b.z) AS oz FROM b a JOIN b ON a.id < b.id) "


@query(BOX_SQL + "SELECT a, b FROM p WHERE ox > 1e-6 AND oy > 1e-6 AND oz > 1e-6")
def spatial_bbox_intersect(spark, sf_dir):
    return topology.spatial_pairs(boxes(spark, sf_dir), (1.0, 2.0, 2.0)).where("kind = 'intersects'").select("a", "b")


@query(BOX_SQL + "SELECT a, b FROM p WHERE (abs(ox) <= 1e-6 AND oy > 1e-6 AND oz > 1e-6) OR (ox > 1e-6 AND abs(oy) <= 1e-6 AND oz > 1e-6) OR (ox > 1e-6 AND oy > 1e-6 AND abs(oz) <= 1e-6)")
def spatial_bbox_touch(spark, sf_dir):
    return topology.spatial_pairs(boxes(spark, sf_dir), (1.0, 2.0, 2.0)).where("kind = 'touches'").select("a", "b")


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey")
def canonical_pairs(spark, sf_dir):
    return topology.canonical_pairs(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


# --- matching

def keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    code = F.concat(F.lit("c"), F.col("p_partkey") % 50)
    index = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("pset"), F.col("p_name").alias("prop"), code.alias("code"))
    asked = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_brand")).alias("cls"), F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_type")).alias("pset"), F.col("p_name").alias("prop"))
    return asked, index


CASCADE_SQL = """
    WITH i AS (SELECT p_brand AS cls, p_type AS pset, p_name AS prop, 'c' || p_partkey % 50 AS code FROM part WHERE p_partkey % 2 = 0),
    q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE p_brand END AS cls, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE p_type END AS pset, p_name AS prop FROM part),
    c AS (SELECT q.id, 1 AS l, 'exact' AS level, 1.0::DOUBLE AS sure, code FROM q JOIN i USING (cls, pset, prop)
        UNION ALL SELECT q.id, 2, 'pset_prop', 0.95::DOUBLE, code FROM q JOIN i USING (pset, prop)
        UNION ALL SELECT q.id, 3, 'class_prop', 0.9::DOUBLE, code FROM q JOIN i USING (cls, prop)
        UNION ALL SELECT q.id, 4, 'prop', 0.85::DOUBLE, code FROM q JOIN i USING (prop)),
    b AS (SELECT id, l, level, sure, count(DISTINCT code) AS n, min(code) AS code FROM c WHERE l = (SELECT min(l) FROM c d WHERE d.id = c.id) GROUP BY ALL),
    m AS (SELECT q.id, coalesce(level, 'none') AS level, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status,
        CASE WHEN n = 1 THEN code END AS code, CASE WHEN n = 1 THEN sure ELSE 0.0::DOUBLE END AS confidence FROM q LEFT JOIN b USING (id)) """
CASCADE_SQL = CASCADE_SQL.replace("b AS (SELECT id, l, level, sure, count(DISTINCT code) AS n, min(code) AS code FROM c WHERE l = (SELECT min(l) FROM c d WHERE d.id = c.id) GROUP BY ALL)", "f AS (SELECT *, min(l) OVER (PARTITION BY id) AS first FROM c), b AS (SELECT id, level, sure, count(DISTINCT code) AS n, min(code) AS code FROM f WHERE l = first GROUP BY id, level, sure)")


@query(CASCADE_SQL + "SELECT * FROM m")
def match_cascade(spark, sf_dir):
    return matching.cascade(*keys(spark, sf_dir))


@query(CASCADE_SQL + "SELECT status, level, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 3) AS ratio FROM m GROUP BY ALL")
def match_statistics(spark, sf_dir):
    return matching.statistics(matching.cascade(*keys(spark, sf_dir)))


FUZZY_SQL = """
    WITH q AS (SELECT c_custkey AS id, c_mktsegment AS cls, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE substr(c_name, 1, 10) || substr(c_name, 12) END AS key FROM customer),
    i AS (SELECT c_mktsegment AS cls, c_name AS key, c_custkey::VARCHAR AS code FROM customer),
    s AS (SELECT q.id, q.cls, q.key, i.code, round(jaro_winkler_similarity(q.key, i.key), 12) AS score FROM q JOIN i ON q.cls = i.cls AND q.key[1] = i.key[1] AND abs(length(q.key) - length(i.key)) <= 3),
    b AS (SELECT *, max(score) OVER (PARTITION BY cls, key) AS best FROM s WHERE score >= {0})
    SELECT DISTINCT id, code, round(score, 6) AS score FROM b WHERE score + {1} >= best"""


def fuzzy_customers(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    typo = F.concat(F.substring("c_name", 1, 10), F.substring("c_name", 12, 100))
    asked = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cls"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(typo).alias("key"))
    index = c.select(F.col("c_mktsegment").alias("cls"), F.col("c_name").alias("key"), F.col("c_custkey").cast("string").alias("code"))
    return matching.fuzzy(asked, index, places=6, **options)


@query(FUZZY_SQL.format("0.94", "0.02"))
def match_fuzzy_blocked(spark, sf_dir):
    return fuzzy_customers(spark, sf_dir)


@query(FUZZY_SQL.format("0.9444", "0.020001"))
def match_fuzzy_all_customers(spark, sf_dir):
    """The same with thresholds between the scores there are."""
    return fuzzy_customers(spark, sf_dir, least=0.9444, ties=0.020001)


# --- sets, windows, order

@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first_wins(spark, sf_dir):
    return G.first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT user_id, string_agg(v, '|' ORDER BY v) AS fingerprint FROM (SELECT DISTINCT user_id, event_type || '=' || props AS v FROM events) GROUP BY user_id")
def dedupe_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws("=", "event_type", "props").alias("v")).distinct()
    return rows.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("fingerprint"))


def perturbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = order_graph(spark, sf_dir).select("s", "p", "o")
    return t, t.withColumn("o", F.when(F.col("o") == "BUILDING", "HOUSE").otherwise(F.col("o")))


@query(f"SELECT {CC} AS s, '{B}segment' AS p, unnest(['BUILDING', 'HOUSE']) AS o, unnest(['left', 'right']) AS side FROM customer WHERE c_mktsegment = 'BUILDING'")
def graph_diff(spark, sf_dir):
    return G.difference(*perturbed(spark, sf_dir))


@query("SELECT true AS same, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') = 0 AS subset")
def graph_subset(spark, sf_dir):
    a, b = perturbed(spark, sf_dir)
    return spark.createDataFrame([(G.is_isomorphic(a, a), G.is_subset(a, b))], "same boolean, subset boolean")


@query(f"SELECT {OC} AS s, '{B}status' AS p, 'F' AS o FROM orders WHERE o_orderstatus = 'F'")
def graph_pattern(spark, sf_dir):
    return G.matching(order_graph(spark, sf_dir), p=B + "status", o="F").select("s", "p", "o")


@query(f"SELECT {OC} AS s, '{TYPE}' AS p, '{B}Purchase' AS o FROM orders UNION ALL SELECT {OC}, '{B}placedBy', '{B}customer/' || o_custkey FROM orders UNION ALL SELECT {OC}, '{B}state', o_orderstatus FROM orders")
def graph_rename(spark, sf_dir):
    rows = order_graph(spark, sf_dir).where(F.col("p").isin(B + "placedBy", B + "status") | (F.col("o") == B + "Order"))
    return G.rename(rows, {B + "status": B + "state", B + "Order": B + "Purchase"}, ("p", "o")).select("s", "p", "o")


@query("SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1")
def count_by_graph(spark, sf_dir):
    rows = G.expand(table(spark, sf_dir, "customer"), F.concat(F.lit(B), F.col("c_custkey")), [(B + "name", G.literal(F.col("c_name")))], graph=F.col("c_mktsegment"))
    return G.counts_by_graph(rows)


@query(f"SELECT '{B}customer/' || o_custkey AS s, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey")
def count_distinct_objects(spark, sf_dir):
    return G.distinct_objects(order_graph(spark, sf_dir)).where(F.col("p") == B + "placed").select("s", "n")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def list_has_next(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("SELECT s, p, o, row_number() OVER (ORDER BY s, p, CASE WHEN o_kind <> 'literal' THEN 0 WHEN o_dt = '' THEN 1 ELSE 2 END, o, o_dt) - 1 AS line_no FROM (" + CHAIN_SQL + ")")
def turtle_order(spark, sf_dir):
    rows = Compiler(chain_maps(), Tables(spark, sf_dir)).run().select("s", "p", "o", "o_kind", "o_dt")
    return G.numbered(rows, [F.col("s"), F.col("p"), G.object_rank(), F.col("o"), F.col("o_dt")]).select("s", "p", "o", "line_no")


LINES_SQL = "SELECT '<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"' END || ' .' AS value FROM (" + CHAIN_SQL + ")"


@query(LINES_SQL)
def ntriples_lines(spark, sf_dir):
    return Compiler(chain_maps(), Tables(spark, sf_dir)).run().select(G.ntriples_line().alias("value"))


@query(f"SELECT '<{B}nation/' || n_nationkey || '> <{B}name> \"' || n_name || '\" <{B}graph/' || n_regionkey || '> .' AS value FROM nation")
def nquads_lines(spark, sf_dir):
    rows = G.expand(table(spark, sf_dir, "nation"), F.concat(F.lit(B + "nation/"), F.col("n_nationkey")), [(B + "name", G.literal(F.col("n_name")))], graph=F.concat(F.lit(B + "graph/"), F.col("n_regionkey")))
    return rows.select(G.ntriples_line(True).alias("value"))


@query("SELECT n // 4096 AS chunk, count(*) AS lines, sum(strlen(value) + 1)::BIGINT AS bytes FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS n FROM (" + LINES_SQL + ")) GROUP BY 1")
def chunk_manifest_lines(spark, sf_dir):
    lines = ntriples_lines(spark, sf_dir)
    rows = G.chunk_of_lines(lines, [F.col("value")], 4096)
    return rows.groupBy("chunk").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))


@query("SELECT c::BIGINT AS chunk, count(*) AS lines, sum(b)::BIGINT AS bytes FROM (SELECT b, (sum(b) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - b) // 100000 AS c FROM (SELECT value, strlen(value) + 1 AS b FROM (" + LINES_SQL + "))) GROUP BY 1")
def chunk_manifest_bytes(spark, sf_dir):
    rows = G.chunk_of_bytes(ntriples_lines(spark, sf_dir), [F.col("value")], 100_000)
    return rows.groupBy("chunk").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))


@query("SELECT (n // 4096) % 3 AS core, count(*) AS lines FROM (SELECT row_number() OVER (ORDER BY value) - 1 AS n FROM (" + LINES_SQL + ")) GROUP BY 1")
def chunk_round_robin(spark, sf_dir):
    rows = G.chunk_of_lines(ntriples_lines(spark, sf_dir), [F.col("value")], 4096)
    return rows.groupBy((F.col("chunk") % 3).alias("core")).agg(F.count("*").alias("lines"))


@query(f"SELECT '{B}nation/' || n_nationkey AS s, 'ex:nation_' || n_nationkey || ' ex:name \"' || n_name || '\", \"' || n_nationkey || '\"^^xsd:integer ;' || chr(10) || '    a ex:Nation .' AS block FROM nation")
def turtle_grouped(spark, sf_dir):
    s = F.concat(F.lit(B + "nation_"), F.col("n_nationkey"))
    rows = G.expand(table(spark, sf_dir, "nation"), s, [(TYPE, G.iri(B + "Nation")), (B + "name", G.literal(F.col("n_name"))), (B + "name", G.literal(F.col("n_nationkey"), T.XSD_INTEGER)), (B + "name", G.literal(F.col("n_name")))])
    return G.turtle_blocks(rows, {"ex": B, "xsd": T.XSD}).withColumn("s", F.replace("s", F.lit("nation_"), F.lit("nation/")))


# --- quantities

@query("""
    WITH e AS (SELECT p_partkey AS object, unnest(['Size', 'Price', 'Weight']) AS name FROM part),
    h AS (SELECT p_partkey AS object, 'size' AS name FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'PRICE' FROM part WHERE p_retailprice > 1000)
    SELECT object, name FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.object = e.object AND lower(h.name) = lower(e.name))""")
def audit_missing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").alias("object")
    expected = spark.createDataFrame([("part", "Size"), ("part", "Price"), ("part", "Weight")], "cls string, name string")
    present = part.where("p_size > 10").select(key, F.lit("size").alias("name")).union(part.where("p_retailprice > 1000").select(key, F.lit("PRICE").alias("name")))
    return quantity.audit_missing(part.select(key, F.lit("part").alias("cls")), expected, present)


@query("SELECT CASE WHEN v <= 0 THEN 'not positive' WHEN net > gross * (1 + 1e-9) THEN 'net above gross' ELSE 'accepted' END AS verdict, count(*) AS n FROM (SELECT l_discount AS v, l_extendedprice AS net, l_quantity * 1500 AS gross FROM lineitem) GROUP BY 1")
def gate_refuse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("value"), F.col("l_extendedprice").alias("net"), (F.col("l_quantity") * 1500).alias("gross"))
    return quantity.gate(rows).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS kind, CASE WHEN min(s) = max(s) THEN min(s) END AS scale, min(s) <> max(s) AS conflict FROM (SELECT p_brand, (CASE WHEN p_size > 48 THEN 0.001 ELSE 1.0 END)::DOUBLE AS s FROM part) GROUP BY 1")
def unit_conflict(spark, sf_dir):
    return quantity.unit_scales(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 48, 0.001).otherwise(1.0).alias("scale")))


@query("""
    WITH c AS (SELECT l_returnflag, CASE WHEN l_quantity > 5 THEN abs(l_extendedprice - l_quantity * 1000) / l_extendedprice END AS e FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY e NULLS LAST) AS k, count(e) OVER (PARTITION BY l_returnflag) AS n FROM c)
    SELECT l_returnflag, count(*) AS attempted, count(e) AS computed, round(count(e) / count(*), 9) AS coverage, round(count(*) FILTER (e <= 0.1) / count(e), 9) AS within_share,
        round(max(e) FILTER (k = floor((n - 1) * 0.5 + 0.5) + 1), 9) AS median, round(max(e) FILTER (k = floor((n - 1) * 0.95 + 0.5) + 1), 9) AS p95 FROM r GROUP BY 1""")
def report_percentiles(spark, sf_dir):
    e = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000) / F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 5, e).alias("relative_error"))
    out = quantity.report(rows, "l_returnflag", 0.1)
    return out.select("l_returnflag", "attempted", "computed", *[F.round(c, 9).alias(c) for c in ("coverage", "within_share", "median", "p95")])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS value FROM lineitem ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber LIMIT 20")
def report_outliers(spark, sf_dir):
    v = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").orderBy(v.desc(), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", F.round(v, 6).alias("value"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.struct(*[F.col("embedding")[3 * k + j].cast("double").alias(x) for j, x in enumerate("xyz")]).alias(f"v{k}")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("element_id"), at(0), at(1), at(2))


MESH_SQL = """
    WITH t AS (SELECT label AS element_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    v AS (SELECT element_id, e[1] ax, e[2] ay, e[3] az, e[4] bx, e[5] b2, e[6] bz, e[7] cx, e[8] cy, e[9] cz FROM t),
    n AS (SELECT *, (b2-ay)*(cz-az)-(bz-az)*(cy-ay) nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay)-(b2-ay)*(cx-ax) nz,
        (ax*(b2*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-b2*cx)) / 6 AS vol FROM v)
    SELECT element_id, round(abs(sum(vol)), 6) AS volume, round(sum(sqrt(nx*nx+ny*ny+nz*nz)/2), 6) AS area, count(*) AS triangles,
        round(max(greatest(ax, bx, cx)) - min(least(ax, bx, cx)), 6) AS extent_x, round(sum(abs(nx) / 4), 6) AS shadow_x FROM n GROUP BY 1"""


@query(MESH_SQL)
def mesh_aggregates(spark, sf_dir):
    out = quantity.sound(quantity.mesh_measures(triangles(spark, sf_dir)))
    return out.select("element_id", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"), "triangles", F.round("extent_x", 6).alias("extent_x"), F.round("shadow_x", 6).alias("shadow_x"))


@query("""
    WITH f AS (SELECT l_orderkey AS element_id, l_linenumber % 4 AS a, (l_linenumber + 1) % 4 AS b, (l_linenumber + 2) % 4 AS c FROM lineitem),
    e AS (SELECT element_id, a AS x, b AS y FROM f UNION ALL SELECT element_id, b, c FROM f UNION ALL SELECT element_id, c, a FROM f),
    p AS (SELECT element_id, least(x, y) AS lo, greatest(x, y) AS hi, count(*) AS n, sum((x < y)::INT) AS fw FROM e GROUP BY ALL)
    SELECT element_id, count(*) AS edges, bool_and(n = 2) AS closed, bool_and(n = 2 AND fw = 1) AS oriented FROM p GROUP BY 1""")
def edge_incidence(spark, sf_dir):
    k = F.col("l_linenumber")
    faces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), (k % 4).alias("a"), ((k + 1) % 4).alias("b"), ((k + 2) % 4).alias("c"))
    return quantity.edge_incidence(faces)


@query("SELECT o_orderkey::BIGINT AS object, n AS name, o_totalprice AS authored, v AS computed, round(abs(v - o_totalprice) / abs(o_totalprice), 9) AS relative_error FROM orders LEFT JOIN (SELECT l_orderkey, 'total' AS m, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey, (SELECT 'total' AS n)")
def authored_vs_computed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    authored = t["orders"].select(F.col("o_orderkey").cast("long").alias("object"), F.lit("total").alias("name"), F.col("o_totalprice").alias("authored"))
    values = t["lineitem"].groupBy(F.col("l_orderkey").cast("long").alias("object")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value")).withColumn("name", F.lit("total"))
    return quantity.compared(authored, values).drop("unit_error").withColumn("relative_error", F.round("relative_error", 9))
