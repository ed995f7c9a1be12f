"""Queries over the test tables for matching, emission, quantities, relations, comparison and export, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import archive, compare, entities, matching, model, properties, quantity, topology
from graphloom.operators import triples as G
from graphloom.queries import IRI_SQL, LIT_SQL, ORACLE_SQL, QUERIES, TYPE, B, Tables, dt_sql, order_graph, query, scalar, table  # noqa: F401

BASE, WHEN = "http://example.org/id", "2000-01-01T00:00:00Z"
PROV, STATE = properties.GENERATED, model.OPM + "CurrentPropertyState"


def fnv(x: str) -> str:
    """SQL of the 64-bit FNV-1a hash."""
    step = f"list_transform(range(strlen({x})), lambda nth: ('0x' || substr(hex(encode({x})), 2 * nth + 1, 2))::UHUGEINT)"
    return f"printf('%016x', (list_reduce(list_prepend(14695981039346656037::UHUGEINT, {step}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT)"


NORM = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"

# --- scalar functions

query(f"SELECT p_partkey, {fnv('p_name')} AS v FROM part", "fn_fnv1a64")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", T.fnv1a64(F.col("p_name")).alias("v")))

_WORDS = "list_filter(list_transform(regexp_split_to_array({c}, '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '')"
_LOCAL = f"CASE WHEN upper({{c}}) = {{c}} THEN CASE WHEN regexp_matches({{c}}, '^[A-Za-z]') THEN '' ELSE 'p_' END || regexp_replace(replace(replace(url_encode(replace({{c}}, ' ', '_')), '_', '%5F'), '-', '%2D'), '\\.', '%2E', 'g') ELSE array_to_string(list_transform({_WORDS}, lambda w, i: CASE WHEN i = 1 THEN lower(w[1]) ELSE upper(w[1]) END || substr(w, 2)), '') END"
scalar("fn_local_name", T.local_name, _LOCAL)
scalar("fn_local_name_capitals", T.local_name, _LOCAL, "orders", "o_orderkey", "o_orderpriority")
scalar("fn_pascal_name", lambda c: T.pascal_name(F.concat(F.lit("IFC"), F.upper(F.regexp_replace(c, " ", "_")), F.lit("2D"))), "'Ifc' || array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), '') || '2D'")
scalar("fn_value_signature", lambda c: T.signature(F.when(c == "ECONOMY", F.lit(None)).when(c == "SMALL", "enum").otherwise("string"), c, F.when(c == "LARGE", "IFCLABEL")), "CASE WHEN {c} = 'ECONOMY' THEN 'none' WHEN {c} = 'SMALL' THEN 'e:SMALL' WHEN {c} = 'LARGE' THEN 't:IFCLABEL:s:LARGE' ELSE 's:' || {c} END", "part", "p_partkey", "p_type")
scalar("fn_escape_controls", T.escape_controls, "replace(replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(133), '\\u0085')", "documents", "doc_id", "text")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://qudt.org/vocab/unit/MilliM2' WHEN 1 THEN 'http://qudt.org/vocab/unit/DEG' WHEN 2 THEN NULL ELSE 'http://qudt.org/vocab/unit/M' END AS unit, CASE p_partkey % 3 WHEN 0 THEN 'LENGTHUNIT' WHEN 1 THEN 'PLANEANGLEUNIT' END AS measured FROM part")
def fn_units(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "SQUARE_METRE").when(k % 4 == 1, "DEGREE").otherwise("METRE")
    unit = T.unit_iri(F.when(k % 4 == 1, "conversion").otherwise("si"), name, F.when(k % 4 == 0, "MILLI").when(k % 4 == 2, "KILO"))
    measure = F.when(k % 3 == 0, "IFCPOSITIVELENGTHMEASURE").when(k % 3 == 1, "IFCPLANEANGLEMEASURE").otherwise("IFCLABEL")
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), T.measure_unit(measure).alias("measured"))


@query("SELECT l_orderkey, l_linenumber, round(abs(l_quantity * 1000 - l_extendedprice) / abs(l_extendedprice), 9) AS e, abs(l_extendedprice / (l_quantity * 1000) * 1000 - 1) < 0.01 OR abs(l_extendedprice / (l_quantity * 1000) / 1000 - 1) < 0.01 AS unit_error FROM lineitem")
def fn_relative_error(spark, sf_dir):
    a, c = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.relative_error(a, c), 9).alias("e"), T.unit_error(c, a, F.lit(1000.0)).alias("unit_error"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 50)::VARCHAR WHEN 1 THEN (event_id % 7 = 0)::VARCHAR ELSE event_type END AS v FROM events")
def fn_normal_number(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit(".000"))).when(k % 3 == 1, F.upper((k % 7 == 0).cast("string"))).otherwise(F.col("event_type"))
    dt = F.when(k % 3 == 0, T.XSD + "double").when(k % 3 == 1, T.XSD_BOOLEAN).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", T.normal_number(text, dt).alias("v"))


@query()
def fn_guid(spark, sf_dir):
    """Name-based ids, compressed and expanded again. Tested against the UUID library."""
    made = T.uuid5(quantity.SET_NAMESPACE, F.concat_ws("|", F.col("p_name"), F.col("p_partkey")))
    rows = table(spark, sf_dir, "part").select("p_partkey", made.alias("uuid")).withColumn("token", T.compressed_guid(F.col("uuid")))
    return rows.select("p_partkey", "uuid", "token", T.expanded_guid(F.col("token")).alias("back"))


# --- matching

PROFILE = matching.Profile("shop", hard={"brand1|economy|redwidget": "by hand"}, set_aliases={"small": "MEDIUM"}).over(matching.Profile("base", prop_aliases={"redbolt": "blue bolt"}))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for its name: as it is, behind a group's name, or with its last letters the wrong way round."""
    k, name = F.col("p_partkey"), F.col("p_name")
    n = F.length(name)
    typo = F.concat(F.substring(name, F.lit(1), n - 2), F.substring(name, n, F.lit(1)), F.substring(name, n - 1, F.lit(1)))
    prop = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(F.lit("Group:"), name)).otherwise(typo)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.lit("IFC4").alias("schema"), F.col("p_brand").alias("cls"), F.col("p_type").alias("pset"), prop.alias("prop"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the larger parts, with a code of their own for each brand's second letter."""
    rows = table(spark, sf_dir, "part").where("p_size > 25")
    return rows.select(*[T.norm_key(F.col(c)).alias(n) for c, n in (("p_brand", "cls"), ("p_type", "pset"), ("p_name", "prop"))], F.concat(F.lit("c"), F.length("p_name"), F.lit("-"), F.length("p_brand")).alias("code"))


LADDER_SQL = f"""
    WITH i AS (SELECT {NORM.format('p_brand')} AS cls, {NORM.format('p_type')} AS pset, {NORM.format('p_name')} AS prop, 'c' || length(p_name) || '-' || length(p_brand) AS code FROM part WHERE p_size > 25),
    q AS (SELECT p_partkey AS id, {NORM.format('p_brand')} AS cls, {NORM.format('p_type')} AS s0, p_brand, p_type,
        CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Group:' || p_name ELSE substr(p_name, 1, length(p_name) - 2) || p_name[-1] || p_name[-2] END AS prop FROM part),
    s AS (SELECT id, 0 AS ord, 'medium' AS pset FROM q WHERE s0 = 'small' UNION ALL SELECT id, 1, s0 FROM q),
    n AS (SELECT id, 0 AS ord, 'bluebolt' AS p FROM q WHERE {NORM.format('prop')} = 'redbolt' UNION ALL SELECT id, 1, 'bolt' FROM q WHERE {NORM.format('prop')} = 'redbolt'
        UNION ALL SELECT id, 2, {NORM.format('prop')} FROM q UNION ALL SELECT id, 3, {NORM.format("split_part(prop, ':', -1)")} FROM q
        UNION ALL SELECT id, 4, {NORM.format("substr(prop, instr(prop, ' ') + 1)")} FROM q WHERE instr(prop, ' ') > 0),
    e AS (SELECT q.id, s.ord * 100 + n.ord AS ord, CASE WHEN cls || '|' || pset || '|' || p = 'brand1|economy|redwidget' THEN 'by hand' END AS hard, (SELECT min(code) FROM i WHERE i.cls = q.cls AND i.pset = s.pset AND i.prop = n.p) AS code FROM q JOIN s USING (id) JOIN n USING (id)),
    r1 AS (SELECT id, arg_min(coalesce(hard, code), ord) AS code, arg_min(CASE WHEN hard IS NULL THEN 'exact_class_pset_prop' ELSE 'hard_override' END, ord) AS method FROM e WHERE hard IS NOT NULL OR code IS NOT NULL GROUP BY id),
    l AS (SELECT id, 1 AS rung, [code] AS codes, method, 1.0::DOUBLE AS sure FROM r1
        UNION ALL SELECT id, 2, list_sort(list(DISTINCT code)), 'pset_prop', 0.95::DOUBLE FROM s JOIN n USING (id) JOIN i ON i.pset = s.pset AND i.prop = n.p GROUP BY id
        UNION ALL SELECT id, 3, list_sort(list(DISTINCT code)), 'class_prop', 0.9::DOUBLE FROM q JOIN n USING (id) JOIN i ON i.cls = q.cls AND i.prop = n.p GROUP BY id
        UNION ALL SELECT id, 4, list_sort(list(DISTINCT code)), 'prop', 0.85::DOUBLE FROM n JOIN i ON i.prop = n.p GROUP BY id),
    f AS (SELECT id, arg_min(rung, rung) AS rung, arg_min(codes, rung) AS codes, arg_min(method, rung) AS method, arg_min(sure, rung) AS sure FROM l GROUP BY id),
    z AS (SELECT q.id, n.ord, i.prop, i.code, round(jaro_winkler_similarity(n.p, i.prop), 12) AS score FROM q JOIN n USING (id) JOIN i ON i.cls = q.cls AND i.prop[1] = n.p[1] AND abs(length(i.prop) - length(n.p)) <= 3
        WHERE q.id NOT IN (SELECT id FROM f) AND round(jaro_winkler_similarity(n.p, i.prop), 12) >= 0.94),
    z1 AS (SELECT *, max(score) OVER (PARTITION BY id, ord) AS best, min(ord) OVER (PARTITION BY id) AS first FROM z),
    f5 AS (SELECT id, list_sort(list(DISTINCT code)) AS codes, max(score) AS sure FROM z1 WHERE ord = first AND score + 0.02 >= best GROUP BY id),
    a AS (SELECT * FROM f UNION ALL SELECT id, 5, codes, 'fuzzy', sure FROM f5),
    m AS (SELECT q.id, p_brand AS cls, p_type AS pset, q.prop, CASE WHEN rung IS NULL THEN 'unmapped' WHEN len(codes) > 1 THEN 'ambiguous' WHEN rung = 1 THEN 'mapped' ELSE 'normalized' END AS status,
        CASE WHEN rung IS NULL THEN 'unmapped' WHEN rung = 1 THEN method WHEN rung = 5 THEN CASE WHEN len(codes) = 1 THEN 'fuzzy' ELSE 'fuzzy_ambiguous' END WHEN len(codes) = 1 THEN 'normalized_' || method ELSE 'ambiguous_' || method END AS method,
        CASE WHEN len(codes) = 1 THEN codes[1] END AS code, CASE WHEN len(codes) > 1 THEN array_to_string(codes, ',') ELSE '' END AS candidates, CASE WHEN len(codes) = 1 THEN round(sure, 6) END AS confidence FROM q LEFT JOIN a USING (id)) """


@query(LADDER_SQL + "SELECT id, status, method, code, candidates, confidence FROM m")
def match_ladder(spark, sf_dir):
    out = matching.ladder(asked(spark, sf_dir), dictionary(spark, sf_dir), PROFILE)
    return out.select("id", "status", "method", "code", F.array_join("candidates", ",").alias("candidates"), F.round("confidence", 6).alias("confidence"))


@query(LADDER_SQL + "SELECT pset || '|' || prop AS key, count(*) AS n FROM m WHERE status = 'unmapped' GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def match_histogram_top20(spark, sf_dir):
    return matching.histogram(matching.ladder(asked(spark, sf_dir), dictionary(spark, sf_dir).where("length(prop) > 8"), PROFILE), 20)


# the smaller dictionary of the histogram leaves names without any match
ORACLE_SQL["match_histogram_top20"] = ORACLE_SQL["match_histogram_top20"].replace("FROM part WHERE p_size > 25)", f"FROM part WHERE p_size > 25 AND length({NORM.format('p_name')}) > 8)")


@query(LADDER_SQL + "SELECT count(*) AS rows, round(avg((status = 'mapped')::INT), 3) AS mapped, round(avg((status = 'normalized')::INT), 3) AS normalized, round(avg((status = 'ambiguous')::INT), 3) AS ambiguous, round(avg((status = 'unmapped')::INT), 3) AS unmapped, round(avg(confidence), 3) AS confidence, round(min(CASE WHEN method = 'fuzzy' THEN confidence END), 3) AS fuzzy_min, round(avg(CASE WHEN method = 'fuzzy' THEN confidence END), 3) AS fuzzy_avg, round(max(CASE WHEN method = 'fuzzy' THEN confidence END), 3) AS fuzzy_max FROM m")
def profile_score(spark, sf_dir):
    return matching.score(matching.ladder(asked(spark, sf_dir), dictionary(spark, sf_dir), PROFILE))


@query(f"""
    WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT 'IFC' || p_type FROM part UNION SELECT 'none'), c AS (SELECT 'economy' AS key, 'Economy' AS code UNION ALL SELECT 'ifcsmall', 'Small' UNION ALL SELECT 'large', 'Large')
    SELECT name, coalesce((SELECT code FROM c WHERE key = lower(name)), (SELECT code FROM c WHERE key = 'ifc' || lower(regexp_replace(name, '^IFC', '')))) AS code FROM n""")
def match_classes(spark, sf_dir):
    types = table(spark, sf_dir, "part").select("p_type")
    names = types.select(F.col("p_type").alias("name")).union(types.select(F.concat(F.lit("IFC"), F.col("p_type")))).union(spark.createDataFrame([("none",)], "name string"))
    return matching.resolve_classes(names, spark.createDataFrame([("economy", "Economy"), ("ifcsmall", "Small"), ("large", "Large")], "key string, code string"))


@query(f"""
    WITH e AS (SELECT {NORM.format('p_brand')} AS c, {NORM.format('p_type')} AS s, {NORM.format('p_name')} AS p, p_type AS code FROM part),
    k AS (SELECT code, unnest([{{'scope': 'exact', 'key': c || '|' || s || '|' || p}}, {{'scope': 'pset_prop', 'key': s || '|' || p}}, {{'scope': 'class_prop', 'key': c || '|' || p}}, {{'scope': 'prop', 'key': p}}]) AS k FROM e)
    SELECT k.scope AS scope, k.key AS key, array_to_string(list_sort(list(DISTINCT code)), '|') AS codes, count(DISTINCT code) AS n FROM k GROUP BY 1, 2""")
def index_build(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("pset"), F.col("p_name").alias("prop"), F.col("p_type").alias("code"))
    return matching.build_index(rows).select("scope", "key", F.array_join("codes", "|").alias("codes"), F.col("n").cast("long").alias("n"))


@query("SELECT scope, count(*) AS keys, sum((n > 1)::INT)::BIGINT AS ambiguous FROM (" + ORACLE_SQL["index_build"] + ") GROUP BY 1")
def index_inspect(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("pset"), F.col("p_name").alias("prop"), F.col("p_type").alias("code"))
    return matching.inspect(matching.build_index(rows))


# --- properties

def shop_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of each supplier with its name, its balance as a length and its nation."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    objects = s.select(k.alias("object"), F.concat(F.lit(B + "supplier/"), k).alias("subject"), F.concat(F.lit("g"), k).alias("guid"))
    sets = s.select(k.alias("set"), F.concat(F.lit("set"), k).alias("set_guid"), F.when(k % 5 == 0, None).otherwise("Trade").alias("set_name"))
    value = lambda n, name, kind, v, measure: F.struct((k * 3 + n).alias("item"), F.lit(n).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), v.cast("string").alias("value"), F.lit(measure).alias("measure"))
    items = s.select(k.alias("set"), F.explode(F.array(value(0, "Trade name", "string", F.col("s_name"), ""), value(1, "BALANCE", "real", F.col("s_acctbal"), "IFCPOSITIVELENGTHMEASURE"), value(2, "Nation", "int", F.col("s_nationkey"), ""))).alias("v")).select("set", "v.*")
    rows = properties.object_values(objects, s.select(k.alias("object"), k.alias("set")), sets, items.select("set", "pos", "item"), items.drop("set", "pos"))
    units = spark.createDataFrame([(1, "si", "LENGTHUNIT", "", "METRE"), (2, "si", "AREAUNIT", "", "SQUARE_METRE")], "unit long, kind string, unit_type string, prefix string, unit_name string")
    rows = rows.withColumns({"unit": F.lit(None).cast("long"), "entity": F.lit(None).cast("string")})
    return properties.with_units(rows, units, properties.unit_table(units, units.select("unit")))


SHOP_SQL = f"""
    WITH v AS (SELECT s_suppkey AS k, '{B}supplier/' || s_suppkey AS subject, 'g' || s_suppkey AS guid, 'set' || s_suppkey AS sg, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Trade' END AS sn, s_nationkey, s_name, s_acctbal FROM supplier),
    d AS (SELECT *, regexp_replace(regexp_replace(printf('%.9f', s_acctbal), '0+$', ''), '\\.$', '') AS t FROM v),
    x AS (SELECT k, subject, guid, sg, sn, 'Trade name' AS name, 'tradeName' AS local, s_name AS o, '' AS o_dt, NULL AS unit FROM d
        UNION ALL SELECT k, subject, guid, sg, sn, 'BALANCE', 'BALANCE', t, CASE WHEN regexp_matches(s_acctbal::VARCHAR, '^[+-]?[0-9]+$') THEN '{T.XSD_INTEGER}' ELSE '{T.XSD_DECIMAL}' END, '{T.UNIT}M' FROM d WHERE s_acctbal > 0
        UNION ALL SELECT k, subject, guid, sg, sn, 'Nation', 'nation', s_nationkey::VARCHAR, '{T.XSD_INTEGER}', NULL FROM d),
    h AS (SELECT *, 'http://example.org/id/p_' || {fnv("(local || '|' || sg || '|' || guid)")} AS p, 'http://example.org/id/s_' || {fnv("(local || '|' || sg || '|' || guid || '|' || o)")} AS s, CASE WHEN sn IS NULL THEN name ELSE sn || ':' || name END AS label FROM x) """


@query(SHOP_SQL + f"""
    SELECT subject AS s, '{model.PROPS}' || local AS p, p AS o, {IRI_SQL}, 'iri' AS s_kind FROM h
    UNION SELECT p, '{TYPE}', '{model.OPM}Property', {IRI_SQL}, 'iri' FROM h UNION SELECT p, '{properties.LABEL}', label, {LIT_SQL}, 'iri' FROM h
    UNION SELECT p, '{model.OPM}hasPropertyState', s, {IRI_SQL}, 'iri' FROM h UNION SELECT s, '{TYPE}', '{STATE}', {IRI_SQL}, 'iri' FROM h
    UNION SELECT s, '{PROV}', '{WHEN}', {dt_sql(T.XSD + 'dateTime')}, 'iri' FROM h UNION SELECT s, '{properties.VALUE}', o, 'literal', o_dt, '', '', 'iri' FROM h
    UNION SELECT s, '{properties.HAS_UNIT}', unit, {IRI_SQL}, 'iri' FROM h WHERE unit IS NOT NULL""")
def props_states(spark, sf_dir):
    return properties.states(shop_values(spark, sf_dir), BASE, WHEN)


M = "http://example.org/match#"


@query(SHOP_SQL.replace("http://example.org/id/p_", "http://example.org/id/cp_").replace("http://example.org/id/s_", "http://example.org/id/cs_").replace("local || '|' || sg || '|' || guid || '|' || o", "local || '|' || coalesce(sn, '') || '|' || o").replace("(local || '|' || sg || '|' || guid)", "(local || '|' || coalesce(sn, '') || '|' || o)") + f""",
    c AS (SELECT k, string_agg(t, '|' ORDER BY t) AS content FROM (SELECT k, {NORM.format('name')} || '=' || CASE local WHEN 'tradeName' THEN 's:' WHEN 'nation' THEN 'i:' ELSE 't:IFCPOSITIVELENGTHMEASURE:r:' END || CASE local WHEN 'BALANCE' THEN v ELSE o END AS t
        FROM (SELECT x.*, (SELECT s_acctbal::VARCHAR FROM supplier WHERE s_suppkey = k) AS v FROM x)) GROUP BY k),
    y AS (SELECT h.*, 'http://example.org/id/cps_' || {fnv("(coalesce(sn, '') || '|' || content)")} AS ps FROM h JOIN c USING (k))
    SELECT subject AS s, '{M}hasPropertySet' AS p, ps AS o, {IRI_SQL}, 'iri' AS s_kind FROM y UNION SELECT subject, '{M}hasProperty', p, {IRI_SQL}, 'iri' FROM y
    UNION SELECT ps, '{TYPE}', '{M}PropertySet', {IRI_SQL}, 'iri' FROM y UNION SELECT ps, '{TYPE}', '{M}CustomPropertySet', {IRI_SQL}, 'iri' FROM y UNION SELECT ps, '{properties.LABEL}', sn, {LIT_SQL}, 'iri' FROM y WHERE sn IS NOT NULL
    UNION SELECT ps, '{M}containsProperty', p, {IRI_SQL}, 'iri' FROM y
    UNION SELECT p, '{TYPE}', 'http://example.org/dictionary/prop/N1', {IRI_SQL}, 'iri' FROM y WHERE local = 'nation' UNION SELECT p, '{M}candidateProperty', 'http://example.org/dictionary/prop/' || unnest(['B1', 'B2']), {IRI_SQL}, 'iri' FROM y WHERE local = 'BALANCE'
    UNION SELECT p, '{TYPE}', '{model.OPM}Property', {IRI_SQL}, 'iri' FROM y UNION SELECT p, '{model.OPM}hasPropertyState', s, {IRI_SQL}, 'iri' FROM y UNION SELECT p, '{properties.LABEL}', coalesce(sn, '') || ':' || name, {LIT_SQL}, 'iri' FROM y
    UNION SELECT p, '{TYPE}', '{M}' || CASE WHEN local = 'tradeName' THEN 'CustomProperty' ELSE 'Property' END, {IRI_SQL}, 'iri' FROM y
    UNION SELECT p, '{M}mappingStatus', '{M}' || CASE local WHEN 'tradeName' THEN 'Unmapped' WHEN 'nation' THEN 'Normalized' ELSE 'Ambiguous' END, {IRI_SQL}, 'iri' FROM y
    UNION SELECT p, '{M}matchingMethod', CASE local WHEN 'tradeName' THEN 'unmapped' WHEN 'nation' THEN 'normalized_prop' ELSE 'ambiguous_prop' END, {LIT_SQL}, 'iri' FROM y
    UNION SELECT p, '{M}matchingConfidence', '0.8500', {dt_sql(T.XSD_DECIMAL)}, 'iri' FROM y WHERE local = 'nation'
    UNION SELECT s, '{TYPE}', '{STATE}', {IRI_SQL}, 'iri' FROM y UNION SELECT s, '{PROV}', '{WHEN}', {dt_sql(T.XSD + 'dateTime')}, 'iri' FROM y UNION SELECT s, '{properties.VALUE}', o, 'literal', o_dt, '', '', 'iri' FROM y
    UNION SELECT s, '{properties.HAS_UNIT}', unit, {IRI_SQL}, 'iri' FROM y WHERE unit IS NOT NULL""")
def match_emit(spark, sf_dir):
    """Matched properties in the shared form: equal sets and values are one node."""
    rows = shop_values(spark, sf_dir).withColumns({"schema": F.lit("IFC4"), "cls": F.lit("shop"), "pset": F.coalesce("set_name", F.lit("")), "prop": F.col("name")})
    index = spark.createDataFrame([("a", "b", "nation", "N1"), ("a", "b", "balance", "B1"), ("a", "c", "balance", "B2")], "cls string, pset string, prop string, code string")
    rows = matching.ladder(rows, index)
    contents = properties.set_contents(rows.select("set", "item").distinct(), rows.select("item", "name", "kind", "value", "measure"))
    return properties.match_triples(rows.join(contents, "set").withColumn("set_code", F.lit(None).cast("string")), BASE, WHEN, shared=True)


@query(f"""
    WITH a AS (SELECT '{B}supplier/' || s_suppkey AS subject, 'g' || s_suppkey AS guid, unnest([{{'n': 'globalIdIfcRoot', 'v': 'g' || s_suppkey, 'd': ''}}, {{'n': 'nameIfcRoot', 'v': s_name, 'd': ''}},
        {{'n': CASE WHEN s_suppkey % 2 = 0 THEN 'overallHeightIfcDoor' ELSE 'overallHeight' END, 'v': regexp_replace(regexp_replace(printf('%.9f', s_acctbal), '0+$', ''), '\\.$', ''), 'd': '{T.XSD}double'}}, {{'n': 'numberOfRiserIfcStairFlight', 'v': s_nationkey::VARCHAR, 'd': '{T.XSD}integer'}}]) AS a FROM supplier)
    SELECT subject, guid, a.n AS name, a.v AS o, a.d AS o_dt, a.d = '{T.XSD}double' AS lengthy FROM a""")
def props_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(B + "supplier/"), F.col("s_suppkey")).alias("subject"), F.concat(F.lit("g"), F.col("s_suppkey")).alias("guid"), F.when(F.col("s_suppkey") % 2 == 0, "IFCDOOR").otherwise("IFCWALL").alias("entity_name"), F.col("s_name").alias("name"), F.lit("").alias("description"), F.col("s_acctbal").alias("overall_height"), F.col("s_nationkey").alias("number_of_risers"))
    return properties.attributes(rows).select("subject", "guid", "name", "v.o", "v.o_dt", "lengthy")


@query(f"""
    WITH b AS (SELECT p_partkey AS k, p_size::VARCHAR AS x1, (p_partkey % 7)::VARCHAR AS z1, CASE WHEN p_partkey % 10 = 0 THEN 'POINT Z (1 2 3)' END AS own, p_size = 0 AND p_partkey % 7 = 0 AS none FROM part),
    t AS (SELECT k, coalesce(own, CASE WHEN p THEN NULL ELSE w END) AS wkt FROM (SELECT k, own, none AS p, 'POLYHEDRALSURFACE Z (((0 0 0, ' || x1 || ' 0 0, ' || x1 || ' 0 0, 0 0 0, 0 0 0)), ((0 0 ' || z1 || ', 0 0 ' || z1 || ', ' || x1 || ' 0 ' || z1 || ', ' || x1 || ' 0 ' || z1 || ', 0 0 ' || z1 || ')), ((0 0 0, 0 0 ' || z1 || ', ' || x1 || ' 0 ' || z1 || ', ' || x1 || ' 0 0, 0 0 0)), ((' || x1 || ' 0 0, ' || x1 || ' 0 ' || z1 || ', ' || x1 || ' 0 ' || z1 || ', ' || x1 || ' 0 0, ' || x1 || ' 0 0)), ((' || x1 || ' 0 0, ' || x1 || ' 0 ' || z1 || ', 0 0 ' || z1 || ', 0 0 0, ' || x1 || ' 0 0)), ((0 0 0, 0 0 ' || z1 || ', 0 0 ' || z1 || ', 0 0 0, 0 0 0)))' AS w FROM b))
    SELECT 'part/' || k AS s, 'http://example.org/geometry#hasBoundingBox' AS p, 'http://example.org/id/geometry_g' || k AS o, {IRI_SQL}, 'iri' AS s_kind FROM t WHERE wkt IS NOT NULL
    UNION ALL SELECT 'http://example.org/id/geometry_g' || k, '{TYPE}', '{properties.GEO}Geometry', {IRI_SQL}, 'iri' FROM t WHERE wkt IS NOT NULL
    UNION ALL SELECT 'http://example.org/id/geometry_g' || k, '{properties.GEO}asWKT', wkt, {dt_sql(properties.GEO + 'wktLiteral')}, 'iri' FROM t WHERE wkt IS NOT NULL""")
def box_geometry(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    boxes = part.select(k.alias("object"), *[F.lit(0.0).alias(c) for c in ("x_min", "y_min", "z_min", "y_max")], F.col("p_size").cast("double").alias("x_max"), (k % 7).cast("double").alias("z_max"))
    objects = part.select(k.alias("object"), F.concat(F.lit("part/"), k).alias("subject"), F.concat(F.lit("g"), k).alias("guid"))
    return properties.box_triples(objects, boxes, part.where("p_partkey % 10 = 0").select(k.alias("object"), F.lit("POINT Z (1 2 3)").alias("wkt")), BASE)


@query(f"""
    WITH d AS (SELECT unnest(['SMALL', 'SMALL-Brand#1', 'SMALL-Brand#2', 'LARGE', 'ECONOMY-Brand#3']) AS name), e AS (SELECT 'part/' || p_partkey AS s, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'NOTDEFINED' ELSE p_brand END AS t FROM part WHERE p_type IN (SELECT name FROM d))
    SELECT s, 'iri' AS s_kind, '{TYPE}' AS p, '{B}' || name AS o, {IRI_SQL} FROM (SELECT s, p_type AS name FROM e UNION ALL SELECT s, p_type || '-' || t FROM e) JOIN d USING (name)""")
def product_types(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), k).alias("subject"), F.col("p_type").alias("product"), F.when(k % 3 == 0, "NOTDEFINED").otherwise(F.col("p_brand")).alias("predefined"))
    return properties.product_types(rows, spark.createDataFrame([(n,) for n in ("SMALL", "SMALL-Brand#1", "SMALL-Brand#2", "LARGE", "ECONOMY-Brand#3")], "name string"), B)


@query(f"""
    WITH t AS (SELECT 'supplier/' || s_suppkey AS s, 'http://example.org/id/geometry_g' || s_suppkey AS g FROM supplier)
    SELECT s, 'iri' AS s_kind, '{properties.OMG}hasGeometry' AS p, g AS o, {IRI_SQL} FROM t UNION ALL SELECT g, 'iri', '{TYPE}', '{properties.OMG}Geometry', {IRI_SQL} FROM t""")
def geometry_links(spark, sf_dir):
    k = F.col("s_suppkey")
    return properties.geometry_links(table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), k).alias("subject"), F.concat(F.lit("g"), k).alias("guid")), BASE)


# --- entities

def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers as STEP entities: a name, a reference, a list of references, a list of numbers, a measure."""
    t = Tables(spark, sf_dir)
    arg = lambda k, v, kind=None: F.concat(F.lit(f'{{"k":"{k}",' + (f'"t":"{kind}",' if kind else "") + '"v":'), v, F.lit("}"))
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    row = lambda *args: F.concat(F.lit("["), F.concat_ws(",", *args), F.lit("]"))
    n = F.col("n_nationkey")
    nations = t["nation"].select((n + 1).cast("long").alias("id"), F.lit("IFCNATION").alias("entity_name"), row(arg("string", text("n_name")), arg("list", row(arg("int", n), arg("real", n + 0.5))), F.lit('{"k":"null","v":null}')).alias("args"))
    k = F.col("c_custkey")
    customers = t["customer"].select((k + 1000).alias("id"), F.lit("IFCCUSTOMER").alias("entity_name"), row(arg("typed", arg("real", F.col("c_acctbal")), "IFCMONEY"), arg("ref", F.col("c_nationkey") + 1), arg("list", row(arg("ref", F.lit(1)), arg("ref", F.col("c_nationkey") + 1)))).alias("args"))
    return nations.union(customers)


KNOWN = [("IFCNATION", 0, "name", "Label"), ("IFCNATION", 1, "numbers", "Number_List"), ("IFCCUSTOMER", 0, "balance", "Money"), ("IFCCUSTOMER", 1, "nation", "IfcNation")]
ENTITY_SQL = f"""
    WITH n AS (SELECT 'http://example.org/id/IfcNation_' || (n_nationkey + 1) AS s, n_name, n_nationkey::VARCHAR AS i, (n_nationkey + 0.5)::VARCHAR AS r, n_nationkey + 1 AS id FROM nation),
    c AS (SELECT 'http://example.org/id/IfcCustomer_' || (c_custkey + 1000) AS s, 'http://example.org/id/IfcNation_' || (c_nationkey + 1) AS n, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS v FROM customer),
    E AS (SELECT 'http://example.org/entities#' AS ns),
    b AS (SELECT s, '{TYPE}' AS p, 'http://example.org/entities#IfcNation' AS o, {IRI_SQL} FROM n UNION ALL SELECT s, '{TYPE}', 'http://example.org/entities#IfcCustomer', {IRI_SQL} FROM c
        UNION ALL SELECT s, 'http://example.org/entities#nation', n, {IRI_SQL} FROM c
        UNION ALL SELECT s, 'http://example.org/entities#arg_3', unnest(['http://example.org/id/IfcNation_1', n]), {IRI_SQL} FROM c),
    h AS (SELECT s, i, r, 'http://example.org/id/Number_List_' || {fnv("('list_' || id || '_1_0')")} AS a, 'http://example.org/id/Number_List_' || {fnv("('list_' || id || '_1_1')")} AS z FROM n) """
EX = "http://example.org/entities#"


@query(ENTITY_SQL + f"""SELECT *, 'iri' AS s_kind FROM (SELECT * FROM b UNION ALL SELECT s, '{EX}name', n_name, {LIT_SQL} FROM n UNION ALL SELECT s, '{EX}balance', v, {dt_sql(T.XSD + 'double')} FROM c
    UNION ALL SELECT s, '{EX}numbers', a, {IRI_SQL} FROM h UNION ALL SELECT a, '{TYPE}', '{entities.RDF}Seq', {IRI_SQL} FROM h
    UNION ALL SELECT a, '{entities.RDF}_1', i, {dt_sql(T.XSD_INTEGER)} FROM h UNION ALL SELECT a, '{entities.RDF}_2', r, {dt_sql(T.XSD + 'double')} FROM h)""")
def entity_emit_projected(spark, sf_dir):
    return entities.emit(step_rows(spark, sf_dir), spark.createDataFrame(KNOWN, "entity_name string, pos int, predicate string, range string"), BASE, "projected")


def _node(cls: str, dt: str, value: str) -> str:
    return f"'http://example.org/id/{cls}_' || " + fnv(f"('{cls}|{dt}|' || {value})")


@query(ENTITY_SQL + f""",
    v AS (SELECT s, '{EX}name' AS p, {_node('Label', '', 'n_name')} AS node, 'Label' AS cls, n_name AS o, '' AS dt, 'hasString' AS holds FROM n
        UNION ALL SELECT s, '{EX}balance', {_node('IfcMoney', T.XSD + 'double', 'v')}, 'IfcMoney', v, '{T.XSD}double', 'hasDouble' FROM c
        UNION ALL SELECT a, 'https://w3id.org/list#hasContents', {_node('Number', T.XSD_INTEGER, 'i')}, 'Number', i, '{T.XSD_INTEGER}', 'hasInteger' FROM h
        UNION ALL SELECT z, 'https://w3id.org/list#hasContents', {_node('Number', T.XSD + 'double', 'r')}, 'Number', r, '{T.XSD}double', 'hasDouble' FROM h)
    SELECT *, 'iri' AS s_kind FROM (SELECT * FROM b UNION ALL SELECT s, p, node, {IRI_SQL} FROM v UNION ALL SELECT DISTINCT node, '{TYPE}', '{EX}' || cls, {IRI_SQL} FROM v
    UNION ALL SELECT DISTINCT node, 'https://w3id.org/express#' || holds, o, 'literal', dt, '', '' FROM v
    UNION ALL SELECT s, '{EX}numbers', a, {IRI_SQL} FROM h UNION ALL SELECT unnest([a, z]), '{TYPE}', '{EX}Number_List', {IRI_SQL} FROM h UNION ALL SELECT a, 'https://w3id.org/list#hasNext', z, {IRI_SQL} FROM h)""")
def entity_emit_full(spark, sf_dir):
    return entities.emit(step_rows(spark, sf_dir), spark.createDataFrame(KNOWN, "entity_name string, pos int, predicate string, range string"), BASE, "full")


# --- quantities

def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a, b = F.col("p_partkey"), F.col("p_size") + 1.0, F.col("p_retailprice") / 100
    kind = F.when(k % 5 == 0, "RECTANGLE").when(k % 5 == 1, "CIRCLEHOLLOW").when(k % 5 == 2, "ISHAPE").when(k % 5 == 3, "LSHAPE").otherwise("TRAPEZIUM")
    d = F.when(k % 5 == 0, F.array(a, b)).when(k % 5 == 1, F.array(a, F.lit(0.25))).when(k % 5 == 2, F.array(a, b, F.lit(0.5), F.lit(0.25))).when(k % 5 == 3, F.array(a, F.lit(None).cast("double"), F.lit(0.5))).otherwise(F.array(a, b, F.lit(3.0)))
    return table(spark, sf_dir, "part").select(k.alias("object"), quantity.profile_metrics(kind, d).alias("p"), a.alias("depth"))


PROFILE_SQL = """
    WITH x AS (SELECT p_partkey AS object, p_size + 1.0::DOUBLE AS a, p_retailprice / 100 AS b FROM part),
    m AS (SELECT object, a, CASE object % 5 WHEN 0 THEN a * b WHEN 1 THEN pi() * (a * a - pow(greatest(a - 0.25, 0), 2)) WHEN 2 THEN 2 * a * 0.25 + greatest(b - 0.5, 0) * 0.5 WHEN 3 THEN 0.5 * (2 * a - 0.5) ELSE (a + b) * 1.5 END AS area,
        CASE object % 5 WHEN 0 THEN 2 * (a + b) WHEN 1 THEN 2 * pi() * a WHEN 2 THEN 2 * (a + b) + 2 * (a - 0.5) WHEN 3 THEN 4 * a ELSE a + b + 3 + sqrt(pow(a - b, 2) + 9) END AS perimeter,
        CASE object % 5 WHEN 0 THEN least(a, b) WHEN 1 THEN 2 * a WHEN 2 THEN least(a, b) WHEN 3 THEN 0.5 ELSE least(3, a, b) END AS min_span,
        CASE object % 5 WHEN 0 THEN greatest(a, b) WHEN 1 THEN 2 * a WHEN 2 THEN greatest(a, b) WHEN 3 THEN a ELSE greatest(3, a, b) END AS max_span FROM x) """


@query(PROFILE_SQL + "SELECT object, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(min_span, 6) AS min_span, round(max_span, 6) AS max_span FROM m")
def qto_profile(spark, sf_dir):
    return profiles(spark, sf_dir).select("object", *[F.round(f"p.{c}", 6).alias(c) for c in ("area", "perimeter", "min_span", "max_span")])


@query(PROFILE_SQL + "SELECT object, round(area * a * 0.8, 5) AS volume, round(perimeter * a, 5) AS lateral_area, round(perimeter * a + 2 * area, 5) AS total_area, round(a * 0.8, 5) AS height FROM m WHERE object % 7 <> 0")
def qto_extrusion(spark, sf_dir):
    along = F.when(F.col("object") % 7 == 0, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).otherwise(F.struct(F.lit(3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-4.0).alias("z")))
    rows = profiles(spark, sf_dir).withColumn("e", quantity.extrusion(F.col("p"), F.col("depth"), along)).where("e IS NOT NULL")
    return rows.select("object", *[F.round(f"e.{c}", 5).alias(c) for c in ("volume", "lateral_area", "total_area", "height")])


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elements: rectangles swept upright, with a mesh of the same box; some voided, some of two solids."""
    k, a, h = F.col("p_partkey"), F.col("p_size") + 1.0, F.col("p_retailprice") / 100
    cls = F.when(k % 4 == 0, "IFCWALL").when(k % 4 == 1, "IFCSLAB").when(k % 4 == 2, "IFCBEAM").otherwise("IFCSPACE")
    area, around = a * 2, 2 * (a + 2)
    mesh = F.struct((k % 6 != 0).alias("proved"), (area * h).alias("volume"), (around * h + 2 * area).alias("area"), area.alias("footprint"), a.alias("extent_x"), F.lit(2.0).alias("extent_y"), h.alias("extent_z"), area.alias("box_area"), around.alias("box_round"), F.lit(True).alias("fills"))
    p = F.struct(area.alias("area"), around.alias("perimeter"), F.least(a, F.lit(2.0)).alias("min_span"), F.greatest(a, F.lit(2.0)).alias("max_span"))
    sweep = F.struct(F.when(k % 9 == 0, 2).otherwise(1).alias("parts"), (area * h * F.when(k % 9 == 0, 2).otherwise(1)).alias("volume"), p.alias("p"), (around * h + 2 * area).alias("total_area"), h.alias("height"), h.alias("depth"))
    return table(spark, sf_dir, "part").select(k.alias("object"), cls.alias("cls"), (k % 5 == 0).alias("voided"), F.when(k % 8 == 0, F.lit(7.5)).alias("inline_height"), mesh.alias("mesh"), F.when(k % 3 != 0, sweep).alias("sweep"))


WANTED = ("NetVolume", "GrossVolume", "NetSurfaceArea", "GrossSurfaceArea", "GrossFootprintArea", "NetFootprintArea", "GrossArea", "NetArea", "Width", "Height", "Depth", "Length", "Perimeter", "GrossSideArea", "GrossFloorArea", "GrossPerimeter")
RULES_SQL = """
    WITH x AS (SELECT p_partkey AS k, p_size + 1.0::DOUBLE AS a, p_retailprice / 100 AS h, p_partkey % 4 AS c, p_partkey % 5 = 0 AS voided, p_partkey % 6 <> 0 AS proved, p_partkey % 3 <> 0 AS swept, CASE WHEN p_partkey % 9 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN p_partkey % 8 = 0 THEN 7.5 END AS inline FROM part),
    y AS (SELECT *, a * 2 AS area, 2 * (a + 2) AS around, c IN (1, 3) AS plan, swept AND parts = 1 AS one FROM x),
    q AS (SELECT k AS object, unnest([
        {'n': 'NetVolume', 'v': CASE WHEN voided THEN NULL WHEN swept THEN area * h * parts WHEN proved THEN area * h END}, {'n': 'GrossVolume', 'v': CASE WHEN voided THEN NULL WHEN swept THEN area * h * parts WHEN proved THEN area * h END},
        {'n': 'NetSurfaceArea', 'v': around * h + 2 * area}, {'n': 'GrossSurfaceArea', 'v': CASE WHEN c = 2 AND one THEN around * h + 2 * area END},
        {'n': 'GrossFootprintArea', 'v': CASE WHEN c = 0 AND one OR plan AND NOT voided THEN area END}, {'n': 'NetFootprintArea', 'v': CASE WHEN c = 0 AND one AND NOT voided OR plan THEN area END},
        {'n': 'GrossArea', 'v': CASE WHEN c = 1 AND one OR plan AND NOT voided THEN area END}, {'n': 'NetArea', 'v': CASE WHEN plan THEN area END},
        {'n': 'Width', 'v': CASE WHEN plan AND h <= least(a, 2) THEN h END}, {'n': 'Height', 'v': CASE WHEN c = 0 AND one THEN coalesce(inline, h) WHEN c = 0 THEN h WHEN c = 3 AND one THEN h END},
        {'n': 'Depth', 'v': CASE WHEN c = 1 AND one THEN h ELSE least(a, 2, h) END}, {'n': 'Length', 'v': CASE WHEN c = 2 AND one THEN h END}, {'n': 'Perimeter', 'v': CASE WHEN plan THEN around END},
        {'n': 'GrossSideArea', 'v': CASE WHEN c = 0 AND one THEN greatest(a, 2) * coalesce(inline, h) END}, {'n': 'GrossFloorArea', 'v': CASE WHEN c = 3 AND one THEN area END}, {'n': 'GrossPerimeter', 'v': CASE WHEN c = 3 AND one THEN around END}]) AS q FROM y) """


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), F.explode(F.array(*[F.lit(n) for n in WANTED])).alias("name"))


@query(RULES_SQL + "SELECT object, q.n AS name, round(q.v, 6) AS value FROM q WHERE q.v IS NOT NULL")
def qto_rules(spark, sf_dir):
    return quantity.computed(measured(spark, sf_dir), wanted(spark, sf_dir)).select("object", "name", F.round("value", 6).alias("value"))


@query("""
    WITH l AS (SELECT l_orderkey AS object, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS set, CASE l_linenumber % 3 WHEN 0 THEN ' BaseQuantities' WHEN 1 THEN 'Other' ELSE 'qto_base' END AS name FROM lineitem),
    w AS (SELECT DISTINCT l_orderkey AS object FROM lineitem)
    SELECT object, 'Qto_Base' AS set_name, coalesce((SELECT arg_max(set, pos) FROM l WHERE l.object = w.object AND lower(trim(name)) = 'qto_base'), (SELECT arg_min(set, pos) FROM l WHERE l.object = w.object AND lower(trim(name)) = 'basequantities')) AS set FROM w""")
def qto_existing_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("set"))
    name = F.when(F.col("pos") % 3 == 0, " BaseQuantities").when(F.col("pos") % 3 == 1, "Other").otherwise("qto_base")
    return quantity.existing_sets(lines, lines.select("set", name.alias("name")), lines.select("object", F.lit("Qto_Base").alias("set_name")).distinct())


@query("""
    WITH v AS (SELECT p_partkey AS object, unnest(['GrossVolume', 'NetVolume']) AS name, unnest([p_size::DOUBLE, p_retailprice / 40]) AS value FROM part),
    g AS (SELECT v.*, p_size::DOUBLE AS gross FROM v JOIN part ON p_partkey = object)
    SELECT object, name, round(value, 6) AS value, CASE WHEN value <= 0 THEN 'not positive' WHEN name = 'NetVolume' AND value > gross * (1 + 1e-9) THEN 'net above gross' ELSE 'accepted' END AS verdict FROM g""")
def qto_checked(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), F.explode(F.array(F.struct(F.lit("GrossVolume").alias("name"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("NetVolume").alias("name"), (F.col("p_retailprice") / 40).alias("value")))).alias("v")).select("object", "v.*")
    return quantity.checked(rows).select("object", "name", F.round("value", 6).alias("value"), "verdict")


@query("""
    WITH a AS (SELECT p_partkey AS object, 'Qto' AS set_name, unnest(['Height', 'NetVolume']) AS name, p_retailprice AS value, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS set FROM part),
    n AS (SELECT object, 1000000 + row_number() OVER (ORDER BY object) - 1 AS new_set FROM (SELECT DISTINCT object FROM a WHERE set IS NULL)),
    f AS (SELECT 1000000 + count(*) AS first FROM n)
    SELECT (SELECT first FROM f) + row_number() OVER (ORDER BY object, name) - 1 AS id, object, coalesce(set, new_set) AS set, CASE name WHEN 'Height' THEN 'IFCQUANTITYLENGTH' ELSE 'IFCQUANTITYVOLUME' END AS entity_name, name, value FROM a LEFT JOIN n USING (object)""")
def qto_inject(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    accepted = part.select(k.alias("object"), F.lit("Qto").alias("set_name"), F.explode(F.array(F.lit("Height"), F.lit("NetVolume"))).alias("name"), F.col("p_retailprice").alias("value"))
    targets = part.where("p_partkey % 3 = 0").select(k.alias("object"), F.lit("Qto").alias("set_name"), k.alias("set"))
    return quantity.inject(accepted, targets, part.select(k.alias("object"), F.concat(F.lit("g"), k).alias("guid")), 1_000_000)[0]


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each line, over vertices by its quantity and line number: orders of several parts."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), (F.col("l_quantity").cast("int") % 5 * 3).alias("a"), (F.col("l_quantity").cast("int") % 5 * 3 + 1).alias("b"), (100 + n % 4).alias("c"))


@query("""
    WITH RECURSIVE f AS (SELECT l_orderkey AS e, l_quantity::INT % 5 * 3 AS a, l_quantity::INT % 5 * 3 + 1 AS b, 100 + l_linenumber % 4 AS c FROM lineitem),
    g AS (SELECT DISTINCT e, unnest([a, b, b, c, a, c]) AS x, unnest([b, a, c, b, c, a]) AS y FROM f),
    r(e, x, y) AS (SELECT e, x, x FROM g UNION SELECT r.e, r.x, g.y FROM r JOIN g ON r.e = g.e AND r.y = g.x),
    l AS (SELECT e, x, min(y) AS label FROM r GROUP BY e, x)
    SELECT e AS element_id, count(DISTINCT label) AS parts, count(*) AS vertices FROM l GROUP BY e""")
def mesh_parts(spark, sf_dir):
    topology.with_checkpoints(spark)
    return quantity.parts(faces(spark, sf_dir))


@query("""
    WITH t AS (SELECT l_orderkey AS e, l_linenumber AS n, l_quantity::INT % 2 AS q FROM lineitem),
    k AS (SELECT *, count(*) OVER (PARTITION BY e, q) AS same FROM t)
    SELECT e AS element_id, count(*) AS triangles FROM k WHERE same = 1 GROUP BY e""")
def mesh_without_inner_faces(spark, sf_dir):
    """Triangles over one of two planes, corners in an order by line: those that come twice are walls inside."""
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), (F.col("l_quantity").cast("int") % 2).cast("double").alias("z"))
    a, b, c, turn = at(0, 0), at(1, 0), at(0, 1), F.col("l_linenumber") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.when(turn, a).otherwise(c).alias("v0"), b.alias("v1"), F.when(turn, c).otherwise(a).alias("v2"))
    return quantity.without_inner_faces(rows).groupBy("element_id").agg(F.count("*").alias("triangles"))


# --- relations

def building(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations and regions as zones, customers as elements: orders bound zones, lines void and fill."""
    t = Tables(spark, sf_dir)
    zone = lambda c: (F.col(c) + 1).cast("long")
    thing = lambda c: (F.col(c) + 1000).cast("long")
    o, n = t["orders"], t["nation"]
    nodes = n.select(zone("n_nationkey").alias("id"), F.lit("space").alias("level")).union(t["region"].select((F.col("r_regionkey") + 101).cast("long"), F.lit("storey")))
    classes = F.when(F.col("c_custkey") % 3 == 0, "IFCRAILING").when(F.col("c_custkey") % 3 == 1, "IFCWALL").otherwise("IFCROOF")
    return {
        "nodes": nodes, "elements": t["customer"].select(thing("c_custkey").alias("id"), classes.alias("entity_name")),
        "aggregates": n.select((F.col("n_regionkey") + 101).cast("long").alias("parent"), zone("n_nationkey").alias("child")).union(t["customer"].where("c_custkey % 3 = 2 AND c_custkey > 5").select(thing("c_custkey"), F.expr("3 * ((c_custkey - 2) div 6) + 1002"))),
        "boundaries": o.select((F.col("o_orderkey") % 25 + 1).alias("space"), F.when(F.col("o_orderkey") % 7 != 0, thing("o_custkey")).alias("element"), (F.col("o_orderstatus") == "F").alias("external")),
        "contained": t["customer"].select(thing("c_custkey").alias("element"), zone("c_nationkey").alias("structure")),
        "voids": o.select(F.col("o_orderkey").alias("rel"), thing("o_custkey").alias("element"), (F.col("o_orderkey") % 500).alias("opening")), "fills": o.select((F.col("o_orderkey") % 700).alias("opening"), (F.col("o_custkey") + 1001).alias("element")),
    }


BUILDING_SQL = """
    WITH RECURSIVE nodes AS (SELECT n_nationkey + 1 AS id, 'space' AS level FROM nation UNION ALL SELECT r_regionkey + 101, 'storey' FROM region), el AS (SELECT c_custkey + 1000 AS id, c_custkey % 3 AS c FROM customer),
    agg AS (SELECT n_regionkey + 101 AS parent, n_nationkey + 1 AS child FROM nation UNION ALL SELECT c_custkey + 1000, 3 * ((c_custkey - 2) // 6) + 1002 FROM customer WHERE c_custkey % 3 = 2 AND c_custkey > 5),
    bo AS (SELECT o_orderkey % 25 + 1 AS space, o_custkey + 1000 AS element, o_orderstatus = 'F' AS ext FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey + 1000 IN (SELECT id FROM el)),
    bg AS (SELECT space, element, bool_and(ext) AS ext FROM bo GROUP BY ALL),
    ho AS (SELECT o_orderkey % 500 AS opening, arg_max(o_custkey + 1000, o_orderkey) AS host FROM orders GROUP BY 1),
    su AS (SELECT DISTINCT host, o_custkey + 1001 AS element FROM orders JOIN ho ON opening = o_orderkey % 700 WHERE host IN (SELECT id FROM el) AND o_custkey + 1001 IN (SELECT id FROM el)),
    az AS (SELECT DISTINCT x.space AS a, y.space AS b FROM bg x JOIN bg y ON x.element = y.element AND x.space <> y.space AND NOT (x.ext AND y.ext)),
    ed AS (SELECT parent AS source, child AS target, 'ContainsZone' AS kind, 'aggregates' AS derived_from FROM agg WHERE parent < 1000 UNION SELECT c_nationkey + 1, c_custkey + 1000, 'ContainsElement', 'containment' FROM customer
        UNION SELECT space, element, 'AdjacentElement', 'space boundary' FROM bo UNION SELECT a, b, 'AdjacentZone', 'space boundary' FROM az UNION SELECT host, element, 'HasSubElement', 'voids and fills' FROM su) """


def building_relations(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    b = building(spark, sf_dir)
    return b, topology.relations(b["nodes"], b["elements"], b["aggregates"], b["boundaries"], b["contained"], b["voids"], b["fills"])


@query(BUILDING_SQL + "SELECT source::BIGINT AS source, target::BIGINT AS target, kind, derived_from FROM ed")
def topo_relations(spark, sf_dir):
    return building_relations(spark, sf_dir)[1]


@query(BUILDING_SQL + "SELECT * FROM (SELECT parent, child FROM agg WHERE parent > 999 AND child IN (SELECT id FROM el) UNION SELECT host, element FROM su)")
def topo_sub_elements(spark, sf_dir):
    b, edges = building_relations(spark, sf_dir)
    return topology.sub_elements(b["elements"], b["aggregates"], edges)


@query(BUILDING_SQL + """SELECT DISTINCT parent AS structure, h.element AS element FROM agg JOIN nodes s ON s.id = child AND s.level = 'space' JOIN (SELECT c_nationkey + 1 AS space, c_custkey + 1000 AS element FROM customer UNION SELECT space, element FROM bo) h ON h.space = child
    JOIN el ON el.id = h.element AND c = 0 WHERE parent < 1000""")
def topo_through_spaces(spark, sf_dir):
    b = building(spark, sf_dir)
    return topology.through_spaces(b["nodes"], b["elements"], b["aggregates"], b["contained"], b["boundaries"])


@query(BUILDING_SQL + ", w(root, node) AS (SELECT id, id FROM el UNION SELECT root, child FROM w JOIN agg ON parent = node JOIN el r ON r.id = root AND r.c <> 1 WHERE parent > 999) SELECT DISTINCT (c_nationkey + 1)::BIGINT AS structure, node AS element FROM customer JOIN w ON root = c_custkey + 1000")
def topo_contained_closure(spark, sf_dir):
    topology.with_checkpoints(spark)
    b = building(spark, sf_dir)
    return topology.contained_closure(b["contained"], b["elements"], b["aggregates"])


@query(BUILDING_SQL + """, f AS (SELECT c_custkey + 999 AS source, c_custkey + 1000 AS target, CASE WHEN c_custkey % 2 = 0 THEN 'InterfaceOf' ELSE 'IntersectingElement' END AS kind FROM customer),
    g AS (SELECT DISTINCT * FROM f WHERE target IN (SELECT id FROM el) AND (kind = 'InterfaceOf' OR source IN (SELECT id FROM el)))
    SELECT kind, derived_from, count(*) AS n, sum(source * 7 + target)::BIGINT AS s FROM (SELECT * FROM ed UNION ALL SELECT *, 'exact geometry' FROM g) GROUP BY ALL""")
def topo_with_geometry(spark, sf_dir):
    b, edges = building_relations(spark, sf_dir)
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select((k + 999).alias("source"), (k + 1000).alias("target"), F.when(k % 2 == 0, "InterfaceOf").otherwise("IntersectingElement").alias("kind"))
    out = topology.with_geometry(edges, found.union(found), b["elements"].select("id"), True)[0]
    return out.groupBy("kind", "derived_from").agg(F.count("*").alias("n"), F.sum(F.col("source") * 7 + F.col("target")).alias("s"))


@query(f"SELECT id, CASE WHEN id BETWEEN 1 AND 25 THEN 'zone/' || id ELSE 'thing/' || id END AS iri FROM (SELECT DISTINCT o_custkey AS id FROM orders) WHERE id BETWEEN 1 AND 25 OR id IN (SELECT c_custkey FROM customer)")
def topo_subjects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nodes = t["nation"].select((F.col("n_nationkey") + 1).cast("long").alias("id")).withColumn("iri", F.concat(F.lit("zone/"), F.col("id")))
    things = t["customer"].select(F.col("c_custkey").alias("id"), F.concat(F.lit("thing/"), F.col("c_custkey")).alias("iri"))
    return topology.subjects(t["orders"].select(F.col("o_custkey").alias("id")), nodes, things)


# --- comparison and export

@query(f"SELECT '{B}segment' AS p, o, side, count(*) AS n FROM (SELECT unnest(['BUILDING', 'HOUSE']) AS o, unnest(['left', 'right']) AS side FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL")
def graph_compare(spark, sf_dir):
    """Two graphs with other bases and one changed value; states are not named alike, numbers not written alike."""
    t = order_graph(spark, sf_dir)
    moved = lambda c: F.replace(F.col(c), F.lit(B + "customer/"), F.lit("http://other.org/customer/"))
    other = t.withColumns({"s": moved("s"), "o": F.when(F.col("o") == "BUILDING", "HOUSE").otherwise(moved("o"))})
    return compare.compare(t, other, (B + "customer/", "http://other.org/customer/")).groupBy("p", "o", "side").agg(F.count("*").alias("n"))


@query(f"SELECT '{B}Customer' AS name, (SELECT count(*) FROM customer) AS expected, (SELECT count(*) FROM customer) AS found, true AS ok UNION ALL SELECT '{B}Order', 0, (SELECT count(*) FROM orders), false UNION ALL SELECT '{B}Nation', 26, (SELECT count(*) FROM nation), (SELECT count(*) FROM nation) = 26")
def validate_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    facts = t["customer"].agg(F.lit(B + "Customer").alias("name"), F.count("*").alias("expected")).union(spark.createDataFrame([(B + "Nation", 26)], "name string, expected long"))
    return compare.counts(order_graph(spark, sf_dir), facts)


@query("SELECT l_orderkey::VARCHAR AS guid, 'Height' AS name, a, b, round(CASE WHEN b <> 0 THEN abs(a - b) / abs(b) ELSE abs(a - b) END, 9) AS difference, coalesce(CASE WHEN b <> 0 THEN abs(a - b) / abs(b) ELSE abs(a - b) END <= 0.5, false) AS ok FROM (SELECT l_orderkey, max(l_quantity) AS a FROM lineitem WHERE l_discount < 0.05 GROUP BY 1) FULL JOIN (SELECT l_orderkey, min(l_quantity) AS b FROM lineitem WHERE l_tax < 0.05 GROUP BY 1) USING (l_orderkey)")
def validate_quantities(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda where, f: lines.where(where).groupBy(F.col("l_orderkey").cast("string").alias("guid")).agg(f.alias("value")).withColumn("name", F.lit("Height"))
    out = compare.quantities(side("l_discount < 0.05", F.max("l_quantity")), side("l_tax < 0.05", F.min("l_quantity")), 0.5)
    return out.withColumn("difference", F.round("difference", 9))


@query("SELECT entity_name, status, reason, count(*) AS n FROM (SELECT p_type AS entity_name, CASE WHEN p_partkey % 4 = 0 THEN 'has geometry' ELSE 'missing' END AS status, CASE p_partkey % 4 WHEN 1 THEN 'no representation' WHEN 2 THEN 'no items' WHEN 3 THEN 'unsupported items' END AS reason FROM part) GROUP BY ALL")
def geometry_coverage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    shown = part.where("p_partkey % 4 <> 1").select(k.alias("id"), F.when(k % 4 == 0, "IFCEXTRUDEDAREASOLID").when(k % 4 == 3, "IFCOTHER").alias("item"))
    return compare.coverage_counts(compare.geometry_coverage(part.select(k.alias("id"), F.col("p_type").alias("entity_name")), shown, ("IFCEXTRUDEDAREASOLID",)))


@query("SELECT count(*) AS before, sum((p_name LIKE '%x%:%')::INT)::BIGINT AS non_ascii, sum((p_partkey % 3 = 0)::INT)::BIGINT AS segmented, (SELECT count(DISTINCT p_name) FROM part) AS after FROM part")
def name_statistics(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lit(1).alias("set"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/"), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"))
    return compare.name_statistics(rows, part.select("p_name").distinct())


def authored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Customers' balances and names as members of a set each."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    item = lambda n, name, kind, v, m: F.struct((k * 2 + n).alias("item"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), v.cast("string").alias("value"), F.lit(m).alias("measure"))
    items = c.select(k.alias("set"), F.explode(F.array(item(0, "name", "string", F.col("c_name"), ""), item(1, "balance", "real", F.col("c_acctbal"), "IFCMONEY"))).alias("v")).select("set", "v.*")
    return c.select(k.alias("object"), k.alias("set")), c.select(k.alias("set"), F.concat(F.lit("g"), k).alias("set_guid"), F.lit("Customer").alias("set_name")), items.select("set", "item"), items.drop("set")


@query("SELECT c_custkey AS \"EntityId\", 'Customer' AS \"PsetName\", 'g' || c_custkey AS \"PsetGlobalId\", n AS \"PropName\", CASE WHEN n = 'balance' THEN 'measure' ELSE 'string' END AS \"PropType\", CASE WHEN n = 'name' THEN c_name END AS \"ValueString\", CASE WHEN n = 'balance' THEN c_acctbal ELSE 0.0 END AS \"ValueReal\", 0 AS \"ValueInt\" FROM customer, (SELECT unnest(['name', 'balance']) AS n)")
def parquet_tables(spark, sf_dir):
    return archive.properties_table(*authored(spark, sf_dir))


@query("SELECT c_custkey + 1000 AS \"SourceId\", c_nationkey::BIGINT AS \"TargetId\", 'ContainedIn' AS \"RelType\", 0::BIGINT AS \"RelId\" FROM customer UNION ALL SELECT n_nationkey, n_regionkey, 'Aggregates', 0 FROM nation")
def parquet_relationships(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return archive.relationships_table({"ContainedIn": t["customer"].select(F.col("c_custkey") + 1000, "c_nationkey"), "Aggregates": t["nation"].select("n_nationkey", "n_regionkey")})


@query("""
    WITH m AS (SELECT l_orderkey AS id, count(*) AS t, 3 * count(*) AS v FROM lineitem GROUP BY 1)
    SELECT id AS "ExpressId", (coalesce(sum(v) OVER w, 0))::BIGINT AS "VertexStart", v AS "VertexCount", (coalesce(sum(t) OVER w, 0))::BIGINT AS "IndexStart", t AS "IndexCount" FROM m WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def parquet_meshes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("n"))
    point = F.struct(*[F.lit(0.0).alias(x) for x in "xyz"])
    vertices = lines.select("id", F.explode(F.sequence(F.col("n") * 3, F.col("n") * 3 + 2)).alias("pos"), point.alias("point"), point.alias("normal"))
    triangles = lines.select("id", F.col("n").alias("pos"), *[(F.col("n") * 3 + j).alias(c) for j, c in enumerate("abc")])
    return archive.mesh_tables(vertices, triangles)["Meshes"]
