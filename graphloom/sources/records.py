"""Record sources by name of the format: CSV, JSON, XML, Parquet, JDBC; format sniffing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats by extension.
EXTENSIONS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "xml": "xml", "parquet": "parquet", "nt": "rdf", "nq": "rdf", "ttl": "turtle", "trig": "turtle"}


def sniff(path: str, head: str = "") -> str:
    """By extension, then by the first characters; CSV if nothing tells."""
    if found := EXTENSIONS.get(path.rpartition(".")[2].lower()):
        return found
    start = head.lstrip()
    if start[:1] in ("{", "["):
        return "json"
    return "xml" if start[:1] == "<" else "csv"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns are strings; an empty cell is null; cells beyond the header are dropped, missing ones null."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, nullValue="", emptyValue="", mode="PERMISSIVE", quote='"', escape='"', multiLine=True, enforceSchema=False)


STEP = re.compile(r"""\.\.(?P<deep>[\w-]+)|\.\*|\[\*\]|\.(?P<name>[\w@-]+)|\[(?P<at>-?\d+)\]|\['(?P<quoted>[^']*)'\]|\[\?\(@\.(?P<field>[\w-]+)\s*(?P<op>==|!=|>=|<=|>|<)\s*(?P<literal>'[^']*'|-?[\d.]+|true|false)\)\]""")


def path_steps(path: str) -> list[re.Match]:
    """Steps of a JSONPath: fields, elements by number, all elements, fields anywhere below, and filters on one field."""
    if not path.startswith("$"):
        raise ValueError(f"a JSONPath starts with $: {path}")
    out, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"no JSONPath at {path[at:]!r}")
        out.append(m)
        at = m.end()
    return out


def _deep(kind: T.DataType, name: str, way: tuple = ()) -> list[tuple]:
    """Ways to all fields of that name below a type; * goes through an array."""
    if isinstance(kind, T.ArrayType):
        return _deep(kind.elementType, name, (*way, "*"))
    out = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            out += [(*way, f.name)] if f.name == name else []
            out += _deep(f.dataType, name, (*way, f.name))
    return out


def at_path(df: DataFrame, path: str) -> DataFrame:
    """The values (column ``value``) at a JSONPath below column ``value`` of ``df``, a row each; fields that the schema does
    not know give none."""
    for m in path_steps(path):
        kind, v = df.schema["value"].dataType, F.col("value")
        name = m["name"] or m["quoted"]
        if m["deep"]:
            parts = None
            for way in _deep(kind, m["deep"]):
                part = df
                for step in way:
                    part = part.select(F.explode("value").alias("value")) if step == "*" else part.select(F.col("value")[step].alias("value"))
                if isinstance(part.schema["value"].dataType, T.ArrayType):
                    part = part.select(F.explode("value").alias("value"))
                parts = part if parts is None else parts.unionByName(part)
            df = parts if parts is not None else df.limit(0)
        elif name is not None:
            known = isinstance(kind, T.StructType) and name in kind.names
            df = df.select((v[name] if known else F.lit(None)).alias("value"))
        elif m["at"] is not None:
            n = int(m["at"])
            df = df.select(F.try_element_at(v, F.lit(n + 1 if n >= 0 else n)).alias("value"))
        else:
            if isinstance(kind, T.ArrayType):
                df = df.select(F.explode(v).alias("value"))
            elif isinstance(kind, T.StructType) and not m["field"]:
                df = df.select(F.explode(F.array(*[v[f].cast("string") for f in kind.names])).alias("value"))
            if m["field"]:
                text = m["literal"]
                other = F.lit(text[1:-1]) if text[0] == "'" else F.lit(text == "true") if text in ("true", "false") else F.lit(float(text))
                own = F.col("value")[m["field"]]
                tests = {"==": own == other, "!=": own != other, ">=": own >= other, "<=": own <= other, ">": own > other, "<": own < other}
                df = df.where(tests[m["op"]])
        df = df.where("value IS NOT NULL")
    return df


def read_json(spark: SparkSession, path: str, iterator: str = "$", lines: bool = False) -> DataFrame:
    """Records at a JSONPath ``iterator`` (see ``at_path``) of a document, or of every line; an array's elements are records.
    What is no object becomes a row with the column ``value``."""
    df = spark.read.json(path, multiLine=not lines)
    if iterator in ("$", "$[*]"):
        return df
    found = at_path(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("value")), iterator.replace("$[*]", "$", 1))
    return _records(found)


def _records(found: DataFrame) -> DataFrame:
    if isinstance(found.schema["value"].dataType, T.ArrayType):
        found = found.select(F.explode("value").alias("value"))
    return found.select("value.*") if isinstance(found.schema["value"].dataType, T.StructType) else found


def json_column(rows: DataFrame, column: str, schema: str, iterator: str = "$") -> DataFrame:
    """``rows`` with the records of a JSON text column of ``schema`` at a JSONPath, as further columns; texts that hold none
    give no row."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]
    found = rows.select(*kept, F.from_json(F.col(column), schema).alias("value")).where("value IS NOT NULL")
    if iterator == "$":
        return found.select(*kept, "value.*") if isinstance(found.schema["value"].dataType, T.StructType) else found
    box = found.select(F.struct(*kept).alias("_row"), "value")
    for m in path_steps(iterator):
        name = m["name"] or m["quoted"]
        c = F.col("value")[name] if name else F.try_element_at("value", F.lit(int(m["at"]) + 1)) if m["at"] is not None else F.explode("value")
        box = box.select("_row", c.alias("value")).where("value IS NOT NULL")
    kind = box.schema["value"].dataType
    return box.select("_row.*", "value.*") if isinstance(kind, T.StructType) else box.select("_row.*", "value")


def record_of(element) -> dict | str:
    """An XML element as a record: attributes as @name, text as _text, its name as _name, children by name (several as a
    list), children that are text alone as that; an empty child is an empty text."""

    def plain(child) -> object:
        if not child.attrib and not len(child):
            return (child.text or "").strip()
        return record_of(child)

    bare = lambda tag: tag.rpartition("}")[2]
    out: dict = {"_name": bare(element.tag)} | {"@" + bare(k): v for k, v in element.attrib.items()}
    if text := (element.text or "").strip():
        out["_text"] = text
    for child in element:
        if isinstance(child.tag, str):
            name, value = bare(child.tag), plain(child)
            if name not in out:
                out[name] = value
            else:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
    return out


def select_elements(root, xpath: str) -> list:
    """Elements of a document at an XPath: absolute (/a/b), anywhere (//b) or below the root (b), with the predicates that
    ElementTree knows; /* is the root. Names are compared without their namespace."""
    from xml.etree.ElementTree import Element

    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    top = Element("document")
    top.append(root)
    where = "." + xpath if xpath.startswith("/") else xpath if xpath.startswith(".") else "./*/" + xpath
    return top.findall(where)


def read_xml(spark: SparkSession, path: str, element: str) -> DataFrame:
    """One row per element. A bare name, or //name, is read by Spark's own splitting reader: attributes as @name, text beside
    them as _text, repeated children as arrays. Any other XPath (/a/b, /a/b[@k='1'], /*) takes a whole document in one
    task; all its values are texts, and records have their element's name as _name."""
    if re.fullmatch(r"(//)?[\w.-]+", element):
        return spark.read.xml(path, rowTag=element.removeprefix("//"), attributePrefix="@", valueTag="_text", inferSchema=False, nullValue=None)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree.ElementTree import fromstring

        for frame in frames:
            yield pd.DataFrame({"record": [json.dumps(record_of(e)) for content in frame["content"] for e in select_elements(fromstring(bytes(content)), element)]})

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, "record string")
    # one pass for the schema that all records share, one to read by it
    return texts.select(F.from_json("record", _schema_of(texts)).alias("r")).select("r.*")


def _schema_of(texts: DataFrame) -> T.StructType:
    """Fields of all records; a field that is a list anywhere is a list, any other value is its text or JSON."""
    keys = texts.select(F.explode(F.map_entries(F.from_json("record", "map<string,string>"))).alias("e"))
    kinds = keys.groupBy("e.key").agg(F.max(F.col("e.value").startswith("[").cast("int")).alias("many")).orderBy("key").collect()
    return T.StructType([T.StructField(r["key"], T.ArrayType(T.StringType()) if r["many"] else T.StringType()) for r in kinds])


def read_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, **options: str) -> DataFrame:
    """A database's table or query, all columns as strings, null where null."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    df = (reader.option("query", query) if query else reader.option("dbtable", table)).load()
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_records(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    form = form or sniff(path)
    if form == "parquet":
        return spark.read.parquet(path)
    return {"csv": read_csv, "json": read_json, "xml": read_xml}[form](spark, path, **options)


# Names of reference formulations hold these.
FORMULATIONS = {"CSV": "csv", "JSON": "json", "XPath": "xml", "XML": "xml"}


def formulation(iri: str) -> str:
    for name, form in FORMULATIONS.items():
        if name.lower() in iri.lower():
            return form
    raise ValueError(f"unknown reference formulation {iri}")


# Names that stand for the source in mapping documents.
PLACEHOLDERS = tuple(f"{stem}.{end}" for stem in ("source", "data", "input") for end in ("xml", "json", "csv"))


def with_source(document: str, name: str) -> str:
    """A mapping document with the first placeholder that it holds replaced by the real source's name."""
    for placeholder in PLACEHOLDERS:
        if placeholder in document and placeholder not in name:
            return document.replace(placeholder, name)
    return document


def open_source(spark: SparkSession, described: dict[str, str], **options) -> DataFrame:
    """Rows of a logical source as a mapping document describes it: a database (``dsn`` with ``query`` or ``table``), or a file
    (``source``) of the formulation it names, else of the form its name and first characters tell. Network endpoints are not
    read."""
    if dsn := described.get("dsn"):
        return read_table(spark, dsn, described.get("table"), described.get("query"), **options)
    source = described.get("source") or described.get("table")
    if not source:
        raise ValueError("a logical source needs a file or a database")
    if re.match(r"https?://", source) or "endpoint" in described:
        raise ValueError(f"network sources are not read: {described.get('endpoint', source)}")
    form = formulation(described["formulation"]) if described.get("formulation") else None
    iterator = described.get("iterator")
    if form is None:
        head = spark.read.text(source, wholetext=False).limit(1).collect() if "." not in source.rpartition("/")[2] else []
        form = sniff(source, head[0][0] if head else "")
    if iterator and form == "json":
        options["iterator"] = iterator
    if form == "xml":
        options["element"] = iterator or "/*"
    return read_records(spark, source, form, **options)
