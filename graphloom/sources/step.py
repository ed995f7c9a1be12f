"""STEP (ISO 10303-21) files: a data source that reads one entity a row.

A file is one partition: strings may hold line breaks and semicolons, so it cannot be split without reading it from its
start. Many files are read side by side. Arguments come as JSON; every value is {"k": kind, "v": value}."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|/\*.*?\*/|(?P<str>'(?:[^']|'')*')|(?P<ref>\#\d+)|(?P<real>[+-]?\d+\.\d*(?:[eE][+-]?\d+)?)|(?P<int>[+-]?\d+)|(?P<enum>\.[A-Za-z0-9_]+\.)|(?P<bin>\"[0-9A-Fa-f]*\")|(?P<name>[A-Za-z_]\w*)|(?P<mark>[$*(),])", re.S)
STATEMENT = re.compile(r"\s*((?:'(?:[^']|'')*'|/\*.*?\*/|[^';/]|/(?!\*))*);", re.S)
ENTITY = re.compile(r"#(\d+)\s*=\s*([A-Za-z_]\w*)\s*\((.*)\)\s*$", re.S)


def decode_text(s: str) -> str:
    """The escapes of STEP strings: doubled quotes, one-byte, four-digit and eight-digit hexadecimal, and shifted."""
    s = s.replace("''", "'")
    s = re.sub(r"\\X2\\((?:[0-9A-Fa-f]{4})+)\\X0\\", lambda m: bytes.fromhex(m[1]).decode("utf-16-be", "replace"), s)
    s = re.sub(r"\\X4\\((?:[0-9A-Fa-f]{8})+)\\X0\\", lambda m: bytes.fromhex(m[1]).decode("utf-32-be", "replace"), s)
    s = re.sub(r"\\X\\([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), s)
    s = re.sub(r"\\S\\(.)", lambda m: chr((ord(m[1]) + 128) & 0xFF), s)
    return s.replace("\\\\", "\\")


def parse_arguments(text: str) -> list[dict]:
    """Values of an argument list; a character that fits nothing is passed over, up to the next comma."""
    tokens, at = [], 0
    while at < len(text):
        if m := TOKEN.match(text, at):
            if m.lastgroup:
                tokens.append((m.lastgroup, m[0]))
            at = m.end()
        else:
            while at < len(text) and text[at] not in ",()":
                at += 1
    k = 0

    def values() -> list[dict]:
        nonlocal k
        out: list[dict] = []
        while k < len(tokens) and tokens[k][1] != ")":
            kind, t = tokens[k]
            k += 1
            if t == ",":
                continue
            if t == "(":
                out.append({"k": "list", "v": values()})
                k += 1
            elif kind == "name":
                inner: list[dict] = []
                if k < len(tokens) and tokens[k][1] == "(":
                    k += 1
                    inner = values()
                    k += 1
                out.append({"k": "typed", "t": t.upper(), "v": inner[0] if inner else None})
            elif kind == "str":
                out.append({"k": "string", "v": decode_text(t[1:-1])})
            elif kind == "ref":
                out.append({"k": "ref", "v": int(t[1:])})
            elif kind == "real":
                out.append({"k": "real", "v": float(t)})
            elif kind == "int":
                out.append({"k": "int", "v": int(t)})
            elif kind == "enum":
                out.append({"k": "bool", "v": t[1] in "Tt"} if t[1:-1].upper() in ("T", "F") else {"k": "enum", "v": t[1:-1]})
            elif t in "$*":
                out.append({"k": "null" if t == "$" else "derived", "v": None})
            else:
                out.append({"k": "binary", "v": t[1:-1]})
        return out

    return values()


def parse(text: str) -> Iterator[tuple[int, str, list[dict]]]:
    """(id, NAME, arguments) of the entities of the data section."""
    start = re.search(r"^\s*DATA\s*(?:\([^;]*\))?\s*;", text, re.I | re.M)
    at = start.end() if start else len(text)
    while m := STATEMENT.match(text, at):
        at = m.end()
        statement = re.sub(r"/\*.*?\*/", " ", m[1], flags=re.S) if "/*" in m[1] and "'" not in m[1] else m[1]
        if statement.strip().upper() == "ENDSEC":
            return
        if e := ENTITY.match(statement.strip()):
            yield int(e[1]), e[2].upper(), parse_arguments(e[3])


def header(text: str) -> dict[str, list[dict]]:
    """Arguments of FILE_SCHEMA, FILE_NAME and FILE_DESCRIPTION."""
    return {name: parse_arguments(m[1]) for name in ("FILE_SCHEMA", "FILE_NAME", "FILE_DESCRIPTION") if (m := re.search(name + r"\s*\(((?:'(?:[^']|'')*'|[^';])*)\)\s*;", text, re.I | re.S))}


# Schema names start with these, the longest first.
VERSIONS = ("IFC4X3", "IFC4X2", "IFC4X1", "IFC4", "IFC2X3")


def schema_version(text: str) -> str | None:
    names = str(header(text).get("FILE_SCHEMA", "")).upper()
    return next((v for v in VERSIONS if v in names), None)


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """path, id, entity_name, args (JSON), for every file of ``path``; of a repeated id the last stays."""

    def entities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                last = {i: (name, i, kind, json.dumps(args)) for i, kind, args in parse(bytes(content).decode("latin-1"))}
                yield pd.DataFrame(list(last.values()), columns=["path", "id", "entity_name", "args"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entities, "path string, id long, entity_name string, args string")


def argument(k: int, kind: str = "string"):
    """Column of argument ``k``'s value; null if absent, $ or *."""
    return F.get_json_object("args", f"$[{k}].v").cast({"string": "string", "ref": "bigint", "int": "bigint", "real": "double"}[kind])


def references(k: int):
    """array<bigint> of the references in list argument ``k``."""
    found = F.from_json(F.get_json_object("args", f"$[{k}].v"), "array<struct<k:string,v:string>>")
    return F.transform(F.filter(found, lambda x: x["k"] == "ref"), lambda x: x["v"].cast("bigint"))
