"""Column builders for terms and scalar functions. All are built-in expressions: nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and datatypes.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_DECIMAL, XSD_INTEGER, XSD_BOOLEAN = XSD + "decimal", XSD + "integer", XSD + "boolean"


def lit_or(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def url_encode(c: Column) -> Column:
    """RFC 3986: all but A-Z a-z 0-9 - . _ ~ as %HH of the UTF-8 bytes. Spark's own is form style."""
    form = F.url_encode(c)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_token(c: Column) -> Column:
    """An injective name: bytes outside A-Z a-z 0-9 _ as %HH."""
    rest = url_encode(c)
    for ch, code in ((".", "%2E"), ("-", "%2D"), ("~", "%7E")):
        rest = F.replace(rest, F.lit(ch), F.lit(code))
    return rest


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_literal(c: Column, delimiter: str) -> Column:
    return F.split(c, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def slice_text(c: Column, start: int, end: int | None = None) -> Column:
    """Characters [start, end); null where the end (or start) lies beyond the text's length in bytes, or before start."""
    last = F.lit(end) if end is not None else F.octet_length(c)
    ok = (F.lit(start) <= last) & (last <= F.octet_length(c))
    return F.when(ok, F.substring(c, start + 1, (last - F.lit(start)).cast("int")))


def slugify(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), r"\s+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(out, "^-|-$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def value_to_string(c: Column) -> Column:
    """A double without decimals where it has none."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def canonical_decimal(c: Column, places: int = 9) -> Column:
    """Rounded to ``places``, no trailing zeros, no negative zero. Values from 1e15 on keep no decimals in a double."""
    text = F.format_string(f"%.{places}f", c)
    out = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(out == "-0", "0").otherwise(out)


def fnv1a64(c: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits. The product by the prime 2**40 + 0x1b3 is a shift and a small product, kept in two
    32-bit halves, as ANSI arithmetic refuses to wrap. The steps read an array that is made once: what ``c`` stands for would
    be evaluated again in each of them."""
    octets = F.coalesce(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0)), F.array().cast("array<string>"))
    low32 = 0xFFFFFFFF

    def step(acc: Column, octet: Column) -> Column:
        low, high = acc["low"].bitwiseXOR(F.conv(octet, 16, 10).cast("bigint")), acc["high"]
        product = low * 0x1B3
        up = F.shiftright(product, 32)
        new_high = (high * 0x1B3 + up + low.bitwiseAND(0xFFFFFF) * 256).bitwiseAND(low32)
        return F.struct(product.bitwiseAND(low32).alias("low"), new_high.alias("high"))

    start = F.struct(F.lit(0x84222325).cast("bigint").alias("low"), F.lit(0xCBF29CE4).cast("bigint").alias("high"))
    return F.aggregate(octets, start, step, lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["high"]), 8, "0"), F.lpad(F.hex(acc["low"]), 8, "0"))))


def escape_literal(c: Column) -> Column:
    pairs = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def compact_iri(c: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local by the longest namespace that fits and leaves a plain local name, else <iri>."""
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for prefix, space in sorted(prefixes.items(), key=lambda p: len(p[1])):
        local = F.substring(c, len(space) + 1, F.char_length(c))
        out = F.when(c.startswith(space) & local.rlike(r"^[A-Za-z0-9_]([A-Za-z0-9_.-]*[A-Za-z0-9_-])?$"), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str, list[tuple[str, str]]]:
    """What compatibility decomposition leaves of characters outside ASCII, of ASCII letters and digits alone: (characters
    with one of them, those, [(character, several)]). Built from the Unicode tables of this Python."""
    ones, others, many = [], [], []
    for point in range(0x80, 0x110000):
        c = chr(point)
        if unicodedata.decomposition(c):
            rest = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalnum())
            if len(rest) == 1:
                ones.append(c)
                others.append(rest)
            elif rest:
                many.append((c, rest))
    return "".join(ones), "".join(others), many


# Umlauts written out.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))


def umlauts(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), UMLAUTS, c)


def norm_key(c: Column) -> Column:
    """Umlauts written out, compatibility decomposition, ASCII letters and digits alone, lower case. Texts in ASCII, and
    those without the few characters that become several, skip what they don't need."""
    ones, others, many = plain_letters()
    pairs = F.map_entries(F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in many)), F.lit("\x01"), F.lit("\x02")))

    def plain(x: Column) -> Column:
        some = F.when(x.rlike("[" + "".join(a for a, _ in many) + "]"), F.aggregate(pairs, x, lambda acc, p: F.replace(acc, p["key"], p["value"]))).otherwise(x)
        return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(some, ones, others)).otherwise(x)

    # as elements of arrays, so that a long expression stands in the plan once
    full = F.transform(F.transform(F.array(c), umlauts), plain)
    return F.lower(F.regexp_replace(F.element_at(full, 1), "[^A-Za-z0-9]", ""))


def escape_controls(c: Column) -> Column:
    """``escape_literal`` and every other control character as \\u00xx."""
    out = escape_literal(c)
    points = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)]
    full = reduce(lambda x, k: F.replace(x, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), points, out)
    return F.when(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), full).otherwise(out)


def percent_all(c: Column) -> Column:
    """Every byte outside A-Z a-z 0-9 as %HH."""
    return F.replace(percent_token(c), F.lit("_"), F.lit("%5F"))


def local_name(c: Column) -> Column:
    """Local name of a property: umlauts written out, other characters outside ASCII as \\X2\\HHHH\\X0\\. A name without
    lower-case letters keeps its characters, spaces as underscores, percent-encoded; of another each word gives its letters,
    the first word starting in lower case, the others in upper case. A name that starts with no letter gets ``p_`` before
    it; an empty one is ``value``."""
    hexa = lambda x: F.lpad(F.hex(F.ascii(x)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(x)))), F.lit("0"))
    wide = F.array_join(F.transform(F.split(umlauts(c), ""), lambda x: F.when(F.ascii(x) < 128, x).otherwise(F.concat(F.lit("\\X2\\"), hexa(x), F.lit("\\X0\\")))), "")
    text = F.when(c.rlike(r"[^\x00-\x7F]"), wide).otherwise(c)
    words = F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    cased = F.array_join(F.transform(words, lambda w, k: F.concat(F.when(k == 0, F.lower(F.substring(w, 1, 1))).otherwise(F.upper(F.substring(w, 1, 1))), F.substring(w, 2, 1 << 30))), "")
    local = F.when(F.upper(text) == text, percent_all(F.replace(text, F.lit(" "), F.lit("_")))).otherwise(cased)
    return F.when(local == "", "value").when(local.rlike("^[A-Za-z]"), local).otherwise(F.concat(F.lit("p_"), local))


def pascal_name(c: Column) -> Column:
    """IFCWALLSTANDARDCASE to IfcWallstandardcase: after the first three letters a capital, and after each underscore or
    digit, all else in lower case; underscores go. Names that do not start with IFC stay as they are."""
    parts = F.regexp_extract_all(F.substring(F.lower(c), 4, 1 << 30), F.lit("[0-9]+|[^_0-9]+"), F.lit(0))
    cased = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
    return F.when(F.upper(c).startswith("IFC"), F.concat(F.lit("Ifc"), F.array_join(cased, ""))).otherwise(c)


def normal_number(o: Column, dt: Column) -> Column:
    """A literal's text for comparison: doubles and integers in their plainest form, booleans in lower case; others, and
    what is no number, as they are."""
    number, whole = o.try_cast("double"), o.try_cast("bigint")
    return F.when((dt == XSD + "double") & number.isNotNull(), value_to_string(number)).when((dt == XSD_INTEGER) & whole.isNotNull(), whole.cast("string")).when(dt == XSD_BOOLEAN, F.lower(o)).otherwise(o)


# SI units with a name of their own, and the kinds of unit that measures are given in.
UNIT = "http://qudt.org/vocab/unit/"
SI_UNITS = {("METRE", ""): "M", ("METRE", "MILLI"): "MilliM", ("SQUARE_METRE", ""): "M2", ("SQUARE_METRE", "MILLI"): "MilliM2", ("CUBIC_METRE", ""): "M3", ("CUBIC_METRE", "MILLI"): "MilliM3", ("RADIAN", ""): "RAD", ("SECOND", ""): "SEC"}
CONVERTED_UNITS = {"DEGREE": "DEG"}
MEASURES = (("LENGTHMEASURE", "LENGTHUNIT"), ("PLANEANGLEMEASURE", "PLANEANGLEUNIT"), ("AREAMEASURE", "AREAUNIT"), ("VOLUMEMEASURE", "VOLUMEUNIT"))
QUANTITY_UNITS = {"IFCQUANTITYLENGTH": "LENGTHUNIT", "IFCQUANTITYAREA": "AREAUNIT", "IFCQUANTITYVOLUME": "VOLUMEUNIT"}


def lookup(names: dict[str, str], key: Column) -> Column:
    """The entry of a small table, null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key) if names else F.lit(None).cast("string")


def unit_iri(kind: Column, name: Column, prefix: Column) -> Column:
    """IRI of a unit, null for those without; kind: si or conversion."""
    si = lookup({f"{n}|{p}": UNIT + v for (n, p), v in SI_UNITS.items()}, F.concat(name, F.lit("|"), F.coalesce(prefix, F.lit(""))))
    return F.when(kind == "si", si).when(kind == "conversion", lookup({n: UNIT + v for n, v in CONVERTED_UNITS.items()}, name))


def measure_unit(measure: Column) -> Column:
    """The kind of unit a measure is given in, by the end of its name."""
    out = F.lit(None).cast("string")
    for end, kind in reversed(MEASURES):
        out = F.when(F.trim(measure).endswith(end), kind).otherwise(out)
    return out


def signature(kind: Column, value: Column, measure: Column) -> Column:
    """A value's text with its kind before it; of a typed value, its type too. ``none`` without a value."""
    letter = lookup({"string": "s:", "enum": "e:", "bool": "b:", "int": "i:", "real": "r:"}, kind)
    return F.coalesce(F.concat(F.when(F.coalesce(measure, F.lit("")) != "", F.concat(F.lit("t:"), measure, F.lit(":"))).otherwise(""), letter, value), F.lit("none"))


def relative_error(authored: Column, computed: Column) -> Column:
    """Against the authored value; the plain difference where that is about zero."""
    gap = F.abs(computed - authored)
    return F.when(F.abs(authored) > 1e-9, gap / F.abs(authored)).otherwise(gap)


def unit_error(authored: Column, computed: Column, factor: Column) -> Column:
    """Whether two values differ by a unit's factor, either way, within one percent."""
    ratio = computed / F.when(F.abs(authored) >= 1e-12, authored)
    near = lambda x: F.abs(x - 1) < 0.01
    return F.coalesce((F.abs(factor - 1) >= 1e-12) & (near(ratio * factor) | near(ratio / factor)), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5, of a fixed namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    version = F.concat(F.lit("5"), F.substring(h, 14, 3))
    variant = F.concat(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3) + 8)), F.substring(h, 18, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), version, variant, F.substring(h, 21, 12))


# The alphabet of compressed ids.
GUID_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def compressed_guid(uuid: Column) -> Column:
    """A UUID in 22 characters: 2 bits, then 21 groups of 6."""
    digits = F.concat(F.lit("0"), F.replace(uuid, F.lit("-"), F.lit("")))  # 33 digits: 11 groups of 3 are 22 characters
    letter = lambda k: F.substring(F.lit(GUID_ALPHABET), F.lit(1) + k.cast("int"), F.lit(1))
    group = lambda i: F.conv(F.substring(digits, i * 3 + 1, F.lit(3)), 16, 10).cast("bigint")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.concat(letter(F.floor(group(i) / 64)), letter(group(i) % 64))), "")


def expanded_guid(token: Column) -> Column:
    """The UUID of 22 characters; null if they are none."""
    place = lambda k: F.instr(F.lit(GUID_ALPHABET), F.substring(token, k, F.lit(1))) - 1
    group = lambda i: F.lpad(F.lower(F.hex(place(i * 2 + 1) * 64 + place(i * 2 + 2))), 3, "0")
    h = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10)), group), "")
    parts = F.concat_ws("-", F.substring(h, 2, 8), F.substring(h, 10, 4), F.substring(h, 14, 4), F.substring(h, 18, 4), F.substring(h, 22, 12))
    return F.when(token.rlike(r"^[0-3][0-9A-Za-z_$]{21}$"), parts)


def canonical_guid(token: Column) -> Column:
    """22 characters as they are, a UUID compressed, all else as it is."""
    return F.when(token.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), compressed_guid(F.lower(token))).otherwise(token)


# Powers of ten of SI prefixes.
SI = {"EXA": 18, "PETA": 15, "TERA": 12, "GIGA": 9, "MEGA": 6, "KILO": 3, "HECTO": 2, "DECA": 1, "DECI": -1, "CENTI": -2, "MILLI": -3, "MICRO": -6, "NANO": -9, "PICO": -12, "FEMTO": -15, "ATTO": -18}


def si_scale(prefix: Column, dimension: Column) -> Column:
    """Factor to the unit without prefix; ``dimension`` 1, 2 or 3 for length, area, volume. Unknown prefix: null."""
    power = F.when(is_blank(prefix), F.lit(0))
    for name, p in SI.items():
        power = power.when(prefix == name, F.lit(p))
    return F.pow(F.lit(10.0), power * dimension)


#: Scalar functions that mapping documents may name: string columns in, a string column out.
REGISTRY = {
    "toUpperCase": lambda x: F.upper(x),
    "toLowerCase": lambda x: F.lower(x),
    "trim": trim_unicode,
    "replace": lambda x, a, b: F.replace(x, a, b),
    "concat": lambda *xs: F.concat_ws("", *xs),
    "length": lambda x: F.octet_length(x).cast("string"),
    "contains": lambda x, y: F.contains(x, y).cast("string"),
    "startsWith": lambda x, y: F.startswith(x, y).cast("string"),
    "endsWith": lambda x, y: F.endswith(x, y).cast("string"),
    "equal": lambda x, y: (x == y).cast("string"),
    "notEqual": lambda x, y: (x != y).cast("string"),
    "isNull": lambda x: is_blank(x).cast("string"),
    "random": lambda: F.rand().cast("string"),
    "uuid": lambda: F.uuid(),
    "slugify": slugify,
    "urlEncode": url_encode,
}
