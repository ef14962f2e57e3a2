"""Sizes, durations, names, key-value text, metadata maps, image headers and digests as Column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.vectorised import vectorised

#: What a unit stands for, decimal and binary.
UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}
#: Names that can't be files everywhere.
RESERVED = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"


def size_bytes(text: Column) -> Column:
    """25GB is decimal, 25GiB binary, a bare number bytes; null for anything else or for no whole positive number."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"
    number, unit = F.regexp_extract(text, pattern, 1), F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("decimal(20,0)"))])
    factor = F.try_element_at(factor, F.when(unit == "", "B").otherwise(unit))
    value = number.try_cast("decimal(18,6)")
    bytes_ = F.floor(value * factor)
    return F.when(bytes_ > 0, bytes_.cast("long"))


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def portable_name(name: Column) -> Column:
    """Whether a base name is safe on every file system."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.rlike(r"[. ]$") & ~F.upper(name).rlike(rf"^({RESERVED})(\..*)?$")


def output_prefix(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")


def number_map(text: Column) -> Column:
    """Lines of a key and an integer as a map; other lines are left out."""
    pairs = F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+"))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & F.get(p, F.lit(1)).rlike(r"^-?[0-9]+$"))
    return F.map_from_entries(F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).cast("long").alias("value"))))


def section(text: Column, name: str) -> Column:
    """What stands below a line `NAME:` up to the next such line."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n){name}:[ \t]*\r?\n(.*?)(?=\n[A-Z_]+:[ \t]*\r?\n|\n?$(?!\n))", 1)


def header_row_map(text: Column) -> Column:
    """A line of names over a line of numbers as a map."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda i: F.split(F.trim(F.get(lines, F.lit(i))), r"\s+")
    return F.when(F.size(lines) >= 2, F.map_from_arrays(cells(0), F.transform(cells(1), lambda x: x.try_cast("double"))))


def semantic_metadata(metadata: Column) -> Column:
    """Metadata without what statistics tools left in it."""
    return F.map_filter(metadata, lambda k, _: ~F.upper(k).startswith("STATISTICS_"))


def statistics_metadata(**values: Column) -> Column:
    """STATISTICS_* text of the values that are there."""
    entries = [x for k, v in values.items() for x in (F.lit("STATISTICS_" + k.upper()), v.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def png_size(data: Column) -> Column:
    """(width, height) in the header of a PNG, null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    good = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    return F.when(good & (F.octet_length(data) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def image_response(content_type: Column, data: Column, width: int | Column, height: int | Column) -> Column:
    """Whether a response is an image of the size that was asked for, not a report of an error."""
    size = png_size(data)
    text = F.substring(data, 1, 5).cast("string")
    return content_type.startswith("image/") & ~F.lower(text).startswith("<?xml") & ((size["width"] == width) & (size["height"] == height))


@vectorised("string")
def fingerprint(values: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form: sorted keys, no spaces."""
    canonical = values.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))
    return canonical.map(lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest())


def english_labels(style: Column) -> Column:
    """Label tokens {name...} become {name:en}."""
    return F.regexp_replace(style, r"\{name(?:[:_][A-Za-z_]+)?\}", "{name:en}")


#: Types of rasters: the range of integers, or null for floating ones.
_RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1)}


def output_nodata(value: Column, dtype: Column) -> Column:
    """A NoData value given as text, as a number that the type holds as it is; null if it can't. NaN and infinities only fit floating types."""
    number = value.try_cast("double")
    out = F.when(dtype == "float64", number).when((dtype == "float32") & (F.isnan(number) | (number.cast("float").cast("double") == number)), number)
    for name, (low, high) in _RANGES.items():
        exact = value.try_cast("decimal(38,18)")
        out = out.when((dtype == name) & (exact == F.floor(exact)) & exact.between(low, high), number)
    return out


def byte_fill(value: Column) -> Column:
    """A fill given as text, a whole number from 0 to 255; else null."""
    exact = value.try_cast("decimal(38,18)")
    return F.when((exact == F.floor(exact)) & exact.between(0, 255), exact.cast("int"))


def relative_path(path: Column, folder: Column) -> Column:
    """An absolute path as seen from a folder; as it is where they share no store or drive."""
    store = lambda c: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*|[A-Za-z]:|)", 1)
    split = lambda c: F.filter(F.split(F.substr(F.regexp_replace(c, r"\\", "/"), F.length(store(c)) + 1), "/"), lambda x: (x != "") & (x != "."))
    bound = lambda value, of: F.transform(F.array(value), of)[0]  # noqa: E731  # evaluated once, however often it is named

    def parted(both: Column) -> Column:
        target, base = both["target"], both["base"]
        same = F.transform(F.sequence(F.lit(1), F.least(F.size(target), F.size(base)) + 1), lambda n: F.slice(target, F.lit(1), n) == F.slice(base, F.lit(1), n))
        # the first place where they part, at the latest after the shorter one
        n = F.least(F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(target).cast("long")), F.size(base).cast("long"), F.size(target).cast("long")).cast("int")
        return bound(n, lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(base) - n), F.slice(target, n + 1, F.greatest(F.size(target) - n, F.lit(0)))), "/"))

    return F.when(store(path) == store(folder), bound(F.struct(split(path).alias("target"), split(folder).alias("base")), parted)).otherwise(path)
