"""Vector tiles and map styles: what layers a tile has, what a style asks of a schema, rewriting of styles and scales."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from xml.dom import minidom

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectorised import vectorised

#: Operators of style expressions whose first operand names a property; fixed by the style specification.
COMPARISONS = {"==", "!=", "<", ">", "<=", ">=", "in", "!in", "has", "!has", "get"}


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protobuf message; nested messages come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while at < len(data) and shift < 70:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value
        raise ValueError("a number without an end")

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
        if size < 0 or at + size > len(data):
            raise ValueError("not a protobuf message")
        yield key >> 3, data[at : at + size]
        at += size


def tile_layers(blob: bytes) -> dict[str, int]:
    """Layer names of a vector tile, which may be zipped, with how many features each has."""
    found: dict[str, int] = {}
    for number, layer in _fields(gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob):
        if number == 3:
            inner = list(_fields(layer))
            name = next(v for k, v in inner if k == 1).decode()
            found[name] = found.get(name, 0) + sum(k == 2 for k, _ in inner)
    return found


@vectorised("map<string,int>")
def layer_counts(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else tile_layers(bytes(b)))


def features(tiles: DataFrame, keys: list[str], data: str = "tile_data") -> DataFrame:
    """(keys, layer, features) of each tile; geometry isn't decoded."""
    return tiles.select(*keys, F.explode(layer_counts(data)).alias("layer", "features"))


def referenced(style_layer: dict) -> dict[str, str]:
    """Properties that a style layer's filter, layout and paint refer to: Number where compared with one, else String."""
    kinds: dict[str, str] = {}

    def note(name: str, kind: str = "String") -> None:
        if name not in ("$type", "$id") and (kind == "Number" or name not in kinds):
            kinds[name] = kind

    def visit(x) -> None:
        if isinstance(x, str):
            for token in re.findall(r"\{([^{}]+)\}", x):
                note(token)
        elif isinstance(x, dict):
            if isinstance(x.get("property"), str):
                note(x["property"], "Number")
            for v in x.values():
                visit(v)
        elif isinstance(x, list):
            if len(x) > 1 and isinstance(x[0], str) and x[0] in COMPARISONS and isinstance(x[1], str):
                number = len(x) > 2 and isinstance(x[2], (int, float)) and not isinstance(x[2], bool)
                note(x[1], "Number" if number else "String")
            for v in x:
                visit(v)

    for part in ("filter", "layout", "paint"):
        visit(style_layer.get(part))
    return kinds


@vectorised("array<struct<layer:string,fields:map<string,string>>>")
def required_fields(styles: pd.Series) -> pd.Series:
    """The source layers that style documents draw, with the properties that they need."""

    def of(text: str | None):
        if text is None:
            return None
        found: dict[str, dict[str, str]] = {}
        for layer in json.loads(text).get("layers", []):
            if "source-layer" in layer:
                for name, kind in referenced(layer).items():
                    own = found.setdefault(layer["source-layer"], {})
                    if kind == "Number" or name not in own:
                        own[name] = kind
                found.setdefault(layer["source-layer"], {})
        return [{"layer": k, "fields": v} for k, v in sorted(found.items())]

    return styles.map(of)


def completed_schema(required: DataFrame, schema: DataFrame) -> DataFrame:
    """(layer, fields, added): each layer's fields, kept as they are, with the required ones that it lacks.

    required and schema: layer, fields (map of name to kind).
    """
    r, s = required.select("layer", F.col("fields").alias("r")), schema.select("layer", F.col("fields").alias("s"))
    none = F.create_map().cast("map<string,string>")
    both = r.join(s, "layer", "full_outer").select("layer", F.coalesce("r", none).alias("r"), F.coalesce("s", none).alias("s"))
    added = F.map_filter("r", lambda k, _: ~F.map_contains_key(F.col("s"), k))
    return both.select("layer", F.map_concat("s", added).alias("fields"), F.array_sort(F.map_keys(added)).alias("added"))


def missing_layers(styles: DataFrame, available: DataFrame) -> DataFrame:
    """Source layers that styles refer to and nothing provides; styles and available: layer."""
    return styles.select("layer").distinct().join(available.select("layer").distinct(), "layer", "left_anti")


@vectorised("string")
def with_world_below(styles: pd.Series) -> pd.Series:
    """Style documents with their own layers from zoom 6 on, over flat world layers of three scales in the style's colours."""
    ranges = {110: (0, 4), 50: (4, 6), 10: (6, 24)}

    def of(text: str | None):
        if text is None:
            return None
        style = json.loads(text)
        paints = [(x, x.get("paint", {})) for x in style["layers"]]
        land = next(p["background-color"] for x, p in paints if x["type"] == "background")
        water = next(p["fill-color"] for x, p in paints if x.get("source-layer") == "water" and "fill-color" in p)
        made = [{"id": "background", "type": "background", "paint": {"background-color": water}}]
        for scale, (low, high) in ranges.items():
            for theme, colour in (("ocean", water), ("land", land), ("lakes", water)):
                made.append({"id": f"world-{theme}-{scale}", "type": "fill", "source": "world", "source-layer": f"world_{theme}_{scale}", "minzoom": low, "maxzoom": high, "paint": {"fill-color": colour}})
        for layer, _ in paints:
            low = max(6, layer.get("minzoom", 0))
            if layer["type"] != "background" and layer.get("maxzoom", 24) > low:
                made.append(layer | {"minzoom": low})
        return json.dumps(style | {"layers": made, "sources": {"base": {"type": "vector"}, "world": {"type": "vector"}}})

    return styles.map(of)


@vectorised("string")
def widened_scales(styles: pd.Series) -> pd.Series:
    """Scale limits of SLD documents a hundred-millionth up, so that whole zoom levels fall on one side of them."""
    limit = re.compile(r"(<(?:\w+:)?(?:Min|Max)ScaleDenominator>)([^<]+)")
    return styles.map(lambda t: None if t is None else limit.sub(lambda m: m[1] + repr(float(m[2]) * 1.00000001), t))


#: Namespaces of style documents. Fixed values.
_SPACES = {"sld": "http://www.opengis.net/sld", "ogc": "http://www.opengis.net/ogc"}
#: Pixels around the labelled icons of places of interest, at least, and around icons without a label. Fixed values.
LABELLED_SPACE, UNLABELLED_SPACE = 16, 40
#: How an icon without a label is drawn. Fixed values.
ICON_OPTIONS = {
    "conflictResolution": "true",
    "spaceAround": str(UNLABELLED_SPACE),
    "group": "false",
    "partials": "false",
    "graphicPlacement": "INDEPENDENT",
    "graphic-resize": "NONE",
    "fallbackOnDefaultMark": "false",
}
#: What an icon without a label is behind one with a label, and the priority of symbols that have none. Fixed values.
BEHIND, PRIORITY = "1000000", "1000"


class _Style:
    """A style document whose elements are found and made by prefixed names, whatever prefixes it uses itself."""

    def __init__(self, text: str):
        self.document = minidom.parseString(text.encode())
        for k, v in _SPACES.items():  # what is made here has these prefixes
            self.document.documentElement.setAttribute(f"xmlns:{k}", v)

    def every(self, node, name: str) -> list:
        prefix, tag = name.split(":")
        return node.getElementsByTagNameNS(_SPACES[prefix], tag)

    def inside(self, node, name: str) -> list:
        return [x for x in self.every(node, name) if x.parentNode is node]

    def text(self, node, name: str, default: str) -> str:
        found = self.inside(node, name)
        return "".join(x.data for x in found[0].childNodes if x.nodeType in (x.TEXT_NODE, x.CDATA_SECTION_NODE)) if found else default

    def copies(self, node, *names: str) -> list:
        return [x.cloneNode(True) for name in names for x in self.inside(node, name)[:1]]

    def made(self, tag: str, /, *content, **attributes: str):
        out = self.document.createElementNS(_SPACES[tag.split(":")[0]], tag)
        for k, v in attributes.items():
            out.setAttribute(k, v)
        for x in content:
            out.appendChild(self.document.createTextNode(x) if isinstance(x, str) else x)
        return out

    def option(self, symbol, name: str, value: str) -> None:
        for old in [x for x in self.inside(symbol, "sld:VendorOption") if x.getAttribute("name") == name]:
            symbol.removeChild(old)
        symbol.appendChild(self.made("sld:VendorOption", value, name=name))

    def icon(self, symbol):
        """The symbol's graphic under a label of one blank, which a text section keeps from being trimmed, in letters of no size."""
        make = self.made
        font = make("sld:Font", make("sld:CssParameter", "Noto Sans", name="font-family"), make("sld:CssParameter", "0", name="font-size"))
        anchor = make("sld:AnchorPoint", make("sld:AnchorPointX", "0.5"), make("sld:AnchorPointY", "0.5"))
        own = [x for p in self.inside(symbol, "sld:Priority")[:1] for x in p.childNodes if x.nodeType == x.ELEMENT_NODE]
        before = own[0].cloneNode(True) if own else make("ogc:Literal", self.text(symbol, "sld:Priority", PRIORITY))
        return make(
            "sld:TextSymbolizer", *self.copies(symbol, "sld:Geometry"), make("sld:Label", self.document.createCDATASection(" ")), font,
            make("sld:LabelPlacement", make("sld:PointPlacement", anchor)), *self.copies(symbol, "sld:Graphic"),
            make("sld:Priority", make("ogc:Sub", before, make("ogc:Literal", BEHIND))),
            *[make("sld:VendorOption", value, name=name) for name, value in ICON_OPTIONS.items()], **dict(symbol.attributes.items()),
        )

    def fallback(self, rule, symbols: list, field: str):
        """The rule for features without the field: the same filter and scales, with icons alone."""
        make = self.made
        name = lambda: make("ogc:PropertyName", field)
        missing = make("ogc:Or", make("ogc:PropertyIsNull", name()), make("ogc:PropertyIsEqualTo", name(), make("ogc:Literal", "")))
        own = [x.cloneNode(True) for f in self.inside(rule, "ogc:Filter")[:1] for x in f.childNodes if x.nodeType == x.ELEMENT_NODE]
        spaces = {k: v for k, v in rule.attributes.items() if k.startswith("xmlns")}
        return make(
            "sld:Rule", make("sld:Name", self.text(rule, "sld:Name", "symbol") + "-unlabelled-icon"), make("ogc:Filter", make("ogc:And", *own, missing) if own else missing),
            *self.copies(rule, "sld:MinScaleDenominator", "sld:MaxScaleDenominator"), *map(self.icon, symbols), **spaces,
        )


@vectorised("string")
def with_unlabelled_icons(styles: pd.Series) -> pd.Series:
    """SLD documents in which features without an English name keep their icons.

    A symbol of icon and label is drawn only where the label isn't empty. Each rule with such symbols whose label reads `name:en` gets another one behind
    the rules of its style, for features whose name is null or empty: the rule's filter and scales, and each icon under a blank label, in
    lower priority and with more space. In the layer `poi`, of any workspace, labelled icons get space too and give way to each other. Documents without such a rule come back
    as they are, null ones null; other than XML raises.
    """
    field = "name:en"

    def of(text: str | None):
        if text is None:
            return None
        style, changed = _Style(text), False
        for part in style.every(style.document, "sld:FeatureTypeStyle"):
            layer = part
            while layer is not None and getattr(layer, "localName", None) != "NamedLayer":
                layer = layer.parentNode
            of_interest = layer is not None and style.text(layer, "sld:Name", "").split(":")[-1] == "poi"
            added = []
            for rule in style.inside(part, "sld:Rule"):
                reads = lambda x: any("".join(c.data for c in n.childNodes) == field for label in style.inside(x, "sld:Label") for n in style.every(label, "ogc:PropertyName"))
                symbols = [x for x in style.inside(rule, "sld:TextSymbolizer") if style.inside(x, "sld:Graphic") and reads(x)]
                if symbols:
                    added.append(style.fallback(rule, symbols, field))
                for x in symbols if of_interest else []:
                    wide = [float("".join(c.data for c in o.childNodes)) for o in style.inside(x, "sld:VendorOption") if o.getAttribute("name") == "spaceAround"]
                    style.option(x, "spaceAround", f"{max([LABELLED_SPACE, *wide]):g}")
                    style.option(x, "conflictResolution", "true")
            for rule in added:
                part.appendChild(rule)
            changed = changed or bool(added)
        return style.document.toxml() if changed else text

    return styles.map(of)


def unlabelled(features_: DataFrame, name: str = "name:en") -> DataFrame:
    """Features that only an icon rule without a label should draw: no English name."""
    return features_.where(F.col(f"`{name}`").isNull() | (F.col(f"`{name}`") == ""))


def geojson_features(texts: DataFrame, column: str = "value") -> DataFrame:
    """(kind, name, coordinates as JSON) of the features of GeoJSON documents, in order."""
    shape = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = texts.select(F.posexplode(F.from_json(column, shape)["features"]).alias("i", "f"))
    return rows.select("i", F.col("f.geometry.type").alias("kind"), F.col("f.properties")["name"].alias("name"), F.col("f.geometry.coordinates").alias("coordinates"))


def normalized_metadata(metadata: DataFrame, required: DataFrame) -> DataFrame:
    """(name, value) of a tile set's metadata in which only the row `json` changes: its layers get the required fields they lack.

    metadata: name, value. required: layer, fields (map of name to kind).
    """
    shape = "vector_layers array<struct<id:string,fields:map<string,string>>>"
    own = metadata.where("name = 'json'").select(F.explode(F.from_json("value", shape)["vector_layers"]).alias("l")).select(F.col("l.id").alias("layer"), F.col("l.fields").alias("fields"))
    full = completed_schema(required, own).select("layer", F.map_from_entries(F.array_sort(F.map_entries("fields"))).alias("fields"))
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)  # noqa: E731  # maps have no order
    made = full.agg(F.array_sort(F.collect_list(F.struct(F.col("layer").alias("id"), "fields")), by_id).alias("vector_layers")).select(F.lit("json").alias("name"), F.to_json(F.struct("vector_layers")).alias("value"))
    return metadata.where("name <> 'json'").select("name", "value").union(made)


def varint(value: Column) -> Column:
    """A whole number in the hexadecimal digits of its protobuf form: seven bits a byte, the lowest first, all but the last with the high bit."""
    seven = lambda k: F.shiftrightunsigned(value.cast("long"), 7 * k).bitwiseAND(127)
    more = lambda k: F.shiftrightunsigned(value.cast("long"), 7 * (k + 1)) > 0
    byte = lambda k: F.lpad(F.hex(F.when(more(k), seven(k) + 128).otherwise(seven(k))), 2, "0")
    return F.concat(byte(0), *[F.when(more(k - 1), byte(k)).otherwise("") for k in range(1, 9)])


def field(number: int, content: Column) -> Column:
    """A protobuf field with content of so many bytes; all are hexadecimal digits."""
    return F.concat(varint(F.lit(number << 3 | 2)), varint(F.length(content) / 2), content)
