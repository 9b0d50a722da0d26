"""Markup as a source and a sink: tags and attributes, and designs as SVG text, flat or in nested groups."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lapidary.functions.numeric import rounded

#: Files whose rows are written at once.
_FILES = 64


def escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for raw, name in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def attributes(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per occurrence of an attribute: its place from 0, and its value."""
    found = F.regexp_extract_all(F.col(column), F.lit(f'{name}="([^"]*)"'), F.lit(1))
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(found).alias("place", "value"))


def number_text(column: str) -> Column:
    """A number as people write it: 5, not 5.0; exact when read again."""
    return F.regexp_replace(F.col(column).cast("string"), r"\.0$", "")


def group_name(code: Column, size: str) -> Column:
    return F.concat(F.lit("K_"), code, F.lit("_S"), number_text(size))


def group_size(name: Column) -> Column:
    return F.regexp_extract(name, r"_S(\d+(?:\.\d+)?)", 1).try_cast("double")


def write_svg(stones: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """(key, svg): one text per design, layers in drawing order, a circle per stone."""
    layers = F.array(F.lit("bg"), F.lit("costume"), F.lit("pet"))
    circle = F.concat(
        F.lit('<circle data-id="'), F.col("stone_id").cast("string"), F.lit('" data-code="'), escape(F.col("code_id").cast("string")), F.lit('" cx="'), number_text("x_mm"), F.lit('" cy="'), number_text("y_mm"), F.lit('" data-mm="'), number_text("phys_mm"), F.lit('"/>'),
    )
    lines = stones.select(key, F.array_position(layers, F.col("layer")).alias("_rank"), "layer", "stone_id", circle.alias("_line"))
    groups = lines.groupBy(key, "_rank", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stone_id", "_line"))), lambda s: s["_line"]), "\n").alias("_body"))
    group = F.concat(F.lit('<g data-layer="'), escape(F.col("layer")), F.lit('">\n'), F.col("_body"), F.lit("\n</g>"))
    texts = groups.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", group.alias("_g")))), lambda s: s["_g"]), "\n").alias("_body"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}mm" height="{height:g}mm" viewBox="0 0 {width:g} {height:g}">\n'
    return texts.select(key, F.concat(F.lit(head), F.col("_body"), F.lit("\n</svg>\n")).alias("svg"))


def read_svg(files: DataFrame, key: str) -> DataFrame:
    """The stones of such texts: key, stone_id, layer, code, x_mm, y_mm, phys_mm."""
    groups = files.select(key, F.explode(F.expr("regexp_extract_all(svg, '(?s)<g data-layer=.*?</g>', 0)")).alias("_g"))
    circles = groups.select(key, unescape(F.regexp_extract("_g", 'data-layer="([^"]*)"', 1)).alias("layer"), F.explode(F.expr("regexp_extract_all(_g, '<circle [^>]*/>', 0)")).alias("_c"))
    get = lambda name: unescape(F.regexp_extract("_c", f' {name}="([^"]*)"', 1))
    return circles.select(key, get("data-id").try_cast("long").alias("stone_id"), "layer", get("data-code").alias("code"), *(get(a).try_cast("double").alias(c) for a, c in (("cx", "x_mm"), ("cy", "y_mm"), ("data-mm", "phys_mm"))))


def parse_transform(text: Column) -> Column:
    """A transform attribute (translate, scale, rotate, matrix) as one matrix a..f, an array of six numbers."""
    # no attribute: no change
    calls = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(translate|scale|rotate|matrix)\s*\([^)]*\)"), F.lit(0))

    # each call is read once: what a lambda is given is a value, what it computes would be computed wherever it is named
    read = F.transform(calls, lambda call: F.struct(
        F.regexp_extract(call, r"^(\w+)", 1).alias("name"), F.transform(F.regexp_extract_all(call, F.lit(r"(-?[0-9.]+(?:[eE][-+]?\d+)?)"), F.lit(1)), lambda x: x.try_cast("double")).alias("v"),
    ))

    def matrix(call: Column) -> Column:
        name, v = call["name"], call["v"]
        at = lambda i, other=0.0: F.coalesce(F.get(v, F.lit(i)), other if isinstance(other, Column) else F.lit(other))
        turn = F.radians(at(0))
        c, s = F.cos(turn), F.sin(turn)
        x, y = at(1), at(2)
        n = F.when(name == "translate", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), at(0), at(1)))
        n = n.when(name == "scale", F.array(at(0), F.lit(0.0), F.lit(0.0), at(1, at(0)), F.lit(0.0), F.lit(0.0)))
        return n.when(name == "rotate", F.array(c, s, -s, c, x - c * x + s * y, y - s * x - c * y)).otherwise(v)

    one = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))
    return F.aggregate(F.transform(read, matrix), one, composed)


TAG = r"</?[A-Za-z][^<>]*>[^<]*"
_TAG, _NAME = re.compile(TAG), re.compile(r"</?([\w:-]+)", re.ASCII)
_ATTRIBUTE, _GAP = re.compile(r'([\w:-]+)\s*=\s*"([^"]*)"', re.ASCII), re.compile(r"([\w:-]+)\s*=\s*\Z", re.ASCII)


def tag_list(text: str) -> list[str]:
    """All tags of a text, each with the text behind it."""
    return _TAG.findall(text)


def tag_name(tag: str) -> str:
    return _NAME.match(tag)[1]


class _Gaps(dict):
    """What stands between a value and the next one's quotes -> that one's name, or None; files have few of them."""

    def __missing__(self, gap: str) -> str | None:
        if len(self) > 4096:
            self.clear()
        found = _GAP.search(gap)
        self[gap] = found and found[1]
        return self[gap]


_GAPS = _Gaps()


def attribute_map(tag: str) -> dict[str, str]:
    """The attributes of a tag, the first of each name; a closing tag has none."""
    if tag.startswith("</"):
        return {}
    inside = tag.partition(">")[0]
    parts = inside.split('"')
    names = [_GAPS[gap] for gap in parts[:-1:2]]
    if len(parts) % 2 == 0 or None in names:
        # quotes that open no value
        return dict(reversed(_ATTRIBUTE.findall(inside)))
    return dict(zip(names[::-1], parts[-2::-2]))


def file_rows(files: DataFrame, keys: list[str], text: str, rows: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """(keys, ``columns``): what ``rows`` reads from each text, in its order; from no text nothing."""
    schema = StructType([f for f in files.select(*keys).schema] + StructType.fromDDL(columns).fields)
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _FILES):
                part = batch.slice(start, _FILES)
                found = [(at, *row) for at, svg in enumerate(part.column(len(keys)).to_pylist()) if svg is not None for row in rows(svg)]
                if found:
                    at, *values = zip(*found)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at)).cast(types.field(k).type) for k in range(len(keys))), *(pa.array(v, f.type) for v, f in zip(values, list(types)[len(keys):]))], schema=types)

    return files.select(*keys, text).mapInArrow(run, schema)


def composed(m: Column, n: Column) -> Column:
    """The matrix (a..f) that applies n, then m."""
    return F.array(
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5],
    )


_GROUP, _CALL = re.compile(r"</?g(?![\w:-])", re.ASCII), re.compile(r"(?:translate|scale|rotate|matrix)\s*\([^)]*\)", re.ASCII)
_VALUE = re.compile(r"-?[0-9.]+(?:[eE][-+]?\d+)?", re.ASCII)
_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _value(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return math.nan


def _matrix(call: str) -> tuple[float, ...]:
    v = [_value(x) for x in _VALUE.findall(call)]
    if call.startswith("matrix"):
        return tuple(v[:6]) + (math.nan,) * (6 - len(v))
    at = lambda i, other=0.0: v[i] if i < len(v) and v[i] == v[i] else other
    if call.startswith("translate"):
        return (1.0, 0.0, 0.0, 1.0, at(0), at(1))
    if call.startswith("scale"):
        return (at(0), 0.0, 0.0, at(1, at(0)), 0.0, 0.0)
    turn, x, y = math.radians(at(0)), at(1), at(2)
    c, s = math.cos(turn), math.sin(turn)
    return (c, s, -s, c, x - c * x + s * y, y - s * x - c * y)


def _product(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """As ``composed``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def transform_matrix(text: str | None) -> tuple[float, ...]:
    """As ``parse_transform``; what is missing in a matrix is no number."""
    calls = _CALL.findall(text) if text else ()
    return reduce(_product, map(_matrix, calls)) if calls else _ONE


def groups(text: str) -> list[tuple]:
    """The groups of a file, in order: place, level, layer, matrix to the canvas, attributes.

    A group's level is a running sum over opening and closing tags. Its parent is the last group that opened one level above
    and is not closed at once; from it come matrix and layer. The layer is that of the outermost group that names one. Ends
    with a row of None and whether groups do not close as they open.
    """
    marks = [(place, tag.partition(">")[0]) for place, tag in enumerate(tag_list(text)) if _GROUP.match(tag)]
    found, above, open_, broken = [], {}, 0, False
    for n, (place, inside) in enumerate(marks):
        if inside.startswith("</"):
            open_ -= 1
            broken |= open_ < 0
            continue
        alone = inside.endswith("/")
        # a group that closes itself holds nothing, and stands a level below what is open
        level, own = open_ + 1, attribute_map(inside)
        open_ += not alone
        m, layer = transform_matrix(own.get("transform")), own.get("data-layer")
        if level in above:
            up, outer = above[level]
            m, layer = _product(up, m), layer if outer is None else outer
        found.append((place, level, layer, m, own))
        if not alone and n + 1 < len(marks) and not marks[n + 1][1].startswith("</"):
            above[level + 1] = m, layer
    return [*found, (None, None, None, None, broken or open_ != 0)]


_STONE = {"id": "id", "code": "code", "shape": "shape", "phys_mm": "phys", "ref_mm": "ref", "locked": "locked", "source": "source"}


def _stones(text: str) -> Iterator[tuple]:
    """The groups with data-id: place, level, layer, four values of the matrix, attributes, whether the file is broken."""
    *found, (*_, broken) = groups(text)
    for place, level, layer, m, own in found:
        if "data-id" in own:
            yield place, level, layer, *(None if v != v else v for v in (m[0], m[1], m[4], m[5])), *(own.get(f"data-{a}") for a in _STONE.values()), broken


def read_groups(files: DataFrame, keys: list[str], text: str = "svg") -> DataFrame:
    """The stones (groups with data-id) of files with nested groups, in order of place, on the canvas:

    keys, place, level, layer, id, code, shape, x_mm, y_mm, rot_deg, phys_mm, ref_mm, locked, source, fault (outside_layer,
    broken_file, or null). Numbers are to a millionth.
    """
    columns = ["place int", "level long", "layer string", "_a double", "_b double", "_e double", "_f double", *(f"{c} string" for c in _STONE), "_broken boolean"]
    rows = file_rows(files, keys, text, _stones, ", ".join(columns))
    get = lambda name: unescape(F.col(name))
    # the layer's own mark is on its group; a stone that names one says so itself
    return rows.select(
        *keys, "place", "level", get("layer").alias("layer"), get("id").alias("id"), get("code").alias("code"), F.coalesce(get("shape"), F.lit("round")).alias("shape"),
        rounded(F.col("_e"), 6).alias("x_mm"), rounded(F.col("_f"), 6).alias("y_mm"), rounded(F.degrees(F.atan2("_b", "_a")), 6).alias("rot_deg"),
        get("phys_mm").try_cast("double").alias("phys_mm"), get("ref_mm").try_cast("double").alias("ref_mm"), F.coalesce(get("locked") == "true", F.lit(False)).alias("locked"), F.coalesce(get("source"), F.lit("")).alias("source"),
        F.when(F.col("_broken"), "broken_file").when(F.col("layer").isNull(), "outside_layer").alias("fault"),
    )


def group_text(name: str, value: Column, transform: Column | None, body: Column) -> Column:
    """A group with one attribute and, where given, a transform."""
    moved = F.lit("") if transform is None else F.concat(F.lit(' transform="'), transform, F.lit('"'))
    return F.concat(F.lit(f'<g {name}="'), escape(value), F.lit('"'), moved, F.lit(">\n"), body, F.lit("</g>\n"))


def stone_group(id_: Column, code: Column, shape: Column, x: Column, y: Column, rot: Column, phys: Column, ref: Column, locked: Column) -> Column:
    """A stone as a group that can be edited: what it is as attributes, where it is as a transform."""
    fields = {"id": id_, "code": code, "shape": shape, "phys": phys.cast("string"), "ref": ref.cast("string"), "locked": locked.cast("string")}
    head = F.concat(*(F.concat(F.lit(f' data-{k}="'), escape(v), F.lit('"')) for k, v in fields.items()))
    at = F.concat(F.lit(' transform="translate('), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(") rotate("), rot.cast("string"), F.lit(')">'))
    return F.concat(F.lit("<g"), head, at, F.lit('<circle r="'), (ref / 2).cast("string"), F.lit('"/></g>\n'))
