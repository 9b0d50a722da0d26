"""Symbol maps as SVG text: a writer, a strict reader with a fault for each broken rule, and layers by the mark before.

A stone is a group with two ellipses, followed by its symbol as text; stones follow the mark of their layer. A file's tags
are found once, where the file is, and what belongs together is told by place; a stone is a row, whose rules are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.sources import markup

# The format's scale and canvas.
PX_PER_MM, CANVAS_PX = 11.81, 3543


def _number(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def stone_text(id_: Column, symbol: Column, code: Column, x: Column, y: Column, d_mm: Column, group: Column, hex_: Column, shape: Column) -> Column:
    """One stone's elements; x and y in pixels."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    r, k = d_mm / 2, F.lit(f"{PX_PER_MM:.6f}")
    outer = F.concat(
        F.lit('<ellipse cx="0" cy="0"'), attribute("rx", _number(r, 6)), attribute("fill", hex_), attribute("data-position-id", id_), attribute("data-symbol", symbol), attribute("data-stone-code", code), attribute("data-shape", shape),
        attribute("data-center-x-source-px", _number(x, 6)), attribute("data-center-y-source-px", _number(y, 6)), attribute("data-width-mm", _number(d_mm, 6)), attribute("data-height-mm", _number(d_mm, 6)), attribute("data-group", group), F.lit("/>"),
    )
    inner = F.concat(F.lit('<ellipse cx="0" cy="0"'), attribute("rx", _number(r * F.lit(0.87), 6)), attribute("fill", hex_), F.lit("/>"))
    matrix = F.concat(F.lit('<g transform="matrix('), k, F.lit(" 0.000000 0.000000 "), k, F.lit(" "), _number(x, 6), F.lit(" "), _number(y, 6), F.lit(')">'))
    return F.concat(matrix, outer, inner, F.lit("</g>\n<text"), attribute("data-position-id", id_), F.lit(">"), symbol, F.lit("</text>\n"))


def file_text(stones: Column) -> Column:
    return F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="300mm" viewBox="0 0 {CANVAS_PX} {CANVAS_PX}">\n'), stones, F.lit("</svg>\n"))


#: What is read of a marked ellipse: columns and attributes.
_OWN = {"id": "position-id", "symbol": "symbol", "code": "stone-code", "group": "group", "_shape": "shape", "x": "center-x-source-px", "y": "center-y-source-px", "d_mm": "width-mm", "_height": "height-mm"}
_READ = ["place", "layer", *_OWN, "_rx", "_in_group", "_transform", "_has_text", "_text_id", "_said"]
_NAMES = [f"data-{a}" for a in _OWN.values()]
_TYPES = {"place": "int", "_in_group": "boolean", "_has_text": "boolean"}


def _is(tag: str | None, name: str) -> bool:
    """Whether it is there and opens an element of that name."""
    return tag is not None and tag.startswith(f"<{name}") and markup.tag_name(tag) == name


def _stones(text: str) -> Iterator[tuple]:
    """The marked ellipses of a file, in order: place, layer by the last mark, attributes, and the tags before and behind."""
    tags, layer = markup.tag_list(text), None
    for place, tag in enumerate(tags):
        ellipse = tag.startswith("<ellipse") and "data-position-id" in tag
        if ellipse or "data-layer" in tag:
            own = markup.attribute_map(tag)
            layer = own.get("data-layer", layer)
            if ellipse and "data-position-id" in own and _is(tag, "ellipse"):
                yield place, layer, own, tags[place - 1] if place else None, tags[place + 3] if place + 3 < len(tags) else None


def _row(place: int, layer: str | None, own: dict[str, str], group: str | None, text: str | None) -> tuple:
    """The values of ``_READ``, numbers as they are written."""
    behind = {} if text is None else markup.attribute_map(text)
    return (
        place, layer, *map(own.get, _NAMES), own.get("rx"), _is(group, "g"), None if group is None else markup.attribute_map(group).get("transform"),
        _is(text, "text"), behind.get("data-position-id"), None if text is None else text.rpartition(">")[2],
    )


def read(files: DataFrame, keys: list[str], text: str = "svg") -> DataFrame:
    """One row a stone, in order: keys, place, layer, id, symbol, code, x, y (pixels), d_mm, group, size_mm, fault, faults.

    A stone is known by its marked ellipse; the tags around it are read by their place. ``layer`` is that of the last mark
    before the stone. ``faults`` are all rules that a stone breaks, or null; ``fault`` is the first of them by name.
    """
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = markup.file_rows(files, keys, text, lambda svg: (_row(*stone) for stone in _stones(svg)), ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in _READ))
    rows = rows.select(*keys, "place", "layer", "id", "symbol", "code", "group", "_shape", *map(number, ("x", "y", "d_mm", "_height", "_rx")), markup.parse_transform(F.col("_transform")).alias("_m"), "_in_group", "_has_text", "_text_id", "_said")
    off = lambda a, b, most: F.coalesce(F.abs(a - b) > most, F.lit(True))
    scale = F.hypot(F.get("_m", F.lit(0)), F.get("_m", F.lit(1)))
    rules = {
        "no_group": ~F.col("_in_group"),
        "no_text": ~F.col("_has_text"),
        "not_round": ~F.col("_shape").eqNullSafe("round") | ~F.col("d_mm").eqNullSafe(F.col("_height")),
        "odd_scale": F.col("_in_group") & off(scale, F.lit(PX_PER_MM), 1e-3) | off(F.col("_rx") * 2, F.col("d_mm"), 1e-4),
        "off_centre": F.col("_in_group") & (off(F.get("_m", F.lit(4)), F.col("x"), 0.01) | off(F.get("_m", F.lit(5)), F.col("y"), 0.01)),
        "text_differs": F.col("_has_text") & (~F.col("_text_id").eqNullSafe(F.col("id")) | ~F.col("_said").eqNullSafe(F.col("symbol"))),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    rows = rows.withColumn("faults", broken).withColumn("faults", F.when(F.size("faults") > 0, F.col("faults")))
    return rows.select(*keys, "place", "layer", "id", "symbol", "code", "x", "y", "d_mm", "group", size_of_group(F.col("group")).alias("size_mm"), F.get("faults", F.lit(0)).alias("fault"), "faults")


def size_of_group(group: Column) -> Column:
    """Millimetres named at the end of a group: ``_S`` and a size, or a width and a height with an x (their geometric mean)."""
    sides = F.when(F.contains(group, F.lit("_S")), F.split(F.substring_index(group, "_S", -1), "x"))
    side = lambda i: F.get(sides, F.lit(i)).try_cast("double")
    return F.when(F.size(sides) == 1, side(0)).when(F.size(sides) == 2, F.sqrt(side(0) * side(1)))


def file_faults(files: DataFrame, keys: list[str], text: str = "svg") -> DataFrame:
    """Files with another canvas, or with a marked ellipse that has no group before it or no text behind: keys, fault."""
    # a file is read once, for both
    seen = lambda svg: [(f'viewBox="0 0 {CANVAS_PX} {CANVAS_PX}"' not in svg, not all(_is(group, "g") and _is(behind, "text") for *_, group, behind in _stones(svg)))]
    rows = markup.file_rows(files, keys, text, seen, "_canvas boolean, _alone boolean")
    return rows.where("_canvas or _alone").groupBy(*keys).agg(F.min(F.when(F.col("_canvas"), "canvas").otherwise("unread_stones")).alias("fault"))
