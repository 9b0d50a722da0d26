"""A registry of checks. A check is a function of (stones, context) that gives findings (design_id, level, message, n)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import color
from lapidary.functions.numeric import rounded
from lapidary.operators import design, shaped, spatial

RANK = {"pass": 0, "info": 1, "warn": 2, "error": 3}
CHECKS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register(name: str):
    def add(f):
        CHECKS[name] = f
        return f

    return add


def unregister(name: str) -> None:
    CHECKS.pop(name, None)


def _found(df: DataFrame, level, message: str, n) -> DataFrame:
    return df.select("design_id", (F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(message).alias("message"), n.cast("long").alias("n"))


@register("code-count")
def code_count(stones: DataFrame, context: dict) -> DataFrame:
    return _found(design.code_count(stones), F.col("level"), "codes in use", F.col("codes"))


#: Findings of one kind name so many of their stones.
MOST_IDS = 50
_ENTRY_LEVELS = {"unknown": "error", "inactive": "warn", "shape": "error", "size": "error", "drawn size": "warn"}


def entry_faults(stones: DataFrame, catalog: DataFrame, size_map: DataFrame | None = None) -> DataFrame:
    """Where stones differ from their catalogue entry: design_id, code_id, fault, stated, n, ids (the first ``MOST_IDS``).

    Looked at is what both sides have: whether the code is known and made, ``shape``, ``phys_mm``, and ``ref_mm``, which for a
    round entry has to be what ``size_map`` (phys_mm, ref_mm) draws its size as, and for others the entry's own, scaled as
    the stone is. ``stated`` is what the stone says, null for a code's own faults.
    """
    known = catalog.select("code_id", F.col("active").alias("_active"), F.col("phys_mm").alias("_mm"), *(F.col(c).alias(f"_{c}") for c in ("shape", "ref_mm") if c in catalog.columns))
    rows = stones.join(known, "code_id", "left")
    if size_map is not None:
        rows = rows.join(F.broadcast(size_map.select(F.col("phys_mm"), F.col("ref_mm").alias("_map"))), "phys_mm", "left")
    text, none = (lambda c: F.col(c).cast("string")), F.lit(None).cast("string")
    fault = lambda when, name, stated: F.when(when, F.struct(F.lit(name).alias("fault"), stated.alias("stated")))
    faults = [fault(~F.col("_active"), "inactive", none), fault(F.abs(F.col("_mm") - F.col("phys_mm")) >= 1e-6, "size", text("phys_mm"))]
    if "shape" in stones.columns and "_shape" in rows.columns:
        faults.append(fault(F.col("_shape") != F.col("shape"), "shape", F.col("shape")))
    if "ref_mm" in stones.columns and "_ref_mm" in rows.columns:
        scaled = F.col("_ref_mm") * (F.col("phys_mm") / F.col("_mm"))
        due = F.when(F.col("_shape") == "round", F.col("_map")).otherwise(scaled) if size_map is not None and "_shape" in rows.columns else scaled
        faults.append(fault(F.coalesce(F.abs(due - F.col("ref_mm")) >= 1e-6, F.lit(True)), "drawn size", text("ref_mm")))
    found = F.when(F.col("_active").isNull(), F.array(F.struct(F.lit("unknown").alias("fault"), none.alias("stated")))).otherwise(F.array_compact(F.array(*faults)))
    each = rows.select("design_id", "code_id", "stone_id", F.explode(found).alias("f")).select("design_id", "code_id", "stone_id", "f.*")
    key = ["design_id", "code_id", "fault", "stated"]
    # of a kind, only the first stones are ever gathered
    numbered = each.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("stone_id")))
    return numbered.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_IDS, F.col("stone_id")))).alias("ids"))


def _entries(stones: DataFrame, context: dict) -> DataFrame:
    """A finding for each code and fault; designs without one pass, with the number of their codes."""
    out = []
    if context.get("pinned") is not None:
        # pinned: (design_id, version) that each design was made with
        out.append(_found(context["pinned"].where(~F.col("version").eqNullSafe(F.lit(context.get("version")))).withColumn("n", F.lit(1)), "warn", "another version of the catalogue", F.col("n")))
    faults = entry_faults(stones, context["catalog"], context.get("size_map"))
    level = F.element_at(F.create_map(*(F.lit(x) for kv in _ENTRY_LEVELS.items() for x in kv)), F.col("fault"))
    stated = F.when(F.col("stated").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), "stated"))
    out.append(faults.select("design_id", level.alias("level"), F.concat(F.lit("code "), F.col("code_id").cast("string"), F.lit(" "), "fault", stated).alias("message"), "n"))
    failed = reduce(DataFrame.unionByName, out)
    fine = stones.join(failed.select("design_id").distinct(), "design_id", "left_anti").groupBy("design_id").agg(F.count_distinct("code_id").alias("n"))
    return failed.unionByName(_found(fine, "pass", "all codes as in the catalogue", F.col("n")))


def _layers(stones: DataFrame, context: dict) -> DataFrame:
    """Stones in another layer than they name, totals and codes that differ from the bill (design_id, code_id, expected)."""
    out = []
    if "in_layer" in stones.columns:
        out.append(_found(stones.where("layer <> in_layer").groupBy("design_id").agg(F.count("*").alias("n")), "error", "stones name another layer", F.col("n")))
    sums = stones.groupBy("design_id").agg(F.count("*").alias("n"))
    bill = context.get("expected")
    if bill is None:
        return reduce(DataFrame.unionByName, [*out, _found(sums, "info", "no bill to compare with", F.col("n"))])
    differ = design.against_bill(stones, bill).join(bill.select("design_id").distinct(), "design_id", "left_semi")
    totals = sums.join(bill.groupBy("design_id").agg(F.sum("expected").alias("expected")), "design_id", "full_outer").select("design_id", F.coalesce("n", F.lit(0)).alias("n"), "expected")
    out.append(_found(totals.where("expected is null"), "info", "no bill to compare with", F.col("n")))
    out.append(_found(totals.where("n <> expected"), "error", "total differs from the bill", F.col("n") - F.col("expected")))
    out.append(differ.select("design_id", F.lit("error").alias("level"), F.concat(F.lit("code "), F.col("code_id").cast("string"), F.lit(" differs from the bill")).alias("message"), (F.col("placed") - F.col("expected")).cast("long").alias("n")))
    failed = reduce(DataFrame.unionByName, out)
    fine = sums.join(failed.select("design_id").distinct(), "design_id", "left_anti")
    return failed.unionByName(_found(fine, "pass", "layers, total and codes as in the bill", F.col("n")))


@register("catalog")
def in_catalog(stones: DataFrame, context: dict) -> DataFrame:
    if context.get("by_code"):
        return _entries(stones, context)
    rows = design.catalog_faults(stones, context["catalog"]).groupBy("design_id", "fault").agg(F.sum("n").alias("n"))
    return rows.select("design_id", F.when(F.col("fault") == "inactive", "warn").otherwise("error").alias("level"), F.concat(F.lit("code "), F.col("fault")).alias("message"), "n")


@register("symbols")
def symbols(stones: DataFrame, context: dict) -> DataFrame:
    faults = design.symbol_faults(design.symbols(stones, context["catalog"])).groupBy("design_id", "fault").agg(F.count("*").alias("n"))
    return faults.select("design_id", F.when(F.col("fault") == "outside_set", "warn").otherwise("error").alias("level"), F.concat(F.lit("symbol "), F.col("fault")).alias("message"), "n")


@register("layer-total")
def layer_total(stones: DataFrame, context: dict) -> DataFrame:
    if context.get("by_code"):
        return _layers(stones, context)
    if context.get("expected") is None:
        return _found(stones.groupBy("design_id").agg(F.count("*").alias("n")), "info", "no bill to compare with", F.col("n"))
    return _found(design.against_bill(stones, context["expected"]).groupBy("design_id").agg(F.count("*").alias("n")), "error", "codes that differ from the bill", F.col("n"))


def _near(stones: DataFrame, clearance: float) -> DataFrame:
    """Pairs closer than that, by their outlines where the stones have shapes and boxes, else as round ones."""
    if set(shaped.COLUMNS) <= set(stones.columns):
        return shaped.shaped_pairs(stones, clearance, ["design_id"])
    return spatial.close_pairs(stones.select("design_id", "stone_id", "x_mm", "y_mm", "phys_mm"), clearance, ["design_id"]).withColumn("gap", spatial.gap())


@register("overlap")
def overlap(stones: DataFrame, context: dict) -> DataFrame:
    pairs = _near(stones, -0.05)
    return _found(pairs.groupBy("design_id").agg(F.count("*").alias("n")), "error", "overlapping pairs", F.col("n"))


@register("gap")
def gap(stones: DataFrame, context: dict) -> DataFrame:
    # of a stone that is too close, the smallest gap is among these
    near = spatial.both_ends(_near(stones, 0.15), ["design_id"], ["gap"]).groupBy("design_id", "stone_id").agg(F.min("gap").alias("gap"))
    return _found(near.where("gap >= -0.05D").groupBy("design_id").agg(F.count("*").alias("n")), "warn", "stones too close", F.col("n"))


def _every(stones: DataFrame, level: str, message: str) -> DataFrame:
    """One finding for each design: a check without what it needs, or one that failed."""
    return _found(stones.groupBy("design_id").agg(F.count("*").alias("n")), level, message, F.col("n"))


def at_pixel(v: str, size: float, pixels: int) -> Column:
    """The pixel that a place falls into, the last one for the far edge."""
    return F.greatest(F.least(F.floor(F.col(v) / F.lit(float(size)) * pixels), F.lit(pixels - 1)), F.lit(0))


def outside_mask(stones: DataFrame, cells: DataFrame, context: dict, keys: list[str]) -> DataFrame:
    """Stones whose centre lies in none of the cells (keys, px, py) of a mask of ``context["pixels"]`` a side."""
    at = {"px": at_pixel("x_mm", context["width"], context["pixels"]), "py": at_pixel("y_mm", context["height"], context["pixels"])}
    return stones.withColumns(at).join(cells.select(*keys, "px", "py").distinct(), [*keys, "px", "py"], "left_anti")


@register("outside-region")
def outside(stones: DataFrame, context: dict) -> DataFrame:
    """Bodies over the canvas's edge; centres outside the region, and outside their layer's (null layer: any)."""
    r, w, h = F.col("phys_mm") / 2, context["width"], context["height"]
    over = F.greatest(r - F.col("x_mm"), r - F.col("y_mm"), F.col("x_mm") + r - w, F.col("y_mm") + r - h) > 0.05
    out = [_found(stones.where(over).groupBy("design_id").agg(F.count("*").alias("n")), "error", "stones over the edge", F.col("n"))]
    for name, keys in (("region", ["design_id"]), ("layer_regions", ["design_id", "layer"])):
        if context.get(name) is not None:
            out.append(_found(outside_mask(stones, context[name], context, keys).groupBy("design_id").agg(F.count("*").alias("n")), "error", f"centres outside the {name.replace('_', ' ')}", F.col("n")))
    return reduce(DataFrame.unionByName, out)


def free_probes(stones: DataFrame, cells: DataFrame, context: dict, step: float = 1.0, size: float = 2.8, gap: float = 0.15) -> DataFrame:
    """Probes (design_id, i, j) in the mask, at every step, where a stone of ``size`` would fit a gap away from all others."""
    w, h, pixels, need = context["width"], context["height"], context["pixels"], size / 2 + gap
    # a mask cell makes the probes within it
    along = lambda p, side: F.sequence(F.greatest(F.ceil(F.col(p) * side / pixels / step - 0.5) - 1, F.lit(0)), F.ceil((F.col(p) + 1) * side / pixels / step - 0.5))
    probes = cells.select("design_id", "px", "py", F.explode(along("px", w)).alias("i")).select("*", F.explode(along("py", h)).alias("j"))
    probes = probes.withColumns({"x_mm": (F.col("i") + F.lit(0.5)) * step, "y_mm": (F.col("j") + F.lit(0.5)) * step})
    inner = F.col("x_mm").between(size / 2, w - size / 2) & F.col("y_mm").between(size / 2, h - size / 2)
    probes = probes.where(inner & (at_pixel("x_mm", w, pixels) == F.col("px")) & (at_pixel("y_mm", h, pixels) == F.col("py")))
    # a probe is near what is nearer than half the largest size of the design and its own need
    bodies = spatial.with_largest(stones.select("design_id", "x_mm", "y_mm", "phys_mm"), ["design_id"], need + 1e-6, factor=0.5)
    reach = bodies.groupBy("design_id").agg(F.first("_reach").alias("_reach"))
    near = spatial.within(probes.select("design_id", "i", "j", "x_mm", "y_mm").join(reach, "design_id"), bodies, "_reach", ["design_id"])
    covered = near.where(F.col("distance") - F.col("b_phys_mm") / 2 <= need).select("design_id", F.col("a_i").alias("i"), F.col("a_j").alias("j")).distinct()
    return probes.select("design_id", "i", "j").join(covered, ["design_id", "i", "j"], "left_anti")


@register("holes")
def holes(stones: DataFrame, context: dict) -> DataFrame:
    if context.get("mask") is None:
        return _every(stones, "info", "no mask of what to cover")
    free = free_probes(stones, context["mask"], context, context.get("step_mm", 1.0))
    return _found(free.groupBy("design_id").agg(F.count("*").alias("n")), "warn", "places for one more stone", F.col("n"))


def image_difference(pixels: DataFrame) -> DataFrame:
    """Mean and largest difference of two images' pixels (design_id, p_r, p_g, p_b, p_alpha, q_r, ...) that both show."""
    both = pixels.where((F.col("p_alpha") >= 128) & (F.col("q_alpha") >= 128))
    both = color.add(both, color.lab_steps("p_r", "p_g", "p_b", "x"), ["x_l", "x_a", "x_b"])
    both = color.add(both, color.lab_steps("q_r", "q_g", "q_b", "y"), ["y_l", "y_a", "y_b"])
    both = color.add(both, color.de2000_steps("x", "y"), ["de"])
    return both.groupBy("design_id").agg(rounded(F.avg("de"), 2).alias("mean"), rounded(F.max("de"), 1).alias("most"), F.count("*").alias("n"))


@register("delta-e")
def delta_e(stones: DataFrame, context: dict) -> DataFrame:
    if context.get("images") is None:
        return _every(stones, "info", "no images to compare")
    rows = image_difference(context["images"])
    return _found(rows, F.when(F.col("mean") > context.get("most_de", 10.0), "warn").otherwise("pass"), "mean difference of the images", F.col("n"))


@register("merge-warnings")
def merges(stones: DataFrame, context: dict) -> DataFrame:
    rows = context.get("merges")
    if rows is None:
        return _found(stones.groupBy("design_id").agg(F.lit(0).alias("n")), "pass", "no merged codes", F.col("n"))
    return _found(rows.where("de > 20").groupBy("design_id").agg(F.count("*").alias("n")), "warn", "merged codes over 20 apart", F.col("n"))


def _guarded(name: str, stones: DataFrame, context: dict) -> DataFrame:
    """A check's findings, as a table; one that cannot be planned or fails when it runs is an error finding itself."""
    try:
        found = spatial.stored(CHECKS[name](stones, context).select("design_id", "level", "message", "n"), "findings")
    except Exception as e:  # noqa: BLE001  the registry is open: any failure of a check is a finding
        return _every(stones, "error", f"check failed: {type(e).__name__}")
    return found


def run(stones: DataFrame, context: dict, only: list[str] | None = None) -> DataFrame:
    """Findings of all checks, or of those named: design_id, check_id, level, level_rank, message, n."""
    parts = [_guarded(name, stones, context).withColumn("check_id", F.lit(name)) for name in sorted(CHECKS) if only is None or name in only]
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("level"))
    return reduce(DataFrame.unionByName, parts).withColumn("level_rank", rank)


def worst(findings: DataFrame) -> DataFrame:
    return findings.groupBy("design_id").agg(F.max_by("level", "level_rank").alias("status"), F.count("*").alias("findings"))
