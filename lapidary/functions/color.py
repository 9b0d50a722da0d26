"""Colour expressions as SQL text: sRGB to CIE Lab, two colour differences, colour families.

A Lab colour is three columns; ``lab`` gives their expressions in two steps, so that engines evaluate the powers once.
"""

from __future__ import annotations

import numpy as np

# Matrices from linear sRGB to XYZ (D65), with four and with seven digits.
MATRICES = {
    "short": ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505)),
    "long": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)),
}
WHITE = (0.95047, 1.0, 1.08883)


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def linear(channel: str) -> str:
    """A channel of 0..255 to linear light."""
    v = f"(CAST({channel} AS DOUBLE) / {d(255.0)})"
    return f"CASE WHEN {v} > {d(0.04045)} THEN POWER(({v} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) ELSE {v} / {d(12.92)} END"


def _response(t: str) -> str:
    return f"CASE WHEN {t} > {d(0.008856)} THEN CBRT({t}) ELSE {d(7.787)} * {t} + {d(16.0)} / {d(116.0)} END"


def lab_steps(r: str, g: str, b: str, prefix: str = "lab", variant: str = "short") -> list[dict[str, str]]:
    """Columns to add, step by step; the last step adds <prefix>_l, <prefix>_a and <prefix>_b."""
    lin = {f"{prefix}_{c}lin": linear(x) for c, x in zip("rgb", (r, g, b))}
    xyz = {}
    for name, row, white in zip("xyz", MATRICES[variant], WHITE):
        total = " + ".join(f"{d(m)} * {prefix}_{c}lin" for m, c in zip(row, "rgb"))
        xyz[f"{prefix}_{name}rel"] = f"({total}) / {d(white)}"
    bent = {f"{prefix}_f{n}": _response(f"{prefix}_{n}rel") for n in "xyz"}
    out = {
        f"{prefix}_l": f"{d(116.0)} * {prefix}_fy - {d(16.0)}",
        f"{prefix}_a": f"{d(500.0)} * ({prefix}_fx - {prefix}_fy)",
        f"{prefix}_b": f"{d(200.0)} * ({prefix}_fy - {prefix}_fz)",
    }
    return [lin, xyz, bent, out]


def de76(p: str, q: str) -> str:
    return "SQRT(" + " + ".join(f"({p}_{c} - {q}_{c}) * ({p}_{c} - {q}_{c})" for c in "lab") + ")"


def de2000_steps(p: str, q: str, out: str = "de") -> list[dict[str, str]]:
    """CIEDE2000 (Sharma, Wu and Dalal, 2005) between Lab columns p_* and q_*, as columns to add step by step."""
    rad = d(0.017453292519943295)
    seven = f"POWER({d(25.0)}, {d(7.0)})"

    def chroma(a: str, b: str) -> str:
        return f"SQRT({a} * {a} + {b} * {b})"

    def hue(a: str, b: str) -> str:
        turned = f"(ATAN2({b}, {a}) / {rad})"
        return f"CASE WHEN {a} = 0 AND {b} = 0 THEN {d(0.0)} WHEN {turned} < 0 THEN {turned} + {d(360.0)} ELSE {turned} END"

    def power7(c: str) -> str:
        return f"POWER({c}, {d(7.0)})"

    mean = f"(({chroma(f'{p}_a', f'{p}_b')} + {chroma(f'{q}_a', f'{q}_b')}) / 2)"
    return [
        {f"{out}_m7": power7(mean)},
        {f"{out}_g": f"{d(0.5)} * (1 - SQRT({out}_m7 / ({out}_m7 + {seven})))"},
        {f"{out}_a1": f"(1 + {out}_g) * {p}_a", f"{out}_a2": f"(1 + {out}_g) * {q}_a"},
        {f"{out}_c1": chroma(f"{out}_a1", f"{p}_b"), f"{out}_c2": chroma(f"{out}_a2", f"{q}_b"), f"{out}_h1": hue(f"{out}_a1", f"{p}_b"), f"{out}_h2": hue(f"{out}_a2", f"{q}_b")},
        {
            f"{out}_dh": f"CASE WHEN {out}_c1 * {out}_c2 = 0 THEN {d(0.0)} WHEN {out}_h2 - {out}_h1 > 180 THEN {out}_h2 - {out}_h1 - 360 WHEN {out}_h2 - {out}_h1 < -180 THEN {out}_h2 - {out}_h1 + 360 ELSE {out}_h2 - {out}_h1 END",
            f"{out}_hm": f"CASE WHEN {out}_c1 * {out}_c2 = 0 THEN {out}_h1 + {out}_h2 WHEN ABS({out}_h1 - {out}_h2) <= 180 THEN ({out}_h1 + {out}_h2) / 2 WHEN {out}_h1 + {out}_h2 < 360 THEN ({out}_h1 + {out}_h2 + 360) / 2 ELSE ({out}_h1 + {out}_h2 - 360) / 2 END",
            f"{out}_lm": f"({p}_l + {q}_l) / 2 - 50",
            f"{out}_cm": f"({out}_c1 + {out}_c2) / 2",
        },
        {
            f"{out}_t": f"1 - {d(0.17)} * COS(({out}_hm - 30) * {rad}) + {d(0.24)} * COS(2 * {out}_hm * {rad}) + {d(0.32)} * COS((3 * {out}_hm + 6) * {rad}) - {d(0.2)} * COS((4 * {out}_hm - 63) * {rad})",
            f"{out}_turn": f"2 * SQRT({power7(f'{out}_cm')} / ({power7(f'{out}_cm')} + {seven})) * SIN(60 * {rad} * EXP(-POWER(({out}_hm - 275) / 25, {d(2.0)})))",
        },
        {
            f"{out}_u": f"({q}_l - {p}_l) / (1 + {d(0.015)} * {out}_lm * {out}_lm / SQRT(20 + {out}_lm * {out}_lm))",
            f"{out}_v": f"({out}_c2 - {out}_c1) / (1 + {d(0.045)} * {out}_cm)",
            f"{out}_w": f"2 * SQRT({out}_c1 * {out}_c2) * SIN({out}_dh / 2 * {rad}) / (1 + {d(0.015)} * {out}_cm * {out}_t)",
        },
        {out: f"SQRT(GREATEST({out}_u * {out}_u + {out}_v * {out}_v + {out}_w * {out}_w - {out}_turn * {out}_v * {out}_w, {d(0.0)}))"},
    ]


def de2000_array(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 between Lab arrays whose last axis is (L, a, b); the other axes broadcast."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(p, -1, 0), np.moveaxis(q, -1, 0)
    seven = 25.0**7
    m7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(m7 / (m7 + seven))
    a1, a2 = stretch * a1, stretch * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey, turn = c1 * c2 == 0, h2 - h1
    dh = np.where(grey, 0.0, np.where(turn > 180, turn - 360, np.where(turn < -180, turn + 360, turn)))
    both = h1 + h2
    hm = np.where(grey, both, np.where(np.abs(turn) <= 180, both / 2, np.where(both < 360, both / 2 + 180, both / 2 - 180)))
    lm, cm = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    wave = lambda times, off: np.cos(np.radians(times * hm + off))
    t = 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.2 * wave(4, -63)
    c7 = cm**7
    rotation = 2 * np.sqrt(c7 / (c7 + seven)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    u = (l2 - l1) / (1 + 0.015 * lm * lm / np.sqrt(20 + lm * lm))
    v = (c2 - c1) / (1 + 0.045 * cm)
    w = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2)) / (1 + 0.015 * cm * t)
    return np.sqrt(np.maximum(u * u + v * v + w * w - rotation * v * w, 0.0))


def family_steps(r: str, g: str, b: str) -> list[dict[str, str]]:
    """A name for a colour, by brightness, saturation and hue; adds ``family``."""
    third = lambda x: f"(CAST({x} AS DOUBLE) / {d(255.0)})"
    return [
        {"fr": third(r), "fg": third(g), "fb": third(b)},
        {"top": "GREATEST(fr, fg, fb)", "low": "LEAST(fr, fg, fb)"},
        {"spread": "top - low", "sat": f"CASE WHEN top > 0 THEN (top - low) / top ELSE {d(0.0)} END"},
        {"turn": f"CASE WHEN spread = 0 THEN {d(0.0)} WHEN top = fr THEN (fg - fb) / spread WHEN top = fg THEN (fb - fr) / spread + 2 ELSE (fr - fg) / spread + 4 END * 60"},
        {"hue": "CASE WHEN turn < 0 THEN turn + 360 ELSE turn END", "pale": f"sat < {d(0.45)} AND top > {d(0.75)}"},
        {
            "family": f"CASE WHEN sat < {d(0.18)} OR spread < {d(0.08)} THEN CASE WHEN top > {d(0.78)} THEN 'white' WHEN top < {d(0.25)} THEN 'black' ELSE 'grey' END"
            f" WHEN top < {d(0.2)} THEN 'black' WHEN hue < 50 AND top < {d(0.6)} THEN 'brown' WHEN hue < 15 OR hue >= 340 THEN 'red'"
            " WHEN hue < 45 THEN CASE WHEN pale THEN 'cream' ELSE 'orange' END WHEN hue < 70 THEN CASE WHEN pale THEN 'cream' ELSE 'yellow' END"
            " WHEN hue < 165 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 260 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'pink' END"
        },
    ]


def add(df, steps: list[dict[str, str]], keep: list[str] | None = None):
    """A DataFrame with the steps' columns; ``keep`` names the new columns to keep (all, if None)."""
    from pyspark.sql import functions as F

    new = [c for step in steps for c in step]
    for step in steps:
        df = df.withColumns({c: F.expr(x) for c, x in step.items()})
    return df if keep is None else df.drop(*(c for c in new if c not in keep))


def nest(source: str, steps: list[dict[str, str]]) -> str:
    """The same as nested SQL subqueries over ``source`` (a table name or a parenthesised query)."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{x} AS {c}' for c, x in step.items())} FROM {source})"
    return source
