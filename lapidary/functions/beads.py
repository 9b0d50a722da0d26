"""Rules on measured beads and colours, as SQL text over named columns, so that every engine reads the same rule."""

from __future__ import annotations

from lapidary.functions.color import d

# Thresholds of the material rules.
CHROMA_HIGH, GOLD_HUE, WHITE_L, PEARL_CHROMA, PEARL_EDGE, GOLD_DARK_CHROMA = 45.0, (55.0, 100.0), 65.0, 15.0, 0.05, 30.0
GOLD_NAMES = "gold|amber|bronze|copper|yellow"


def chroma(a: str = "lab_a", b: str = "lab_b") -> str:
    return f"SQRT({a} * {a} + {b} * {b})"


def hue(a: str = "lab_a", b: str = "lab_b") -> str:
    """Degrees in (-180, 180]."""
    return f"(ATAN2({b}, {a}) * {d(180.0)} / {d(3.141592653589793)})"


def turn(a: str = "lab_a", b: str = "lab_b") -> str:
    """Degrees in [0, 360)."""
    return f"(CASE WHEN {hue(a, b)} < 0 THEN {hue(a, b)} + 360 ELSE {hue(a, b)} END)"


def material() -> str:
    """Of a bead, by chroma, hue, lightness and how much edge it shows: gold, color, pearl or white."""
    golden = f"{hue()} >= {d(GOLD_HUE[0])} AND {hue()} <= {d(GOLD_HUE[1])}"
    return (
        f"CASE WHEN {chroma()} >= {d(CHROMA_HIGH)} THEN CASE WHEN {golden} AND lab_l >= 40 THEN 'gold' ELSE 'color' END"
        f" WHEN lab_l >= {d(WHITE_L)} THEN CASE WHEN {chroma()} >= {d(PEARL_CHROMA)} AND edge < {d(PEARL_EDGE)} THEN 'pearl' ELSE 'white' END"
        f" WHEN {golden} AND {chroma()} >= {d(GOLD_DARK_CHROMA)} THEN 'gold' ELSE 'color' END"
    )


def confidence() -> str:
    """How far a bead lies inside its material's bounds, 0 to 1; reads the column ``material``."""
    clamp = lambda x: f"GREATEST({d(0.0)}, LEAST({d(1.0)}, {x}))"
    high = f"({chroma()} - {d(CHROMA_HIGH)}) / 15"
    gold = clamp(f"LEAST({high}, ({hue()} - {d(GOLD_HUE[0])}) / 12, ({d(GOLD_HUE[1])} - {hue()}) / 12) + {d(0.2)}")
    vivid, dim = clamp(f"LEAST({high}, ({d(GOLD_HUE[0])} - {hue()}) / 12) + {d(0.2)}"), clamp(f"({d(WHITE_L)} - lab_l) / 12")
    pale = clamp(f"LEAST((lab_l - {d(WHITE_L)}) / 10, ABS({chroma()} - {d(PEARL_CHROMA)}) / 6, ABS(edge - {d(PEARL_EDGE)}) / {d(0.03)}) + {d(0.1)}")
    return f"CASE material WHEN 'gold' THEN {gold} WHEN 'color' THEN CASE WHEN {chroma()} >= {d(CHROMA_HIGH)} THEN {vivid} ELSE {dim} END ELSE {pale} END"


def image_material() -> str:
    """Of a sampled disc, by Lab and saturation: white, gold or color."""
    return (
        f"CASE WHEN (lab_l >= 55 AND sat < 130 AND {chroma()} < 42) OR ({chroma()} < 16 AND lab_l >= 60) THEN 'white'"
        f" WHEN {turn()} >= 43 AND {turn()} <= 92 AND {chroma()} >= 28 AND lab_l >= 20 THEN 'gold' ELSE 'color' END"
    )


def is_pearl() -> str:
    return f"(d_mm >= {d(4.5)} AND lab_l >= 62 AND sat <= 100)"


def tier(size: str) -> str:
    return f"CASE WHEN {size} >= 8 THEN 1 WHEN {size} >= 5 THEN 2 ELSE 3 END"


def is_gold(l: str = "lab_l", a: str = "lab_a", b: str = "lab_b") -> str:  # noqa: E741
    return f"({chroma(a, b)} >= 20 AND {l} >= 35 AND {turn(a, b)} >= 45 AND {turn(a, b)} <= 105)"


def bead_like() -> str:
    """Whether an outline is that of one bead."""
    solid = f"CASE WHEN shape = 'heart' THEN solidity >= {d(0.8)} WHEN shape IN ('round', 'oval') THEN solidity >= {d(0.88)} AND ell_iou >= {d(0.8)} ELSE solidity >= {d(0.86)} END"
    return f"(d_mm >= {d(1.2)} AND d_mm <= 20 AND filled >= {d(0.85)} AND {solid})"


def code_material(l: str, a: str, b: str) -> str:  # noqa: E741
    """Of a catalogue entry, by kind, name and colour: pearl, gold, white or color."""
    names = " OR ".join(f"LOWER(series) LIKE '%{n}%'" for n in GOLD_NAMES.split("|"))
    return f"CASE WHEN kind = 'pearl' THEN 'pearl' WHEN {names} THEN 'gold' WHEN {l} >= 75 AND {chroma(a, b)} <= 12 THEN 'white' ELSE 'color' END"


def hue_fits(image: str, code: str) -> str:
    """Whether a code's colour may stand for an image's: a neutral code always, a coloured one within 50 degrees."""
    off = f"({hue(f'{image}_a', f'{image}_b')} - {hue(f'{code}_a', f'{code}_b')} + 540)"
    wrapped = f"ABS({off} - 360 * FLOOR({off} / 360) - 180)"
    return f"({chroma(f'{code}_a', f'{code}_b')} < 15 OR ({chroma(f'{image}_a', f'{image}_b')} >= 6 AND {wrapped} <= 50))"


def label_fold(material: str, color: str) -> str:
    """A labelled bead's material and colour folded to gold, pearl, white or color."""
    return f"CASE WHEN {color} = 'gold' THEN 'gold' WHEN {material} = 'pearl' THEN 'pearl' WHEN {color} IN ('white', 'clear', 'silver', 'grey') THEN 'white' ELSE 'color' END"
