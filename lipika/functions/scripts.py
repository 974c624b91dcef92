"""Scripts, slots and structural spans: the fixed values of segmentation, and column functions on them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Slot and script names.
NEUTRAL, LATIN, DEVANAGARI, KANNADA, CODE_MATH, CATCHALL = "NEUTRAL", "LATIN", "DEVANAGARI", "KANNADA", "CODE_MATH", "CATCHALL"
COMMON, UNKNOWN, INHERITED = "COMMON", "UNKNOWN", "INHERITED"

# The code-point ranges of each script.
SCRIPT_RANGES: dict[str, tuple[tuple[int, int], ...]] = {
    "LATIN": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "GREEK": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "CYRILLIC": ((0x400, 0x4FF), (0x500, 0x52F), (0x2DE0, 0x2DFF)),
    "ARMENIAN": ((0x530, 0x58F),),
    "HEBREW": ((0x590, 0x5FF),),
    "ARABIC": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "DEVANAGARI": ((0x900, 0x97F), (0xA8E0, 0xA8FF), (0x1CD0, 0x1CFF)),
    "BENGALI": ((0x980, 0x9FF),),
    "GURMUKHI": ((0xA00, 0xA7F),),
    "GUJARATI": ((0xA80, 0xAFF),),
    "ORIYA": ((0xB00, 0xB7F),),
    "TAMIL": ((0xB80, 0xBFF),),
    "TELUGU": ((0xC00, 0xC7F),),
    "KANNADA": ((0xC80, 0xCFF),),
    "MALAYALAM": ((0xD00, 0xD7F),),
    "SINHALA": ((0xD80, 0xDFF),),
    "THAI": ((0xE00, 0xE7F),),
    "LAO": ((0xE80, 0xEFF),),
    "TIBETAN": ((0xF00, 0xFFF),),
    "MYANMAR": ((0x1000, 0x109F),),
    "GEORGIAN": ((0x10A0, 0x10FF),),
    "ETHIOPIC": ((0x1200, 0x137F),),
    "CHEROKEE": ((0x13A0, 0x13FF),),
    "KHMER": ((0x1780, 0x17FF),),
    "HANGUL": ((0x1100, 0x11FF), (0xAC00, 0xD7AF), (0x3130, 0x318F)),
    "HIRAGANA": ((0x3040, 0x309F),),
    "KATAKANA": ((0x30A0, 0x30FF),),
    "CJK": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
# The patterns of structural spans, in order of priority; every delimiter must close.
STRUCTURAL = ("```[\\s\\S]*?```", "\\$\\$[\\s\\S]*?\\$\\$", "\\\\\\[[\\s\\S]*?\\\\\\]", "\\\\\\([\\s\\S]*?\\\\\\)", "\\$[^$\\n]{1,200}?\\$", "`[^`\\n]{1,200}?`")
# White space that is not of category Z; joiners and variation selectors.
SPACE_CONTROLS = "\t\n\x0b\x0c\r"
JOINERS = ((0x200C, 0x200D), (0xFE00, 0xFE0F))

DEFAULT_SLOT_MAP = {COMMON: NEUTRAL, LATIN: LATIN, DEVANAGARI: DEVANAGARI, KANNADA: KANNADA}

STRUCT = "|".join(STRUCTURAL)


def nfc(text: Column) -> Column:
    """Canonical composition, on the flat buffer of a batch; null stays null."""
    from .arrow_runs import composed

    @F.arrow_udf("string")
    def compose(v: pa.Array) -> pa.Array:
        return composed(v)

    return compose(text)


def structural_spans(text: Column) -> Column:
    """The spans of code and formulas, leftmost first."""
    return F.regexp_extract_all(text, F.lit(STRUCT), F.lit(0))
