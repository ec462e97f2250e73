"""A machine's page settings: presets, option strings, settings blocks; and whose word counts for each value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dots import DEFAULTS

#: Fixed: presets, page sizes in lines, and the fields of a settings block (offset, units of an inch in the block, of ours).
PRESETS = {"default": {}, "sawyer": {"mt": 1195 / 1440 * 6, "mb": 6.0, "po": 7.0}, "modern": {"mt": 6.0, "mb": 6.0, "po": 10.0}}
SIZES = {"letter": 66.0, "legal": 84.0, "a4": 11.693 * 6}
FIELDS = {"mt": (0x14, 1440, 6), "mb": (0x16, 1440, 6), "pl": (0x18, 1440, 6), "hm": (0x1F, 1440, 6), "fm": (0x21, 1440, 6), "po": (0x24, 1800, 10), "lh": (0x40, 1440, 48)}
RULER_SIZE, RULER_COUNT, RULER_STOPS, MOST_STOPS = 74, 8, 10, 25
#: Options a conversion takes, with what each may be.
OPTIONS = {"mode": ("modern", "printed"), "note_refs": ("word", "prefixed"), "fonts": ("office", "mac", "web"), "variant": (None, "ws3", "ws4", "ws5+", "printstream", "text")}


def page_settings(said: str) -> dict[str, float]:
    """A preset's name, or ``mt=1in,po=8,size=a4``: plain numbers are lines or columns."""
    said = said.strip().lower()
    if said in PRESETS:
        return dict(PRESETS[said])
    out: dict[str, float] = {}
    for part in said.split(","):
        key, mark, value = (x.strip() for x in part.partition("="))
        if key == "size" and value in SIZES:
            out["pl"] = SIZES[value]
        elif key in ("mt", "mb", "hm", "fm", "po") and value:
            per = 10.0 if key == "po" else 6.0
            try:
                out[key] = float(value[:-2]) * per if value.endswith("in") else float(value)
            except ValueError:
                raise ValueError(f"page settings: {part!r} has no number") from None
        else:
            raise ValueError(f"page settings: {part!r} is neither a setting nor one of {', '.join(PRESETS)}")
    return out


def block_settings(block: bytes | None) -> dict[str, float]:
    """The fields that a settings block is long enough to hold."""
    return {k: int.from_bytes(block[at : at + 2], "little") / theirs * ours for k, (at, theirs, ours) in FIELDS.items() if block and len(block) >= at + 2}


def ruler_stops(block: bytes | None) -> list[float]:
    """Tab stops in columns of the first ruler record; zero is an unused entry."""
    if not block or len(block) < RULER_SIZE:
        return []
    found = (int.from_bytes(block[RULER_STOPS + 2 * k : RULER_STOPS + 2 * k + 2], "little") for k in range(min(block[RULER_COUNT], MOST_STOPS)))
    return [n / 180 for n in found if n]


def effective(name: str, machine: dict[str, float]) -> tuple[Column, Column]:
    """A page value and its source: the document's word, then the machine's, then the default."""
    own = F.col(name)
    if name in machine:
        return F.coalesce(own, F.lit(machine[name])), F.when(own.isNotNull(), "file").otherwise("machine-default")
    return F.coalesce(own, F.lit(DEFAULTS[name])), F.when(own.isNotNull(), "file").otherwise("default")


def checked_options(options: dict, drop: tuple[str, ...] = ()) -> dict:
    """The options, if each is one of what it may be, without those to be dropped; formats follow the mode where none is named."""
    for key, value in options.items():
        if key in OPTIONS and value not in OPTIONS[key]:
            raise ValueError(f"{key}: {value!r} is not one of {', '.join(OPTIONS[key])}")
    mode = options.get("mode", "modern")
    made = {"mode": mode, "to": "pdf" if mode == "printed" else "rtf"} | options
    return {k: v for k, v in made.items() if k not in (*drop, *(["to"] if "to" not in options and drop else []))}
