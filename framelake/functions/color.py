"""Colour and pixel predicates as Column expressions. A colour is a mapping r, g, b, a -> Column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
MAX_OPAQUE = 16

# Fixed value: the key colour used when the source background is fully transparent black.
FALLBACK_CHROMA = (0, 255, 0, 255)


def channels(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in CHANNELS}


def fields(struct: Column) -> dict[str, Column]:
    return {c: struct.getField(c) for c in CHANNELS}


def literal(colour: Iterable[int]) -> dict[str, Column]:
    return {c: F.lit(v) for c, v in zip(CHANNELS, colour)}


def packed(colour: dict[str, Column]) -> Column:
    """The colour as a struct, usable as a grouping key."""
    return F.struct(*[colour[c].alias(c) for c in CHANNELS])


def text(colour: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[colour[c].cast("string") for c in CHANNELS])


def hex6(colour: dict[str, Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(colour[c].cast("long"))), 2, "0") for c in "rgb"])


def same_color(left: dict[str, Column], right: dict[str, Column], tolerance=0) -> Column:
    """Largest difference over all four channels is within the tolerance; alpha has no exception."""
    return F.greatest(*[F.abs(left[c] - right[c]) for c in CHANNELS]) <= tolerance


def matches_background(pixel: dict[str, Column], key: dict[str, Column], tolerance=0, use_alpha: bool = True) -> Column:
    """Like ``same_color``, but transparent matches transparent whatever its RGB, and alpha is optional."""
    used = CHANNELS if use_alpha else CHANNELS[:3]
    near = F.greatest(*[F.abs(pixel[c] - key[c]) for c in used]) <= tolerance
    if not use_alpha:
        return near
    return ((key["a"] == 0) & (pixel["a"] == 0)) | near


def dominant_channel(key: dict[str, Column]) -> Column:
    """Name of the uniquely largest of r, g, b; null when two share the maximum."""
    r, g, b = key["r"], key["g"], key["b"]
    return (
        F.when((r > g) & (r > b), "r").when((g > r) & (g > b), "g").when((b > r) & (b > g), "b")
    )


def is_chroma_spill(pixel: dict[str, Column], key: dict[str, Column], tolerance, minimum: int) -> Column:
    """Key colour, or a pixel of the key's alpha whose key channel beats both others by ``minimum``."""
    channel = dominant_channel(key)
    lead = (
        F.when(channel == "r", pixel["r"] - F.greatest(pixel["g"], pixel["b"]))
        .when(channel == "g", pixel["g"] - F.greatest(pixel["r"], pixel["b"]))
        .when(channel == "b", pixel["b"] - F.greatest(pixel["r"], pixel["g"]))
    )
    spill = (F.abs(pixel["a"] - key["a"]) <= tolerance) & (lead >= minimum)
    return same_color(pixel, key, tolerance) | F.coalesce(spill, F.lit(False))


def alpha_class(alpha: Column) -> Column:
    return F.when(alpha == 255, "opaque").when(alpha == 0, "transparent").otherwise("partial")


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def alpha_over(top: dict[str, Column], under: dict[str, Column]) -> dict[str, Column]:
    """Source-over on bytes: opaque replaces, transparent keeps, anything else mixes with half-up rounding."""
    cover, hidden = top["a"], under["a"] * (F.lit(255) - top["a"])
    weight = cover * 255 + hidden
    mixed = {c: _half_up((top[c] * cover * 255 + under[c] * hidden) / weight) for c in "rgb"}
    mixed["a"] = _half_up(weight / 255)
    return {
        c: F.when(cover == 255, top[c]).when(cover == 0, under[c]).otherwise(mixed[c]).cast("int")
        for c in CHANNELS
    }


def check_palette(palette: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """A contract palette: one leading transparent entry, then at most sixteen distinct opaque ones."""
    if len(palette) - 1 > MAX_OPAQUE:
        raise ValueError(f"at most {MAX_OPAQUE} opaque entries, not {len(palette) - 1}")
    if len(palette) < 2 or palette[0][3] != 0 or any(c[3] != 255 for c in palette[1:]):
        raise ValueError("entry 0 must have alpha 0 and every later one alpha 255")
    if len(set(palette)) != len(palette):
        raise ValueError("an entry is listed twice")
    return palette


def in_palette(pixel: dict[str, Column], palette: list[tuple[int, int, int, int]]) -> Column:
    """Exact membership in a palette of at most seventeen entries, as one expression without a join."""
    words = [(r << 24) | (g << 16) | (b << 8) | a for r, g, b, a in check_palette(palette)]
    word = (
        F.shiftleft(pixel["r"].cast("long"), 24)
        + F.shiftleft(pixel["g"].cast("long"), 16)
        + F.shiftleft(pixel["b"].cast("long"), 8)
        + pixel["a"].cast("long")
    )
    return word.isin(words)


def entry_word(entry: Column) -> Column:
    """A palette entry [r, g, b, a] as one number."""
    part = lambda i: F.get(entry, F.lit(i)).cast("long")
    return F.shiftleft(part(0), 24) + F.shiftleft(part(1), 16) + F.shiftleft(part(2), 8) + part(3)


def pixel_word(pixel: dict[str, Column]) -> Column:
    return F.shiftleft(pixel["r"].cast("long"), 24) + F.shiftleft(pixel["g"].cast("long"), 16) + F.shiftleft(pixel["b"].cast("long"), 8) + pixel["a"].cast("long")


def in_own_palette(pixel: dict[str, Column], palette: Column) -> Column:
    """Exact membership in the row's own palette, an array of [r, g, b, a]; false where it has none."""
    return F.coalesce(F.array_contains(F.transform(palette, entry_word), pixel_word(pixel)), F.lit(False))


def nearest_own_entry(pixel: dict[str, Column], palette: Column) -> Column:
    """``nearest_entry`` for the row's own palette."""
    part = lambda e, i: F.get(e, F.lit(i)).cast("int")
    square = lambda e, i, c: (pixel[c] - part(e, i)) * (pixel[c] - part(e, i))
    options = F.transform(palette, lambda e, i: F.struct(
        (square(e, 0, "r") + square(e, 1, "g") + square(e, 2, "b")).cast("long").alias("dist"), i.cast("int").alias("ord"),
        *[part(e, k).alias(c) for k, c in enumerate(CHANNELS)],
    ))
    return F.array_min(F.filter(options, lambda o: o.ord > 0))


def nearest_entry(pixel: dict[str, Column], palette: list[tuple[int, int, int, int]]) -> Column:
    """Closest opaque entry by squared RGB distance, ties to the lower position; struct<dist, ord, r, g, b, a>."""
    options = []
    for position, entry in enumerate(check_palette(palette)):
        if position == 0:
            continue
        key = literal(entry)
        distance = sum(((pixel[c] - key[c]) * (pixel[c] - key[c]) for c in "rgb"), F.lit(0))
        options.append(
            F.struct(
                distance.cast("long").alias("dist"),
                F.lit(position).alias("ord"),
                *[key[c].alias(c) for c in CHANNELS],
            )
        )
    return F.array_min(F.array(*options))
