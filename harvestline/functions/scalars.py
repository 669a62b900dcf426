"""Column functions: every one maps columns to a column and stays inside codegen."""

from __future__ import annotations

from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, functions as F

LEAD_PATTERN = r"_LT(\d+)$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- names, keys, labels -------------------------------------------------------------

def parse_scene_date(name: Column | str) -> Column:
    """Date inside a file or scene name. Understood: ``.AyyyyDDD``, ``yyyy-MM-dd``
    anywhere, ``yyyyMMdd``, and a bare ``yyyyDDD``."""
    name = _c(name)
    swath = F.regexp_extract(name, r"\.A(\d{7})", 1)
    dashed = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_extract(name, r"(?:^|\D)(\d{8})(?:\D|$)", 1)
    ordinal = F.regexp_extract(name, r"(?:^|\D)(\d{7})(?:\D|$)", 1)
    return F.coalesce(
        F.try_to_date(F.nullif(swath, F.lit("")), "yyyyDDD"),
        F.try_to_date(F.nullif(dashed, F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(compact, F.lit("")), "yyyyMMdd"),
        F.try_to_date(F.nullif(ordinal, F.lit("")), "yyyyDDD"))


ADMIN_LENGTH = {"country": 2, "nuts1": 3, "nuts2": 4, "nuts3": 5}


def admin_key(region: Column | str, level: str = "country") -> Column:
    """Administrative code of a coarser level: a prefix of the region code."""
    return F.substring(_c(region), 1, ADMIN_LENGTH[level])


def field_year_key(field: Column | str, year: Column | str) -> Column:
    return F.concat_ws("_", _c(field), _c(year).cast("string"))


def recode(col: Column | str, mapping: Mapping[Any, Any], default: Column | None = None) -> Column:
    """Dictionary recode for a literal map; unlisted values keep themselves (or get
    ``default``). Larger dictionaries belong in a dimension table and a join."""
    col = _c(col)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col if default is None else default)


def normalize_label(col: Column | str) -> Column:
    """Separators become blanks, first letter upper case, the rest lower case."""
    text = F.translate(_c(col), "-_", "  ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))


def lead_of(feature: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(feature), LEAD_PATTERN, 1), F.lit("")).cast("int")


def base_of(feature: Column | str) -> Column:
    return F.regexp_replace(_c(feature), LEAD_PATTERN, "")


def parse_decimal_comma(col: Column | str) -> Column:
    """``'1.234,5'`` and ``'12,5'`` to double; text that is no number becomes NULL."""
    text = F.regexp_replace(F.regexp_replace(_c(col), r"\.(?=\d{3}(\D|$))", ""), ",", ".")
    return text.try_cast("double")


# --- units, sentinels, ranges --------------------------------------------------------

def scale_units(col: Column | str, factor: float = 1.0, offset: float = 0.0) -> Column:
    return _c(col) * F.lit(float(factor)) + F.lit(float(offset))


def scale_checked(col: Column | str, scale: Column | str, offset: Column | str,
                  allowed_scales: Sequence[float]) -> Column:
    """``v*scale+offset`` where scale and offset come with the raster; a scale outside
    the allowed list stops the job instead of yielding wrong units."""
    scale = _c(scale)
    bad = ~scale.isin([float(s) for s in allowed_scales])
    return F.when(bad, F.raise_error(F.concat(F.lit("unexpected raster scale "), scale.cast("string"))).cast("double")) \
        .otherwise(_c(col) * scale + _c(offset))


def null_sentinels(col: Column | str, equal: Sequence[Any] = (-9999,), at_most: float | None = None) -> Column:
    """Sentinels, NaN and (optionally) everything up to ``at_most`` become NULL."""
    col = _c(col)
    keep = ~col.isin(list(equal))
    if at_most is not None:
        keep = keep & (col > F.lit(at_most)) & ~F.isnan(col)
    return F.when(keep, col)


def nan_to_null(col: Column | str) -> Column:
    return F.when(~F.isnan(_c(col)), _c(col))


def fill_sentinel(col: Column | str, sentinel: float = -9999.0) -> Column:
    return F.coalesce(_c(col), F.lit(sentinel))


# Plausible ranges per quantity (low, high, ends included).
VALID_RANGES = {
    "lst": (260.0, 310.0, False),
    "evi": (-1.0, 1.0, True),
    "sig0": (None, 0.0, False),
    "sig40": (None, -3.5, False),
}


def valid_range(col: Column | str, low: float | None, high: float | None, inclusive: bool = False) -> Column:
    col = _c(col)
    tests = []
    if low is not None:
        tests.append(col >= low if inclusive else col > low)
    if high is not None:
        tests.append(col <= high if inclusive else col < high)
    return F.when(reduce(lambda a, b: a & b, tests), col)


def is_daytime(ts: Column | str, after: int = 11, before: int = 18) -> Column:
    return F.hour(_c(ts)).between(after + 1, before - 1)


def offset_since(col: Column | str, date: Column | str, since: str = "2022-01-25", offset: float = 1000.0) -> Column:
    """Undo an additive offset that a product carries from a given day on."""
    return F.when(_c(date) >= F.lit(since).cast("date"), _c(col) - F.lit(offset)).otherwise(_c(col))


CLEAR_CLASSES = (4, 5, 6)  # fixed values: vegetation, bare soil, water


def scene_class_mask(col: Column | str, scene_class: Column | str, keep: Sequence[int] = CLEAR_CLASSES) -> Column:
    return F.when(_c(scene_class).isin(list(keep)), _c(col))


def is_cropland(land_class: Column | str, low: int = 10, high: int = 40) -> Column:
    return _c(land_class).between(low, high)


def flag_bit(flag: Column | str, n: int) -> Column:
    return F.shiftright(_c(flag), n).bitwiseAND(F.lit(1))


# --- radar and optical ---------------------------------------------------------------

def db_to_linear(x: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10.0)


def linear_to_db(x: Column | str) -> Column:
    return F.log10(_c(x)) * 10.0


def reflectance(band: Column | str) -> Column:
    return F.when(_c(band) > -9999, _c(band) / 10000.0)


def spectral_indices(b02, b04, b08, b11, b12) -> dict[str, Column]:
    """NDVI, EVI, NDWI and NMDI of five scaled bands; a zero denominator gives NULL."""
    blue, red, nir, swir1, swir2 = (reflectance(b) for b in (b02, b04, b08, b11, b12))

    def normalized(a: Column, b: Column) -> Column:
        return F.try_divide(a - b, a + b)

    return {
        "ndvi": normalized(nir, red),
        "evi": F.try_divide((nir - red) * 2.5, nir + red * 6.0 - blue * 7.5 + 1.0),
        "ndwi": normalized(nir, swir2),
        "nmdi": normalized(nir, swir1 - swir2),
    }


# --- geometry helpers ----------------------------------------------------------------

def ring_from_wkt(wkt: Column | str) -> tuple[Column, Column]:
    """(xs, ys) of all rings of a WKT polygon or multipolygon, one behind the other with a NULL
    between them. Edges that touch a NULL do not exist, so an even-odd test over all edges counts
    islands in and holes out; a simple polygon is just its ring."""
    rings = F.regexp_extract_all(_c(wkt), F.lit(r"\(([^()]*)\)"), F.lit(1))
    points = F.transform(rings, lambda r: F.split(F.trim(r), r"\s*,\s*"))

    def part(i: int) -> Column:
        def ring(r: Column, k: Column) -> Column:
            values = F.transform(r, lambda p: F.split(F.trim(p), r"\s+")[i].cast("double"))
            return F.when(k == 0, values).otherwise(F.concat(F.array(F.lit(None).cast("double")), values))

        return F.flatten(F.transform(points, ring))

    return part(0), part(1)


def polygon_to_pixels(xs: Column | str, ys: Column | str, size: float = 10.0) -> tuple[Column, Column]:
    """Ring coordinates as column and row offsets from the upper-left corner."""
    xs, ys = _c(xs), _c(ys)
    cols = F.transform(xs, lambda x: (x - F.array_min(xs)) / size)
    rows = F.transform(ys, lambda y: F.abs(y - F.array_max(ys)) / size)
    return cols, rows


def inside_ring(px: Column | str, py: Column | str, xs: Column | str, ys: Column | str) -> Column:
    """Even-odd ray cast against a closed ring."""
    px, py, xs, ys = _c(px), _c(py), _c(xs), _c(ys)

    def crossing(acc: Column, i: Column) -> Column:
        x0, y0 = F.get(xs, i), F.get(ys, i)
        x1, y1 = F.get(xs, i + 1), F.get(ys, i + 1)
        hit = ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * F.try_divide(py - y0, y1 - y0) + x0)
        return acc + F.when(hit, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), F.lit(0), crossing) % 2 == 1


def ring_edges(xs: Column | str, ys: Column | str) -> Column:
    """Edges of a closed ring as (y0, y1, x0, inverse slope), horizontal ones left out: what
    the ray cast needs, computed once per region instead of once per pixel."""
    xs, ys = _c(xs), _c(ys)

    def edge(i: Column) -> Column:
        x0, y0, x1, y1 = F.get(xs, i), F.get(ys, i), F.get(xs, i + 1), F.get(ys, i + 1)
        return F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), F.try_divide(x1 - x0, y1 - y0).alias("k"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(xs) - 2), edge), lambda e: e["y0"] != e["y1"])


def inside_edges(px: Column | str, py: Column | str, edges: Column | str) -> Column:
    """Even-odd ray cast against prepared edges."""
    px, py = _c(px), _c(py)
    hit = lambda e: ((e["y0"] > py) != (e["y1"] > py)) & (px < e["k"] * (py - e["y0"]) + e["x0"])
    return F.size(F.filter(_c(edges), hit)) % 2 == 1


def pixel_center(a: float, c: float, e: float, f: float, row: Column | str, col: Column | str) -> tuple[Column, Column]:
    """Affine transform of a pixel's centre."""
    return (_c(col) + 0.5) * a + c, (_c(row) + 0.5) * e + f
