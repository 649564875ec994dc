"""Intensity scaling of two solar instruments to bytes."""

from __future__ import annotations

from math import log10, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.functions.images import _like

#: Band: lower limit, upper limit, reference exposure (None: the exposure itself), transform. Fixed values.
BANDS = {
    94: (1.5 / 1.06, 50 / 1.06, 4.99803, "sqrt"),
    131: (7.0 / 1.49, 1200 / 1.49, 6.99685, "log10"),
    171: (10.0 / 1.49, 6000 / 1.49, 4.99803, "sqrt"),
    193: (120.0 / 2.2, 6000.0 / 2.2, 2.9995, "log10"),
    211: (30.0 / 1.10, 13000 / 1.10, 4.99801, "log10"),
    304: (50.0 / 12.11, 2000 / 12.11, 4.99941, "log10"),
    335: (3.5 / 2.97, 1000 / 2.97, 6.99734, "log10"),
    1600: (-8.0, 200.0, 2.99911, "linear"),
    1700: (0.0, 2500.0, 1.00026, "linear"),
    4500: (0.0, 26000.0, 1.00026, "linear"),
    6173: (0.0, 65535.0, None, "linear"),
}
_FORM = {"sqrt": (F.sqrt, sqrt), "log10": (F.log10, log10), "linear": (lambda x: x, lambda x: x)}


def _band(img: Column, time: Column, low: float, high: float, ref: float | None, form: str) -> Column:
    shape, limit = _FORM[form]
    a, b = F.lit(limit(low)), F.lit(limit(high))

    def one(v: Column) -> Column:
        x = F.nanvl(v, F.lit(0.0))
        x = x * (F.lit(ref) / time) if ref else x / time
        y = (shape(F.greatest(F.lit(low), F.least(F.lit(high), x))) - a) / (b - a) * 255.0
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), y))).cast("double")

    return F.transform(img["data"], one)


def aia_intscale(img: Column, exptime: Column | float, wavelnth: Column | float) -> Column:
    """The image normalised to its band's exposure, clipped, transformed and scaled to bytes; NaN counts as 0.

    The band is the wavelength rounded half to even. An unknown band, a null wavelength or a null exposure is an error.
    """
    band, time = F.rint(F.lit(wavelnth).cast("double")), F.lit(exptime).cast("double")
    out = None
    for w, (low, high, ref, form) in BANDS.items():
        data = _band(img, time, low, high, ref, form)
        out = F.when(band == w, data) if out is None else out.when(band == w, data)
    fail = F.raise_error(F.concat(F.lit("no such band or no exposure: "), F.coalesce(F.lit(wavelnth).cast("string"), F.lit("null")))).cast("array<double>")
    return _like(img, F.when(time.isNull(), fail).otherwise(out.otherwise(fail)), dtype="uint8")


def hmi_intscale(img: Column) -> Column:
    """Values from -100 to 100 to bytes, clipped and cut; NaN becomes 0."""
    one = lambda v: F.when(F.isnan(v), 0.0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v + 100.0) * (255.0 / 200.0)))).cast("double"))
    return _like(img, F.transform(img["data"], one), dtype="uint8")
