"""Image kernels as column expressions over a struct of height, width, channels, dtype and row-major values (channel last).

All work is in DOUBLE and an image stays one row. Kernels over single values are higher-order functions in the JVM, which
Spark interprets value by value; resizing and turning look up neighbours, and run in numpy: see sampling.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of integer kinds of pixel. Fixed values.
LIMITS = {
    "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767),
    "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647), "int64": (-9223372036854775808, 9223372036854775807),
}


def image(data: Column | str, height: int | Column, width: int | Column, channels: int = 1, dtype: str = "float64") -> Column:
    """An image of values in row-major order. The number of values must fit the shape."""
    data = F.col(data) if isinstance(data, str) else data
    shape = [F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in (height, width, channels)]
    right = F.size(data) == shape[0] * shape[1] * shape[2]
    values = F.when(right, data.cast("array<double>")).otherwise(F.raise_error(F.lit("values do not fit the image's shape")).cast("array<double>"))
    return F.struct(shape[0].alias("height"), shape[1].alias("width"), shape[2].alias("channels"), F.lit(dtype).alias("dtype"), values.alias("data"))


def _like(img: Column, data: Column, height: Column | None = None, width: Column | None = None, dtype: str | None = None) -> Column:
    return F.struct((img["height"] if height is None else height).alias("height"), (img["width"] if width is None else width).alias("width"), img["channels"].alias("channels"), (img["dtype"] if dtype is None else F.lit(dtype)).alias("dtype"), data.alias("data"))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a projection may be inlined, also into a lambda, where it would run for every pixel."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x within limits; a NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(low, F.least(high, x)))


def value_range(img: Column) -> tuple[Column, Column]:
    """Least and greatest value without NaN; null if there is none."""
    known = F.filter(img["data"], lambda v: ~F.isnan(v))
    return F.array_min(known), F.array_max(known)


def bytescale_image(img: Column, imin: Column | float | None = None, imax: Column | float | None = None, omin: int = 0, omax: int = 255) -> Column:
    """The image scaled from [imin, imax] (default: its own range) to [omin, omax], as uint8; NaN becomes 0.

    imin >= imax is an error, so a constant image needs limits. An image of NaN only becomes 0.
    """
    if not 0 <= omin <= omax <= 255:
        raise ValueError("output limits must lie within 0 and 255")

    def scaled(b: Column) -> Column:
        low, high = b["low"], b["high"]

        def one(x: Column) -> Column:
            y = (x - low) / (high - low) * float(omax - omin) + float(omin)
            return F.when(F.isnan(x) | low.isNull() | high.isNull(), 0.0).otherwise(F.floor(F.greatest(F.lit(float(omin)), F.least(F.lit(float(omax)), y))).cast("double"))

        return F.transform(b["data"], one)

    def checked(im: Column) -> Column:
        own_low, own_high = value_range(im)
        low = own_low if imin is None else F.lit(imin).cast("double")
        high = own_high if imax is None else F.lit(imax).cast("double")
        fail = F.raise_error(F.lit("imin must be less than imax")).cast("double")
        return bound(F.struct(F.when(low >= high, fail).otherwise(low).alias("low"), high.alias("high"), im["data"].alias("data")), scaled)

    return bound(img, lambda im: _like(im, checked(im), dtype="uint8"))


def _size(size: int | tuple[int, int]) -> tuple[int, int]:
    return (size, size) if isinstance(size, int) else size


def _distance(size: int | tuple[int, int], center: tuple[float, float] | None, test) -> Column:
    h, w = _size(size)
    cy, cx = center or (h / 2.0, w / 2.0)

    def one(i: Column) -> Column:
        y, x = F.floor(i / w) - float(cy), i % w - float(cx)
        return test(F.sqrt(y * y + x * x))

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), one)


def circle_mask(image_size: int | tuple[int, int], radius: float, center: tuple[float, float] | None = None, mask_type: str = "inner") -> Column:
    """Booleans in row-major order: whether a pixel lies within the radius of the centre (cy, cx), or, "outer", does not."""
    if mask_type not in ("inner", "outer"):
        raise ValueError(f"mask_type must be 'inner' or 'outer', not {mask_type!r}")
    return _distance(image_size, center, (lambda d: d < float(radius)) if mask_type == "inner" else (lambda d: d >= float(radius)))


def annulus_mask(image_size: int | tuple[int, int], inner_radius: float, outer_radius: float, center: tuple[float, float] | None = None) -> Column:
    """Booleans: inner_radius <= distance < outer_radius."""
    return _distance(image_size, center, lambda d: (d >= float(inner_radius)) & (d < float(outer_radius)))


def apply_mask(img: Column, mask: Column, fill: float = 0.0) -> Column:
    """The image where the mask holds, else the fill; every channel alike."""
    def shown(b: Column) -> Column:
        im, m = b["im"], b["m"]
        return _like(im, F.transform(im["data"], lambda v, i: F.when(F.get(m, F.floor(i / im["channels"]).cast("int")), v).otherwise(float(fill))))

    return bound(F.struct(img.alias("im"), mask.alias("m")), shown)


def _moved(img: Column, size: tuple[int, int], places, fill: float) -> Column:
    """An image of this size whose pixel (y, x) is the source's (y - top, x - left), or the fill outside it; (top, left) = places(img)."""
    return bound(img, lambda im: bound(F.struct(im.alias("im"), *[x.cast("int").alias(n) for n, x in zip(("top", "left"), places(im))]), lambda b: _gathered(b["im"], size, b["top"], b["left"], fill)))


def _gathered(img: Column, size: tuple[int, int], top: Column, left: Column, fill: float) -> Column:
    h, w = size
    c = img["channels"]

    def one(i: Column) -> Column:
        y, x = F.floor(i / (c * w)) - top, F.floor(i / c) % w - left
        inside = (y >= 0) & (y < img["height"]) & (x >= 0) & (x < img["width"])
        return F.when(inside, F.get(img["data"], ((y * img["width"] + x) * c + i % c).cast("int"))).otherwise(float(fill))

    return _like(img, F.transform(F.sequence(F.lit(0), c * (h * w) - 1), one), F.lit(h), F.lit(w))


def pad_image(img: Column, target_size: int | tuple[int, int], pad_value: float = 0, center: bool = True) -> Column:
    """The image inside a larger one; an odd pixel goes to the bottom and right. A smaller target is an error."""
    h, w = _size(target_size)

    def places(im: Column) -> tuple[Column, Column]:
        top = F.floor((F.lit(h) - im["height"]) / 2) if center else F.lit(0).cast("bigint")
        fail = F.raise_error(F.lit("target size is smaller than the image")).cast("bigint")
        return F.when((im["height"] > h) | (im["width"] > w), fail).otherwise(top), F.floor((F.lit(w) - im["width"]) / 2) if center else F.lit(0)

    return _moved(img, (h, w), places, pad_value)


def crop_or_pad(img: Column, target_size: int | tuple[int, int], pad_value: float = 0, center: bool = True) -> Column:
    """Each axis cut or padded to the target, about the centre or from the top left."""
    h, w = _size(target_size)

    def shift(have: Column, want: int) -> Column:
        if not center:
            return F.lit(0)
        return F.when(have > want, -F.floor((have - want) / 2)).otherwise(F.floor((F.lit(want) - have) / 2))

    return _moved(img, (h, w), lambda im: (shift(im["height"], h), shift(im["width"], w)), pad_value)


def resize_image(img: Column, size: tuple[int, int], order: int = 1, preserve_range: bool = True) -> Column:
    """The image at another size, corners on corners; order 0 nearest, 1 bilinear, 2 and 3 splines."""
    from helioframe.functions.sampling import resized

    if order not in (0, 1, 2, 3):
        raise ValueError("order must be 0, 1, 2 or 3")
    return resized(img, *size, order, preserve_range)


def rotation(angle: float, height: int, width: int, reshape: bool) -> tuple[tuple[float, float], tuple[float, float], int, int]:
    """(cosine, sine), offsets and size of the output for a turn by an angle in degrees about the image's centre."""
    from math import cos, radians, sin

    turn = angle % 360
    c, s = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}.get(turn, (cos(radians(turn)), sin(radians(turn))))
    h, w = height, width
    if reshape:
        ys, xs = [0, s * w, c * h, c * h + s * w], [0, c * w, -s * h, c * w - s * h]
        h, w = int(max(ys) - min(ys) + 0.5), int(max(xs) - min(xs) + 0.5)
    oy, ox = (height - 1) / 2 - (c * (h - 1) / 2 + s * (w - 1) / 2), (width - 1) / 2 - (-s * (h - 1) / 2 + c * (w - 1) / 2)
    return (c, s), (oy, ox), h, w


def rotate_image(img: Column, angle: float, shape: tuple[int, int], order: int = 1, reshape: bool = False, cval: float = 0, preserve_range: bool = True) -> Column:
    """Images of one shape turned by an angle in degrees; with reshape the canvas holds the whole image. Outside is cval."""
    from helioframe.functions.sampling import turned

    if order not in (0, 1, 2, 3):
        raise ValueError("order must be 0, 1, 2 or 3")
    return turned(img, angle, shape, order, reshape, cval, preserve_range)


resize, rotate, bytescale, pad = resize_image, rotate_image, bytescale_image, pad_image
