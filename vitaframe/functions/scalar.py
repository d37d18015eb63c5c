"""Column expressions shared by the operators."""

from __future__ import annotations

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column
from pyspark.sql import functions as F

# Gauss-Legendre nodes and weights on [0, 1] for the integrals behind a p-value.
NODES = [((x + 1.0) / 2.0, w / 2.0) for x, w in zip(*map(list, leggauss(48)), strict=True)]
# The integrals end where the integrand has fallen to exp(-TAIL) of its start.
TAIL = 40.0


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round_even(value, digits: int = 0) -> Column:
    """Round half to even."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def _split(x):
    """A double as the sum of two with half the digits each (Veltkamp)."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def fixed(value, digits: int) -> Column:
    """Text with a fixed number of decimals; null stays null.

    Rounds the exact binary value, halves to even, for every magnitude: 0.835 is
    stored slightly below and gives ``0.83``. The fraction is taken off (exactly) and
    scaled; what rounding that product left over (Dekker) decides where it is a half.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    scale_high, scale_low = _split(scale)

    def text(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size).cast("double") if digits else F.rint(size)
        fraction = size - whole if digits else F.lit(0.0)
        product = fraction * scale
        high, low = _split(fraction)
        rest = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
        nearest = F.rint(product)
        half = (F.abs(product - nearest) == 0.5) & (rest != 0.0)
        above = F.floor(product) + F.when(rest > 0.0, 1.0).otherwise(0.0)
        units = F.when(half, above).otherwise(nearest)
        carried = units >= scale
        shown = F.concat(
            F.when(v < 0.0, "-").otherwise(""),
            F.format_string("%d", (whole + F.when(carried, 1.0).otherwise(0.0) if digits else whole).cast("long")),
            *([F.lit("."), F.format_string(f"%0{digits}d", F.when(carried, 0.0).otherwise(units).cast("long"))] if digits else []),
        )
        # Beyond 2**52 a double has no decimals.
        return F.when(size < 2.0**52, shown).when(v.isNotNull(), F.format_string(f"%.{digits}f", v))

    return _with(value.cast("double"), text)


def grouped(value) -> Column:
    """Whole-number text with thousands separators; null stays null."""
    whole = round_even(value, 0).cast("long")
    return F.when(whole.isNotNull(), F.format_string("%,d", whole))


def sentence(template: str, *parts: Column | str) -> Column:
    """Fill the ``{}`` of a text with columns."""
    pieces = template.split("{}")
    out: list[Column] = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        out += [part if isinstance(part, Column) else F.col(part), F.lit(piece)]
    return F.concat(*out)


def percent(part, whole) -> Column:
    """Share of ``whole`` in percent, 0 for an empty whole."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)) * 100.0


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` kept between two bounds; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def pearson(a: Column, b: Column) -> Column:
    """Null-safe Pearson aggregate; null when either side is constant.

    ``a`` and ``b`` must be null on the same rows.
    """
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return clamp(r, -1.0, 1.0)


def _power_integral(k: Column, slope: Column, top: Column) -> Column:
    """Integral of (cos u - slope sin u)**k over u from 0 to ``top``.

    The integrand falls at least like exp(-k (slope u + u u / 2)), which gives the
    place where it ends for practical purposes.
    """
    steep = k * slope
    reach = F.try_divide(F.lit(2.0 * TAIL), steep + F.sqrt(steep * steep + k * (2.0 * TAIL)))

    def total(size: Column) -> Column:
        def value(u: Column) -> Column:
            drop = F.sin(u / 2.0) * F.sin(u / 2.0) * 2.0 + slope * F.sin(u)
            return F.exp(k * F.log1p(-drop))

        nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in NODES])
        return size * F.aggregate(nodes, F.lit(0.0), lambda s, node: s + node["w"] * value(size * node["x"]))

    # No reach (k = 0): the whole range.
    return _with(F.least(top, reach), total)


def correlation_p_value(r, n) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs (n >= 3).

    With v = n - 2, the integral of cos**(v - 1) from asin |r| to pi / 2, over the
    one from 0. The factor (1 - r r)**((v - 1) / 2) is taken out of the upper one,
    so that small values keep their digits; one way for every n.
    """
    r = F.col(r) if isinstance(r, str) else r
    n = (F.col(n) if isinstance(n, str) else n).cast("double")

    def p(x: Column) -> Column:
        k, size = x["k"], x["size"]
        rest = (1.0 - size) * (1.0 + size)
        upper = _power_integral(k, size / F.sqrt(rest), F.atan2(F.sqrt(rest), size))
        whole = _power_integral(k, F.lit(0.0), F.lit(1.5707963267948966))
        return F.least(F.exp(k / 2.0 * F.log(rest)) * upper / whole, F.lit(1.0))

    return (
        F.when(r.isNull() | (n < 3.0), F.lit(None).cast("double"))
        .when(F.abs(r) >= 1.0, F.lit(0.0))
        .otherwise(_with(F.struct((n - 3.0).alias("k"), F.abs(r).alias("size")), p))
    )


def weekday(ts) -> Column:
    return F.date_format(ts, "EEEE")


def month_name(ts) -> Column:
    return F.date_format(ts, "MMMM")


def clock(ts) -> Column:
    return F.date_format(ts, "HH:mm")


# Microseconds since 1970 that a timestamp can hold.
MAX_MICROS = 2**63 - 1


def within_timestamps(epoch: Column, per_second: int) -> Column:
    """The epoch, or null where no timestamp can hold it."""
    limit = MAX_MICROS * per_second // 1_000_000
    return F.when(epoch.between(-limit, limit), epoch)
