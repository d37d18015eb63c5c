"""Exact ranks and quantiles of groups of any size.

A group is cut into bands of neighbouring values where its own values lie: a sample of
its distinct values (chosen by hash, so the same in every run) gives edges that leave
about ``band`` distinct values between them, whether they spread from 0 to 10^300 or lie
between two whole numbers. Nearly all groups are smaller than two bands and have no
edges; they are summed up directly. For the others running counts over bands place each
band, and values are ordered inside a band only. No task holds a whole large group: it
holds one band, or one count per band.

Whether there are large groups at all is asked first, by a job of its own over the
sample. Edges, and bands that hold a wanted rank, are staged: Spark sees their size and
broadcasts them only if they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.session import stage_table

# Distinct values that a band should hold, sampled values per band, and bands of a group.
BAND = 1 << 16
SAMPLES = 32
MOST_BANDS = 512


def _known(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a group and a number."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, value])
    return df.where(f"{present} AND NOT isnan(CAST({value} AS DOUBLE))")


def band_edges(df: DataFrame, keys: list[str], value: str, band: int = BAND) -> DataFrame | None:
    """keys, _edges (sorted values) of the groups with two bands or more; None if there is none.

    A value belongs to the band that is the number of edges at or below it.
    """
    rate = max(1, band // SAMPLES)
    sample = (
        _known(df, keys, value)
        .where(f"pmod(xxhash64({value}), {rate}) = 0")
        .select(*keys, value)
        .distinct()
    )
    bands = f"least({MOST_BANDS}, count(1) * {rate} div {band})"
    large = f"{bands} >= 2"
    if sample.groupBy(*keys).agg(F.expr(large).alias("_large")).where("_large").isEmpty():
        return None
    shares = ", ".join(f"{k / MOST_BANDS}D" for k in range(1, MOST_BANDS))
    cuts = sample.groupBy(*keys).agg(
        F.expr(f"percentile_approx({value}, array({shares}), {16 * MOST_BANDS})").alias("_cuts"),
        F.expr(f"int({bands})").alias("_bands"),
    )
    edges = f"transform(sequence(1, _bands - 1), k -> _cuts[k * {MOST_BANDS} div _bands - 1])"
    return stage_table(
        cuts.where("_bands >= 2").selectExpr(*keys, f"array_distinct({edges}) AS _edges"),
        "band-edges",
    )


def _banded(df: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the band of each value, by halving its group's edges."""
    middle = "(s.lo + s.hi) div 2"
    step = (
        f"CASE WHEN s.lo = s.hi THEN s WHEN _edges[int({middle})] <= {value} "
        f"THEN named_struct('lo', {middle} + 1, 'hi', s.hi) "
        f"ELSE named_struct('lo', s.lo, 'hi', {middle}) END"
    )
    halvings = MOST_BANDS.bit_length()
    found = (
        f"aggregate(sequence(1, {halvings}), named_struct('lo', 0L, 'hi', bigint(size(_edges))), "
        f"(s, i) -> {step}, s -> s.lo)"
    )
    # Groups without edges are one band. The band is never null, and saying so keeps
    # Spark from filtering the two uses of this table differently.
    return (
        df.join(edges, keys, "left")
        .withColumn("_band", F.expr(f"CASE WHEN _edges IS NULL THEN 0L ELSE {found} END"))
        .withColumn("_band", F.coalesce("_band", F.lit(0).cast("long")))
        .drop("_edges")
    )


def _placed(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Bands with the rows before them and the rows of the group."""
    group = f"PARTITION BY {', '.join(keys)} ORDER BY _band ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return sizes.selectExpr(
        "*",
        f"sum(_size) OVER ({group} CURRENT ROW) - _size AS _before",
        f"sum(_size) OVER ({group} UNBOUNDED FOLLOWING) AS _total",
    )


def _counted(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    """Distinct values of each group with their number, which combine before the shuffle."""
    count = f"sum({weight})" if weight else "count(1)"
    return _known(df, keys, value).groupBy(*keys, value).agg(F.expr(f"{count} AS _count"))


def _running(keys: list[str], value: str) -> str:
    return (
        f"sum(_count) OVER (PARTITION BY {', '.join(keys)} ORDER BY {value} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _count"
    )


def value_positions(
    df: DataFrame,
    keys: list[str],
    value: str,
    weight: str | None = None,
    band: int = BAND,
    whole: bool = False,
) -> DataFrame:
    """Distinct values of each group with their place in its sorted order.

    Adds ``copies`` (rows with this value), ``start`` (rows with a smaller
    value), ``total`` (rows of the group) and ``average_rank`` (ranks from 1,
    ties averaged). ``whole`` says that no group is known to be large, so that
    nothing has to be asked first.
    """
    counted = _counted(df, keys, value, weight)
    edges = None if whole else band_edges(df, keys, value, band)
    if edges is None:
        total = f"sum(_count) OVER (PARTITION BY {', '.join(keys)})"
        placed = counted.selectExpr("*", f"{_running(keys, value)} AS _start", f"{total} AS _total")
    else:
        banded = _banded(counted, edges, keys, value)
        inside = [*keys, "_band"]
        bands = _placed(banded.groupBy(*inside).agg(F.expr("sum(_count) AS _size")), keys)
        placed = banded.join(bands, inside).selectExpr(
            "*", f"_before + {_running(inside, value)} AS _start"
        )
    return placed.selectExpr(
        *keys,
        value,
        "_count AS copies",
        "_start AS start",
        "_total AS total",
        "_start + (_count + 1) / 2D AS average_rank",
    )


def previous_values(df: DataFrame, keys: list[str], value: str, edges: DataFrame | None) -> DataFrame:
    """Rows with distinct values in their group, with the next smaller one as ``previous``.

    ``edges`` as ``band_edges`` gives them. In a large group only the first row of a band looks across its border, at the
    greatest value of the last band before it that holds any.
    """
    group = ", ".join(keys)
    if edges is None:
        return df.selectExpr("*", f"lag({value}) OVER (PARTITION BY {group} ORDER BY {value}) AS previous")
    banded = _banded(df, edges, keys, value)
    borders = (
        banded.groupBy(*keys, "_band")
        .agg(F.max(value).alias("_last"))
        .selectExpr(*keys, "_band", f"lag(_last) OVER (PARTITION BY {group} ORDER BY _band) AS _earlier")
    )
    inside = f"PARTITION BY {group}, _band ORDER BY {value}"
    return (
        banded.join(borders, [*keys, "_band"])
        .withColumn("previous", F.expr(f"coalesce(lag({value}) OVER ({inside}), _earlier)"))
        .drop("_band", "_earlier")
    )


def _built_in(probabilities: dict[str, float], value: str, weight: str | None) -> Column:
    """Exact quantiles of a group that is small enough to be counted in one place."""
    shares = ", ".join(f"{float(p)}D" for p in probabilities.values())
    by = f", {weight}" if weight else ""
    return F.expr(f"percentile({value}, array({shares}){by})").alias("_quantiles")


def _named(probabilities: dict[str, float]) -> list[Column]:
    return [F.col("_quantiles")[i].alias(name) for i, name in enumerate(probabilities)]


def _large_quantiles(
    rows: DataFrame,
    edges: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    weight: str | None,
) -> DataFrame:
    """Quantiles of the groups with edges. Rows are counted per band where they are.

    Only values of bands that hold a wanted rank are shuffled.
    """
    spots = {name: f"CAST(_total - 1 AS DOUBLE) * {float(p)}D" for name, p in probabilities.items()}
    ranks = {}
    for name, spot in spots.items():
        ranks[f"{name}_lo"] = f"floor({spot})"
        ranks[f"{name}_hi"] = f"ceil({spot})"
    count = f"sum({weight})" if weight else "count(1)"
    inside = [*keys, "_band"]
    banded = _banded(rows.join(edges.select(*keys), keys, "left_semi"), edges, keys, value)
    wanted = f"array({', '.join(ranks.values())})"
    sizes = _placed(banded.groupBy(*inside).agg(F.expr(f"{count} AS _size")), keys).where(
        f"exists({wanted}, k -> k >= _before AND k < _before + _size)"
    )
    chosen = stage_table(sizes, "wanted-bands")
    counted = (
        banded.join(chosen.select(*inside), inside, "left_semi")
        .groupBy(*inside, value)
        .agg(F.expr(f"{count} AS _count"))
    )
    placed = counted.join(chosen, inside).selectExpr(
        "*", f"_before + {_running(inside, value)} AS _start"
    )
    picked = placed.groupBy(*keys).agg(
        F.expr("max(_total) AS _total"),
        *[
            F.expr(f"max(CASE WHEN {k} >= _start AND {k} < _start + _count THEN {value} END) AS {name}")
            for name, k in ranks.items()
        ],
    )
    return picked.selectExpr(
        *keys,
        *[
            f"{name}_lo + ({name}_hi - {name}_lo) * ({spot} - floor({spot})) AS {name}"
            for name, spot in spots.items()
        ],
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    weight: str | None = None,
    band: int = BAND,
) -> DataFrame:
    """Quantiles with linear interpolation, one column per named probability."""
    rows = _known(df, keys, value)
    edges = band_edges(df, keys, value, band)

    def small(part: DataFrame) -> DataFrame:
        found = part.groupBy(*keys).agg(_built_in(probabilities, value, weight))
        return found.select(*keys, *_named(probabilities))

    if edges is None:
        return small(rows)
    return small(rows.join(edges.select(*keys), keys, "left_anti")).unionByName(
        _large_quantiles(rows, edges, keys, value, probabilities, weight)
    )


def group_summary(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], band: int = BAND
) -> DataFrame:
    """Count, mean, population deviation, extremes and exact quantiles.

    One aggregate for groups that are not large.
    """
    rows = _known(df, keys, value)
    moments = [
        F.expr("count(1) AS n"),
        F.expr(f"avg({value}) AS mean"),
        F.expr(f"stddev_pop({value}) AS std"),
        F.expr(f"min({value}) AS min"),
        F.expr(f"max({value}) AS max"),
    ]
    edges = band_edges(df, keys, value, band)

    def small(part: DataFrame) -> DataFrame:
        found = part.groupBy(*keys).agg(*moments, _built_in(probabilities, value, None))
        return found.select(*keys, "n", "mean", "std", "min", "max", *_named(probabilities))

    if edges is None:
        return small(rows)
    of_large = rows.join(edges.select(*keys), keys, "left_semi").groupBy(*keys).agg(*moments)
    quantiles = _large_quantiles(rows, edges, keys, value, probabilities, None)
    return small(rows.join(edges.select(*keys), keys, "left_anti")).unionByName(
        of_large.join(quantiles, keys)
    )
