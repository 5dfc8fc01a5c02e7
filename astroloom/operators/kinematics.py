"""Places and motions of stars, with errors by sampling. A draw is made from the md5 of star, draw and name, so it depends
neither on how the rows are spread nor on a task being run again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import astro


def uniform(key: str, name: str) -> Column:
    """Between 0 and 1, from (key, draw, name)."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string"), F.lit(name)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(key: str, name: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, name + "/r"))) * F.cos(2 * math.pi * uniform(key, name + "/a"))


def draws(stars: DataFrame, n: int) -> DataFrame:
    return stars.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def two_sided(key: str, name: str, value: Column, low: Column, high: Column) -> Column:
    """A draw around a value with unequal errors: half of a normal to either side, each side as likely; not below a
    millionth of the value."""
    side, step = uniform(key, name + "/side") < 0.5, F.abs(normal(key, name))
    return F.greatest(value + F.when(side, step * (high - value)).otherwise(-step * (value - low)), value * 1e-6)


def sampled(rows: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, then for each value its median, mean, p16 and p84)."""
    aggs = []
    for v in values:
        p = F.percentile(v, F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
        aggs += [p[1].alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean"), p[0].alias(f"{v}_p16"), p[2].alias(f"{v}_p84")]
    return rows.groupBy(key).agg(*aggs)


def monte_carlo_place(stars: DataFrame, key: str, n: int) -> DataFrame:
    """Places (kpc) and distances from the centre, in the plane and in space, of (key, ra, dec, dist, dist_lo, dist_hi)."""
    rows = draws(stars, n).withColumn("d", two_sided(key, "dist", F.col("dist"), F.col("dist_lo"), F.col("dist_hi")))
    x, y, z = astro.galactocentric(F.col("ra"), F.col("dec"), F.col("d"))
    rows = rows.withColumns({"x": x, "y": y, "z": z})
    plane = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    rows = rows.withColumns({"r_plane": F.sqrt(plane), "r_centre": F.sqrt(plane + F.col("z") * F.col("z"))})
    return sampled(rows, key, ("x", "y", "z", "r_plane", "r_centre"))


def monte_carlo_velocity(stars: DataFrame, key: str, n: int) -> DataFrame:
    """U, V, W and total speed of (key, ra, dec, dist, dist_lo, dist_hi, pmra, pmra_err, pmdec, pmdec_err, vlos, vlos_err)."""
    rows = draws(stars, n).withColumn("d", two_sided(key, "dist", F.col("dist"), F.col("dist_lo"), F.col("dist_hi")))
    rows = rows.withColumns({f"{c}_d": F.col(c) + F.col(f"{c}_err") * normal(key, c) for c in ("pmra", "pmdec", "vlos")})
    u, v, w = astro.space_velocity(F.col("ra"), F.col("dec"), F.col("pmra_d"), F.col("pmdec_d"), F.col("d"), F.col("vlos_d"))
    rows = rows.withColumns({"u": u, "v": v, "w": w})
    return sampled(rows.withColumn("speed", astro.total_speed(F.col("u"), F.col("v"), F.col("w"))), key, ("u", "v", "w", "speed"))


def monte_carlo_line_of_sight(stars: DataFrame, key: str, n: int) -> DataFrame:
    """Rest-frame velocity of (key, ra, dec, vlos, vlos_err)."""
    l, b = astro.galactic(F.col("ra"), F.col("dec"))  # noqa: E741
    rows = draws(stars, n).withColumn("vlos_d", F.col("vlos") + F.col("vlos_err") * normal(key, "vlos"))
    return sampled(rows.withColumn("vrf", astro.rest_frame_velocity(l, b, F.col("vlos_d"))), key, ("vrf",))


def monte_carlo_luminosity_distance(stars: DataFrame, key: str, n: int, ratio: float) -> DataFrame:
    """Distance (pc) from magnitudes and reddening, of (key, mag, mag_err, absolute, absolute_err, reddening)."""
    rows = draws(stars, n).withColumns({f"{c}_d": F.col(c) + F.col(f"{c}_err") * normal(key, c) for c in ("mag", "absolute")})
    return sampled(rows.withColumn("distance", astro.photometric_distance(F.col("mag_d"), F.col("absolute_d"), F.col("reddening"), ratio)), key, ("distance",))


def velocity_curves(epochs: DataFrame, key: str) -> DataFrame:
    """(key, n, curve): radial velocities with errors in time order from (t, z, z_err); -9999 is unknown and goes."""
    rows = epochs.withColumns({"rv": astro.radial_velocity(F.col("z")), "err": astro.radial_velocity(F.col("z_err"))}).filter("rv IS NOT NULL")
    curve = F.array_sort(F.collect_list(F.struct("t", "rv", "err")))
    return rows.groupBy(key).agg(F.count("*").alias("n"), curve.alias("curve"))


def band_extent(wide: DataFrame, key: str, bands: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, t_min, t_max, mag_min, mag_max) over whichever bands (name: time and magnitude column) a table has."""
    have = {b: c for b, c in bands.items() if set(c) <= set(wide.columns)}
    t, m = [F.col(c[0]) for c in have.values()], [F.col(c[1]) for c in have.values()]
    least = lambda c: F.array_min(F.array(*c))
    most = lambda c: F.array_max(F.array(*c))
    return wide.groupBy(key).agg(F.min(least(t)).alias("t_min"), F.max(most(t)).alias("t_max"), F.min(least(m)).alias("mag_min"), F.max(most(m)).alias("mag_max"))
