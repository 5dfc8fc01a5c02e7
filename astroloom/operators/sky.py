"""Sky-catalogue operators. A catalogue is rows (id, ra, dec, ...) in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import astro
from ..sources.shared import stored
from .blocks import beside, scanned

#: Rows that a target may meet on its way to each of its nearest, and the radius below which circles are not made smaller.
MET, LEAST = 200, 1e-4


def cone(catalogue: DataFrame, ra: float, dec: float, radius: float, order: str | None = None, n: int | None = None) -> DataFrame:
    """Rows within ``radius`` degrees of a point, with ``sep``. The box is plain comparisons, which a Parquet scan can
    use; near a pole every right ascension is in it, and a box over 0/360 is two ranges."""
    low, high = dec - radius, dec + radius
    rows = catalogue.filter(F.col("dec").between(low, high))
    if low > -90 and high < 90:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec))))) + 1e-9
        a, b = (ra - half) % 360, (ra + half) % 360
        if half < 180:
            rows = rows.filter(F.col("ra").between(a, b) if a <= b else (F.col("ra") >= a) | (F.col("ra") <= b))
    rows = rows.withColumn("sep", astro.separation(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec))).filter(F.col("sep") <= radius)
    return rows.orderBy(order, "id").limit(n) if order else rows


def cross_match(targets: DataFrame, catalogue: DataFrame, radius: float) -> DataFrame:
    """All pairs (target, id, sep) within ``radius`` degrees.

    Declination zones as high as the radius cut right ascension into cells that are at least the radius wide at the
    zone's highest declination. A target visits its own and the neighbouring zones, and in each the cells that its circle
    can touch, so the match is an equi-join on (zone, cell) whatever the number of rows; the zones at the poles are one
    cell each."""
    left, right = _celled(targets, catalogue, radius)
    pairs = left.join(right, ["zone", "cell"]).withColumn("sep", astro.separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec")))
    return pairs.filter(F.col("sep") <= radius).select("target", "id", "sep")


def _celled(targets: DataFrame, catalogue: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Targets (target, ra, dec) in each zone and cell they visit, and the catalogue (id, _ra, _dec) in its own."""
    height = radius

    def cells(zone: Column) -> Column:
        top = F.least(F.greatest(F.abs(zone * height), F.abs((zone + 1) * height)) + height, F.lit(90.0))
        # The half width of a circle of this radius that is centred at the zone's edge or one zone beyond it.
        ratio = F.sin(F.radians(F.lit(radius))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        n = F.floor(360.0 / F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).cast("long")
        return F.when(ratio >= 1.0, F.lit(1).cast("long")).otherwise(F.greatest(n, F.lit(1).cast("long")))  # a circle over the pole meets all

    def cell(ra: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n), n - 1).cast("long")

    zone = F.floor(F.col("dec") / height)
    right = catalogue.select(F.col("id"), F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), zone.alias("zone")).withColumn("cell", cell(F.col("_ra"), cells(F.col("zone"))))
    left = targets.select(F.col("id").alias("target"), "ra", "dec", F.explode(F.array(zone - 1, zone, zone + 1)).alias("zone")).withColumn("_n", cells(F.col("zone")))
    own = cell(F.col("ra"), F.col("_n"))
    near = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(own + k, F.col("_n"))))
    left = left.select("target", "ra", "dec", "zone", F.explode(near).alias("cell"))
    return left, right


def pairs_met(targets: DataFrame, catalogue: DataFrame, radius: float) -> int:
    """How many pairs ``cross_match`` meets, from the rows of each cell."""
    left, right = (side.groupBy("zone", "cell").agg(F.count("*").alias(n)) for side, n in zip(_celled(targets, catalogue, radius), ("_l", "_r")))
    return left.join(right, ["zone", "cell"]).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0


def nearby(targets: DataFrame, catalogue: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """(target, id, sep, rank): the k nearest matches within ``radius`` (ties: the smaller id) of the targets that have any.

    Circles begin so small that targets meet a bounded number of rows each on average, however dense the catalogue. A
    target with k matches in its circle is settled, as all others lie farther; the rest go on with wider circles, up to
    the radius."""
    here, rows = targets.count(), catalogue.count()
    most = MET * k * (here + rows)
    # The smallest circle that holds 8 k rows of an even sky, then smaller ones where the sky is not even.
    even = math.degrees(2 * math.asin(math.sqrt(min(1.0, 8 * k / max(rows, 1)))))
    at = radius
    while at / 2 >= even:
        at /= 2
    while at > LEAST and pairs_met(targets, catalogue, at) > most:
        at /= 2
    w = W.partitionBy("target").orderBy("sep", "id")
    out = None
    while True:
        best = cross_match(targets, catalogue, at).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if at < radius:
            best = stored(best)
            settled = best.filter(F.col("rank") == k).select("target")
            targets = stored(beside(targets.select(F.col("id"), "ra", "dec"), settled.withColumnRenamed("target", "id"), ["id"], "left_anti"))
            best = beside(best, settled, ["target"], "left_semi")
        out = best if out is None else out.unionByName(best)
        if at >= radius or targets.isEmpty():
            return out
        at = radius if pairs_met(targets, catalogue, radius) <= most else min(2 * at, radius)


def nearest(targets: DataFrame, catalogue: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """Every target with its k nearest matches (ties: the smaller id), or with nulls if there is none."""
    return targets.select(F.col("id").alias("target")).join(nearby(targets, catalogue, radius, k), "target", "left")


def match_counts(targets: DataFrame, catalogues: dict[str, DataFrame], radius: float) -> DataFrame:
    """(target, a count per catalogue, n_matched: catalogues with a match)."""
    out, names = targets.select(F.col("id").alias("target")), list(catalogues)
    for name in names:
        out = out.join(cross_match(targets, catalogues[name], radius).groupBy("target").agg(F.count("*").alias(name)), "target", "left")
    out = out.fillna(0, names)
    return out.withColumn("n_matched", sum(((F.col(c) > 0).cast("int") for c in names[1:]), (F.col(names[0]) > 0).cast("int")))


def with_fallback(targets: DataFrame, releases: list[DataFrame], radius: float) -> DataFrame:
    """(target, release, id, sep): the nearest match of the first release that has one."""
    every, rest = None, targets.select("id", "ra", "dec")
    for k, release in enumerate(releases):
        found = nearby(rest, release, radius).select("target", F.lit(k).alias("release"), "id", "sep")
        if k + 1 < len(releases):
            found = stored(found)
            rest = stored(beside(rest, found.select(F.col("target").alias("id")), ["id"], "left_anti"))
        every = found if every is None else every.unionByName(found)
    return every


def dust(catalogue: DataFrame, dust_map: DataFrame, nside: int, ratio: float = 3.1) -> DataFrame:
    """Adds ebv of the HEALPix pixel (missing: 0) and a_v."""
    rows = catalogue.withColumn("pixel", astro.healpix_ring(F.col("ra"), F.col("dec"), nside)).join(dust_map.select("pixel", "ebv"), "pixel", "left")
    return rows.withColumn("ebv", F.coalesce(F.nanvl("ebv", F.lit(None).cast("double")), F.lit(0.0))).withColumn("a_v", ratio * F.col("ebv"))


def grid_cell(longitude: Column, latitude: Column, nx: int = 36, ny: int = 18) -> tuple[Column, Column]:
    """Column and row of a rectangular galactic map, from 0 at longitude 0 and latitude 90, clamped to it."""
    clamp = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1))
    return clamp(longitude / 360 * nx, nx), clamp((90 - latitude) / 180 * ny, ny)


def reddening_at(catalogue: DataFrame, steps: DataFrame, values: tuple[str, ...] = ("ebv",)) -> DataFrame:
    """As-of join: (id, values, bin) of the farthest step (pixel, bin, values) of the row's pixel with bin <= distance; null
    before the first and for a null distance.

    Rows and steps are put in one order of pixel and distance, and each row takes the last step before it, so a row meets
    one step however many its pixel has, and a pixel of many rows is cut into ranges."""
    step = F.struct(F.col("bin").cast("double").alias("bin"), *values)
    kind = steps.select(step.alias("_step")).schema["_step"].dataType
    merged = steps.filter("bin IS NOT NULL").select("pixel", F.col("bin").cast("double").alias("_at"), F.lit(0).alias("_row_of"), F.lit(None).cast(catalogue.schema["id"].dataType).alias("id"), step.alias("_step"))
    merged = merged.unionByName(catalogue.select("pixel", F.col("distance").cast("double").alias("_at"), F.lit(1).alias("_row_of"), "id", F.lit(None).cast(kind).alias("_step")))
    found = scanned(merged, ["pixel"], ["_at", "_row_of"], lasts={"_last": F.col("_step")}).filter("_row_of = 1")
    return found.select("id", *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last.bin").alias("bin"))


def sample_quantile(samples: Column, share: float) -> Column:
    """Quantile of an array with linear interpolation; null for an empty one."""
    x = F.array_sort(F.filter(samples, lambda v: v.isNotNull()))
    at = (F.size(x) - 1) * F.lit(float(share))
    low, high = (F.get(x, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def reddening_percentiles(catalogue: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, bin, p16, median, p84) of the samples of E(B-V) that the row's step has."""
    rows = reddening_at(catalogue, steps, ("samples",))
    return rows.select("id", "bin", *[sample_quantile(F.col("samples"), q).alias(n) for n, q in (("p16", 0.16), ("median", 0.5), ("p84", 0.84))])


def exploded_epochs(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, epoch): one row per entry of the id's ``;`` separated list, the id itself where it has none."""
    joined = rows.join(lists, "id", "left")
    return joined.select("id", F.explode(F.split(F.coalesce("epochs", F.col("id").cast("string")), ";")).alias("epoch"))


def line_moments(spectra: DataFrame, lines: DataFrame) -> DataFrame:
    """Per spectrum and line window (line, lo, hi, rest): flux-weighted centre, width and velocity of what stands out of
    a linear continuum. The line list is a parameter-sized table; the join is a range condition on it."""
    rows = spectra.join(lines, (F.col("wave") >= F.col("lo")) & (F.col("wave") < F.col("hi")))
    fit = rows.groupBy("spec", "line").agg(F.regr_slope("flux", "wave").alias("b"), F.regr_intercept("flux", "wave").alias("a"), F.count("*").alias("n"))
    depth = F.abs(F.col("flux") - F.col("a") - F.col("b") * F.col("wave"))
    moments = rows.join(fit.filter("n >= 3"), ["spec", "line"]).groupBy("spec", "line", "rest").agg(F.sum(depth).alias("w"), F.sum(depth * F.col("wave")).alias("x"), F.sum(depth * F.col("wave") * F.col("wave")).alias("xx"), F.count("*").alias("n"))
    centre = F.col("x") / F.nullif("w", F.lit(0.0))
    sigma = F.sqrt(F.greatest(F.col("xx") / F.nullif("w", F.lit(0.0)) - centre * centre, F.lit(0.0)))
    return moments.select("spec", "line", "n", centre.alias("centre"), (2.3548200450309493 * sigma).alias("fwhm"), ((centre - F.col("rest")) / F.col("rest") * astro.LIGHT_KM_S).alias("rv"))


def blackbody_fit(seds: DataFrame, temperatures: tuple[float, float, int]) -> DataFrame:
    """(spec, temperature, amplitude, chi2): the grid temperature whose scaled black body is nearest to (wave, flux)."""
    low, high, n = temperatures
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) + k * F.lit((high - low) / (n - 1)))).alias("temperature")
    rows = seds.select("spec", "wave", "flux", grid)
    b = astro.planck_lambda(F.col("wave"), F.col("temperature"))
    sums = rows.groupBy("spec", "temperature").agg(F.sum(F.col("flux") * b).alias("fb"), F.sum(b * b).alias("bb"), F.sum(F.col("flux") * F.col("flux")).alias("ff"))
    fits = sums.select("spec", "temperature", (F.col("fb") / F.col("bb")).alias("amplitude"), (F.col("ff") - F.col("fb") * F.col("fb") / F.col("bb")).alias("chi2"))
    return fits.groupBy("spec").agg(F.min(F.struct("chi2", "temperature", "amplitude")).alias("f")).select("spec", "f.temperature", "f.amplitude", "f.chi2")
