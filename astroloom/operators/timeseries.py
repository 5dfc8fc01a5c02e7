"""Light-curve operators. A light curve is rows (source, band, t in days, mag, flag); every operator treats all sources
at once, grouped by ``by`` columns. Frequency and period grids are generated, never collected, and each row meets a grid
only to be summed at once into its source's partial aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored
from .blocks import beside, placed, quantiles, scanned, windowed

TWO_PI = 2 * math.pi
#: Samples of a source from which on they are summed where they lie.
LARGE = 1_000_000


def light_curves(events: DataFrame, source: str = "user_id", band: str = "event_type", value: str = "value") -> DataFrame:
    """Normalises an event table: t counts days from 2024-01-01 without a time zone, flag 1 marks bad samples."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return events.select(F.col(source).alias("source"), F.col(band).alias("band"), (micros / 8.64e10).alias("t"), F.col(value).alias("mag"), (k % 10 == 0).cast("int").alias("flag"))


def good(lc: DataFrame) -> DataFrame:
    """Unflagged samples whose time and magnitude are finite."""
    finite = lambda c: F.abs(F.nanvl(c, F.lit(None))) < float("inf")
    return lc.filter((F.col("flag") == 0) & finite("t") & finite("mag"))


def extent(lc: DataFrame) -> DataFrame:
    return lc.groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("band").alias("n_bands"), F.min("t").alias("t_min"), F.max("t").alias("t_max"),
        (F.max("t") - F.min("t")).alias("span"), F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"),
    )


def statistics(lc: DataFrame, by: tuple[str, ...] = ("source", "band")) -> DataFrame:
    """Variability statistics; standard deviations are of the population. Medians of large groups are found in ranges."""
    rows = lc.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("mag").alias("mag_mean"), F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"),
        (F.max("mag") - F.min("mag")).alias("mag_delta"), F.stddev_pop("mag").alias("mag_std"),
    )
    middle = quantiles(lc, list(by), "mag", {"mag_median": 0.5})
    return beside(rows, middle, list(by)).withColumn("rel_semi_amp", F.col("mag_delta") / 2 / F.col("mag_median"))


def centred(lc: DataFrame, floor: float = 1.1) -> DataFrame:
    """Adds ``c``, the magnitude less its source's median, and ``lifted``, less ``floor`` times its source's minimum. Both
    are joined back, one row for each source, so no source is held in a window."""
    stats = beside(lc.groupBy("source").agg(F.min("mag").alias("_min")), quantiles(lc, ["source"], "mag", {"_mid": 0.5}), ["source"])
    return beside(lc, stats, ["source"]).withColumns({"c": F.col("mag") - F.col("_mid"), "lifted": F.col("mag") - floor * F.col("_min")}).drop("_min", "_mid")


def sigma_clip(lc: DataFrame, k: float = 3.0, rounds: int = 1, by: tuple[str, ...] = ("source",), low: float | None = None) -> DataFrame:
    """Drops samples farther than k population sigmas above (and ``low`` or k below) the group's median, ``rounds`` times."""
    for _ in range(rounds):
        stats = lc.groupBy(*by).agg(F.median("mag").alias("_m"), F.stddev_pop("mag").alias("_s"))
        lc = lc.join(stats, list(by)).filter((F.col("mag") - F.col("_m") <= k * F.col("_s")) & (F.col("_m") - F.col("mag") <= (k if low is None else low) * F.col("_s"))).drop("_m", "_s")
    return lc


def clipped_to_null(rows: DataFrame, value: str, by: tuple[str, ...], high: float = 3.9, low: float = 3.6, also: tuple[str, ...] = ()) -> DataFrame:
    """Keeps every row; ``value`` (and the columns ``also``) become null at or beyond ``high`` population sigmas above its
    group's median, or ``low`` below. NaN counts as missing, and stays null."""
    sane = F.nanvl(value, F.lit(None))
    stats = beside(rows.groupBy(*by).agg(F.stddev_pop(sane).alias("_s")), quantiles(rows.withColumn(value, sane), list(by), value, {"_m": 0.5}), list(by))
    inside = (sane < F.col("_m") + high * F.col("_s")) & (sane > F.col("_m") - low * F.col("_s"))
    rows = beside(rows, stats, list(by)).withColumn("_in", inside)
    return rows.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in (value, *also)}).drop("_s", "_m", "_in")


def error_statistics(lc: DataFrame, error: str = "error", by: tuple[str, ...] = ("source", "band"), k: float = 8.0) -> DataFrame:
    """Scatter against measurement errors: magnitudes and errors are each clipped once at ``k`` sigmas about their own
    median; then (n, n_kept, mag_std, error_max, error_median, error_mean, and the scatter over the mean and over the
    median error). Ratios to an error of zero are null."""
    edge = k * (1 + 1e-12)  # a sample on the limit stays
    rows = lc.select(*by, "mag", F.col(error).alias("error"))
    for column in ("mag", "error"):
        rows = clipped_to_null(rows, column, by, edge, edge) if k else rows
    # A group without scatter has no room within its limits: all of it stays.
    flat = lc.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("mag").alias("_fm"), F.stddev_pop(error).alias("_fe"), F.max(error).alias("_e"))
    kept = rows.groupBy(*by).agg(F.count("mag").alias("n_kept"), F.stddev_pop("mag").alias("mag_std"), F.max("error").alias("error_max"), F.avg("error").alias("error_mean"))
    all_ = beside(beside(flat, kept, list(by)), quantiles(rows, list(by), "error", {"error_median": 0.5}), list(by))
    level = lambda c: F.when(F.col("_fe") == 0, F.col("_e")).otherwise(F.col(c))
    all_ = all_.withColumns({"n_kept": F.when(F.col("_fm") == 0, F.col("n")).otherwise(F.col("n_kept")), "mag_std": F.when(F.col("_fm") == 0, 0.0).otherwise(F.col("mag_std")), **{c: level(c) for c in ("error_max", "error_median", "error_mean")}})
    ratio = lambda c: F.col("mag_std") / F.nullif(c, F.lit(0.0))
    return all_.select(*by, "n", "n_kept", "mag_std", "error_max", "error_median", "error_mean", ratio("error_mean").alias("over_mean"), ratio("error_median").alias("over_median"))


def difference_features(lc: DataFrame) -> DataFrame:
    """Shape and first differences in time order; a source is cut into blocks of its order."""
    stepped = windowed(lc, ["source"], ["t", "mag"], 1, 0, lambda w: {"d": F.col("mag") - F.lag("mag").over(w)})
    return stepped.groupBy("source").agg(
        F.avg("mag").alias("mean"), F.stddev_pop("mag").alias("std"), F.percentile("mag", 0.25).alias("p25"), F.percentile("mag", 0.75).alias("p75"),
        F.skewness("mag").alias("skew"), F.stddev_pop("d").alias("diff_std"), F.avg(F.abs("d")).alias("diff_abs"),
    )


def downsample(lc: DataFrame, width: float, by: tuple[str, ...] = ("source",)) -> DataFrame:
    return lc.groupBy(*by, F.floor(F.col("t") / width).alias("slot")).agg(F.count("*").alias("n"), F.avg("mag").alias("mag"))


def phase(t: Column, period: Column | float) -> Column:
    """Fraction of the cycle, in [0, 1)."""
    cycles = t / period
    return cycles - F.floor(cycles)


def fold(lc: DataFrame, period: float, bins: int = 10, center: str = "avg") -> DataFrame:
    """Binned phase profile with the semi-amplitude of the bins."""
    f = {"avg": F.avg, "median": F.median}[center]
    folded = lc.groupBy("source", F.floor(phase(F.col("t"), period) * bins).alias("bin")).agg(F.count("*").alias("n"), f("mag").alias("mag"))
    w = W.partitionBy("source")
    return folded.withColumn("semi_amp", (F.max("mag").over(w) - F.min("mag").over(w)) / 2)


def fold_profile(lc: DataFrame, period: float, bins: int = 10, center: str = "avg", epoch: float = 0.0, half: bool = False, error: str | None = None) -> DataFrame:
    """(source, bin, n, mag, error, semi_amp): a binned phase profile whose phase 0 is at ``epoch``, or half a period
    before it with ``half``. A bin's error comes from its samples' own (column ``error``), or from their scatter: the
    population deviation over the root of their number."""
    at = phase(F.col("t") - epoch + (period / 2 if half else 0.0), period)
    rows = lc.withColumn("bin", F.floor(at * bins).cast("int"))
    spread = F.sqrt(F.sum(F.col(error) ** 2)) / F.count("*") if error else F.stddev_pop("mag") / F.sqrt(F.count("*"))
    folded = rows.groupBy("source", "bin").agg(F.count("*").alias("n"), F.avg("mag").alias("mag"), spread.alias("error"))
    if center == "median":
        folded = beside(folded.drop("mag"), quantiles(rows, ["source", "bin"], "mag", {"mag": 0.5}), ["source", "bin"])
    w = W.partitionBy("source")  # a source has ``bins`` rows
    return folded.select("source", "bin", "n", "mag", "error", ((F.max("mag").over(w) - F.min("mag").over(w)) / 2).alias("semi_amp"))


def phase_ordered(lc: DataFrame, period: float, epoch: float | None = None) -> DataFrame:
    """Adds phase and the sample's place in phase order, from 0; phases count from ``epoch``, or from each source's first
    time."""
    if epoch is None:
        lc = beside(lc, lc.groupBy("source").agg(F.min("t").alias("_first")), ["source"])
    rows = lc.withColumn("phase", phase(F.col("t") - (F.col("_first") if epoch is None else F.lit(epoch)), period)).drop("_first")
    return placed(rows, ["source"], ["phase", "t", "mag"])


def gates(lc: DataFrame, error: float = 0.05, least: int = 10, amplitude: float = 0.01, ratio: float = 1.02) -> DataFrame:
    """(source, band, n, amp, ratio) of the light curves that vary significantly: samples enough, a relative semi-amplitude
    and a scatter over the mean error (a share of each magnitude) above their limits."""
    rows = statistics(lc).join(lc.groupBy("source", "band").agg(F.avg(error * F.col("mag")).alias("_e")), ["source", "band"])
    rows = rows.select("source", "band", "n", F.col("rel_semi_amp").alias("amp"), (F.col("mag_std") / F.col("_e")).alias("ratio"))
    return rows.filter((F.col("n") >= least) & (F.col("amp") > amplitude) & (F.col("ratio") > ratio))


def significant(best: DataFrame, false_alarm_level: Column | float, power: str = "power") -> DataFrame:
    """Periodogram peaks whose power is above the false-alarm level."""
    return best.filter(F.col(power) > false_alarm_level)


def grid(low: float, high: float, n: int) -> Column:
    """Array of (k, value): n evenly spaced values from low to high."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), (F.lit(low) + k * F.lit(step)).alias("x")))


def by_source(lc: DataFrame, summed: Callable[[DataFrame], DataFrame], large: int | None = None) -> DataFrame:
    """What ``summed`` makes of each source's samples on a grid. The samples are shuffled, and what they make with the grid
    is summed in the same task. A source of more than ``large`` samples stays spread, and its partial sums are shuffled:
    they are few beside its samples, and one task would have all of these."""
    many = lc.groupBy("source").agg(F.count("*").alias("_n")).filter(F.col("_n") > (large or LARGE)).select("source")
    parts = int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if many.isEmpty():
        return summed(lc.repartition(parts, "source"))
    many = stored(many)  # it has no more rows than the table has over ``large``
    return summed(beside(lc, many, ["source"], "left_anti").repartition(parts, "source")).unionByName(summed(beside(lc, many, ["source"], "left_semi")))


def pdm(lc: DataFrame, low: float, high: float, n: int, bins: int = 4, least: int = 10) -> DataFrame:
    """Phase-dispersion periodogram (source, k, period, theta): the mean of the phase bins' variances over the total
    variance. Bins of one sample are skipped; a constant curve has theta 1; sources under ``least`` samples have none."""
    bin = F.floor(phase(F.col("t"), F.col("g.x")) * bins)
    theta = F.when(F.col("v") == 0, 1.0).otherwise(F.avg(F.when(F.col("m") > 1, F.col("b"))) / F.col("v"))

    def thetas(lc: DataFrame) -> DataFrame:
        total = lc.groupBy("source").agg(F.var_pop("mag").alias("v"), F.count("*").alias("n")).filter(F.col("n") >= least)
        rows = lc.join(total, "source").withColumn("g", F.explode(grid(low, high, n)))
        per_bin = rows.groupBy("source", "v", "g", bin.alias("bin")).agg(F.var_pop("mag").alias("b"), F.count("*").alias("m"))
        return per_bin.groupBy("source", "v", "g").agg(theta.alias("theta"))

    return by_source(lc, thetas).select("source", F.col("g.k").alias("k"), F.col("g.x").alias("period"), "theta")


def pdm_best(periodogram: DataFrame) -> DataFrame:
    """Best period (ties: the shortest), its significance, and half the width of the dip at half depth, 0.1 % at least.

    Periods that cut the samples into the same bins have one theta, but for the order in which it was summed: thetas that
    agree in twelve places are ties."""
    periodogram = periodogram.withColumn("theta", F.round("theta", 12))
    best = periodogram.groupBy("source").agg(
        F.min(F.struct("theta", "period")).alias("b"), F.avg("theta").alias("mean"), F.stddev_pop("theta").alias("std"), F.max("theta").alias("top"),
    )
    below = F.when(F.col("theta") < (F.col("b.theta") + F.col("top")) / 2, F.col("period"))
    joined = periodogram.join(best, "source").groupBy("source", "b", "mean", "std").agg(F.max(below).alias("hi"), F.min(below).alias("lo"))
    return joined.select(
        "source", F.col("b.period").alias("period"), F.col("b.theta").alias("theta"), (1 - F.col("b.theta")).alias("power"),
        ((F.col("mean") - F.col("b.theta")) / F.nullif("std", F.lit(0.0))).alias("significance"),
        F.greatest((F.col("hi") - F.col("lo")) / 2, F.col("b.period") * 0.001).alias("period_error"),
    )


def spans(lc: DataFrame, low: float, high: float, per_peak: float = 5.0) -> DataFrame:
    """(source, step, n): each source's own frequency grid from ``low``, so fine that a peak, which is as wide as one over
    the source's span, has ``per_peak`` samples; sources without a span have none."""
    rows = lc.groupBy("source").agg((F.max("t") - F.min("t")).alias("_span")).filter("_span > 0")
    step = 1 / (per_peak * F.col("_span"))
    return rows.select("source", step.alias("step"), (F.floor((high - low) / step) + 1).cast("int").alias("n"))


def _sums(w: Column, y: Column, arg: Column) -> list[Column]:
    s, c = F.sin(arg), F.cos(arg)
    terms = {"w": w, "y": w * y, "yy": w * y * y, "c": w * c, "s": w * s, "cc": w * c * c, "ss": w * s * s, "cs": w * c * s, "yc": w * y * c, "ys": w * y * s}
    return [F.sum(v).alias(f"_{k}") for k, v in terms.items()]


def lomb_scargle(lc: DataFrame, low: float, high: float, n: int, weight: str | None = None, least: int = 10) -> DataFrame:
    """Floating-mean Lomb-Scargle periodogram (source, k, freq, power, c0, cs, cc) in closed form from weighted sums;
    c0 + cc cos + cs sin is the fitted model. Power is null where the frequency's design is degenerate."""
    return by_source(lc, lambda lc: _spectrum(lc.withColumn("g", F.explode(grid(low, high, n))), weight, least))


def lomb_scargle_spans(lc: DataFrame, low: float, high: float, per_peak: float = 5.0, weight: str | None = None, least: int = 10, block: int = 512) -> DataFrame:
    """The same over each source's own grid (``spans``). A long span has many frequencies: a sample meets them in blocks,
    each a row of its own until it is summed, so neither a grid nor a block's sums grow with the longest span."""

    def spectrum(lc: DataFrame) -> DataFrame:
        rows = lc.join(spans(lc, low, high, per_peak), "source")
        rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
        ks = F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("n")) - 1)
        return _spectrum(rows.withColumn("g", F.explode(F.transform(ks, lambda k: F.struct(k.alias("k"), (F.lit(low) + k * F.col("step")).alias("x"))))), weight, least)

    return by_source(lc, spectrum)


def _spectrum(rows: DataFrame, weight: str | None, least: int) -> DataFrame:
    """Sums of samples that have met their frequencies, and the fit."""
    sums = rows.groupBy("source", "g").agg(*_sums(F.col(weight) if weight else F.lit(1.0), F.col("mag"), F.lit(TWO_PI) * F.col("g.x") * F.col("t")), F.count("*").alias("m"))
    v = lambda name: F.col(f"_{name}") / F.col("_w")
    rows = sums.filter(F.col("m") >= least).select(
        "source", F.col("g.k").alias("k"), F.col("g.x").alias("freq"), v("y").alias("y"), v("c").alias("c"), v("s").alias("s"), (v("yy") - v("y") * v("y")).alias("YY"),
        (v("yc") - v("y") * v("c")).alias("YC"), (v("ys") - v("y") * v("s")).alias("YS"), (v("cc") - v("c") * v("c")).alias("CC"), (v("ss") - v("s") * v("s")).alias("SS"),
        (v("cs") - v("c") * v("s")).alias("CS"), "m", F.col("_w").alias("w"),
    )
    D = F.nullif(F.expr("CC * SS - CS * CS"), F.lit(0.0))
    rows = rows.withColumns({"a": (F.expr("YC * SS - YS * CS")) / D, "b": (F.expr("YS * CC - YC * CS")) / D})
    return rows.select("source", "k", "freq", ((F.expr("a * YC + b * YS")) / F.nullif("YY", F.lit(0.0))).alias("power"), F.col("y").alias("_y"), F.expr("y - a * c - b * s").alias("c0"), F.col("b").alias("cs"), F.col("a").alias("cc"), "m")


def best_frequency(periodogram: DataFrame, cut: float = 0.0) -> DataFrame:
    """The strongest frequency of each source (ties: the lowest), after cutting a share of the grid off both ends; with
    the model's amplitude and Baluev's estimate of the false-alarm probability for n samples."""
    if cut:
        last = F.max("k").over(W.partitionBy("source"))
        periodogram = periodogram.withColumn("_n", last).filter((F.col("k") >= cut * F.col("_n")) & (F.col("k") <= (1 - cut) * F.col("_n")))
    best = periodogram.groupBy("source").agg(F.max(F.struct(F.col("power"), (-F.col("freq")).alias("minus"), "c0", "cs", "cc", "m")).alias("b"))
    return best.select(
        "source", (-F.col("b.minus")).alias("freq"), F.col("b.power").alias("power"), F.sqrt(F.col("b.cs") ** 2 + F.col("b.cc") ** 2).alias("amplitude"),
        F.col("b.c0").alias("c0"), F.col("b.cs").alias("cs"), F.col("b.cc").alias("cc"), F.col("b.m").alias("n"),
    )


def false_alarm(power: Column, n: Column, f_max: Column | float, time_variance: Column) -> Column:
    """Baluev (2008): false-alarm probability of the largest of a standard periodogram's peaks."""
    half = (n - 3) / 2
    tau = f_max * F.sqrt(4 * math.pi * time_variance) * F.pow(1 - power, (n - 4) / 2) * F.sqrt(half * power)
    return 1 - (1 - F.pow(1 - power, half)) * F.exp(-tau)


def false_alarm_level(probability: float, n: Column, f_max: Column | float, time_variance: Column, steps: int = 40) -> Column:
    """The power whose false-alarm probability is ``probability``, halved in on between 0 and 1; null under five samples."""
    half = lambda lo, hi: (lo + hi) / 2
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def closer(s: Column, _: Column) -> Column:
        middle = half(s["lo"], s["hi"])
        likely = false_alarm(middle, n, f_max, time_variance) > probability
        return F.struct(F.when(likely, middle).otherwise(s["lo"]).alias("lo"), F.when(likely, s["hi"]).otherwise(middle).alias("hi"))

    return F.when(n > 4, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, closer, lambda s: half(s["lo"], s["hi"])))


FEATURES = ("mean", "std", "min", "max", "median", "p25", "p75", "skew", "best_freq", "best_power", "power_std", "diff_std", "diff_abs")


def feature_vectors(lc: DataFrame, low: float, high: float, n: int, least: int = 11) -> DataFrame:
    """(source, features): the statistics named in ``FEATURES``, in that order, divided by the vector's length. Sources under
    ``least`` samples have zeros for their periodogram, single samples zeros for differences, constant ones no skew.
    Nothing is padded: a longer vector would hold no more."""
    shape = lc.groupBy("source").agg(F.avg("mag").alias("mean"), F.stddev_pop("mag").alias("std"), F.min("mag").alias("min"), F.max("mag").alias("max"), F.skewness("mag").alias("skew"))
    middle = quantiles(lc, ["source"], "mag", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    stepped = windowed(lc, ["source"], ["t", "mag"], 1, 0, lambda w: {"d": F.col("mag") - F.lag("mag").over(w)})
    steps = stepped.groupBy("source").agg(F.stddev_pop("d").alias("diff_std"), F.avg(F.abs("d")).alias("diff_abs"))
    # The best of a source's powers and their spread, in one aggregate.
    waves = lomb_scargle(lc, low, high, n, least=least).groupBy("source").agg(F.max(F.struct("power", (-F.col("freq")).alias("minus"))).alias("b"), F.stddev_pop("power").alias("power_std"))
    waves = waves.select("source", (-F.col("b.minus")).alias("best_freq"), F.col("b.power").alias("best_power"), "power_std")
    rows = shape.join(middle, "source", "left").join(steps, "source", "left").join(waves, "source", "left")
    rows = rows.select("source", F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in FEATURES]).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    return rows.select("source", length.alias("length"), "raw").select("source", F.transform("raw", lambda x: x / F.col("length")).alias("features"))


def with_model(lc: DataFrame, best: DataFrame) -> DataFrame:
    """Samples with their source's model and what is left when the flux is divided by it."""
    arg = F.lit(TWO_PI) * F.col("freq") * F.col("t")
    rows = lc.join(best.select("source", "freq", "c0", "cs", "cc"), "source").withColumn("model", F.col("c0") + F.col("cs") * F.sin(arg) + F.col("cc") * F.cos(arg))
    return rows.withColumn("residual", F.col("mag") / F.nullif("model", F.lit(0.0)))


def prewhiten(lc: DataFrame, low: float, high: float, n: int, rounds: int = 2) -> DataFrame:
    """(source, round, freq, power): search, divide by the model, search again."""
    out = None
    for turn in range(1, rounds + 1):
        best = best_frequency(lomb_scargle(lc, low, high, n))
        best = stored(best) if turn < rounds else best  # a row for each source, read by the next round too
        found = best.select("source", F.lit(turn).alias("round"), "freq", "power")
        out = found if out is None else out.unionByName(found)
        if turn < rounds:
            lc = with_model(lc, best).select("source", "band", "t", F.col("residual").alias("mag"), "flag")
    return out


def sine_fit(binned: DataFrame, bins: int) -> DataFrame:
    """Least-squares sinusoid through a binned profile (source, bin, mag): amplitude, phase and constant."""
    arg = F.lit(TWO_PI) * (F.col("bin") + 0.5) / bins
    v = lambda name: F.col(f"_{name}") / F.col("_w")
    s = binned.groupBy("source").agg(*_sums(F.lit(1.0), F.col("mag"), arg), F.count("*").alias("m")).filter("m >= 4")
    s = s.select("source", v("y").alias("y"), v("c").alias("c"), v("s").alias("s"), (v("yc") - v("y") * v("c")).alias("YC"), (v("ys") - v("y") * v("s")).alias("YS"), (v("cc") - v("c") * v("c")).alias("CC"), (v("ss") - v("s") * v("s")).alias("SS"), (v("cs") - v("c") * v("s")).alias("CS"))
    D = F.nullif(F.expr("CC * SS - CS * CS"), F.lit(0.0))
    s = s.withColumns({"a": F.expr("YC * SS - YS * CS") / D, "b": F.expr("YS * CC - YC * CS") / D})
    return s.select("source", F.sqrt(F.expr("a * a + b * b")).alias("amplitude"), F.atan2("a", "b").alias("phase"), F.expr("y - a * c - b * s").alias("constant"))


def peaks(series: DataFrame, height: float, distance: int) -> DataFrame:
    """Local maxima of (source, k, power) of at least ``height`` with no higher sample within ``distance`` steps."""
    w = W.partitionBy("source").orderBy("k")
    near = W.partitionBy("source").orderBy("k").rangeBetween(-distance, distance)
    rows = series.withColumns({"_l": F.lag("power").over(w), "_r": F.lead("power").over(w), "_m": F.max("power").over(near)})
    return rows.filter((F.col("power") > F.col("_l")) & (F.col("power") > F.col("_r")) & (F.col("power") >= height) & (F.col("power") == F.col("_m"))).select("source", "k", "power")


# Factors of distance and of height, tried in this order.
RETRIES = ((1, 1.0), (5, 1.0), (10, 1.0), (10, 1.8))


def peaks_retried(series: DataFrame, height: float, distance: int, most: int = 50, retries: tuple[tuple[int, float], ...] = RETRIES) -> DataFrame:
    """(source, rank, k, power, turn): each source's peaks, highest first (ties: the smaller k), by the first of the
    ``retries`` that leaves ``most`` or fewer; by the last one where none does. One sort of a source serves all distances."""
    w = W.partitionBy("source").orderBy("k")
    reach = {d: W.partitionBy("source").orderBy("k").rangeBetween(-d * distance, d * distance) for d, _ in retries}
    rows = series.withColumns({"_l": F.lag("power").over(w), "_r": F.lead("power").over(w)} | {f"_m{d}": F.max("power").over(near) for d, near in reach.items()})
    rows = rows.filter((F.col("power") > F.col("_l")) & (F.col("power") > F.col("_r")) & (F.col("power") >= height))
    turns = F.array_compact(F.array(*[F.when((F.col("power") == F.col(f"_m{d}")) & (F.col("power") >= height * h), F.lit(i)) for i, (d, h) in enumerate(retries)]))
    found = rows.select("source", "k", "power", turns.alias("turns"))
    # How many each turn finds; a source may lose all in a later one, so counts of none count too.
    counts = [F.count_if(F.array_contains("turns", i)).alias(f"_c{i}") for i in range(len(retries))]
    chosen = F.lit(len(retries) - 1)
    for i in reversed(range(len(retries) - 1)):
        chosen = F.when(F.col(f"_c{i}") <= most, i).otherwise(chosen)
    turn = found.groupBy("source").agg(*counts).select("source", chosen.alias("turn"))
    kept = found.join(turn, "source").filter(F.array_contains("turns", F.col("turn")))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("power"), "k"))
    return kept.select("source", rank.alias("rank"), "k", "power", "turn")


# Thresholds in standard deviations above the mean, tried in this order.
LADDER = (5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.7, 0.6)


def peak_ladder(series: DataFrame, wanted: int, distance: int, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """For each source the first rung whose threshold (mean + rung * sigma) leaves ``wanted`` peaks or more."""
    stats = series.groupBy("source").agg(F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))
    rungs = F.explode(F.array(*[F.struct(F.lit(k).alias("rung"), F.lit(x).alias("sigmas")) for k, x in enumerate(ladder)])).alias("r")
    found = peaks(series, float("-inf"), distance).join(stats, "source").select("source", "power", "mean", "std", rungs)
    passed = found.filter(F.col("power") >= F.col("mean") + F.col("r.sigmas") * F.col("std")).groupBy("source", "r.rung", "r.sigmas").agg(F.count("*").alias("n_peaks"))
    first = passed.filter(F.col("n_peaks") >= wanted).groupBy("source").agg(F.min(F.struct("rung", "sigmas", "n_peaks")).alias("f"))
    return first.select("source", "f.sigmas", "f.n_peaks")


def detrend_rolling(lc: DataFrame, half: int, gap: float | None = None, steps: float | None = None) -> DataFrame:
    """Trend (mean of up to 2 * half + 1 samples of the same run) and flattened values. A gap longer than ``gap`` days, or
    than ``steps`` times the source's median step, starts a new run. A source is cut into blocks of its order."""
    rows = windowed(lc, ["source"], ["t", "mag"], 1, 0, lambda w: {"_step": F.col("t") - F.lag("t").over(w)})
    if steps is not None:
        rows = beside(rows, quantiles(rows, ["source"], "_step", {"_mid": 0.5}), ["source"])
    long = F.col("_step") > (F.lit(gap) if steps is None else steps * F.col("_mid"))
    rows = scanned(rows, ["source"], ["t", "mag"], {"run": F.coalesce(long.cast("int"), F.lit(0))}).drop("_step", "_mid")
    rows = windowed(rows, ["source", "run"], ["t", "mag"], half, half, lambda w: {"trend": F.avg("mag").over(w.rowsBetween(-half, half))})
    return rows.withColumn("flat", F.col("mag") / F.nullif("trend", F.lit(0.0)))


def running_median(lc: DataFrame, half: int = 1) -> DataFrame:
    return windowed(lc, ["source"], ["t", "mag"], half, half, lambda w: {"smooth": F.percentile("mag", 0.5).over(w.rowsBetween(-half, half))})


def minimum_epoch(profile: DataFrame, period: float, bins: int, epoch: float = 0.0) -> DataFrame:
    """Epoch of minimum: the lowest bin of a profile, refined by the parabola through it and its two neighbours."""
    w = W.partitionBy("source").orderBy("bin")
    rows = profile.withColumns({"_l": F.lag("mag").over(w), "_r": F.lead("mag").over(w)})
    low = rows.groupBy("source").agg(F.min(F.struct("mag", "bin", "_l", "_r")).alias("b"))
    curve = F.col("b._l") - 2 * F.col("b.mag") + F.col("b._r")
    shift = F.coalesce(0.5 * (F.col("b._l") - F.col("b._r")) / F.nullif(curve, F.lit(0.0)), F.lit(0.0))
    at = (F.col("b.bin") + 0.5 + shift) / bins
    return low.select("source", at.alias("phase_min"), (F.lit(epoch) + at * period).alias("epoch_min"))


def ephemeris(epochs: DataFrame, period: float, n: int) -> DataFrame:
    """Predicted minima epoch + period * E for E = 0..n."""
    return epochs.select("source", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("e"), "epoch_min").select("source", "e", (F.col("epoch_min") + period * F.col("e")).alias("t_min"))


def band_agreement(best: DataFrame, one: str, two: str, tolerance: float = 0.05) -> DataFrame:
    """Two bands' best periods (source, band, period, power): double when they agree, and whether either is an
    observing alias (a day or half a day, within 8 and 7 minutes)."""
    a = best.filter(F.col("band") == one).select("source", F.col("period").alias("p1"), F.col("power").alias("w1"))
    b = best.filter(F.col("band") == two).select("source", F.col("period").alias("p2"), F.col("power").alias("w2"))
    alias = lambda p: (F.abs(p - 1.0) < 8 / 1440) | (F.abs(p - 0.5) < 7 / 1440)
    near = F.abs(F.col("p1") - F.col("p2")) / F.greatest("p1", "p2") < tolerance
    return a.join(b, "source").select("source", "p1", "p2", F.when(near, "double").otherwise("single").alias("identified"), (alias(F.col("p1")) | alias(F.col("p2"))).alias("alias"))


def identified(best: DataFrame, one: str, two: str, tolerance: float = 0.05, over: float = 1.25) -> DataFrame:
    """(source, p1, p2, identified) of the sources whose two bands (source, band, period in days, power, level) report a
    period: those that agree within ``tolerance`` ("double"), or of which one is ``over`` times above its false-alarm level
    ("single"). A band at a day or half a day proves nothing: a pair is vetoed when the other band is such too, or weak."""
    side = lambda band, i: best.filter(F.col("band") == band).select("source", F.col("period").alias(f"p{i}"), F.col("power").alias(f"w{i}"), F.col("level").alias(f"l{i}"))
    alias = lambda i: (F.abs(F.col(f"p{i}") - 1.0) < 8 / 1440) | (F.abs(F.col(f"p{i}") - 0.5) < 7 / 1440)
    weak = lambda i: F.col(f"w{i}") < F.col(f"l{i}")
    strong = lambda i: F.col(f"w{i}") > over * F.col(f"l{i}")
    same = F.abs(F.col("p1") - F.col("p2")) / F.col("p2") < tolerance
    veto = (alias(1) & (alias(2) | weak(2))) | (alias(2) & (alias(1) | weak(1)))
    rows = side(one, 1).join(side(two, 2), "source").filter((same | strong(1) | strong(2)) & ~veto)
    return rows.select("source", "p1", "p2", F.when(same, "double").otherwise("single").alias("identified"))


def monte_carlo(lc: DataFrame, draws: int, error: float, seed: int) -> DataFrame:
    """Draws of each source's mean magnitude when every sample is moved by a normal error. The noise of a sample and
    draw is made from hashes, so it does not depend on how the rows are spread."""
    u = lambda name: (F.pmod(F.xxhash64("source", "t", "mag", "draw", F.lit(f"{seed}{name}")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    noise = F.sqrt(-2 * F.log(u("a"))) * F.cos(F.lit(TWO_PI) * u("b"))
    rows = lc.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.groupBy("source", "draw").agg(F.avg(F.col("mag") + error * noise).alias("mean"))


def sample_statistics(draws: DataFrame, value: str, by: str = "source") -> DataFrame:
    """Median, 16th and 84th percentile, and the errors to either side."""
    p = quantiles(draws, [by], value, {"median": 0.5, "p16": 0.16, "p84": 0.84})
    return p.select(by, "median", "p16", "p84", (F.col("p84") - F.col("median")).alias("upper"), (F.col("median") - F.col("p16")).alias("lower"))
