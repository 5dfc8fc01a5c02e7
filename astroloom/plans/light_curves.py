"""Light-curve queries over the event table: source = user, band = event type, magnitude = value."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import astro
from ..operators import timeseries as ts
from ..sources import readers
from ..sources.shared import spread
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

LC = """lc AS (SELECT user_id AS source, event_type AS band, (epoch_us(ts) - 1704067200000000) / 8.64e10 AS t, value AS mag,
  CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 10 = 0 THEN 1 ELSE 0 END AS flag FROM events),
good AS (SELECT * FROM lc WHERE flag = 0 AND t IS NOT NULL AND mag IS NOT NULL)"""
FREQS = (0.05, 1.0, 60)
PERIODS = (1.0, 20.0, 40)
FOLD, BINS = 7.0, 12


def _good(spark, sf):
    return ts.good(ts.light_curves(spread(table(spark, sf, "events"))))


def _rounded(df, *columns, places=4):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _nudged(df, *columns):
    """For means of values in hundredths, which often lie on a rounding edge; the SQL adds the same billionth."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in columns})


@query(f"WITH {LC} SELECT source, count(*) AS n, count(DISTINCT band) AS n_bands, round(max(t) - min(t), 4) AS span, min(mag) AS mag_min, max(mag) AS mag_max FROM good GROUP BY source")
def lc_extent(spark, sf):
    return _rounded(ts.extent(_good(spark, sf)), "span").select("source", "n", "n_bands", "span", "mag_min", "mag_max")


@query(f"""WITH {LC} SELECT source, band, count(*) AS n, round(median(mag) + 1e-9, 4) AS mag_median, round(avg(mag) + 1e-9, 4) AS mag_mean, min(mag) AS mag_min, max(mag) AS mag_max,
  round(max(mag) - min(mag) + 1e-9, 4) AS mag_delta, round(stddev_pop(mag) + 1e-9, 4) AS mag_std, round((max(mag) - min(mag)) / 2 / median(mag) + 1e-9, 4) AS rel_semi_amp FROM good GROUP BY ALL""")
def lc_stats(spark, sf):
    return _nudged(ts.statistics(_good(spark, sf)), "mag_median", "mag_mean", "mag_delta", "mag_std", "rel_semi_amp")


@query(f"""WITH {LC}, s AS (SELECT source, median(mag) AS m, stddev_pop(mag) AS s FROM good GROUP BY source)
SELECT source, count(*) AS n_kept, round(avg(mag) + 1e-9, 4) AS mag_mean FROM good JOIN s USING (source) WHERE abs(mag - m) <= 3 * s GROUP BY source""")
def lc_sigma_clip(spark, sf):
    return _nudged(ts.sigma_clip(_good(spark, sf)).groupBy("source").agg(F.count("*").alias("n_kept"), F.avg("mag").alias("mag_mean")), "mag_mean")


@query(f"""WITH {LC}, s AS (SELECT source, median(mag) AS m, stddev_pop(mag) AS s FROM good GROUP BY source)
SELECT source, count(*) AS n_kept, max(mag) AS mag_max FROM good JOIN s USING (source) WHERE mag - m <= 1.5 * s AND m - mag <= 0.9 * s GROUP BY source""")
def lc_asymmetric_clip(spark, sf):
    return ts.sigma_clip(_good(spark, sf), 1.5, low=0.9).groupBy("source").agg(F.count("*").alias("n_kept"), F.max("mag").alias("mag_max"))


@query(f"""WITH {LC}, d AS (SELECT source, mag, mag - lag(mag) OVER (PARTITION BY source ORDER BY t, mag) AS d FROM good),
m AS (SELECT *, avg(mag) OVER (PARTITION BY source) AS mu FROM d)
SELECT source, round(avg(mag), 4) AS mean, round(stddev_pop(mag), 4) AS std, round(quantile_cont(mag, 0.25), 4) AS p25, round(quantile_cont(mag, 0.75), 4) AS p75,
  round(avg(power(mag - mu, 3)) / power(stddev_pop(mag), 3), 3) AS skew, round(stddev_pop(d), 4) AS diff_std, round(avg(abs(d)), 4) AS diff_abs FROM m GROUP BY source""")
def lc_diff_features(spark, sf):
    out = _rounded(ts.difference_features(_good(spark, sf)), "mean", "std", "p25", "p75", "diff_std", "diff_abs")
    return out.withColumn("skew", F.round("skew", 3))


@query(f"WITH {LC} SELECT source, CAST(floor(t / 2.0) AS BIGINT) AS slot, count(*) AS n, round(avg(mag) + 1e-9, 4) AS mag FROM good GROUP BY ALL")
def lc_downsample(spark, sf):
    return _nudged(ts.downsample(_good(spark, sf), 2.0), "mag")


PROFILE = f"b AS (SELECT source, CAST(floor((t / {FOLD} - floor(t / {FOLD})) * {BINS}) AS BIGINT) AS bin, count(*) AS n, avg(mag) AS mag FROM good GROUP BY ALL)"


@query(f"WITH {LC}, {PROFILE} SELECT source, bin, n, round(mag + 1e-9, 4) AS mag, round((max(mag) OVER w - min(mag) OVER w) / 2 + 1e-9, 4) AS semi_amp FROM b WINDOW w AS (PARTITION BY source)")
def lc_fold(spark, sf):
    return _nudged(ts.fold(_good(spark, sf), FOLD, BINS), "mag", "semi_amp")


_P = f"{PERIODS[0]}e0 + k * {(PERIODS[1] - PERIODS[0]) / (PERIODS[2] - 1)!r}e0"
PDM = f"""{LC}, total AS (SELECT source, var_pop(mag) AS v FROM good GROUP BY source HAVING count(*) >= 10),
g AS (SELECT good.source, v, k, {_P} AS p, t, mag FROM good JOIN total USING (source), (SELECT unnest(range({PERIODS[2]})) AS k)),
bins AS (SELECT source, v, k, p, floor((t / p - floor(t / p)) * 4) AS bin, var_pop(mag) AS b, count(*) AS m FROM g GROUP BY ALL),
th AS (SELECT source, k, p AS period, CASE WHEN v = 0 THEN 1.0 ELSE avg(CASE WHEN m > 1 THEN b END) / v END AS theta FROM bins GROUP BY source, k, p, v)"""


@query(f"WITH {PDM} SELECT source, CAST(k AS INT) AS k, round(period, 6) AS period, round(theta, 5) AS theta FROM th")
def lc_pdm(spark, sf):
    return ts.pdm(_good(spark, sf), *PERIODS).withColumns({"period": F.round("period", 6), "theta": F.round("theta", 5)})


@query(f"""WITH {PDM}, b AS (SELECT source, min(theta) AS lo, avg(theta) AS mean, stddev_pop(theta) AS std, max(theta) AS top FROM th GROUP BY source),
p AS (SELECT th.source, min(CASE WHEN theta = lo THEN period END) AS period, any_value(lo) AS theta, any_value((mean - lo) / nullif(std, 0)) AS significance,
  (max(CASE WHEN theta < (lo + top) / 2 THEN period END) - min(CASE WHEN theta < (lo + top) / 2 THEN period END)) / 2 AS w FROM th JOIN b USING (source) GROUP BY th.source)
SELECT source, round(period, 4) AS period, round(theta, 4) AS theta, round(1 - theta, 4) AS power, round(significance, 4) AS significance, round(greatest(w, period * 0.001), 4) AS period_error FROM p""")
def lc_pdm_best(spark, sf):
    return _rounded(ts.pdm_best(ts.pdm(_good(spark, sf), *PERIODS)), "period", "theta", "power", "significance", "period_error")


def _gls(source: str, mag: str, name: str) -> str:
    """SQL of a floating-mean periodogram of the rows (source, t, mag) of ``source``."""
    step = (FREQS[1] - FREQS[0]) / (FREQS[2] - 1)
    two = repr(2 * math.pi)
    return f"""{name}_g AS (SELECT source, k, {FREQS[0]}e0 + k * {step!r}e0 AS f, t, {mag} AS mag FROM {source}, (SELECT unnest(range({FREQS[2]})) AS k)),
{name}_a AS (SELECT source, k, f, count(*) AS m, avg(mag) AS y, avg(mag * mag) AS yy, avg(cos({two} * f * t)) AS c, avg(sin({two} * f * t)) AS s, avg(power(cos({two} * f * t), 2)) AS cc,
  avg(power(sin({two} * f * t), 2)) AS ss, avg(sin({two} * f * t) * cos({two} * f * t)) AS cs, avg(mag * cos({two} * f * t)) AS yc, avg(mag * sin({two} * f * t)) AS ys FROM {name}_g GROUP BY source, k, f HAVING count(*) >= 10),
{name}_d AS (SELECT *, yc - y * c AS ayc, ys - y * s AS ays, cc - c * c AS acc, ss - s * s AS ass, cs - c * s AS acs FROM {name}_a),
{name}_m AS (SELECT *, (ayc * ass - ays * acs) / nullif(acc * ass - acs * acs, 0) AS a, (ays * acc - ayc * acs) / nullif(acc * ass - acs * acs, 0) AS b FROM {name}_d),
{name} AS (SELECT source, k, f AS freq, (a * ayc + b * ays) / nullif(yy - y * y, 0) AS power, y - a * c - b * s AS c0, b AS cs, a AS cc, m FROM {name}_m),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY power DESC NULLS LAST, freq) AS r FROM {name}) WHERE r = 1)"""


@query(f"WITH {LC}, {_gls('good', 'mag', 'ls')} SELECT source, CAST(k AS INT) AS k, round(freq, 6) AS freq, round(power, 5) AS power FROM ls")
def lc_gls(spark, sf):
    return ts.lomb_scargle(_good(spark, sf), *FREQS).select("source", "k", F.round("freq", 6).alias("freq"), F.round("power", 5).alias("power"))


_OWN = _gls("good", "mag", "ls").replace("FROM good, (SELECT", "FROM good JOIN sp USING (source), (SELECT")


@query(f"""WITH {LC}, sp AS (SELECT source, 1 / (3e0 * (max(t) - min(t))) AS step FROM good GROUP BY source HAVING max(t) > min(t)),
{_OWN[:_OWN.index("ls_g AS")]}ls_g AS (SELECT source, k, 0.1e0 + k * step AS f, t, mag FROM (SELECT good.*, step, unnest(range(CAST(floor(0.9e0 / step) AS INT) + 1)) AS k FROM good JOIN sp USING (source)) u),
{_OWN[_OWN.index("ls_a AS"):]} SELECT source, CAST(k AS INT) AS k, round(freq, 6) AS freq, round(power, 5) AS power FROM ls""")
def lc_gls_spans(spark, sf):
    """Each source over its own grid: three samples to a peak, so the longer the span, the more frequencies."""
    return ts.lomb_scargle_spans(_good(spark, sf), 0.1, 1.0, 3.0).select("source", "k", F.round("freq", 6).alias("freq"), F.round("power", 5).alias("power"))


@query(f"WITH {LC}, {_gls('good', 'mag', 'ls')} SELECT source, round(freq, 6) AS freq, round(power, 5) AS power, round(sqrt(cs * cs + cc * cc), 4) AS amplitude, round(c0, 4) AS c0, m AS n FROM ls_best")
def lc_gls_best(spark, sf):
    best = ts.best_frequency(ts.lomb_scargle(_good(spark, sf), *FREQS))
    return best.select("source", F.round("freq", 6).alias("freq"), F.round("power", 5).alias("power"), F.round("amplitude", 4).alias("amplitude"), F.round("c0", 4).alias("c0"), "n")


_TV = "(SELECT source, var_pop(t) AS tv FROM good GROUP BY source)"


@query(f"""WITH {LC}, {_gls('good', 'mag', 'ls')}
SELECT source, round(1 - (1 - power(1 - power, (m - 3) / 2.0)) * exp(-({FREQS[1]} * sqrt(4 * {math.pi!r} * tv) * power(1 - power, (m - 4) / 2.0) * sqrt((m - 3) / 2.0 * power))), 5) AS fap
FROM ls_best JOIN {_TV} USING (source)""".replace("power(1 - power,", "pow(1 - power,"))
def lc_false_alarm(spark, sf):
    lc = _good(spark, sf)
    best = ts.best_frequency(ts.lomb_scargle(lc, *FREQS)).join(lc.groupBy("source").agg(F.var_pop("t").alias("tv")), "source")
    return best.select("source", F.round(ts.false_alarm(F.col("power"), F.col("n"), FREQS[1], F.col("tv")), 5).alias("fap"))


_MODEL = f"(c0 + cs * sin({2 * math.pi!r} * freq * t) + cc * cos({2 * math.pi!r} * freq * t))"


@query(f"""WITH {LC}, {_gls('good', 'mag', 'ls')}, res AS (SELECT source, t, mag / nullif({_MODEL}, 0) AS mag FROM good JOIN ls_best USING (source)), {_gls('res', 'mag', 'l2')}
SELECT source, 1 AS round, round(freq, 6) AS freq, round(power, 4) AS power FROM ls_best UNION ALL SELECT source, 2, round(freq, 6), round(power, 4) FROM l2_best""")
def lc_prewhiten(spark, sf):
    return ts.prewhiten(_good(spark, sf), *FREQS).select("source", "round", F.round("freq", 6).alias("freq"), F.round("power", 4).alias("power"))


@query(f"WITH {LC}, {_gls('good', 'mag', 'ls')} SELECT source, round(stddev_pop(mag - {_MODEL}), 4) AS residual_std, count(*) AS n FROM good JOIN ls_best USING (source) GROUP BY source")
def lc_model_residual(spark, sf):
    lc = _good(spark, sf)
    rows = ts.with_model(lc, ts.best_frequency(ts.lomb_scargle(lc, *FREQS)))
    return rows.groupBy("source").agg(F.round(F.stddev_pop(F.col("mag") - F.col("model")), 4).alias("residual_std"), F.count("*").alias("n"))


_A = f"{2 * math.pi!r} * (bin + 0.5) / {BINS}"


@query(f"""WITH {LC}, {PROFILE}, a AS (SELECT source, avg(mag) AS y, avg(cos({_A})) AS c, avg(sin({_A})) AS s, avg(pow(cos({_A}), 2)) AS cc, avg(pow(sin({_A}), 2)) AS ss, avg(sin({_A}) * cos({_A})) AS cs,
  avg(mag * cos({_A})) AS yc, avg(mag * sin({_A})) AS ys FROM b GROUP BY source HAVING count(*) >= 4),
d AS (SELECT *, yc - y * c AS ayc, ys - y * s AS ays, cc - c * c AS acc, ss - s * s AS ass, cs - c * s AS acs FROM a),
m AS (SELECT *, (ayc * ass - ays * acs) / nullif(acc * ass - acs * acs, 0) AS p, (ays * acc - ayc * acs) / nullif(acc * ass - acs * acs, 0) AS q FROM d)
SELECT source, round(sqrt(p * p + q * q), 4) AS amplitude, round(atan2(p, q), 3) AS phase, round(y - p * c - q * s, 4) AS constant FROM m""")
def lc_sinefit(spark, sf):
    return _rounded(ts.sine_fit(ts.fold(_good(spark, sf), FOLD, BINS), BINS), "amplitude", "constant").withColumn("phase", F.round("phase", 3))


@query(f"""WITH {LC}, {PROFILE}, n AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS r FROM b WINDOW w AS (PARTITION BY source ORDER BY bin)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mag, bin) AS i FROM n) WHERE i = 1),
e AS (SELECT source, (bin + 0.5 + coalesce(0.5 * (l - r) / nullif(l - 2 * mag + r, 0), 0)) / {BINS} * {FOLD} AS e0 FROM m)
SELECT source, CAST(e AS INT) AS e, round(e0 + {FOLD} * e, 4) AS t_min FROM e, (SELECT unnest(range(6)) AS e)""")
def lc_ephemeris(spark, sf):
    epochs = ts.minimum_epoch(ts.fold(_good(spark, sf), FOLD, BINS), FOLD, BINS)
    return _rounded(ts.ephemeris(epochs, FOLD, 5), "t_min")


DAILY = "s AS (SELECT source, CAST(floor(t) AS BIGINT) AS k, round(sum(mag), 6) AS power FROM good GROUP BY ALL)"


def _daily(spark, sf):
    lc = _good(spark, sf)
    return lc.groupBy("source", F.floor("t").alias("k")).agg(F.round(F.sum("mag"), 6).alias("power"))


_PEAKS = """x AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS r, max(power) OVER (PARTITION BY source ORDER BY k RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM s
  WINDOW w AS (PARTITION BY source ORDER BY k)), pk AS (SELECT source, k, power FROM x WHERE power > l AND power > r AND power = m)"""


@query(f"WITH {LC}, {DAILY}, {_PEAKS} SELECT * FROM pk WHERE power >= 50")
def lc_peaks(spark, sf):
    return ts.peaks(_daily(spark, sf), 50.0, 2)


_RUNGS = ", ".join(f"({k}, {x})" for k, x in enumerate(ts.LADDER))


@query(f"""WITH {LC}, {DAILY}, {_PEAKS}, st AS (SELECT source, avg(power) AS mu, stddev_pop(power) AS sd FROM s GROUP BY source),
c AS (SELECT source, rung, sigmas, count(*) AS n_peaks FROM pk JOIN st USING (source), (VALUES {_RUNGS}) AS r(rung, sigmas) WHERE power >= mu + sigmas * sd GROUP BY ALL HAVING count(*) >= 3)
SELECT source, CAST(sigmas AS DOUBLE) AS sigmas, n_peaks FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rung) AS i FROM c) WHERE i = 1""")
def lc_peak_ladder(spark, sf):
    return ts.peak_ladder(_daily(spark, sf), 3, 2)


@query(f"""WITH {LC}, n AS (SELECT source, t, mag, CASE WHEN t - lag(t) OVER w > 1.5 THEN 1 ELSE 0 END AS new FROM good WINDOW w AS (PARTITION BY source ORDER BY t, mag)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t, mag ROWS UNBOUNDED PRECEDING) AS run FROM n),
f AS (SELECT source, run, mag / nullif(avg(mag) OVER (PARTITION BY source, run ORDER BY t, mag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS flat FROM r)
SELECT source, CAST(run AS BIGINT) AS run, count(*) AS n, round(avg(flat), 4) AS flat_mean FROM f GROUP BY ALL""")
def lc_detrend(spark, sf):
    return ts.detrend_rolling(_good(spark, sf), 2, 1.5).groupBy("source", "run").agg(F.count("*").alias("n"), F.round(F.avg("flat"), 4).alias("flat_mean"))


@query(f"""WITH {LC}, n AS (SELECT source, t, mag, t - lag(t) OVER w AS step FROM good WINDOW w AS (PARTITION BY source ORDER BY t, mag)), md AS (SELECT source, median(step) AS mid FROM n GROUP BY source),
r AS (SELECT n.*, sum(CASE WHEN step > 3 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, mag ROWS UNBOUNDED PRECEDING) AS run FROM n JOIN md USING (source))
SELECT source, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY ALL""")
def lc_runs_by_step(spark, sf):
    """Runs that end where a gap is three times the source's median step."""
    return ts.detrend_rolling(_good(spark, sf), 2, steps=3.0).groupBy("source", "run").agg(F.count("*").alias("n"))


@query(f"""WITH {LC}, s AS (SELECT source, quantile_cont(mag, 0.5) OVER (PARTITION BY source ORDER BY t, mag ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM good)
SELECT source, round(sum(smooth), 3) AS total, round(max(smooth), 4) AS top FROM s GROUP BY source""")
def lc_running_median(spark, sf):
    return ts.running_median(_good(spark, sf)).groupBy("source").agg(F.round(F.sum("smooth"), 3).alias("total"), F.round(F.max("smooth"), 4).alias("top"))


@query(f"""WITH {LC}, c AS (SELECT source, mag - median(mag) OVER (PARTITION BY source) AS c, mag - 1.1 * min(mag) OVER (PARTITION BY source) AS lifted FROM good)
SELECT source, round(avg(c), 4) AS centred_mean, round(min(lifted), 4) AS lifted_min FROM c GROUP BY source""")
def lc_center(spark, sf):
    return ts.centred(_good(spark, sf)).groupBy("source").agg(F.round(F.avg("c"), 4).alias("centred_mean"), F.round(F.min("lifted"), 4).alias("lifted_min"))


@query(f"""WITH {LC}, s AS (SELECT source, band, count(*) AS n, (max(mag) - min(mag)) / 2 / median(mag) AS amp, stddev_pop(mag) / avg(0.05 * mag) AS ratio FROM good GROUP BY ALL)
SELECT source, band, n, round(amp, 4) AS amp, round(ratio, 4) AS ratio FROM s WHERE n >= 10 AND amp > 0.01 AND ratio > 1.02""")
def lc_gates(spark, sf):
    """Significance gates, with an error of 5 % of each magnitude."""
    return _rounded(ts.gates(_good(spark, sf)), "amp", "ratio")


_BAND_BEST = """sb AS (SELECT source || '|' || band AS source, t, mag FROM good WHERE band IN ('click', 'view'))"""


@query(f"""WITH {LC}, {_BAND_BEST}, {_gls('sb', 'mag', 'ls')}, p AS (SELECT split_part(source, '|', 1) AS src, split_part(source, '|', 2) AS band, 1 / freq AS period FROM ls_best)
SELECT CAST(a.src AS BIGINT) AS source, round(a.period, 4) AS p1, round(b.period, 4) AS p2, CASE WHEN abs(a.period - b.period) / greatest(a.period, b.period) < 0.05 THEN 'double' ELSE 'single' END AS identified,
  abs(a.period - 1) < 8 / 1440.0 OR abs(a.period - 0.5) < 7 / 1440.0 OR abs(b.period - 1) < 8 / 1440.0 OR abs(b.period - 0.5) < 7 / 1440.0 AS alias
FROM p a JOIN p b ON a.src = b.src AND a.band = 'click' AND b.band = 'view'""")
def band_agree(spark, sf):
    lc = _good(spark, sf).filter(F.col("band").isin("click", "view")).withColumn("source", F.struct("source", "band"))
    best = ts.best_frequency(ts.lomb_scargle(lc, *FREQS)).select(F.col("source.source").alias("source"), F.col("source.band").alias("band"), (1 / F.col("freq")).alias("period"), "power")
    return _rounded(ts.band_agreement(best, "click", "view"), "p1", "p2")


@query(f"""WITH {LC}, f AS (SELECT source, pow(10, 0.4 * (25 - mag)) AS flux FROM good)
SELECT source, round(avg(log10(flux)) + 1e-9, 6) AS log_flux, round(avg(25 - 2.5 * log10(flux)) + 1e-9, 4) AS mag, round(avg(abs(-2.5 / ln(10) * 0.02)), 6) AS mag_err FROM f GROUP BY source""")
def lc_flux(spark, sf):
    flux = _good(spark, sf).withColumn("flux", astro.mag_to_flux(F.col("mag")))
    return flux.groupBy("source").agg(F.round(F.avg(F.log10("flux")) + 1e-9, 6).alias("log_flux"), F.round(F.avg(astro.flux_to_mag(F.col("flux"))) + 1e-9, 4).alias("mag"), F.round(F.avg(astro.mag_error(F.col("flux"), 0.02 * F.col("flux"))), 6).alias("mag_err"))


@query("""SELECT l_orderkey AS source, band, count(*) AS n, round(avg(mag) + 1e-9, 4) AS mag FROM (
  SELECT l_orderkey, 'q' AS band, l_quantity AS mag FROM lineitem UNION ALL SELECT l_orderkey, 'd', nullif(l_discount, 0) FROM lineitem UNION ALL SELECT l_orderkey, 'x', nullif(l_tax, 0) FROM lineitem
) WHERE mag IS NOT NULL GROUP BY ALL""")
def epoch_unpivot(spark, sf):
    """Wide epoch photometry to one row per band, nulls dropped."""
    wide = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_quantity").alias("q"), F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("x"))
    return wide.unpivot(["source"], ["q", "d", "x"], "band", "mag").filter("mag IS NOT NULL").groupBy("source", "band").agg(F.count("*").alias("n"), F.round(F.avg("mag") + 1e-9, 4).alias("mag"))


@query()
def lc_monte_carlo(spark, sf):
    """Spread of each source's mean under its samples' errors; noise is beyond SQL."""
    return ts.sample_statistics(ts.monte_carlo(_good(spark, sf), 30, 0.5, 7), "mean")


@query(f"""WITH {LC}, p AS (SELECT source, mag, (t - 0.3e0 + 1.25e0) / 2.5e0 AS c FROM good), b AS (SELECT source, CAST(floor((c - floor(c)) * 8) AS INT) AS bin, mag FROM p),
g AS (SELECT source, bin, count(*) AS n, median(mag) AS mag, stddev_pop(mag) / sqrt(count(*)) AS error FROM b GROUP BY ALL)
SELECT source, bin, n, round(mag, 4) AS mag, round(error, 4) AS error, round((max(mag) OVER (PARTITION BY source) - min(mag) OVER (PARTITION BY source)) / 2, 4) AS semi_amp FROM g""")
def lc_fold_profile(spark, sf):
    """Medians and errors of phase bins, with an epoch and half a period's shift."""
    return _rounded(ts.fold_profile(_good(spark, sf), 2.5, 8, "median", 0.3, True), "mag", "error", "semi_amp")


@query(f"""WITH {LC}, f AS (SELECT source, t, mag, (t - min(t) OVER (PARTITION BY source)) / 2.5e0 AS c FROM good), p AS (SELECT source, t, mag, c - floor(c) AS phase FROM f)
SELECT source, round(mag, 6) AS mag, round(phase, 6) AS phase, row_number() OVER (PARTITION BY source ORDER BY phase, t, mag) - 1 AS place FROM p""")
def lc_phase_order(spark, sf):
    return ts.phase_ordered(_good(spark, sf), 2.5).select("source", F.round("mag", 6).alias("mag"), F.round("phase", 6).alias("phase"), "place")


@query(f"""WITH {LC}, s AS (SELECT source, median(mag) AS m, stddev_pop(mag) AS s FROM good GROUP BY source)
SELECT source, count(*) AS n, count(CASE WHEN mag < m + 1.5 * s AND mag > m - 0.9 * s THEN mag END) AS n_kept, max(CASE WHEN mag < m + 1.5 * s AND mag > m - 0.9 * s THEN mag END) AS mag_max FROM good JOIN s USING (source) GROUP BY source""")
def lc_null_clip(spark, sf):
    rows = ts.clipped_to_null(_good(spark, sf), "mag", ("source",), 1.5, 0.9)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("mag").alias("n_kept"), F.max("mag").alias("mag_max"))


@query(f"""WITH {LC}, e AS (SELECT source, mag, 0.01e0 * mag + 0.001e0 AS error FROM good), s AS (SELECT source, count(*) AS n, median(mag) AS m, stddev_pop(mag) AS s, median(error) AS me, stddev_pop(error) AS se FROM e GROUP BY source),
c AS (SELECT source, n, CASE WHEN s = 0 OR abs(mag - m) < 2.00000001e0 * s THEN mag END AS mag, CASE WHEN se = 0 OR abs(error - me) < 2.00000001e0 * se THEN error END AS error FROM e JOIN s USING (source))
SELECT source, n, count(mag) AS n_kept, round(stddev_pop(mag) / nullif(avg(error), 0) + 1e-9, 4) AS over_mean, round(stddev_pop(mag) / nullif(median(error), 0) + 1e-9, 4) AS over_median FROM c GROUP BY source, n""")
def lc_error_stats(spark, sf):
    """With an error that grows with the magnitude."""
    rows = ts.error_statistics(_good(spark, sf).withColumn("error", 0.01 * F.col("mag") + 0.001), by=("source",), k=2.0)
    return _nudged(rows.select("source", "n", "n_kept", "over_mean", "over_median"), "over_mean", "over_median")


_FAP = f"1 - (1 - pow(1 - z, (m - 3) / 2.0)) * exp(-({FREQS[1]} * sqrt(4 * {math.pi!r} * tv) * pow(1 - z, (m - 4) / 2.0) * sqrt((m - 3) / 2.0 * z)))"
_LEVELS = f"""fal AS (SELECT source, p, (lo + hi) / 2 AS level FROM (WITH RECURSIVE h AS (SELECT source, m, tv, p, 0 AS i, 0e0 AS lo, 1e0 AS hi FROM ls_best JOIN {_TV} USING (source), (VALUES (0.1e0), (0.01e0)) AS q(p)
UNION ALL SELECT source, m, tv, p, i + 1, CASE WHEN {_FAP.replace("z", "((lo + hi) / 2)")} > p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_FAP.replace("z", "((lo + hi) / 2)")} > p THEN hi ELSE (lo + hi) / 2 END FROM h WHERE i < 40) SELECT * FROM h WHERE i = 40))"""


@query(f"""WITH {LC}, {_gls('good', 'mag', 'ls')}, {_LEVELS} SELECT source, round(max(CASE WHEN p = 0.1 THEN level END), 5) AS level_10, round(max(CASE WHEN p = 0.01 THEN level END), 5) AS level_1,
  round(max(power) / max(CASE WHEN p = 0.01 THEN level END), 4) AS ratio FROM ls_best JOIN fal USING (source) GROUP BY source""")
def lc_false_alarm_levels(spark, sf):
    lc = _good(spark, sf)
    best = ts.best_frequency(ts.lomb_scargle(lc, *FREQS)).join(lc.groupBy("source").agg(F.var_pop("t").alias("tv")), "source")
    level = lambda p: ts.false_alarm_level(p, F.col("n"), FREQS[1], F.col("tv"))
    rows = best.select("source", "power", level(0.1).alias("level_10"), level(0.01).alias("level_1"))
    return rows.select("source", F.round("level_10", 5).alias("level_10"), F.round("level_1", 5).alias("level_1"), F.round(F.col("power") / F.col("level_1"), 4).alias("ratio"))


_STEPS = "d AS (SELECT source, mag, mag - lag(mag) OVER (PARTITION BY source ORDER BY t, mag) AS d FROM good)"


@query(f"""WITH {LC}, {_gls('good', 'mag', 'ls').replace('>= 10', '>= 11')}, {_STEPS}, p AS (SELECT source, stddev_pop(power) AS ps FROM ls GROUP BY source),
f AS (SELECT source, avg(mag) AS a, stddev_pop(mag) AS b, min(mag) AS c, max(mag) AS e, median(mag) AS g, quantile_cont(mag, 0.25) AS h, quantile_cont(mag, 0.75) AS i,
  coalesce(avg(power(mag - u, 3)) / nullif(power(stddev_pop(mag), 3), 0), 0) AS j, stddev_pop(d) AS o, avg(abs(d)) AS q FROM d JOIN (SELECT source, avg(mag) AS u FROM good GROUP BY source) USING (source) GROUP BY source),
v AS (SELECT source, [a, b, c, e, g, h, i, j, coalesce(freq, 0), coalesce(power, 0), coalesce(ps, 0), coalesce(o, 0), coalesce(q, 0)] AS raw FROM f LEFT JOIN ls_best USING (source) LEFT JOIN p USING (source))
SELECT source, CAST(unnest(range(13)) AS INT) AS dim, round(unnest(list_transform(raw, lambda x: x / (sqrt(list_sum(list_transform(raw, lambda y: y * y))) + 1e-8))), 5) AS value FROM v""")
def lc_feature_vectors(spark, sf):
    rows = ts.feature_vectors(_good(spark, sf), *FREQS)
    return rows.select("source", F.posexplode("features").alias("dim", "value")).withColumn("value", F.round("value", 5))


_REACHES = ", ".join(f"max(power) OVER (PARTITION BY source ORDER BY k RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS m{d}" for d in (1, 5, 10))


@query(f"""WITH {LC}, {DAILY}, x AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS r, {_REACHES} FROM s WINDOW w AS (PARTITION BY source ORDER BY k)),
f AS (SELECT source, k, power, power = m1 AS t0, power = m5 AS t1, power = m10 AS t2, power = m10 AND power >= 36 AS t3 FROM x WHERE power > l AND power > r AND power >= 20),
c AS (SELECT source, CASE WHEN count(*) FILTER (t0) <= 2 THEN 0 WHEN count(*) FILTER (t1) <= 2 THEN 1 WHEN count(*) FILTER (t2) <= 2 THEN 2 ELSE 3 END AS turn FROM f GROUP BY source)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY power DESC, k) AS INT) AS rank, k, power, CAST(turn AS INT) AS turn FROM f JOIN c USING (source) WHERE CASE turn WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END""")
def lc_peaks_retried(spark, sf):
    return ts.peaks_retried(_daily(spark, sf), 20.0, 1, 2)


@query(f"""WITH {LC}, {_BAND_BEST}, {_gls('sb', 'mag', 'ls')}, p AS (SELECT split_part(source, '|', 1) AS src, split_part(source, '|', 2) AS band, 1 / freq AS period, power FROM ls_best),
b AS (SELECT CAST(x.src AS BIGINT) AS source, x.period AS p1, y.period AS p2, x.power AS w1, y.power AS w2, abs(x.period - y.period) / y.period < 0.05 AS same,
  abs(x.period - 1) < 8 / 1440.0 OR abs(x.period - 0.5) < 7 / 1440.0 AS a1, abs(y.period - 1) < 8 / 1440.0 OR abs(y.period - 0.5) < 7 / 1440.0 AS a2 FROM p x JOIN p y ON x.src = y.src AND x.band = 'click' AND y.band = 'view')
SELECT source, round(p1, 4) AS p1, round(p2, 4) AS p2, CASE WHEN same THEN 'double' ELSE 'single' END AS identified FROM b
WHERE (same OR w1 > 1.25 * 0.3 OR w2 > 1.25 * 0.3) AND NOT (a1 AND a2) AND NOT (a1 AND w2 < 0.3) AND NOT (a2 AND w1 < 0.3)""")
def band_identified(spark, sf):
    lc = _good(spark, sf).filter(F.col("band").isin("click", "view")).withColumn("source", F.struct("source", "band"))
    best = ts.best_frequency(ts.lomb_scargle(lc, *FREQS)).select(F.col("source.source").alias("source"), F.col("source.band").alias("band"), (1 / F.col("freq")).alias("period"), "power")
    return _rounded(ts.identified(best.withColumn("level", F.lit(0.3)), "click", "view"), "p1", "p2")


@query("""SELECT l_orderkey AS source, band, CAST(l_linenumber AS DOUBLE) AS t, mag, err FROM (SELECT l_orderkey, 'W1' AS band, l_linenumber, nullif(l_discount, 0) AS mag, l_tax AS err FROM lineitem
UNION ALL SELECT l_orderkey, 'W2', l_linenumber, nullif(l_tax, 0), l_discount FROM lineitem) WHERE mag IS NOT NULL""")
def infrared_epochs(spark, sf):
    """Lines of an order stand for the epochs of a source; no discount and no tax for a missing magnitude."""
    none = lambda c: F.nullif(c, F.lit(0.0))
    wide = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("mjd"), none("l_discount").alias("w1mpro"), F.col("l_tax").alias("w1sigmpro"), none("l_tax").alias("w2mpro"), F.col("l_discount").alias("w2sigmpro"))
    return readers.paired_epochs(wide)


@query(f"""SELECT l_orderkey AS source, band, l_linenumber + {readers.GAIA_JD!r}e0 AS t, mag, round(abs(-2.5e0 / ln(10) * err / flux), 8) AS err FROM (SELECT l_orderkey, 'G' AS band, l_linenumber, l_quantity AS mag, l_extendedprice AS flux, l_tax AS err FROM lineitem
UNION ALL SELECT l_orderkey, 'BP', l_linenumber, nullif(l_discount, 0), l_extendedprice, l_tax FROM lineitem UNION ALL SELECT l_orderkey, 'RP', l_linenumber, nullif(l_tax, 0), l_extendedprice, l_tax FROM lineitem) WHERE mag IS NOT NULL""")
def optical_epochs(spark, sf):
    none = lambda c: F.nullif(c, F.lit(0.0))
    line = table(spark, sf, "lineitem")
    columns = [c for b, m in (("G", F.col("l_quantity")), ("BP", none("l_discount")), ("RP", none("l_tax"))) for c in (F.col("l_linenumber").alias(f"Time{b}"), F.col("l_extendedprice").alias(f"F{b}"), F.col("l_tax").alias(f"e_F{b}"), m.alias(f"{b}mag"))]
    return readers.gaia_epochs(line.select(F.col("l_orderkey").alias("source"), *columns)).withColumn("err", F.round("err", 8))
