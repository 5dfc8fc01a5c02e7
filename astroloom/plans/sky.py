"""Sky queries: customers, suppliers and parts get positions from their keys, spread over the sphere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import astro
from ..operators import selection
from ..operators import sky as s
from ..sources.shared import spread
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

RADIUS, NSIDE = 3.0, 16


def _sky(spark, sf, name, key, mag):
    k = F.col(key).cast("double")
    u = k * 0.618034 - F.floor(k * 0.618034)
    return table(spark, sf, name).select(F.col(key).alias("id"), (k * 137.508 - 360 * F.floor(k * 137.508 / 360)).alias("ra"), F.degrees(F.asin(2 * u - 1)).alias("dec"), F.col(mag).alias("m"))


def _sql(alias, name, key, mag):
    k = f"CAST({key} AS DOUBLE)"
    return f"{alias} AS (SELECT {key} AS id, {k} * 137.508e0 - 360 * floor({k} * 137.508e0 / 360) AS ra, degrees(asin(2 * ({k} * 0.618034e0 - floor({k} * 0.618034e0)) - 1)) AS dec, {mag} AS m FROM {name})"


CUST, SUPP, PART = ("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"), ("part", "p_partkey", "p_retailprice")
C, S, P = _sql("c", *CUST), _sql("s", *SUPP), _sql("p", *PART)


def _sep(a, b):
    return f"degrees(2 * asin(sqrt(least(pow(sin(radians(({b}.dec - {a}.dec) / 2)), 2) + cos(radians({a}.dec)) * cos(radians({b}.dec)) * pow(sin(radians(({b}.ra - {a}.ra) / 2)), 2), 1))))"


@query(f"WITH {C}, q AS (SELECT 150.0e0 AS ra, 20.0e0 AS dec), r AS (SELECT id, m, round({_sep('c', 'q')}, 6) AS sep FROM c, q) SELECT * FROM r WHERE sep <= 20 ORDER BY m, id LIMIT 10")
def cone_topn(spark, sf):
    return s.cone(_sky(spark, sf, *CUST), 150.0, 20.0, 20.0, "m", 10).select("id", "m", F.round("sep", 6).alias("sep"))


@query(f"WITH {C}, {S}, x AS (SELECT s.id AS target, c.id AS id, {_sep('s', 'c')} AS sep FROM s, c), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sep, id) AS r FROM x WHERE sep <= {RADIUS}) SELECT s.id AS target, b.id, round(sep, 6) AS sep FROM s LEFT JOIN b ON s.id = target AND r = 1")
def xmatch_nearest(spark, sf):
    return s.nearest(_sky(spark, sf, *SUPP), _sky(spark, sf, *CUST), RADIUS).select("target", "id", F.round("sep", 6).alias("sep"))


@query(f"WITH {P}, {S}, x AS (SELECT s.id AS target, p.id AS id, {_sep('s', 'p')} AS sep FROM s, p), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sep, id) AS rank FROM x WHERE sep <= {RADIUS}) SELECT target, id, CAST(rank AS INT) AS rank, round(sep, 6) AS sep FROM b WHERE rank <= 3")
def xmatch_top3(spark, sf):
    return s.nearest(_sky(spark, sf, *SUPP), _sky(spark, sf, *PART), RADIUS, 3).filter("id IS NOT NULL").select("target", "id", "rank", F.round("sep", 6).alias("sep"))


@query(f"""WITH {C}, {P}, {S}, a AS (SELECT s.id AS target, count(*) AS n FROM s, c WHERE {_sep('s', 'c')} <= {RADIUS} GROUP BY s.id), b AS (SELECT s.id AS target, count(*) AS n FROM s, p WHERE {_sep('s', 'p')} <= {RADIUS} GROUP BY s.id)
SELECT s.id AS target, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS parts, CAST(a.n IS NOT NULL AS INT) + CAST(b.n IS NOT NULL AS INT) AS n_matched FROM s LEFT JOIN a ON s.id = a.target LEFT JOIN b ON s.id = b.target""")
def xmatch_counts(spark, sf):
    return s.match_counts(_sky(spark, sf, *SUPP), {"customers": _sky(spark, sf, *CUST), "parts": _sky(spark, sf, *PART)}, RADIUS)


@query(f"""WITH {C}, {P}, {S}, x AS (SELECT s.id AS target, 0 AS release, c.id AS id, {_sep('s', 'c')} AS sep FROM s, c UNION ALL SELECT s.id, 1, p.id, {_sep('s', 'p')} FROM s, p)
SELECT target, release, id, round(sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY release, sep, id) AS r FROM x WHERE sep <= 1.5) WHERE r = 1""")
def release_fallback(spark, sf):
    return s.with_fallback(_sky(spark, sf, *SUPP), [_sky(spark, sf, *CUST), _sky(spark, sf, *PART)], 1.5).withColumn("sep", F.round("sep", 6))


_G = astro.GALACTIC
_V = ("cos(radians(dec)) * cos(radians(ra))", "cos(radians(dec)) * sin(radians(ra))", "sin(radians(dec))")
_X, _Y, _Z = (" + ".join(f"({m!r}e0) * {v}" for m, v in zip(row, _V)) for row in _G)


@query(f"WITH {C}, g AS (SELECT id, degrees(atan2({_Y}, {_X})) AS l, degrees(asin(greatest(least({_Z}, 1), -1))) AS b FROM c) SELECT id, round(CASE WHEN l < 0 THEN l + 360 ELSE l END, 5) AS l, round(b, 5) AS b FROM g")
def galactic(spark, sf):
    l, b = astro.galactic(F.col("ra"), F.col("dec"))  # noqa: E741
    return _sky(spark, sf, *CUST).select("id", F.round(l, 5).alias("l"), F.round(b, 5).alias("b"))


@query(f"WITH {C}, g AS (SELECT id, degrees(atan2({_Y}, {_X})) AS l0, degrees(asin(greatest(least({_Z}, 1), -1))) AS b FROM c), h AS (SELECT id, CASE WHEN l0 < 0 THEN l0 + 360 ELSE l0 END AS l, b FROM g) SELECT id, CAST(least(greatest(floor(l / 360 * 36), 0), 35) AS BIGINT) AS x, CAST(least(greatest(floor((90 - b) / 180 * 18), 0), 17) AS BIGINT) AS y FROM h")
def dust_grid(spark, sf):
    """Cells of a rectangular galactic map, clamped to it."""
    l, b = astro.galactic(F.col("ra"), F.col("dec"))  # noqa: E741
    x, y = s.grid_cell(l, b)
    return _sky(spark, sf, *CUST).select("id", x.alias("x"), y.alias("y"))


_N = NSIDE
HEALPIX = f"""hz AS (SELECT *, sin(radians(dec)) AS z, (ra - 360 * floor(ra / 360)) / 90 AS tt FROM {{0}}),
hb AS (SELECT *, floor({_N} * (0.5e0 + tt) - {_N} * z * 0.75e0) AS up, floor({_N} * (0.5e0 + tt) + {_N} * z * 0.75e0) AS dn, tt - floor(tt) AS tp, {_N} * sqrt(3 * (1 - abs(z))) AS tmp FROM hz),
hr AS (SELECT *, {_N} + 1 + up - dn AS ring, floor(tp * tmp) + floor((1 - tp) * tmp) + 1 AS cap FROM hb),
hp AS (SELECT *, CAST(CASE WHEN abs(z) <= 2e0 / 3 THEN {2 * _N * (_N - 1)} + (ring - 1) * {4 * _N} + ((floor((up + dn - {_N} + (CASE WHEN ring % 2 = 0 THEN 1 ELSE 0 END) + 1) / 2) % {4 * _N}) + {4 * _N}) % {4 * _N}
  WHEN z > 0 THEN 2 * cap * (cap - 1) + floor(tt * cap) % (4 * cap) ELSE {12 * _N * _N} - 2 * cap * (cap + 1) + floor(tt * cap) % (4 * cap) END AS BIGINT) AS pixel FROM hr)"""
_MAP = f"dm AS (SELECT CAST(p_partkey % {12 * _N * _N} AS BIGINT) AS pixel, round(avg(p_retailprice) / 2000, 6) AS ebv FROM part GROUP BY 1)"


def _dust_map(spark, sf):
    pixel = (F.col("p_partkey") % (12 * NSIDE * NSIDE)).cast("long")
    return table(spark, sf, "part").groupBy(pixel.alias("pixel")).agg(F.round(F.avg("p_retailprice") / 2000, 6).alias("ebv"))


@query(f"WITH {C}, {HEALPIX.format('c')}, {_MAP} SELECT id, pixel, coalesce(ebv, 0) AS ebv, round(3.1e0 * coalesce(ebv, 0), 6) AS a_v FROM hp LEFT JOIN dm USING (pixel)")
def dust_pixel(spark, sf):
    return s.dust(_sky(spark, sf, *CUST), _dust_map(spark, sf), NSIDE).select("id", "pixel", "ebv", F.round("a_v", 6).alias("a_v"))


@query("""SELECT o_custkey AS id, arg_max(ebv, bin) AS ebv, max(bin) AS bin FROM (SELECT o.o_orderkey, o.o_custkey, CAST(l_linenumber AS DOUBLE) AS bin, max(l_tax) AS ebv FROM orders o JOIN lineitem ON l_orderkey = o.o_orderkey WHERE o_orderkey % 1 = 0 GROUP BY ALL)
WHERE bin <= 3.5 GROUP BY o_orderkey, o_custkey""".replace("o_custkey AS id", "o_orderkey AS id").replace("GROUP BY o_orderkey, o_custkey", "GROUP BY o_orderkey").replace(" WHERE o_orderkey % 1 = 0", ""))
def reddening_asof(spark, sf):
    """The farthest distance step at or before 3.5, of orders standing in for sky pixels."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pixel"), F.lit(3.5).alias("distance"))
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").cast("double").alias("bin")).agg(F.max("l_tax").alias("ebv"))
    return s.reddening_at(rows, steps).filter("bin IS NOT NULL").select("id", "ebv", "bin")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, [max(l_tax), max(l_discount), max(l_quantity) / 100] AS x FROM lineitem GROUP BY ALL),
s AS (SELECT o_orderkey AS id, l_linenumber AS bin, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC) AS i
FROM orders JOIN b ON l_orderkey = o_orderkey AND l_linenumber <= o_orderkey % 5 + 0.5)
SELECT id, CAST(bin AS DOUBLE) AS bin, round(list_aggregate(x, 'quantile_cont', 0.16), 6) AS p16, round(list_aggregate(x, 'quantile_cont', 0.5), 6) AS median, round(list_aggregate(x, 'quantile_cont', 0.84), 6) AS p84 FROM s WHERE i = 1""")
def reddening_samples(spark, sf):
    """Percentiles of the samples that the distance step of each row has; three columns stand for samples."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pixel"), (F.col("o_orderkey") % 5 + 0.5).alias("distance"))
    samples = F.array(F.max("l_tax"), F.max("l_discount"), F.max("l_quantity") / 100).alias("samples")
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").alias("bin")).agg(samples)
    out = s.reddening_percentiles(rows, steps).filter("bin IS NOT NULL")
    return out.select("id", "bin", *[F.round(c, 6).alias(c) for c in ("p16", "median", "p84")])


@query(f"WITH {C}, a AS (SELECT id, m, 1000 / nullif(greatest(m, 0), 0) AS d FROM c) SELECT id, round(d, 4) AS distance, round(15 - 5 * log10(d) + 5 - 2.364e0 * 0.1, 5) AS abs_mag FROM a")
def abs_mag(spark, sf):
    d = astro.distance_pc(F.col("m"))
    return _sky(spark, sf, *CUST).select("id", F.round(d, 4).alias("distance"), F.round(astro.absolute_mag(F.lit(15.0), F.col("m"), 2.364 * 0.1), 5).alias("abs_mag"))


@query("SELECT l_orderkey AS id, sqrt(l_quantity * l_quantity) AS u, CASE WHEN sqrt(l_quantity * l_quantity + pow(l_linenumber * 40, 2) + pow(l_tax * 1000, 2)) < 70 THEN 'thin' WHEN sqrt(l_quantity * l_quantity + pow(l_linenumber * 40, 2) + pow(l_tax * 1000, 2)) < 220 THEN 'thick' WHEN sqrt(l_quantity * l_quantity + pow(l_linenumber * 40, 2) + pow(l_tax * 1000, 2)) < 500 THEN 'halo' ELSE 'high' END AS band FROM lineitem".replace("sqrt(l_quantity * l_quantity) AS u", "round(sqrt(l_quantity * l_quantity + pow(l_linenumber * 40 + 230, 2) + pow(l_tax * 1000, 2)), 4) AS speed"))
def toomre(spark, sf):
    u, v, w = F.col("l_quantity"), F.col("l_linenumber") * 40.0, F.col("l_tax") * 1000
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.round(astro.total_speed(u, v, w), 4).alias("speed"), astro.toomre_band(u, v, w).alias("band"))


@query()
def position_names(spark, sf):
    return _sky(spark, sf, *CUST).select("id", astro.sexagesimal_name(F.col("ra"), F.col("dec")).alias("name"))


@query("SELECT o_custkey AS id, unnest(string_split(string_agg(CAST(o_orderkey AS VARCHAR), ';'), ';')) AS epoch FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def multi_epoch(spark, sf):
    lists = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ";").alias("epochs"))
    return s.exploded_epochs(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), lists)


@query("""SELECT c_custkey AS id, n_name AS place, n_orders, CAST(n_name IS NOT NULL AS INT) + CAST(n_orders IS NOT NULL AS INT) + CAST(s_n IS NOT NULL AS INT) AS n_success FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, count(*) AS s_n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def target_assemble(spark, sf):
    """Optional sources joined to every target, with how many answered."""
    t = lambda n: table(spark, sf, n)
    targets = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    sources = {
        "place": (t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("place")), "nation"),
        "n_orders": (t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders")), "id"),
        "s_n": (t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s_n")), "nation"),
    }
    return selection.assembled(targets, sources).select("id", "place", "n_orders", "n_success")


_SPEC = "sp AS (SELECT l_suppkey AS spec, 3700 + 10.0e0 * l_linenumber + l_quantity AS wave, l_extendedprice / 1000 AS flux FROM lineitem)"


def _spectra(spark, sf):
    return spread(table(spark, sf, "lineitem")).select(F.col("l_suppkey").alias("spec"), (3700 + 10.0 * F.col("l_linenumber") + F.col("l_quantity")).alias("wave"), (F.col("l_extendedprice") / 1000).alias("flux"))


# Windows of lines as (name, from, to, rest wavelength).
LINES = (("h9", 3720.0, 3740.0, 3730.0), ("h8", 3740.0, 3765.0, 3750.0))


@query(f"""WITH {_SPEC}, ln AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}e0, {b}e0, {c}e0)" for n, a, b, c in LINES)}) AS v(line, lo, hi, rest)), r AS (SELECT * FROM sp JOIN ln ON wave >= lo AND wave < hi),
f AS (SELECT spec, line, regr_slope(flux, wave) AS b, regr_intercept(flux, wave) AS a FROM r GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT spec, line, rest, wave, abs(flux - a - b * wave) AS w FROM r JOIN f USING (spec, line)),
m AS (SELECT spec, line, rest, count(*) AS n, sum(w * wave) / nullif(sum(w), 0) AS c FROM d GROUP BY ALL),
v AS (SELECT spec, line, sum(w * pow(wave - c, 2)) / nullif(sum(w), 0) AS v FROM d JOIN m USING (spec, line) GROUP BY ALL)
SELECT spec, line, n, round(c, 3) AS centre, round(2.3548200450309493e0 * sqrt(v), 2) AS fwhm, round((c - rest) / rest * 299792.458e0, 1) AS rv FROM m JOIN v USING (spec, line)""")
def line_moments(spark, sf):
    lines = spark.createDataFrame(list(LINES), "line string, lo double, hi double, rest double")
    return s.line_moments(_spectra(spark, sf), lines).select("spec", "line", "n", F.round("centre", 3).alias("centre"), F.round("fwhm", 2).alias("fwhm"), F.round("rv", 1).alias("rv"))


_T = (2000.0, 40000.0, 39)
_B = "(1e20 / pow(wave, 5) / (exp(least(1.438776877e8 / (wave * t), 700)) - 1))"


@query(f"""WITH {_SPEC}, g AS (SELECT spec, wave, flux, 2000e0 + k * 1000e0 AS t FROM sp, (SELECT unnest(range(39)) AS k)), a AS (SELECT spec, t, sum(flux * {_B}) AS fb, sum({_B} * {_B}) AS bb, sum(flux * flux) AS ff FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY ff - fb * fb / bb, t) AS i FROM a) SELECT spec, t AS temperature FROM r WHERE i = 1""")
def sed_blackbody(spark, sf):
    return s.blackbody_fit(_spectra(spark, sf), _T).select("spec", "temperature")


@query("SELECT CASE WHEN wien < 30000 THEN 'cool' ELSE 'hot' END AS class, count(*) AS n FROM (SELECT 2.897771955e7 / arg_max(3700 + 10.0e0 * l_linenumber + l_quantity, l_extendedprice) AS wien FROM lineitem GROUP BY l_suppkey) GROUP BY 1")
def wien_classes(spark, sf):
    peak = _spectra(spark, sf).groupBy("spec").agg(F.max_by("wave", "flux").alias("wave"))
    return peak.groupBy(F.when(astro.wien_temperature(F.col("wave")) < 30000, "cool").otherwise("hot").alias("class")).agg(F.count("*").alias("n"))
