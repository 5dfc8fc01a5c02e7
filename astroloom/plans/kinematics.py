"""Queries of places and motions; customers stand for stars, line items for epochs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import astro
from ..operators import kinematics as k
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

DRAWS = 16
STARS = """s AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10e0 AS ra, (c_custkey * 53 % 1700) / 10e0 - 85 AS dec, 500 + c_nationkey * 40e0 AS dist, c_acctbal / 100 AS vlos, c_nationkey - 12e0 AS pmra, c_custkey % 17 - 8e0 AS pmdec FROM customer),
g AS (SELECT *, cos(radians(dec)) * cos(radians(ra)) AS a, cos(radians(dec)) * sin(radians(ra)) AS b, sin(radians(dec)) AS c FROM s),
h AS (SELECT *, {0} AS gx, {1} AS gy, {2} AS gz FROM g)""".format(*(f"{r[0]!r}e0 * a + {r[1]!r}e0 * b + {r[2]!r}e0 * c" for r in astro.GALACTIC))
_U = lambda name: f"((CAST('0x' || substr(md5(id || '|' || draw || '|{name}'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"
_N = lambda name: f"(sqrt(-2 * ln({_U(name + '/r')})) * cos({2 * math.pi!r}e0 * {_U(name + '/a')}))"
_DIST = f"greatest(dist + CASE WHEN {_U('dist/side')} < 0.5 THEN abs({_N('dist')}) * 100e0 ELSE -abs({_N('dist')}) * 50e0 END, dist * 1e-6)"
_SIN = astro.SUN_HEIGHT_KPC / astro.SUN_KPC
_COS = math.sqrt(1 - _SIN * _SIN)
DRAWN = f"d AS (SELECT *, {_DIST} AS d FROM h, (SELECT unnest(range({DRAWS})) AS draw))"


def _statistics(v: str, places: int) -> str:
    return ", ".join(f"round({f}, {places}) AS {v}_{n}" for n, f in (("median", f"quantile_cont({v}, 0.5)"), ("mean", f"avg({v})"), ("p16", f"quantile_cont({v}, 0.16)"), ("p84", f"quantile_cont({v}, 0.84)")))


def _stars(spark, sf):
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        key.alias("id"), (key * 37 % 3600 / 10).alias("ra"), (key * 53 % 1700 / 10 - 85).alias("dec"), (500 + F.col("c_nationkey") * 40.0).alias("dist"), (F.col("c_acctbal") / 100).alias("vlos"),
        (F.col("c_nationkey") - 12.0).alias("pmra"), (key % 17 - 8.0).alias("pmdec"),
    )
    return rows.withColumns({"dist_lo": F.col("dist") - 50, "dist_hi": F.col("dist") + 100, "vlos_err": F.lit(5.0), "pmra_err": F.lit(0.5), "pmdec_err": F.lit(0.25)})


def _rounded(df, places):
    return df.select("id", *[F.round(c, places).alias(c) for c in df.columns if c != "id"])


@query(f"""WITH {STARS}, {DRAWN}, p AS (SELECT *, d / 1000 * gx - {astro.SUN_KPC} AS px, d / 1000 * gy AS y, d / 1000 * gz AS pz FROM d), q AS (SELECT id, {_COS!r}e0 * px + {_SIN!r}e0 * pz AS x, y, {_COS!r}e0 * pz - {_SIN!r}e0 * px AS z FROM p),
r AS (SELECT *, sqrt(x * x + y * y) AS r_plane, sqrt(x * x + y * y + z * z) AS r_centre FROM q) SELECT id, {", ".join(_statistics(v, 5) for v in ("x", "y", "z", "r_plane", "r_centre"))} FROM r GROUP BY id""")
def mc_place(spark, sf):
    return _rounded(k.monte_carlo_place(_stars(spark, sf), "id", DRAWS), 5)


_ROW = lambda i: " + ".join(f"{m!r}e0 * {v}" for m, v in zip(astro.GALACTIC[i], ("vx", "vy", "vz")))


@query(f"""WITH {STARS}, {DRAWN}, e AS (SELECT *, 0.00474047e0 * (pmra + 0.5e0 * {_N('pmra')}) * d AS across, 0.00474047e0 * (pmdec + 0.25e0 * {_N('pmdec')}) * d AS up, vlos + 5e0 * {_N('vlos')} AS los FROM d),
v AS (SELECT id, los * a - across * sin(radians(ra)) - up * sin(radians(dec)) * cos(radians(ra)) AS vx, los * b + across * cos(radians(ra)) - up * sin(radians(dec)) * sin(radians(ra)) AS vy, los * c + up * cos(radians(dec)) AS vz FROM e),
w AS (SELECT id, {_ROW(0)} + {astro.SUN_LSR[0]} AS u, {_ROW(1)} + {astro.SUN_LSR[1]} AS v, {_ROW(2)} + {astro.SUN_LSR[2]} AS w FROM v), t AS (SELECT *, sqrt(u * u + (v + 230) * (v + 230) + w * w) AS speed FROM w)
SELECT id, {", ".join(_statistics(x, 3) for x in ("u", "v", "w", "speed"))} FROM t GROUP BY id""")
def mc_velocity(spark, sf):
    return _rounded(k.monte_carlo_velocity(_stars(spark, sf), "id", DRAWS), 3)


@query(f"""WITH {STARS}, d AS (SELECT *, vlos + 5e0 * {_N('vlos')} AS los FROM h, (SELECT unnest(range({DRAWS})) AS draw)), t AS (SELECT id, los + {astro.SUN_FRAME[0]} * gx + {astro.SUN_FRAME[1]} * gy + {astro.SUN_FRAME[2]} * gz AS vrf FROM d)
SELECT id, {_statistics("vrf", 3)} FROM t GROUP BY id""")
def mc_rest_frame(spark, sf):
    return _rounded(k.monte_carlo_line_of_sight(_stars(spark, sf), "id", DRAWS), 3)


@query(f"""WITH r AS (SELECT p_partkey AS id, 10 + p_size / 5e0 AS mag, p_retailprice / 300 AS absolute, p_size / 100e0 AS reddening FROM part), d AS (SELECT id, power(10e0, 0.2e0 * (mag + 0.05e0 * {_N('mag')} - (absolute + 0.2e0 * {_N('absolute')}) + 5 - 2.5e0 * reddening)) AS distance FROM r, (SELECT unnest(range({DRAWS})) AS draw))
SELECT id, {_statistics("distance", 2)} FROM d GROUP BY id""")
def mc_luminosity_distance(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (10 + F.col("p_size") / 5.0).alias("mag"), F.lit(0.05).alias("mag_err"), (F.col("p_retailprice") / 300).alias("absolute"), F.lit(0.2).alias("absolute_err"), (F.col("p_size") / 100.0).alias("reddening"))
    return _rounded(k.monte_carlo_luminosity_distance(rows, "id", DRAWS, 2.5), 2)


@query("""WITH e AS (SELECT l_partkey AS id, l_shipdate AS t, l_orderkey, CASE WHEN l_linenumber = 7 THEN -9999e0 ELSE l_discount / 1000 END AS z FROM lineitem), r AS (SELECT id, t, z * 299792.458e0 AS rv FROM e WHERE z <> -9999)
SELECT id, count(*) AS n, round(arg_min(rv, (t, rv)), 4) AS first, round(max(rv), 4) AS top, round(5892.0e0 / 5890 * 299792.458e0 - 299792.458e0, 3) AS shift, round(5890e0 * (1 + max(rv) / 299792.458e0), 4) AS seen FROM r GROUP BY id""")
def velocity_curves(spark, sf):
    z = F.when(F.col("l_linenumber") == 7, -9999.0).otherwise(F.col("l_discount") / 1000)
    curves = k.velocity_curves(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("t"), z.alias("z"), F.lit(0.0001).alias("z_err")), "id")
    top = F.array_max(F.transform("curve", lambda x: x["rv"]))
    return curves.select("id", "n", F.round(F.col("curve")[0]["rv"], 4).alias("first"), F.round(top, 4).alias("top"), F.round(astro.line_velocity(F.lit(5892.0), F.lit(5890.0)), 3).alias("shift"), F.round(astro.observed_wave(F.lit(5890.0), top / astro.LIGHT_KM_S), 4).alias("seen"))


@query("SELECT o_custkey AS id, min(least(o_orderkey, o_orderkey + 5)) AS t_min, max(o_orderkey + 5) AS t_max, least(min(o_totalprice), min(o_totalprice / 2)) AS mag_min, max(o_totalprice) AS mag_max FROM orders GROUP BY o_custkey")
def multi_band_extent(spark, sf):
    wide = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("tg"), F.col("o_totalprice").alias("g"), (F.col("o_orderkey") + 5).alias("tr"), (F.col("o_totalprice") / 2).alias("r"))
    return k.band_extent(wide, "id", {"g": ("tg", "g"), "r": ("tr", "r"), "i": ("ti", "i")})
