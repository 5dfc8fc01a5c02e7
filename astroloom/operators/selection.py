"""Predicates and look-ups over catalogues, knowledge tables and search results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import patterns

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def matches(conditions: dict) -> Column:
    """A predicate from a metadata filter: {column: value} or {column: {"$gte": value, ...}}; ``$and`` and ``$or`` take
    lists of filters. Nulls match nothing. Scans push the comparisons down."""
    parts = [F.lit(True)]
    for name, wanted in conditions.items():
        if name in ("$and", "$or"):
            parts.append(reduce(Column.__and__ if name == "$and" else Column.__or__, map(matches, wanted)))
        else:
            tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
            parts += [_COMPARE[op](F.col(name), v) for op, v in tests.items()]
    return reduce(Column.__and__, parts)


def by_type(rows: DataFrame, kind: str, value: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(F.col(kind)), F.lit(value.lower())))


def by_entity(rows: DataFrame, entities: str, entity: str) -> DataFrame:
    return rows.filter(F.array_contains(entities, entity))


def by_content(rows: DataFrame, content: str, part: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(F.col(content)), F.lit(part.lower())))


def fuzzy_get(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, key): the equal key, else the first in order of those that hold the asked text or stand in it; null if none.

    Both sides are looked up in one pass over the other, each as one set of patterns, and never joined pair by pair."""
    keys = keys.select("key").distinct().withColumn("_key", F.lower("key"))
    asked = asked.select("q").distinct().withColumn("_q", F.lower("q"))
    inside = patterns.occurring(keys, "key", "_key", asked.select(F.col("_q").alias("pattern"))).withColumnRenamed("pattern", "_q")
    around = patterns.occurring(asked, "q", "_q", keys.select(F.col("_key").alias("pattern"))).withColumnRenamed("pattern", "_key")
    hits = asked.join(inside, "_q").select("q", "key").unionByName(keys.join(around, "_key").select("q", "key"))
    hits = asked.select("q").join(hits, "q", "left")
    return hits.groupBy("q").agg(F.min(F.when(F.col("key").isNotNull(), F.struct((F.lower("q") != F.lower("key")).alias("far"), "key")))["key"].alias("key"))


# Photometric catalogues that enter an energy distribution, and bands of the one that is not taken whole.
SED_TABLES = ("II/335/galex_ais", "I/355/gaiadr3", "II/349/ps1", "I/305/out", "II/328/allwise", "J/ApJS/249/18/table2", "II/363/unwise", "II/365/catwise", "II/378/xmmom6s", "II/368/sstsl2")
SED_BANDS = {"II/336/apass9": ("Johnson:B", "Johnson:V")}


def sed_listed(table: Column, band: Column) -> Column:
    return reduce(Column.__or__, [(table == t) & band.isin(*b) for t, b in SED_BANDS.items()], table.isin(*SED_TABLES))


def survey_of(band: Column, source: Column) -> Column:
    """The survey by names that stand in the filter's and the source's name; the first that fits."""
    b, s = F.upper(F.coalesce(band, F.lit(""))), F.upper(F.coalesce(source, F.lit("")))
    has = lambda c, *names: reduce(Column.__or__, [F.contains(c, F.lit(n)) for n in names])
    return (
        F.when(has(b, "XMM") | has(s, "XMM"), "XMM").when(has(b, "GALEX") | has(s, "GALEX"), "GALEX").when(has(b, "GAIA") | has(s, "GAIA", "DR3"), "GAIA").when(has(s, "2MASS"), "2MASS")
        .when(has(s, "SPITZER"), "Spitzer").when(has(s, "WISE"), "WISE").when(has(s, "PAN-STARRS", "PS1"), "Pan-STARRS").when(has(s, "APASS") | has(b, "JOHNSON"), "APASS").otherwise("default")
    )


def good_parallax(parallax: Column, over_error: Column, least: float = 3.0) -> Column:
    """A target's parallax (``least`` 3) or a field star's (5)."""
    return (parallax > 0) & (over_error > least)


def on_hr_diagram(absolute: Column, colour: Column) -> Column:
    finite = ~F.isnan(absolute) & ~F.isnan(colour)
    return finite & (absolute > -5) & (absolute < 16) & (colour > -1) & (colour < 5)


def field_star(parallax: Column, colour: Column) -> Column:
    return (colour > -1) & (colour < 4) & (parallax > 0) & (parallax < 100)


def augmented_sample(confidence: Column, hallucinated: Column, least: float = 0.6) -> Column:
    return (confidence >= least) & ~F.coalesce(hallucinated, F.lit(False))


def uncertain_steps(rows: DataFrame, confidence: str, evidence: str, least: float = 0.7) -> DataFrame:
    """The rows of low confidence or without evidence, with ``why``."""
    why = F.concat_ws("+", F.when(F.col(confidence) < least, "low confidence"), F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "no evidence"))
    return rows.withColumn("why", why).filter(F.col("why") != "")


def observation_report(rows: DataFrame, by: str, author: str, mission: str, sector: str, dropped: tuple[str, ...] = ("EVEREST", "K2VARCAT")) -> DataFrame:
    """Per target, without two reduction authors: number of rows and of distinct sectors of the main mission, and whether the
    other missions saw it."""
    kept = rows.filter(~F.col(author).isin(*dropped))
    name = F.upper(F.col(mission))
    return kept.groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.contains(name, F.lit("TESS")), F.col(sector))).alias("sectors"),
        F.coalesce(F.bool_or(F.contains(name, F.lit("K2 CAMPAIGN"))), F.lit(False)).alias("has_k2"), F.coalesce(F.bool_or(F.contains(name, F.lit("KEPLER QUARTER"))), F.lit(False)).alias("has_kepler"),
    )


def normalised_objects(rows: DataFrame, ids: str, bands: tuple[str, ...], colours: tuple[tuple[str, str], ...] = (("B", "V"), ("BP", "RP"))) -> DataFrame:
    """Flags of the surveys named among a record's identifiers, its magnitudes where they are finite and between 0 and 30
    (others null), and the colours whose two bands it has."""
    sane = lambda c: F.when((c > 0) & (c < 30) & ~F.isnan(c), c)
    rows = rows.withColumns({b: sane(F.col(b)) for b in bands})
    named = {f"has_{s.lower()}": F.coalesce(F.contains(F.col(ids), F.lit(s)), F.lit(False)) for s in ("LAMOST", "SDSS")}
    return rows.withColumns(named | {f"{a.lower()}_{b.lower()}": F.col(a) - F.col(b) for a, b in colours if a in bands and b in bands})


def line_list(lines: DataFrame, element: str | None = None, ion: int | None = None, low: float | None = None, high: float | None = None, wave: str = "wave") -> DataFrame:
    tests = [F.col("element") == element if element else None, F.col("ion") == ion if ion is not None else None, F.col(wave) >= low if low is not None else None, F.col(wave) <= high if high is not None else None]
    return reduce(DataFrame.filter, [t for t in tests if t is not None], lines)


def covered_topics(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(topic, covered) of each expected topic."""
    seen = present.select("topic").distinct().withColumn("_s", F.lit(True))
    return expected.select("topic").distinct().join(seen, "topic", "left").select("topic", F.coalesce("_s", F.lit(False)).alias("covered"))


def first_batch(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order, as a limit of one run's work; a take-ordered, no full sort."""
    return rows.orderBy(*order).limit(n)


def merged_topics(found: DataFrame, key: str, topic: str) -> DataFrame:
    """One row for each paper that several searches found, with its topics in order."""
    rest = [c for c in found.columns if c not in (key, topic)]
    return found.groupBy(key).agg(F.array_sort(F.collect_set(topic)).alias("topics"), *[F.min(c).alias(c) for c in rest])


def source_statistics(rows: DataFrame, kind: str, subtype: str, known: tuple[str, ...]) -> DataFrame:
    """(grouping, value, n, with_<column>...): in all, by type and by subtype, from one pass; ``known`` columns count where
    they are neither null nor empty."""
    has = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"with_{c}") for c in known]
    sets = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), v.cast("string").alias("value")) for g, v in (("all", F.lit("all")), (kind, F.col(kind)), (subtype, F.col(subtype)))])).alias("g")
    return rows.select(*dict.fromkeys(known), sets).groupBy("g.grouping", "g.value").agg(F.count("*").alias("n"), *has)


def base_report(rows: DataFrame, generator: str, source: str, category: str, top: int = 10) -> DataFrame:
    """(section, value, n, share) of a knowledge base: each generator's share, the ``top`` sources (ties by name), and the
    categories with their total (value null)."""
    total = rows.agg(F.count("*").alias("_all"))
    made = rows.groupBy(F.col(generator).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("section", F.lit("generator"))
    best = rows.groupBy(F.col(source).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top).withColumn("section", F.lit("source"))
    kinds = rows.rollup(F.col(category).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("section", F.lit("category"))
    every = made.unionByName(best).unionByName(kinds).crossJoin(F.broadcast(total))  # a single row
    return every.select("section", "value", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def submitted_between(rows: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows whose date or time lies between two days, both included whole."""
    return rows.filter((F.col(at) >= F.lit(first).cast("date")) & (F.col(at) < F.date_add(F.lit(last).cast("date"), 1)))


def quality(rows: DataFrame, least: int = 1, chars: int = 200) -> DataFrame:
    """Rows of sufficient quality that are long enough and not toxic; unknown marks do not pass."""
    return rows.filter((F.col("quality") >= least) & (F.col("toxic") == 0) & (F.col("n_chars") >= chars))


def assembled(targets: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Optional sources {column: (rows with it, the column they share with the targets)} beside every target, a row each,
    and ``n_success``, how many of them answered."""
    rows = targets
    for column, (found, on) in sources.items():
        rows = rows.join(found.select(on, column), on, "left")
    return rows.withColumn("n_success", sum((F.col(c).isNotNull().cast("int") for c in sources), F.lit(0)))


def with_types(targets: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """Targets with their type's row as a struct ``type``; null where the type is unknown."""
    described = types.select(kind, F.struct(*[c for c in types.columns if c != kind]).alias("type"))
    return targets.join(described, kind, "left")


def image_features(pixels: DataFrame, bins: int = 32, channels: int = 3) -> DataFrame:
    """(img, features): a histogram of ``bins`` for each channel as shares of its pixels, then the mean and population
    deviation of all, divided by the vector's length. ``pixels``: (img, channel from 0, v from 0 to 255)."""
    slot = (F.col("channel") * bins + F.least(F.floor(F.col("v") * bins / 256), F.lit(bins - 1))).cast("int")
    counted = pixels.groupBy("img", "channel", slot.alias("slot")).agg(F.count("*").alias("n"))
    shares = counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("img", "channel")))
    histogram = shares.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("m"))
    level = pixels.groupBy("img").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    whole = F.concat(F.transform(F.sequence(F.lit(0), F.lit(bins * channels - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))), F.array("mean", "std"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    rows = histogram.join(level, "img").select("img", whole.alias("raw")).withColumn("length", length)
    return rows.select("img", F.when(F.col("length") > 0, F.transform("raw", lambda x: x / F.col("length"))).otherwise(F.col("raw")).alias("features"))
