"""Readers that bring survey and corpus files to the common tables. All take a path and a schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of the survey files.
ZTF = "c0 STRING, c1 STRING, hjd DOUBLE, mjd DOUBLE, mag DOUBLE, magerr DOUBLE, catflags INT, filtercode STRING"
ASASSN = "jd DOUBLE, flux DOUBLE, flux_err DOUBLE, mag DOUBLE, mag_err DOUBLE, `limit` DOUBLE, quality STRING, phot_filter STRING"
TESS = "time DOUBLE, flux DOUBLE, flux_err DOUBLE, " + ", ".join(f"c{k} STRING" for k in range(3, 13)) + ", quality INT"
TIME_COLUMNS, FLUX_COLUMNS = ("time", "TIME", "bjd", "btjd"), ("pdcsap_flux", "SAP_FLUX", "flux", "kspsap_flux")
BTJD, GAIA_JD = 2457000.0, 2455197.5
CONVERSATION = "id STRING, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>, metadata MAP<STRING, STRING>"


def _file(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def ztf(spark: SparkSession, path: str) -> DataFrame:
    """Clean samples (catflags 0) of the g, r and i bands."""
    rows = _file(spark.read.schema(ZTF).option("header", True).option("enforceSchema", True).csv(path)).filter("catflags = 0 AND filtercode IN ('zg', 'zr', 'zi')")
    return rows.select("source", F.lit("ztf").alias("survey"), F.col("filtercode").alias("band"), F.col("hjd").alias("t"), "mag", F.col("magerr").alias("err"), F.col("catflags").alias("flag"))


def asassn(spark: SparkSession, path: str) -> DataFrame:
    """Good samples brighter than their limit; the first line of a file, a # header, is a comment."""
    rows = _file(spark.read.schema(ASASSN).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)).filter("quality = 'G' AND mag < `limit` AND mag_err < 0.5")
    return rows.select("source", F.lit("asassn").alias("survey"), F.col("phot_filter").alias("band"), F.col("jd").alias("t"), "mag", F.col("mag_err").alias("err"), F.lit(0).alias("flag"))


def asassn_headers(spark: SparkSession, path: str) -> DataFrame:
    """(source, header MAP) of the # lines, as ``key: value`` pairs between semicolons."""
    lines = _file(spark.read.text(path)).filter(F.col("value").startswith("#"))
    return lines.select("source", F.str_to_map(F.regexp_replace(F.regexp_replace("value", r"^#\s*", ""), r"\s*([:;])\s*", "$1"), F.lit(";"), F.lit(":")).alias("header"))


def tess(spark: SparkSession, path: str) -> DataFrame:
    """Quality 0 samples, the quality being the 14th column; empty cells are null; times as BJD."""
    rows = _file(spark.read.schema(TESS).option("header", True).option("enforceSchema", True).option("nullValue", "").csv(path)).filter("quality = 0 AND flux IS NOT NULL")
    return rows.select("source", F.lit("tess").alias("survey"), F.lit("tess").alias("band"), (F.col("time") + BTJD).alias("t"), F.col("flux").alias("mag"), F.col("flux_err").alias("err"), F.col("quality").alias("flag"))


def gaia_epochs(wide: DataFrame) -> DataFrame:
    """(source, band, t, mag, err) from wide epoch rows (source, Time/F/e_F/mag per band); bands without a magnitude drop."""
    bands = {"G": ("TimeG", "FG", "e_FG", "Gmag"), "BP": ("TimeBP", "FBP", "e_FBP", "BPmag"), "RP": ("TimeRP", "FRP", "e_FRP", "RPmag")}
    stacked = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), (F.col(t) + GAIA_JD).alias("t"), F.col(m).alias("mag"), F.abs(-2.5 / F.log(F.lit(10.0)) * F.col(e) / F.col(f)).alias("err")) for b, (t, f, e, m) in bands.items()]))
    return wide.select("source", stacked.alias("x")).select("source", "x.*").filter("mag IS NOT NULL")


INFRARED = {"W1": ("w1mpro", "w1sigmpro"), "W2": ("w2mpro", "w2sigmpro")}


def paired_epochs(wide: DataFrame, time: str = "mjd", pairs: dict[str, tuple[str, str]] = INFRARED) -> DataFrame:
    """(source, band, t, mag, err) from wide rows with a pair of magnitude and error for each band, of the infrared survey
    if none are named; a band drops where its magnitude is null or not a number, its error may be missing."""
    cells = [F.struct(F.lit(b).alias("band"), F.nanvl(F.col(m).cast("double"), F.lit(None)).alias("mag"), F.col(e).cast("double").alias("err")) for b, (m, e) in pairs.items()]
    rows = wide.select("source", F.col(time).cast("double").alias("t"), F.explode(F.array(*cells)).alias("x"))
    return rows.select("source", "x.band", "t", "x.mag", "x.err").filter("mag IS NOT NULL")


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind): light-curve files by their names; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.contains("k2sff"), "k2sff").when(name.contains("kepler") | name.contains("kplr"), "kepler").when(name.contains("tess") & name.contains("spoc"), "tess").when(name.contains("ztf"), "ztf").when(name.contains("asas"), "asassn")
    return files.withColumn("kind", kind).filter("kind IS NOT NULL")


def directory_stats(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").dropDuplicates(["path"])
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def knowledge(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(id, topic, content): paragraphs of text files, the topic being the file's name."""
    rows = _file(spark.read.text(path, wholetext=True)).withColumnRenamed("source", "topic")
    parts = rows.select("topic", F.posexplode(F.split("value", r"\n\s*\n")).alias("i", "content")).withColumn("content", F.trim("content"))
    return parts.filter(F.length("content") > least).select(F.concat_ws("_", "topic", F.col("i").cast("string")).alias("id"), "topic", "content")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines; rows that do not parse are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def spectrum(rows: DataFrame) -> DataFrame:
    """(spec, wave, flux) from (spec, loglam ARRAY, flux ARRAY)."""
    return rows.select("spec", F.explode(F.arrays_zip("loglam", "flux")).alias("x")).select("spec", F.pow(F.lit(10.0), F.col("x.loglam")).alias("wave"), F.col("x.flux").alias("flux"))


def ztf_summary(spark: SparkSession, path: str) -> DataFrame:
    """(source, n, mean, span, bands) of the samples with catflags below 32768, from files with named columns in any case."""
    rows = spark.read.option("header", True).csv(path)
    rows = _file(rows.toDF(*[c.lower() for c in rows.columns])).filter(F.col("catflags").try_cast("int") < 32768)
    mag, day = F.col("mag").try_cast("double"), F.col("mjd").try_cast("double")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg(mag).alias("mean"), (F.max(day) - F.min(day)).alias("span"), F.array_sort(F.collect_set("filtercode")).alias("bands"))


def flux_table(spark: SparkSession, path: str) -> DataFrame:
    """(source, t, flux, mag) from files whose time and flux columns are the first present of a list; positive, finite
    fluxes only. mag is the magnitude about its median."""
    rows = _file(spark.read.option("header", True).option("caseSensitive", True).csv(path))
    time, flux = (next((c for c in names if c in rows.columns), None) for names in (TIME_COLUMNS, FLUX_COLUMNS))
    if time is None or flux is None:
        raise ValueError(f"no time or no flux column among {rows.columns}")
    rows = rows.select("source", F.col(time).try_cast("double").alias("t"), F.col(flux).try_cast("double").alias("flux")).filter("flux > 0 AND flux < double('inf')")
    rows = rows.withColumn("mag", -2.5 * F.log10("flux"))
    middle = rows.groupBy("source").agg(F.median("mag").alias("_m"))
    return rows.join(middle, "source").withColumn("mag", F.col("mag") - F.col("_m")).drop("_m")


def catalogue(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a Parquet catalogue; nothing else is read."""
    return spark.read.parquet(path).select(*columns)


# What an analysis file of a target holds.
ANALYSIS = (
    "name STRING, ra DOUBLE, dec DOUBLE, extinction STRUCT<success: BOOLEAN, A_V: DOUBLE, E_B_V: DOUBLE>, "
    "ztf STRUCT<success: BOOLEAN, n_points: LONG>, timestamp STRING"
)


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """(Name, RA, DEC, A_V, E_B_V, ZTF_Points, Timestamp) of a folder of analyses; blank where a part of one failed."""
    rows = spark.read.schema(ANALYSIS).option("multiLine", True).json(path)
    of = lambda part, field: F.when(F.col(f"{part}.success"), F.col(f"{part}.{field}"))
    return rows.select(
        F.col("name").alias("Name"), F.col("ra").alias("RA"), F.col("dec").alias("DEC"), of("extinction", "A_V").alias("A_V"), of("extinction", "E_B_V").alias("E_B_V"),
        of("ztf", "n_points").alias("ZTF_Points"), F.col("timestamp").alias("Timestamp"),
    )


def directory_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length) of the files below a folder with one of the extensions, each once; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").dropDuplicates(["path"])
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))


def page_corpus(pages: DataFrame, page: int = 100, document: int = 200) -> DataFrame:
    """(doc, page_no, text, n_chars) of pages (doc, page_no, text) of more than ``page`` characters, without the documents
    that have fewer than ``document`` in all their pages."""
    rows = pages.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    short = rows.groupBy("doc").agg(F.sum("n_chars").alias("_n")).filter(F.col("_n") >= document).select("doc")
    return rows.filter(F.col("n_chars") > page).join(short, "doc", "left_semi").select("doc", "page_no", "text", "n_chars")


def wave_flux(rows: DataFrame) -> DataFrame:
    """(spec, wave, flux) from (spec, wave ARRAY, flux ARRAY); other columns are header fields and stay."""
    rest = [c for c in rows.columns if c not in ("spec", "wave", "flux")]
    return rows.select("spec", *rest, F.explode(F.arrays_zip("wave", "flux")).alias("x")).select("spec", *rest, "x.wave", "x.flux")
