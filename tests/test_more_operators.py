"""Small fixtures with known answers: tokenisers, readers, stored indexes, seen-sets, numbering, kinematics."""

import json

import pytest
from pyspark.sql import functions as F

from astroloom.functions import astro, text
from astroloom.operators import corpus, evaluation, kinematics, models, selection, training
from astroloom.sources import readers, sinks
from astroloom.streaming import incremental


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("c")).first().c


def test_numbering_keeps_every_row(spark):
    rows = spark.range(300_000).select(((F.col("id") * 7919) % 300_000).alias("k"), F.sha1(F.col("id").cast("string")).alias("a"), F.lit("z" * 20).alias("b"))
    out = corpus.numbered(rows, "k", "qa_", 6)
    assert out.count() == 300_000 and out.select("name").distinct().count() == 300_000
    assert out.filter(F.col("name") != F.concat(F.lit("qa_"), F.lpad(F.col("k").cast("string"), 6, "0"))).count() == 0
    assert corpus.numbered(rows.limit(0), "k", "x").count() == 0


def test_tokenisers(spark):
    t = F.col("t")
    assert one(spark, text.specialist_tokens(t), "The AM-CVn star, v2.0 & a M_31!") == ["am-cvn", "star", "v2.0", "m_31"]
    assert one(spark, text.bilingual_tokens(t), "白矮星 of The Stars") == ["白矮", "矮星", "stars"]
    assert one(spark, text.keywords(t), "the Big-Star 为什么 ok") == ["Big", "Star", "ok"]
    assert one(spark, text.spaced_words(t), "白矮星，周期长。ab abc abc") == ["白矮星", "周期长", "abc"]
    assert one(spark, text.topic_sentences(t, ("star",)), "A star. No. Two Stars! star? star.") == ["A star.", "Two Stars!", "star?"]
    assert one(spark, text.reasoning_steps(t, 3), "abcd。x.efgh\nijkl") == ["abcd", "efgh", "ijkl"]
    assert one(spark, text.relevant_header(F.array(F.lit("Obs"), F.lit("PERIOD_d")))) is True
    assert one(spark, text.name_key(t), "AM CVn") == "am_cvn" and one(spark, text.safe_file_name(t), "a b/c") == "a_b_c"


@pytest.mark.parametrize("said, ra, dec", [("at 10:00:00 +20:30:00", 150.0, 20.5), ("20h17m09.0s -03d30m36s", 304.2875, -3.51), ("none here", None, None)])
def test_sexagesimal(spark, said, ra, dec):
    got = one(spark, text.sexagesimal(F.col("t")), said)
    assert got is None if ra is None else (abs(got.ra - ra) < 1e-6 and abs(got.dec - dec) < 1e-6)


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("MJD,Mag,CatFlags,FilterCode\n1,15,0,zg\n3,16,32768,zg\n4,17,5,zr\n")
    assert [(r.n, r["mean"], r.span, r.bands) for r in readers.ztf_summary(spark, str(tmp_path / "z.csv")).collect()] == [(2, 16.0, 3.0, ["zg", "zr"])]
    (tmp_path / "f.csv").write_text("TIME,x,SAP_FLUX\n1,0,10\n2,0,100\n3,0,-5\n4,0,1000\n")
    assert sorted((r.t, round(r.mag, 6)) for r in readers.flux_table(spark, str(tmp_path / "f.csv")).collect()) == [(1.0, 2.5), (2.0, 0.0), (4.0, -2.5)]
    for k, ok in enumerate((True, False)):
        (tmp_path / f"a{k}.json").write_text(json.dumps({"name": f"s{k}", "ra": 1.5, "dec": 2.5, "extinction": {"success": ok, "A_V": 0.3, "E_B_V": 0.1}, "ztf": {"success": True, "n_points": 7}, "timestamp": "t"}))
    assert [(r.Name, r.A_V, r.ZTF_Points) for r in readers.analyses(spark, str(tmp_path / "a*.json")).orderBy("Name").collect()] == [("s0", 0.3, 7), ("s1", None, 7)]
    assert readers.directory_files(spark, str(tmp_path), (".json",)).count() == 2
    sinks.json_array(spark.range(3), str(tmp_path / "array"))
    assert json.loads("".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "array")).collect())) == [{"id": 0}, {"id": 1}, {"id": 2}]


def test_resume_does_not_hide_errors(spark, tmp_path):
    path = str(tmp_path / "done")
    assert sinks.resume(spark, spark.range(3), "id", path, lambda d: d).count() == 3
    assert sinks.resume(spark, spark.range(5), "id", path, lambda d: d).count() == 5
    with pytest.raises(Exception, match="other"):
        sinks.resume(spark, spark.range(5), "other", path, lambda d: d)


def test_stored_index_grows(spark, tmp_path):
    index = models.TextIndex(str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "red star"), (2, "blue star")], "doc_id long, text string"))
    index.add(spark.createDataFrame([(3, "red giant red")], "doc_id long, text string"))
    asked = spark.createDataFrame([(9, "red giant")], "qid long, text string")
    assert [r.doc_id for r in index.search(asked).orderBy("rank").collect()] == [3, 1]
    copy = models.TextIndex.load(index.save(spark, str(tmp_path / "copy")).path)
    assert copy.postings(spark).count() == index.postings(spark).count() == 6
    own = models.retrieved(asked, lambda q: q.select("qid", F.explode(F.array(F.lit(4), F.lit(5))).alias("doc_id")).withColumn("score", F.col("doc_id") / 2.0), 1)
    assert [(r.doc_id, r["rank"]) for r in own.collect()] == [(5, 1)]


def test_seen_set_lasts(spark, tmp_path):
    data = str(tmp_path / "in")
    schema = "id long, v string"
    for batch in ([(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(1, "e"), (4, "f")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        incremental.new_rows(stream, "id", str(tmp_path / "out"), str(tmp_path / "state"), lambda d: d.groupBy("v").count())
    rows = spark.read.parquet(str(tmp_path / "out" / "rows")).collect()
    assert sorted((r.id, r.v) for r in rows) == [(1, "a"), (2, "b"), (3, "d"), (4, "f")]
    assert spark.read.parquet(str(tmp_path / "out" / "changed")).count() == 4


def test_place_of_a_far_star(spark):
    """A star 27.9 kpc away, and one in the direction of the centre."""
    rows = spark.createDataFrame([(1, 344.6565, 40.00147, 27900.0), (2, 266.40499, -28.93617, 8122.0)], "id long, ra double, dec double, d double")
    x, y, z = astro.galactocentric(F.col("ra"), F.col("dec"), F.col("d"))
    far, centre = rows.select(x.alias("x"), y.alias("y"), z.alias("z")).collect()
    assert abs((far.x + 8.122) ** 2 + far.y**2 + (far.z - 0.0208) ** 2 - 27.9**2) < 0.5
    assert max(abs(centre.x), abs(centre.y), abs(centre.z)) < 0.03


def test_sampled_velocities_surround_the_value(spark):
    star = spark.createDataFrame([(1, 262.6717, -23.7501, 4540.0, 4440.0, 4640.0, -4.363, 0.02, -9.627, 0.02, 144.9, 1.0)], "id long, ra double, dec double, dist double, dist_lo double, dist_hi double, pmra double, pmra_err double, pmdec double, pmdec_err double, vlos double, vlos_err double")
    u, v, w = astro.space_velocity(*map(F.col, ("ra", "dec", "pmra", "pmdec", "dist", "vlos")))
    want = star.select(u.alias("u"), v.alias("v"), w.alias("w")).first()
    got = kinematics.monte_carlo_velocity(star, "id", 400).first()
    for c in "uvw":
        assert abs(got[f"{c}_median"] - want[c]) < 3 and got[f"{c}_p16"] < want[c] < got[f"{c}_p84"]


def test_filters_and_rules(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.5), (3, None, 0.7)], "id long, s string, c double")
    ids = lambda f: sorted(r.id for r in rows.filter(selection.matches(f)).collect())
    assert ids({"s": "a"}) == [1] and ids({"c": {"$gte": 0.6, "$lt": 0.9}}) == [3] and ids({"$or": [{"s": "b"}, {"c": {"$gt": 0.8}}]}) == [1, 2] and ids({"s": {"$ne": "a"}}) == [2] and ids({}) == [1, 2, 3]
    assert one(spark, evaluation.subfield(F.col("t")), "How does a white dwarf star cool?") == "stellar" and one(spark, evaluation.subfield(F.col("t")), "hm") == "general"
    assert one(spark, evaluation.category(F.col("t")), "什么是赫罗图") == "hr_diagram"
    assert one(spark, evaluation.breaks_rule(F.col("t"), evaluation.WHITE_DWARF_RULES), "double white dwarf merger always explodes") is True
    assert len(one(spark, training.observing_advice(F.lit("AM CVn"), F.lit(None).cast("boolean"), F.lit(0.0)))) == 6


def test_nested_values(spark):
    from astroloom.functions import nested

    t = F.col("t")
    assert one(spark, nested.json_block(t), 'so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, nested.json_block(t), "```\n[1, 2]\n``` {3}") == "[1, 2]"
    assert one(spark, nested.json_block(t), "nothing") is None
    assert one(spark, nested.at(nested.parsed(t), "$.a.b", "int", 7), '{"a": {"b": 1}}') == 1
    assert one(spark, nested.at(nested.parsed(t), "$.a.b", "int", 7), '{"a": {"b": "x"}}') == 7
    assert one(spark, nested.at(nested.parsed(t), "$.a", "int", 7), "{broken") == 7
    found = nested.first_present(nested.parsed(t), ("gaia", "ztf"), "$.periods", "period")
    assert tuple(one(spark, found, '{"periods": {"gaia": {"period": null}, "ztf": {"period": 2.5}}}')) == (2.5, "ztf")
    assert one(spark, found, "{}") is None
    assert one(spark, nested.band_map({"g": F.lit(1), "r": F.lit(None), "i": F.lit(float("nan"))})) == {"g": 1.0}


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_patterns(spark, block):
    from astroloom.operators import patterns

    texts = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "xbcx ünï"), (1, "abcab")], "k int, t string")
    asked = spark.createDataFrame([("abc",), ("bc",), ("",), (None,), ("ünï",), ("zz",), ("bc",)], "pattern string")
    got = sorted((r.k, r.pattern) for r in patterns.occurring(texts, "k", "t", asked, block).collect())
    assert got == sorted([(1, "abc"), (1, "bc"), (1, "")] * 2 + [(3, ""), (4, "bc"), (4, ""), (4, "ünï")])
    assert patterns.occurring(texts, "k", "t", asked.limit(0), block).collect() == []


def test_no_nested_loop_for_patterns(spark, small):
    from astroloom.plans.registry import QUERIES

    for name in ("containment", "fuzzy_topics"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_replayed_batch_changes_nothing(spark, tmp_path):
    import datetime

    from astroloom.streaming import knowledge

    schema = "id long, kind string, value double, entities array<string>, terms array<string>, confidence double, ts timestamp, source string"
    day = datetime.datetime(2024, 1, 1)
    fact = lambda i, v, c: (i, "p", v, ["a", "b"], ["t"], c, day, f"s{i}")
    kept = knowledge.KnowledgeTable(str(tmp_path / "table"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in ([fact(1, 1.0, 0.9), fact(2, 10.0, 0.2)], [fact(3, 2.0, 0.5), fact(4, 1.1, 0.1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept.keep(stream(), str(tmp_path / "state"))
    see = lambda: sorted((r.id, r.kept, r.value, r.note) for r in kept.version(spark, 2, schema).collect())
    want = [(1, 1, 1.0, None), (2, 2, 10.0, None), (3, 1, 1.0, "kept over s3"), (4, 2, 10.0, "kept over s4")]
    assert see() == want
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the driver was lost before the batch was committed
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    kept.keep(stream(), str(tmp_path / "state"))
    assert see() == want and kept.version(spark, 1, schema).count() == 2


def test_pool_of_generators_and_credentials(spark):
    import time

    def load(credential):
        def model(prompt):
            time.sleep(0.2)
            if credential == "bad":
                raise ValueError("refused")
            return prompt + credential

        return model

    rows = spark.range(12).select(F.col("id").alias("k"), F.lit("p").alias("prompt")).coalesce(1)
    began = time.time()
    out = models.generated(rows, load, "k", tries=2, wait=0.01, pool=6, credentials=("bad", "good")).collect()
    assert {(r.k, r.answer, r.status) for r in out} == {(k, "pgood", "ok") for k in range(12)}
    assert time.time() - began < 12 * 0.2 + 15
    failed = models.generated(rows, load, "k", tries=1, credentials=("bad",)).collect()
    assert {(r.status, r.error) for r in failed} == {("failed", "refused")}
