import random
import re

import xxhash

from astroloom.llm import simhash as s

SCHEMA = "doc_id long, text string, fingerprint string, node long"


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    """(doc_id, print) rows to the smallest id reachable."""
    comp = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (doc, _), c in zip(prints, comp):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return [least.get(c) for c in comp]


def same(spark, docs):
    prints = [(i, brute_print(t)) for i, t in docs]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))]
    out = s.near_duplicates(spark.createDataFrame([(i, t, "x", 9) for i, t in docs], SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_odd_texts(spark):
    same(spark, [(5, None), (3, ""), (8, " \n"), (1, "A b"), (2, "a B"), (4, "a"), (4, "a"), (None, "a"), (6, "x y z " * 20_000), (7, "É é\x0bz w"), (None, "only null ids here")])


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_corpus(spark, small):
    same(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_links_lose_nothing(spark):
    """Chains of close fingerprints, in keys of many blocks."""
    rng = random.Random(2)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    prints = [(k + 100, p) for k, p in enumerate(dict.fromkeys(prints))]
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in prints]
    for distance, segments, block in ((2, 3, 8), (2, 4, 1024), (3, 4, 5), (0, 1, 4)):
        found = s.components(s.links(spark.createDataFrame(signed, "node long, fingerprint long"), distance, segments, block))
        of = {r.node: r.component for r in found.collect()}
        assert [of.get(k, k) for k, _ in prints] == brute_components(prints, distance)


def test_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in [(5, None), (3, ""), (1, "A b"), (2, "a B"), (4, "c"), (4, "c"), (None, "a b"), (7, "solo text")]], SCHEMA)
    assert sorted(map(str, (r.doc_id for r in s.one_of_each(docs).collect()))) == ["1", "3", "4", "7", "None"]
    assert s.one_of_each(docs).columns == docs.columns and s.one_of_each(docs.limit(0)).count() == 0


def test_one_id_with_unequal_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    same(spark, [(4, a), (2, a + " z"), (4, b), (9, b + " z"), (None, "c d e"), (7, "c d e f")])
