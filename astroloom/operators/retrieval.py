"""Retrieval for a table of queries at a time. Query and document sides meet on terms, so the work follows the postings
of the queried terms; sides are broadcast only where Spark's size threshold allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..sources.shared import stored


#: Query vectors that are asked of the rows at a time, and the pairs of them that a task scores at once.
QUERY_BLOCK, TILE = 65_536, 1 << 20
#: Rows of queries' terms that every task holds at a time, pairs of postings and queries that a task adds up at a time,
#: and documents dealt to a task.
ASKED, PAIRS, DOCS = 1_000_000, 2_000_000, 20_000


def postings(docs: DataFrame, only: DataFrame | None = None, n_docs: int | None = None) -> DataFrame:
    """(term, doc_id, length, tf) from (doc_id, text); of the terms in ``only`` alone where an index is made for them. Where
    the number of documents is given and no id repeats, no posting is shuffled."""
    rows = counted(docs.select("doc_id", tx.terms(F.col("text")).alias("terms")), only)
    if n_docs is not None and docs.select("doc_id").distinct().count() == n_docs:
        return rows
    # Rows of one id and length are one document's.
    return rows.groupBy("term", "doc_id", "length").agg(F.sum("tf").alias("tf"))


def counted(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, length, tf) of rows (doc_id, terms), each counted where it lies, a batch of rows at a time."""
    shared = None
    if only is not None:
        some = only.select("term").distinct()
        wanted = some.limit(ASKED + 1).toArrow().column("term").combine_chunks()
        if len(wanted) > ASKED:
            return counted(rows).join(some, "term", "left_semi")
        shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ids = pc.split_pattern(batch.column("terms"), " "), batch.column("doc_id")
            flat, doc = terms.flatten(), pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
            some = pc.not_equal(flat, "")  # of no terms, one is made of nothing
            flat, doc = flat.filter(some), doc[some.to_numpy(zero_copy_only=False)]
            lengths = pa.array(np.bincount(doc, minlength=len(ids)).astype(np.int32))
            if shared is None:
                coded = flat.dictionary_encode()
                words, code = coded.dictionary, coded.indices
            else:
                words = shared.value.cast(flat.type)
                code = pc.index_in(flat, value_set=words)
                doc = doc[code.is_valid().to_numpy(zero_copy_only=False)]
                code = code.drop_null()
            key, tf = np.unique(doc.astype(np.int64) * max(len(words), 1) + code.to_numpy(zero_copy_only=False), return_counts=True)
            doc, code = (pa.array(x) for x in np.divmod(key, max(len(words), 1)))
            yield pa.RecordBatch.from_arrays([words.take(code), ids.take(doc), lengths.take(doc), pa.array(tf.astype(np.int64))], names=["term", "doc_id", "length", "tf"])

    # Terms have no spaces; as one text they cross to Python sooner than as a list.
    joined = rows.select("doc_id", F.array_join("terms", " ").alias("terms"))
    return joined.mapInArrow(count, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, length int, tf long")


def parts(df: DataFrame, n_docs: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n_docs // DOCS)


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def query_terms(queries: DataFrame, multiplicity: bool = False) -> DataFrame:
    """(qid, term, m): distinct terms of each query; m counts repeats if they are to weigh."""
    rows = queries.select("qid", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("m"))
    return rows if multiplicity else rows.withColumn("m", F.lit(1).cast("long"))


def top_k(hits: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id."""
    w = W.partitionBy("qid").orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_search(index: DataFrame, n_docs: int, asked: DataFrame, method: str = "idf", k: int = 5, least: int = 1) -> DataFrame:
    """(qid, doc_id, score, matched, rank). ``idf``: sum of ln(N / (df + 1)) + 1; ``tfidf``: tf / length times the smooth
    idf ln((N + 1) / (df + 1)) + 1; ``count``: distinct shared terms. ``least``: terms a hit must share."""
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = {"idf": F.log(F.lit(float(n_docs)) / (F.col("df") + 1)) + 1, "tfidf": F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1)) + 1, "count": F.lit(1.0)}[method]
    rows = asked.join(df, "term").select("term", "qid", (F.col("m") * idf).alias("w"))
    impact = F.col("tf") / F.col("length") if method == "tfidf" else F.lit(1.0)
    return ranked(index.select("term", "doc_id", impact.alias("x")), rows, n_docs, k, least)


#: Adds to the scores of a tile: from the pairs' cells (document * queries + query) and x, the documents' notes (lists) and
#: the queries' come the cells that score more, and how much.
Extra = Callable[[np.ndarray, np.ndarray, list[list[str]], list[str]], tuple[np.ndarray, np.ndarray]]


def ranked(index: DataFrame, asked: DataFrame, n_docs: int, k: int, least: int = 1, extra: Extra | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, matched, rank): the k best documents of each query by the sum of x * w over the terms they share,
    of an index (term, doc_id, x) and terms (term, qid, w). ``matched`` counts the rows that met. Rows of the index without a
    term hold a document's ``note`` for ``extra``, and ``notes`` (qid, note) the queries'.

    A document's postings come to one task, and the queries' terms to all, which adds up a tile of documents and queries at
    a time and hands on each query's k best there: neither what a posting and a query make nor the sums of a query and a
    document are shuffled, and no task has all postings of a frequent term. More terms than ``ASKED`` come block by block of
    queries."""
    asked = stored(asked)
    blocks = 1 + asked.count() // ASKED
    kinds = [f"{c} {f.schema[c].dataType.simpleString()}" for c, f in (("qid", asked), ("doc_id", index))]
    schema, note = ", ".join([*kinds, "score double", "matched long"]), ["note"] if extra else []

    def best(asked: DataFrame) -> DataFrame:
        rows, spark = asked.select("term", "qid", "w").toArrow(), index.sparkSession
        term, query = (pc.dictionary_encode(rows.column(c), null_encoding="encode").combine_chunks() for c in ("term", "qid"))
        code = term.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(term.dictionary) + 1))
        said = []
        if extra:
            known = notes.join(asked.select("qid").distinct(), "qid", "left_semi").toArrow()
            at = pc.index_in(query.dictionary, value_set=known.column("qid").combine_chunks())
            said = known.column("note").take(at).to_pylist()
        w = rows.column("w").to_numpy().astype(np.float64)[order]
        terms = (starts, query.indices.to_numpy(zero_copy_only=False)[order], w, query.dictionary, said)
        shared = spark.sparkContext.broadcast(terms)
        numbers = pa.table({"term": term.dictionary, "t": pa.array(np.arange(len(term.dictionary), dtype=np.int32))})
        numbered = F.broadcast(spark.createDataFrame(numbers, "term string, t int"))
        met = index.join(numbered, "term", "left" if extra else "inner").filter("t IS NOT NULL OR term IS NULL" if extra else "t IS NOT NULL")
        dealt = met.select("doc_id", "t", "x", *note).repartition(parts(index, n_docs), "doc_id").sortWithinPartitions("doc_id")
        return dealt.mapInArrow(lambda batches: _best(batches, shared.value, k, least, extra), schema)

    hits = [best(asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, hits)
    return top_k(hits.select("qid", "doc_id", F.round("score", 6).alias("score"), "matched"), k)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of their documents as tables of whole documents, and where each document ends."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
        ends = _ends(rows)
        last = ends[-2] if len(ends) > 1 else 0
        if last:
            yield rows.slice(0, last), ends[:-1]
        kept = rows.slice(last)
    if kept is not None and kept.num_rows:
        yield kept, _ends(kept)


def _ends(rows: pa.Table) -> np.ndarray:
    ids = rows.column("doc_id").combine_chunks()
    return pc.run_end_encode(ids).run_ends.to_numpy().astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)


def tiles(batches: Iterator[pa.RecordBatch], starts: np.ndarray, query: np.ndarray, n: int) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (doc_id, t) in the order of their documents, a tile of documents and of the n queries at a time: its rows, the
    documents' ids, each row's document, and of the pairs of a row and a query that asks for its t (places ``starts[t]`` to
    ``starts[t + 1]`` of ``query``) the row, the place and the cell (document * n + query)."""
    for rows, ends in _documents(batches):
        if not n:
            continue
        t, ids = rows.column("t").to_numpy(zero_copy_only=False), rows.column("doc_id").combine_chunks()
        t = np.nan_to_num(t, nan=-1).astype(np.int64) if t.dtype.kind == "f" else t.astype(np.int64)
        many = np.where(t < 0, 0, starts[t + 1] - starts[t])
        upto, at = np.concatenate([[0], np.cumsum(many)]), 0
        while at < len(ends):
            first = ends[at - 1] if at else 0
            stop = int(np.searchsorted(upto[ends], upto[first] + PAIRS, side="right"))
            stop = min(max(stop, at + 1), at + max(1, TILE // n), len(ends))
            span = slice(first, ends[stop - 1])
            doc, each = np.repeat(np.arange(stop - at), np.diff(ends[at:stop], prepend=first)), many[span]
            row = np.repeat(np.arange(len(each)), each)
            place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[np.maximum(t[span], 0)], each)
            yield rows.slice(first, len(each)), ids.take(pa.array(ends[at:stop] - 1)), doc, row, place, doc[row] * n + query[place]
            at = stop


def _best(batches: Iterator[pa.RecordBatch], terms: tuple, k: int, least: int, extra: Extra | None) -> Iterator[pa.RecordBatch]:
    starts, query, weight, qids, said = terms
    n = len(qids)
    floor = np.full(n, -np.inf)  # what a task's k best of a query reach so far
    for rows, ids, doc, row, place, cell in tiles(batches, starts, query, n):
        value = rows.column("x").to_numpy(zero_copy_only=False)[row]
        # Where no pair met, bincount gives integers, to which ``extra`` can't be added.
        score = np.bincount(cell, value * weight[place], len(ids) * n).astype(np.float64, copy=False)
        matched = np.bincount(cell, minlength=len(ids) * n)
        if extra:
            noted = [[] for _ in range(len(ids))]
            at = np.flatnonzero(rows.column("note").is_valid().to_numpy(zero_copy_only=False))
            for d, x in zip(doc[at], rows.column("note").take(pa.array(at)).to_pylist(), strict=True):
                noted[d].append(x)
            more, much = extra(cell, value, noted, said)
            score[more] += much
        score = np.where(matched >= least, np.round(score, 6), -np.inf).reshape(-1, n)
        reach = np.partition(score, len(score) - k, axis=0)[len(score) - k] if len(score) > k else np.full(n, -np.inf)
        # Documents come in the order of their ids, so of equals the earlier stay.
        good = (score >= reach) & (score > floor)
        q, d = np.nonzero(good.T)
        order = np.lexsort((d, -score[d, q], q))
        q, d = q[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, d = q[keep], d[keep]
        floor, cells = np.maximum(floor, reach), d * n + q
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(d)), pa.array(score[d, q]), pa.array(matched[cells])], names=["qid", "doc_id", "score", "matched"])


def hash_embedding(docs: DataFrame) -> DataFrame:
    """(doc_id, embedding): the sum of the terms' md5 bytes by frequency, normalised; texts without terms have none."""
    return embedded(postings(docs))


def embedded(index: DataFrame) -> DataFrame:
    """The same from postings."""
    sums = [F.sum(F.col("tf") * F.col("b")[i]).alias(f"_{i}") for i in range(16)]
    # A term's bytes are made once per distinct term, not once per posting.
    coded = index.select("term").distinct().withColumn("b", vx.md5_bytes(F.col("term")))
    return index.join(coded, "term").groupBy("doc_id").agg(*sums).select("doc_id", vx.unit(F.array(*[F.col(f"_{i}") for i in range(16)])).alias("embedding"))


def vector_search(embedded: DataFrame, asked: DataFrame, k: int = 5, threshold: float = 0.1) -> DataFrame:
    """Exact cosine top-k of (doc_id, embedding) for a stated set of queries (qid, q), every query against every row.

    The rows are scored where they lie, a tile of queries and rows at a time, so a task holds no more than a tile whatever
    the number of queries; each batch of rows hands on its k best of a query, and none below what the task's earlier ones had."""
    asked = asked.filter("q IS NOT NULL").select("qid", vx.unit(F.col("q")).alias("q"))
    embedded = embedded.filter("embedding IS NOT NULL").select("doc_id", vx.unit(F.col("embedding")).alias("embedding"))
    # Bounded by the stated set; beyond what a task can hold, the set is asked block by block.
    rows = asked.limit(QUERY_BLOCK + 1).toArrow()
    if len(rows) > QUERY_BLOCK:
        blocks, embedded, asked = 1 + asked.count() // (QUERY_BLOCK // 2), stored(embedded), stored(asked)
        parts = [vector_search(embedded, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k, threshold) for b in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    qids = rows.column("qid")
    q = matrix(rows.column("q"))
    shared = asked.sparkSession.sparkContext.broadcast((qids.combine_chunks(), q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        floor = np.full(len(q), threshold)  # what a task's k best of a query reach so far
        for batch in batches:
            if not batch.num_rows or not q.size:
                continue
            # In the order of their ids, so that of equals the smaller ids stay.
            batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_start"))
            x, found = matrix(batch.column("embedding")), []
            step = max(1, TILE // len(x))
            for at in range(0, len(q), step):
                value = np.nan_to_num(np.round(q[at : at + step] @ x.T, 6), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                least = floor[at : at + step]
                if len(x) > k:
                    least = np.maximum(least, np.partition(value, len(x) - k, axis=1)[:, len(x) - k])
                elif len(x) == k:
                    least = np.maximum(least, value.min(axis=1))
                i, j = np.nonzero(value >= least[:, None])
                v = value[i, j]
                order = np.lexsort((j, -v, i))
                i, j, v = i[order], j[order], v[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                floor[at : at + step] = np.maximum(floor[at : at + step], least)
                found.append((i[keep] + at, j[keep], v[keep]))
            i, j, v = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column("doc_id").take(pa.array(j)), pa.array(v)], names=["qid", "doc_id", "score"])

    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("qid", asked), ("doc_id", embedded))}
    hits = embedded.mapInArrow(score, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")
    return top_k(hits.select("qid", "doc_id", F.round("score", 6).alias("score")), k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1 if len(column) else 1)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 5, weights: tuple[float, float] = (0.6, 0.4), bonus: float = 1.1, method: str = "weighted") -> DataFrame:
    """(qid, doc_id, score, sources, rank) from two hit lists (qid, doc_id, score, rank).

    ``weighted``: each channel's scores over the query's largest, weighted, times ``bonus`` for hits of both;
    ``rrf``: the sum of 1 / (60 + rank)."""
    total = sum(weights)
    best = W.partitionBy("qid")

    def channel(hits: DataFrame, name: str, weight: float) -> DataFrame:
        value = weight / total * F.col("score") / F.max("score").over(best) if method == "weighted" else 1.0 / (60 + F.col("rank"))
        return hits.select("qid", "doc_id", value.alias(name))

    both = channel(vector, "v", weights[0]).join(channel(keyword, "w", weights[1]), ["qid", "doc_id"], "full")
    score = F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))
    if method == "weighted":
        score = score * F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), bonus).otherwise(1.0)
    sources = F.concat_ws("+", F.when(F.col("v").isNotNull(), "vector"), F.when(F.col("w").isNotNull(), "keyword"))
    return top_k(both.select("qid", "doc_id", F.round(score, 4).alias("score"), sources.alias("sources")), k)


def context(hits: DataFrame, docs: DataFrame, n: int = 3, snippet: int = 200) -> DataFrame:
    """(qid, context, citations): snippets of the first n hits in rank order."""
    rows = hits.filter(F.col("rank") <= n).join(docs.select("doc_id", F.substring("text", 1, snippet).alias("snippet")), "doc_id")
    ordered = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "snippet"))).alias("h"))
    cite = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["doc_id"].cast("string"))
    return ordered.select("qid", F.array_join(F.transform("h", lambda x: x["snippet"]), "\n\n").alias("context"), F.array_join(F.transform("h", cite), "; ").alias("citations"))


# Words that hedge an answer.
HEDGES = ("maybe", "perhaps", "possibly", "probably", "might", "could be", "uncertain")


def grounding(answer: Column, evidence: Column, hedges: tuple[str, ...] = HEDGES) -> tuple[Column, Column]:
    """(score, flagged): 0.2 for each hedge, and min(0.3 n, 0.5) for n of the answer's first five numbers that the
    evidence lacks; capped at 1 and flagged above 0.3."""
    low = F.lower(answer)
    hedged = sum((F.when(F.contains(low, F.lit(h)), 0.2).otherwise(0.0) for h in hedges), F.lit(0.0))
    numbers = F.slice(F.regexp_extract_all(answer, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), 1, 5)
    absent = F.size(F.filter(numbers, lambda x: ~F.contains(evidence, x)))
    score = F.round(F.least(hedged + F.least(0.3 * absent, F.lit(0.5)), F.lit(1.0)), 4)
    return score, score > 0.3


def answer_confidence(hits: DataFrame, hallucination: Column | float = 0.0) -> DataFrame:
    """(qid, confidence, review): mean final score times what is not hallucinated; review below 0.5."""
    c = F.round(F.greatest(F.avg("score") * (1 - (F.lit(hallucination) if isinstance(hallucination, float) else hallucination)), F.lit(0.0)), 4)
    return hits.groupBy("qid").agg(c.alias("confidence")).withColumn("review", F.col("confidence") < 0.5)
