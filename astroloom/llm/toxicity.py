"""Toxicity scoring with a bidirectional gated recurrent network and attention pooling, trained and run in numpy.

A word enters the network as a learned word vector (hashed) beside the mean of its character n-grams' learned vectors,
so unseen words are read by their characters. Overlapping windows of words run through a forward and a backward gated
recurrent layer; attention weighs the states of a window into one vector and a logistic unit scores it. A text's score
is that of its most toxic window, calibrated over texts. Labels are on texts, so training alternates between picking
the most toxic window of each toxic text and fitting the network to the picked windows and to windows of clean texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, f64, fold, table

WINDOW, STRIDE = 24, 12
THRESHOLD = 0.3
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 14
#: Words that a worker remembers before it starts anew, and windows that run together.
REMEMBERED, TOGETHER = 200_000, 4096
TABLE_SCALE, START = 16.0, 0.01


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample (texts of each label, and bytes of a text that may be among them) and of the fit:
    ``rounds`` of ``epochs``, more where these are fewer than ``steps`` batches."""

    toxic: int = 1200
    clean: int = 2800
    longest: int = 100_000
    clean_windows: int = 6
    rounds: int = 3
    epochs: int = 4
    steps: int = 80
    batch: int = 256
    rate: float = 0.01
    size: int = 8
    width: int = 8
    seed: int = 17


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all character n-grams (3 to 5 bytes with the word's bounds), and how many each word has."""
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint32)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - starts[owner]
    rows, owners, code = [], [], data
    for n in (2, 3, 4, 5):
        code = code[: len(data) - n + 1] * np.uint32(69_069) + data[n - 1 :] if len(data) >= n else code[:0]
        if n > 2:
            inside = np.flatnonzero(place[: len(code)] + n <= lengths[owner[: len(code)]])
            rows.append(((code[inside] * np.uint32(2_654_435_761)) >> np.uint32(18)).astype(np.int64))
            owners.append(owner[inside])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(words))


def windows_at(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one window if there are few or none."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of a text's largest logit
    cache: dict = field(default_factory=dict)

    @classmethod
    def new(cls, t: Training) -> Network:
        rng = np.random.default_rng(t.seed)
        d, h = 2 * t.size, t.width
        of = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        p = {"word": of(WORD_ROWS, t.size, s=START), "gram": of(GRAM_ROWS, t.size, s=START)}
        for way in "fb":
            p |= {f"W{way}": of(d, 3 * h, s=d**-0.5), f"U{way}": of(h, 3 * h, s=h**-0.5), f"c{way}": np.zeros(3 * h, dtype=np.float32)}
        p |= {"A": of(2 * h, h, s=0.3), "a": of(h, s=0.5), "o": of(2 * h, s=0.5), "s": np.full(1, -1.0, dtype=np.float32)}
        return cls(p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The words' input vectors and what is needed to train them."""
        hashed = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), dtype=np.int64, count=len(words))
        rows, count = grams_of(words)
        ends = np.cumsum(count)
        # Every word has an n-gram: its bounds and a character.
        sums = np.add.reduceat(self.p["gram"][rows], ends - count, axis=0) if len(words) else np.zeros((0, self.p["gram"].shape[1]), dtype=np.float32)
        return np.concatenate([self.p["word"][hashed], sums / np.maximum(count, 1)[:, None]], axis=1), (hashed, rows, count)

    def _run(self, projected: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States (time, window, unit); ``projected`` is (time, window, 3 units), in the order in which time runs."""
        u, n = self.p[f"U{way}"], self.p[f"U{way}"].shape[0]
        h = np.zeros((mask.shape[1], n), dtype=np.float32)
        out = np.empty((len(mask), *h.shape), dtype=np.float32)
        for t in range(len(mask)) if way == "f" else range(len(mask) - 1, -1, -1):
            x, g = projected[t], h @ u
            zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
            m = mask[t][:, None]
            new = np.where(m, (1 - z) * c + z * h, h)
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * n :], m))
            out[t] = h = new
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.tanh(states @ self.p["A"])
        e = np.where(mask, k @ self.p["a"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["o"] + self.p["s"][0], k, weight, pooled

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Windows (window, time) of word numbers whose projections are given."""
        at, m = ids.T, mask.T
        return self._pool(np.concatenate([self._run(projected[w][at], m, w, None) for w in "fb"], axis=2), m)[0]

    def project(self, words: list[bytes]) -> dict[str, np.ndarray]:
        x, _ = self.inputs(words)
        return {w: x @ self.p[f"W{w}"] + self.p[f"c{w}"] for w in "fb"}

    def step(self, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: dict, rate: float) -> None:
        """One step of Adam on windows over ``words``."""
        x, (hashed, rows, count) = self.inputs(words)
        at, m, p = ids.T, mask.T, self.p
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._run((x @ p[f"W{w}"] + p[f"c{w}"])[at], m, w, kept[w]) for w in "fb"]
        s = np.concatenate(states, axis=2)
        logit, k, attention, pooled = self._pool(s, m)
        g = {}
        d = (weight * (_sigmoid(logit) - y)).astype(np.float32)
        g["o"], g["s"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
        dpool = d[:, None] * p["o"]
        ds = attention[:, :, None] * dpool
        da = (s * dpool).sum(axis=2)
        de = attention * (da - (attention * da).sum(axis=0))
        dk = de[:, :, None] * p["a"] * (1 - k * k)
        g["a"] = np.einsum("tb,tbh->h", de, k)
        g["A"] = np.einsum("tbs,tbh->sh", s, dk)
        ds += dk @ p["A"].T
        dx = np.zeros_like(x)
        n = p["Uf"].shape[0]
        for j, w in enumerate("fb"):
            dh, gp, gu = np.zeros((m.shape[1], n), dtype=np.float32), np.zeros((*at.shape, 3 * n), dtype=np.float32), np.zeros_like(p[f"U{w}"])
            for t, h, z, r, c, gc, mt in reversed(kept[w]):
                dh = dh + ds[t][:, j * n : (j + 1) * n]
                live = dh * mt
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                gp[t] = np.concatenate([dz, dr, dc], axis=1)
                back = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ back
                dh = dh * ~mt + live * z + back @ p[f"U{w}"].T
            flat = scatter(at.ravel(), gp.reshape(-1, 3 * n), len(x))
            g[f"U{w}"], g[f"c{w}"], g[f"W{w}"] = gu, flat.sum(axis=0), x.T @ flat
            dx += flat @ p[f"W{w}"].T
        half = x.shape[1] // 2
        g["word"] = scatter(hashed, dx[:, :half], WORD_ROWS)
        g["gram"] = scatter(rows, np.repeat(dx[:, half:] / np.maximum(count, 1)[:, None], count, axis=0), GRAM_ROWS)
        adam["t"] = adam.get("t", 0) + 1
        for name, grad in g.items():
            mean, var = adam.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
            mean += 0.1 * (grad - mean)
            square = grad * grad
            if name in ("word", "gram"):
                # One scale for a whole table: a row moves with how often and how clearly it tells, so the vectors of
                # rare words stay near where they began and texts cannot be learned by heart.
                square = np.full_like(square, square.sum() / max(int(np.count_nonzero(square)), 1) * TABLE_SCALE)
            var += 0.001 * (square - var)
            p[name] -= rate * (mean / (1 - 0.9 ** adam["t"])) / (np.sqrt(var / (1 - 0.999 ** adam["t"])) + 1e-7)

    def window_logits(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all overlapping windows of each text; the same words are projected once."""
        if len(self.cache) > REMEMBERED:
            self.cache = {}
        ids = self.cache.setdefault("ids", {})
        new = list(dict.fromkeys(w for t in texts for w in t if w not in ids))
        of = self.cache.setdefault("of", {w: np.zeros((1024, 3 * self.p["Uf"].shape[0]), dtype=np.float32) for w in "fb"})
        if new:
            start = len(ids)
            ids.update(zip(new, range(start, start + len(new)), strict=True))
            for w, more in self.project(new).items():
                if len(of[w]) < len(ids):
                    of[w] = np.concatenate([of[w], np.zeros((max(len(ids), len(of[w])), of[w].shape[1]), dtype=np.float32)])
                of[w][start : start + len(new)] = more
        starts = [windows_at(len(t)) for t in texts]
        flat = np.fromiter((ids[w] for t in texts for w in t), dtype=np.int64, count=sum(map(len, texts)))
        flat = np.concatenate([flat, np.zeros(WINDOW + STRIDE, dtype=np.int64)])
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        first = np.concatenate([b + s for b, s in zip(begins, starts, strict=True)])
        left = np.concatenate([n - s for n, s in zip(lengths, starts, strict=True)])
        out = np.empty(len(first), dtype=np.float32)
        span = np.arange(WINDOW)
        for k in range(0, len(first), TOGETHER):
            out[k : k + TOGETHER] = self.logits(of, flat[first[k : k + TOGETHER, None] + span], span < left[k : k + TOGETHER, None])
        return np.split(out, np.cumsum([len(s) for s in starts])[:-1])

    def scores(self, texts: list[str], batch: int = 256) -> np.ndarray:
        out, words, size = [], [], 0
        for k, text in enumerate(texts):
            words.append(words_of(text))
            size += len(words[-1])
            if len(words) == batch or size > 200_000 or k == len(texts) - 1:
                if len(self.cache.get("ids", ())) > REMEMBERED:
                    self.cache = {}
                out += [x.max() for x in self.window_logits(words)]
                words, size = [], 0
        a, b = self.scale
        return _sigmoid(a * np.array(out, dtype=np.float64) + b)


def _window(words: list[bytes], start: int) -> tuple[bytes, ...]:
    return tuple(words[start : start + WINDOW])


def _telling(texts: list[list[bytes]], labels: np.ndarray) -> dict[bytes, float]:
    """How surely words, and words' first four bytes, are held by more toxic than clean texts (in standard errors of
    the difference in shares); only to pick the first windows."""
    counts: list[dict] = [{}, {}]
    for t, y in zip(texts, labels.tolist(), strict=True):
        for w in {x for w in t for x in (w, b"^" + w[:4])}:
            counts[y][w] = counts[y].get(w, 0) + 1
    total = [max(int((labels == y).sum()), 1) for y in (0, 1)]
    out = {}
    for w, n in counts[1].items():
        share = (n + counts[0].get(w, 0)) / sum(total)
        error = np.sqrt(share * (1 - share) * (1 / total[0] + 1 / total[1])) + 1e-9
        out[w] = float((n / total[1] - counts[0].get(w, 0) / total[0]) / error)
    return out


def fit_network(texts: list[str], labels: list[int], t: Training = Training()) -> Network:
    """Fits to labelled texts. With one label only, the network is as it starts and its calibration says that label."""
    net, y = Network.new(t), np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        net.scale = (0.0, 3.0 if labels and labels[0] else -6.0)
        return net
    rng, known = np.random.default_rng(t.seed), {}
    words = [[known.setdefault(w, w) for w in words_of(x)] for x in texts]
    del known
    telling, adam, best = _telling(words, y), {}, {}
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for i in toxic:
        at = windows_at(len(words[i]))
        value = [max((max(telling.get(w, 0.0), telling.get(b"^" + w[:4], 0.0)) for w in _window(words[i], s)), default=0.0) for s in at]
        best[i] = [int(at[int(np.argmax(value))])]
    for turn in range(t.rounds):
        negative = []
        for i in clean:
            at = windows_at(len(words[i]))
            some = rng.choice(at, min(t.clean_windows, len(at)), replace=False)
            negative += [_window(words[i], s) for s in some]
            # A part of a clean window is clean, too: short texts must not be judged by their length.
            negative.append(negative[-1][: int(rng.integers(0, 1 + len(negative[-1])))])
        if turn:
            found = net.window_logits([words[i] for i in toxic])
            for i, x in zip(toxic, found, strict=True):
                best[i] = [int(windows_at(len(words[i]))[int(np.argmax(x))])]
            hard = net.window_logits([words[i] for i in clean])
            negative += [_window(words[i], windows_at(len(words[i]))[int(np.argmax(x))]) for i, x in zip(clean, hard, strict=True)]
            net.cache = {}
        positive = [_window(words[i], s) for i in toxic for s in best[i]]
        windows = positive + negative
        target = np.r_[np.ones(len(positive)), np.zeros(len(negative))].astype(np.float32)
        for _ in range(max(t.epochs, -(-t.steps * t.batch // len(windows)))):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), t.batch):
                pick = order[k : k + t.batch]
                names = list(dict.fromkeys(w for i in pick for w in windows[i])) or [b"x"]
                at = {w: j for j, w in enumerate(names)}
                ids, mask = np.zeros((len(pick), WINDOW), dtype=np.int64), np.zeros((len(pick), WINDOW), dtype=bool)
                for r, i in enumerate(pick):
                    ids[r, : len(windows[i])] = [at[w] for w in windows[i]]
                    mask[r, : len(windows[i])] = True
                weight = np.where(target[pick] > 0, min(len(negative) / len(positive), 4.0), 1.0) / len(pick)
                net.step(names, ids, mask, target[pick], weight.astype(np.float32), adam, t.rate)
    net.cache = {}
    top = np.array([x.max() for x in net.window_logits(words)], dtype=float)
    net.cache = {}
    net.scale = calibrate(top, y)
    return net


def calibrate(logit: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic fit, both labels weighing alike, with a little shrinkage; Newton's method."""
    w = np.where(y == 1, 0.5 / max(int((y == 1).sum()), 1), 0.5 / max(int((y == 0).sum()), 1))
    x, c = np.stack([logit, np.ones_like(logit)], axis=1), np.array([0.3, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ c)
        grad = x.T @ (w * (p - y)) + 1e-3 * c
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(c[0], 1e-3)), float(c[1])


def training_rows(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """Texts of the first ``toxic`` and ``clean`` labelled ids by hash, from labels outside the held-out fold; an id
    with several labels counts as toxic if one is. The ids are bounded by the two parameters, so they are broadcast.
    Labelled texts of more than ``longest`` bytes teach nothing; of an id with several texts the smallest does."""
    labels = labels.filter(F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = labels.filter("toxic = 1").orderBy(order).limit(t.toxic).union(labels.filter("toxic = 0").orderBy(order).limit(t.clean))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= t.longest)
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Network:
    rows = sorted(training_rows(docs, labels, t).collect(), key=lambda r: (r.doc_id, r.text))
    return fit_network([r.text for r in rows], [int(r.toxic) for r in rows], t)


def score_texts(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score`` (0 to 1) of each whole text; a null, empty or wordless text scores as an empty window."""
    rows = docs.select(*keep, "text")
    schema = rows.drop("text").withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(*shared.value)
        for batch in batches:
            score = mine.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], f64(score)], names=schema.names)

    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(mine.scores([t or "" for t in batch.column("text").to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    scored = score_texts(docs.select("doc_id", held, "text"), learn(docs, table(spark, sf_dir, "labels")), ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
