"""Masked pseudo-likelihood of documents under a small bidirectional network over tokens.

Tokens are the ids of a public vocabulary (:mod:`inkdex.llm.tokens`).  The network
sees the tokens on both sides of a masked one and predicts it: embeddings of the
neighbours, one hidden layer, and a softmax in three steps, as an id's three digits
to the base ``DIGITS`` are predicted one after another, each from the hidden layer gated by
the digits before.  All ids have a probability, and they sum to one.

It is trained in numpy on the histogram of all windows of the whole corpus, which
tasks count and Spark brings together: a row for each distinct window, weighted by its count, spread over as
many tasks as the number of rows asks for.  The network starts from the ids' own frequencies.
In each round every task improves the shared weights on its part; tasks send their
weights in blocks, which are averaged where they meet, rows of a token by how often the
task saw it; the driver gets one set of weights.  A document's score is the sum of
its tokens' conditional log-probabilities.

What is gathered grows with the corpus, as its distinct windows do, and stays
distributed.  Texts are encoded once; their ids are kept, compressed, for scoring.

Defined cases: a null text is empty; a text without tokens has sum 0 and a null
mean; repeated rows are scored each and count in training; texts of any length are
scored whole; an empty table gives an empty result; further columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import FLUSH_BYTES, Rows, as_bytes
from inkdex.llm.common import materialize, release, ship, shuffle_partitions
from inkdex.llm.tokens import words

DIGITS = 37
SPACE = DIGITS**3  # ids lie below; the last stands for what is beyond a text
PAD = SPACE - 1
EMBED, HIDDEN, BATCH = 16, 32, 8192
PART_WINDOWS, LEAST_PARTS, ROUNDS, PASSES, RATE = 2_000_000, 8, 3, 1, 0.03
BLOCKS = 64  # rows that a task sends of each array of weights
_TOKENS = FLUSH_BYTES // 4  # tokens that are worked on at a time


def encoded(df: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    """(key, n_tokens, ids): compressed unsigned 32-bit ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, squeeze = words(vocabulary), zstandard.ZstdCompressor(level=1).compress
        rows = Rows(pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = memo.encode(body)
                packed = squeeze(ids)
                rows.add(k, len(ids) // 4, packed, size=len(packed) + 64)
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{key}` bigint, n_tokens bigint, ids binary")


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the window (token before, token, token after) of every token, text by text, and where each text's first one is (and the end)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.full(starts[-1] + len(texts) + 1, PAD, dtype=np.int64)
    inside = np.ones(len(padded), dtype=bool)
    inside[0] = False
    inside[1 + starts[1:] + np.arange(len(texts))] = False  # a pad after each text
    padded[inside] = np.concatenate([*texts, np.zeros(0, np.int64)])
    code = (padded[:-2] * SPACE + padded[1:-1]) * SPACE + padded[2:]
    return code[inside[1:-1]], starts


def split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours as rows of two, masked token) of window codes."""
    rest, right = np.divmod(code, SPACE)
    left, middle = np.divmod(rest, SPACE)
    return np.stack([left, right], axis=1), middle


def _texts(batches: Iterator[pa.RecordBatch], ids: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Blocks of rows, of about _TOKENS tokens, with their ids."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        first, held, texts = 0, 0, []
        for at, z in enumerate(batch.column(ids).to_pylist(), 1):
            texts.append(np.frombuffer(unpack(z), "<u4"))
            held += len(texts[-1])
            if held >= _TOKENS or at == batch.num_rows:
                yield batch.slice(first, at - first), texts
                first, held, texts = at, 0, []


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted counts of codes as one, from several."""
    code, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def histogram(tokens: DataFrame) -> DataFrame:
    """(code, n): how often each window occurs in all texts.

    Each task counts its own; what is shuffled are sorted lists of codes and counts, one for
    each bucket of codes, compressed.  A bucket's lists are merged where they meet; there are
    four buckets for each shuffle partition, so they shrink as partitions are added.
    """
    parts = shuffle_partitions(tokens.sparkSession)
    buckets = 4 * parts
    schema = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, squeeze = [], 0, zstandard.ZstdCompressor(level=1).compress

        def out(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16 if buckets < 65_536 else np.int64), kind="stable")
            code, n, bucket = code[order], n[order], bucket[order]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(code)]
            rows = Rows(schema)
            for lo, hi in zip(cuts, cuts[1:]):
                steps = np.diff(code[lo:hi], prepend=0)
                packed, counts = squeeze(steps.tobytes()), squeeze(n[lo:hi].tobytes())
                rows.add(int(bucket[lo]), packed, counts, size=len(packed) + len(counts))
                if rows.full:
                    yield rows.take()
            yield rows.take()

        for _, texts in _texts(batches, 0):
            code, _ = windows(texts)
            if len(code):
                held.append(np.unique(code, return_counts=True))
                size += len(held[-1][0])
            if size > 3_000_000:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 2_200_000:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*_merged(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, size, now = [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            code, n = _merged(held)
            for at in range(0, len(code), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 200_000]), pa.array(n[at : at + 200_000])], names=["code", "n"])

        for batch in batches:
            for bucket, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from out()
                    held, size = [], 0
                now = bucket
                held.append((np.cumsum(np.frombuffer(unpack(codes), np.int64)), np.frombuffer(unpack(counts), np.int64)))
                size += len(held[-1][0])
                if size > 4_000_000 and len(held) > 1:
                    held = [_merged(held)]
                    size = len(held[0][0])
        if held:
            yield from out()

    lists = tokens.select("ids").mapInArrow(count, "bucket int, codes binary, counts binary")
    return lists.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(merge, "code bigint, n bigint")


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct index, sum of the values' rows with it)."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(index) else np.zeros(0, np.int64)
    return sorted_[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


class Network:
    """Weights: embeddings, hidden layer, and for each digit an output layer, biases and gates by the digits before."""

    NAMES = ("embed", "w", "b", "out1", "bias1", "out2", "bias2", "gate2", "out3", "bias3", "gate3")
    SPARSE = {"embed": 0, "bias2": 1, "gate2": 1, "bias3": 2, "gate3": 2}  # of which a batch moves some rows only

    def __init__(self, seed: int = 7, counts: np.ndarray | None = None):
        rng, f = np.random.default_rng(seed), np.float32
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(f)
        n = np.zeros(SPACE) if counts is None else counts.astype(np.float64)
        n = (n + 0.1).reshape(DIGITS, DIGITS, DIGITS)
        bias = [np.log(n.sum((1, 2)))[None], np.log(n.sum(2)), np.log(n).reshape(-1, DIGITS)]
        bias = [(b - b.max(1, keepdims=True)).astype(f) for b in bias]
        self.w = {
            "embed": normal(0.1, SPACE, EMBED), "w": normal((2 * EMBED) ** -0.5, 2 * EMBED, HIDDEN), "b": np.zeros(HIDDEN, f),
            "out1": normal(0.01, HIDDEN, DIGITS), "bias1": bias[0][0], "out2": normal(0.01, HIDDEN, DIGITS), "bias2": bias[1], "gate2": np.ones((DIGITS, HIDDEN), f),
            "out3": normal(0.01, HIDDEN, DIGITS), "bias3": bias[2], "gate3": np.ones((DIGITS**2, HIDDEN), f)}

    def forward(self, near: np.ndarray, middle: np.ndarray):
        w = self.w
        x = w["embed"][near].reshape(len(near), -1)
        h = np.tanh(x @ w["w"] + w["b"])
        high, third = np.divmod(middle, DIGITS)
        first, second = np.divmod(high, DIGITS)
        steps = []
        for digit, given, n in ((first, None, 1), (second, first, 2), (third, high, 3)):
            hidden = h if given is None else h * w[f"gate{n}"][given]
            z = hidden @ w[f"out{n}"] + (w["bias1"] if given is None else w[f"bias{n}"][given])
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1, keepdims=True)
            log_p = z[np.arange(len(digit)), digit] - np.log(total[:, 0])
            steps.append((digit, given, hidden, p / total, log_p))
        return x, h, steps, sum(s[4] for s in steps)

    def log_p(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of the masked token of each window."""
        out = np.empty(len(code), dtype=np.float32)
        for at in range(0, len(code), BATCH):
            out[at : at + BATCH] = self.forward(*split(code[at : at + BATCH]))[3]
        return out

    def gradient(self, near: np.ndarray, middle: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted negative log-probability; for arrays in SPARSE (rows, their gradients)."""
        w, out = self.w, {}
        x, h, steps, _ = self.forward(near, middle)
        dh = np.zeros_like(h)
        for n, (digit, given, hidden, p, _) in enumerate(steps, 1):
            p[np.arange(len(digit)), digit] -= 1
            p *= weight[:, None]
            out[f"out{n}"] = hidden.T @ p
            back = p @ w[f"out{n}"].T
            if given is None:
                out["bias1"] = p.sum(0)
                dh += back
            else:
                out[f"bias{n}"] = _sums(given, p)
                out[f"gate{n}"] = _sums(given, back * h)
                dh += back * w[f"gate{n}"][given]
        dh *= 1 - h * h
        dx = dh @ w["w"].T
        out["w"], out["b"] = x.T @ dh, dh.sum(0)
        out["embed"] = _sums(near.reshape(-1), dx.reshape(-1, EMBED))
        return out

    def improve(self, code: np.ndarray, n: np.ndarray, rate: float, seed: int) -> None:
        """One pass of Adam over weighted windows, in 64 steps or more; windows of great weight come several times, with a part of it each."""
        most = max(1, int(64 * n.mean()))
        times = -(-n // most)
        weight = np.repeat(n / times / n.mean(), times)
        order = np.random.default_rng(seed).permutation(len(weight))
        code = np.repeat(code, times)
        size = min(BATCH, max(16, len(code) // 64))
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        again = -(-64 // -(-len(order) // size))  # few windows are gone through several times
        order = np.tile(order, again)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            step += 1
            scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, g in self.gradient(*split(code[part]), (weight[part] / size).astype(np.float32)).items():
                rows, g = g if k in self.SPARSE else (slice(None), g)
                m[k][rows] += 0.1 * (g - m[k][rows])
                v[k][rows] += 0.01 * (g * g - v[k][rows])
                self.w[k][rows] -= scale * m[k][rows] / (np.sqrt(v[k][rows]) + 1e-6)

    def mass(self, code: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """How much these windows say of each row of each array."""
        near, middle = split(code)
        count = lambda index, size, weight=n: np.bincount(index, weights=weight, minlength=size)
        by = [count(near.reshape(-1), SPACE, np.repeat(n, 2)), count(middle // DIGITS**2, DIGITS), count(middle // DIGITS, DIGITS**2)]
        return {k: by[self.SPARSE[k]] if k in self.SPARSE else np.full(len(a), float(n.sum())) for k, a in self.w.items()}


def train(windows_: DataFrame, parts: int | None = None, rounds: int = ROUNDS) -> Network:
    """A network fitted to a table (code, n) by rounds of local training and averaging."""
    spark = windows_.sparkSession
    table = materialize(windows_, "windows")
    parts = parts or max(LEAST_PARTS, -(-table.count() // PART_WINDOWS))
    # at most SPACE rows: the ids' frequencies
    middle = F.expr(f"(code div {SPACE}) % {SPACE}").cast("int").alias("token")
    found = table.groupBy(middle).agg(F.sum("n").alias("n")).toPandas()
    counts = np.bincount(found["token"].to_numpy(dtype=np.int64), weights=found["n"].to_numpy(dtype=np.float64), minlength=SPACE)
    spread = materialize(table.repartition(parts, F.xxhash64("code")).sortWithinPartitions("code"), "spread-windows")
    release(table)
    net = Network(counts=counts)
    for k in range(rounds):
        now, rate = spark.sparkContext.broadcast(net.w), RATE / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=rate, k=k) -> Iterator[pa.RecordBatch]:
            own, mass = Network(), None
            own.w = {n: a.copy() for n, a in now.value.items()}
            held: list[pa.RecordBatch] = []

            def learn() -> dict:
                code, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
                for again in range(PASSES):
                    own.improve(code, n, rate, PASSES * k + again)
                return own.mass(code, n)

            def more(a: dict | None, b: dict) -> dict:
                return b if a is None else {n: a[n] + b[n] for n in b}

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= PART_WINDOWS:
                    mass, held = more(mass, learn()), []
            if sum(b.num_rows for b in held):
                mass = more(mass, learn())
            if mass is not None:
                for name, a in own.w.items():
                    for at in range(0, len(a), step := -(-len(a) // BLOCKS)):
                        m = mass[name][at : at + step]
                        v = (a[at : at + step].reshape(len(m), -1) * m[:, None]).astype(np.float32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([at], pa.int64()), pa.array([m.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["name", "at", "mass", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, int], list[np.ndarray]] = {}
            for batch in batches:
                for name, at, m, v in zip(*(c.to_pylist() for c in batch.columns)):
                    m, v = np.frombuffer(m), np.frombuffer(v, np.float32).astype(np.float64)
                    if (name, at) in total:
                        total[name, at][0] += m
                        total[name, at][1] += v
                    else:
                        total[name, at] = [m.copy(), v]
            for (name, at), (m, v) in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at], pa.int64()), pa.array([m.tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["name", "at", "mass", "sums"])

        schema = "name string, at bigint, mass binary, sums binary"
        sent = materialize(spread.mapInArrow(run, schema), "sent-weights")  # trained once, whatever reads it
        merged = sent.repartition("name", "at").mapInArrow(add, schema)
        for r in merged.collect():  # one set of weights
            m, a = np.frombuffer(r.mass), net.w[r.name]
            v = np.frombuffer(r.sums, np.float32).reshape(len(m), -1)
            rows = a.reshape(len(a), -1)[r.at : r.at + len(m)]
            rows[m > 0] = v[m > 0] / m[m > 0, None]
        release(sent)
        now.unpersist()
    return net


def score(tokens: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, sum_log_p, mean_log_p) of every encoded text."""
    weights = tokens.sparkSession.sparkContext.broadcast(net.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.w = weights.value
        for rows, texts in _texts(batches, 1):
            code, starts = windows(texts)
            seen, at = np.unique(code, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(own.log_p(seen)[at], dtype=np.float64)])
            n = np.diff(starts)
            total = sums[starts[1:]] - sums[starts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)],
                names=[key, "n_tokens", "sum_log_p", "mean_log_p"])

    return tokens.select(key, "ids").mapInArrow(run, f"`{key}` bigint, n_tokens bigint, sum_log_p double, mean_log_p double")


def score_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents under a network trained on all of them."""
    ship(df.sparkSession)
    tokens = materialize(encoded(df, vocabulary, key, text), "token-ids")
    return score(tokens, train(histogram(tokens)), key)
