"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded,
gated attention weighs the passages, and the weighted sum of their encodings is
scored; only documents have labels, so attention is learnt from those. The model
is a few thousand numbers, fitted on the driver from a bounded sample of
labelled documents, and applied wherever the text lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hand_back, id_crc, table, text_bytes

#: Words a passage, hashed buckets of character-class trigrams, surface measures of a passage.
PASSAGE_WORDS, BUCKETS, SURFACE = 64, 96, 6
DIM = BUCKETS + SURFACE


def _classes() -> np.ndarray:
    """Character class of each byte: lower, upper, digit, part of a longer code point, blank, and punctuation by itself."""
    out = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        out[c] = 0 if c == 32 else 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3 if ch.isdigit() and c < 128 else 4 if c >= 128 else 5 + c % 27
    return out


_CLASS = _classes()
_BUCKET = ((np.arange(1 << 15, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % BUCKETS


def encode_passages(text: bytes, at_once: int = 1 << 16) -> np.ndarray:
    """A row of DIM features for each passage of the whole text; a text without words is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, DIM), np.float32)
    out = []
    for at in range(0, len(words), at_once):
        part = words[at : at + at_once]
        n = len(part)
        passages = -(-n // PASSAGE_WORDS)
        of_word = np.arange(n) * passages // n
        lengths = np.fromiter(map(len, part), np.int64, n)
        c = _CLASS[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        of_byte = np.repeat(of_word, lengths + 1)
        tri = _BUCKET[(c << 10 | np.roll(c, -1) << 5 | np.roll(c, -2))]
        counts = np.bincount(of_byte * BUCKETS + tri, minlength=passages * BUCKETS).reshape(passages, BUCKETS)
        x = np.zeros((passages, DIM), np.float32)
        x[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        size = np.bincount(of_word, minlength=passages)
        cuts = np.searchsorted(of_word, np.arange(passages + 1))
        same = np.array([0, *(a == b for a, b in zip(part, part[1:]))])
        x[:, BUCKETS] = [len(set(part[a:b])) / (b - a) for a, b in zip(cuts[:-1], cuts[1:])]
        x[:, BUCKETS + 1] = np.bincount(of_word, weights=same, minlength=passages) / size
        x[:, BUCKETS + 2] = np.log1p(np.bincount(of_word, weights=lengths, minlength=passages) / size) / 3
        x[:, BUCKETS + 3] = np.log1p(size) / 5
        x[:, BUCKETS + 4] = np.log1p(len(words)) / 10
        x[:, BUCKETS + 5] = 1
        out.append(x)
    return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """z = tanh(W x + b); attention ~ exp(u . (tanh(V z) * sigmoid(G z))); score = sigmoid(c . sum(attention z) + d)."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """starts: the first passage of each document."""
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        z = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(z @ p["V"]), _sigmoid(z @ p["G"])
        e = (t * g) @ p["u"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(a[:, None] * z, starts)
        s = _sigmoid(bag @ p["c"] + p["d"])
        return s, {"z": z, "t": t, "g": g, "a": a, "bag": bag, "sizes": sizes}

    def gradients(self, x, starts, y) -> dict[str, np.ndarray]:
        p = self.p
        s, k = self.forward(x, starts)
        ds = (s - y) / len(y)
        dbag = np.repeat(ds[:, None] * p["c"], k["sizes"], axis=0)
        da = (dbag * k["z"]).sum(1)
        de = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, starts), k["sizes"]))
        h = de[:, None] * p["u"]
        dt, dg = h * k["g"] * (1 - k["t"] ** 2), h * k["t"] * k["g"] * (1 - k["g"])
        dz = (k["a"][:, None] * dbag + dt @ p["V"].T + dg @ p["G"].T) * (1 - k["z"] ** 2)
        return {"W": x.T @ dz, "b": dz.sum(0), "V": k["z"].T @ dt, "G": k["z"].T @ dg, "u": (k["t"] * k["g"]).T @ de, "c": k["bag"].T @ ds, "d": np.array([ds.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 16, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam on the log loss. Without bags of both labels the score is the share of label 1, kept off 0 and 1."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float64)
    rate1 = (labels.sum() + 1) / (len(labels) + 2)
    p = {"W": draw(DIM, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "G": draw(hidden, gate), "u": draw(gate), "c": np.zeros(hidden), "d": np.array([np.log(rate1 / (1 - rate1))])}
    model = Model(p)
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order, lr = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            step += 1
            for k, g in model.gradients(x, starts, labels[pick]).items():
                g = g + decay * p[k] * (k != "d")
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, passages: int = 100_000) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod 5 is not 0, on every passage of each.

    ``sample`` bounds the labelled rows, taken in order of a hash of id and text, and ``passages`` what they hold together: a row
    that would go beyond it is passed over. So what comes to the driver is bounded whatever the tables hold. Labels that are
    null are none; where an id has several labels, their rounded mean counts; rows alike in id and text are one. Ids may be of
    any type. ``labels`` needs doc_id and quality; other columns of either table are not read.
    """
    spark = docs.sparkSession
    told = labels.where("quality is not null and doc_id is not null").where(id_crc(F.col("doc_id")) % 5 != 0)
    n = told.count()
    if not n:
        return fit([], np.array([]))
    keep = min(1.0, 1.2 * sample / n)
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < int(keep * 1_000_000) + 1
    ids = told.where(dice).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y")).orderBy(F.xxhash64("doc_id")).limit(sample).collect()
    known = F.broadcast(spark.createDataFrame([(str(r["doc_id"]), r["y"]) for r in ids], "_id string, _y int"))  # at most `sample` rows
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(known, F.col("id") == F.col("_id"))
    rows = rows.select("id", "text", "_y", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"))
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    sized = rows.select("id", "h", "t", words.alias("n")).distinct().orderBy("h", "id", "t").limit(sample).collect()
    held, picks = 0, []
    for r in sized:
        n = max(1, -(-r["n"] // PASSAGE_WORDS))
        if held + n <= passages:
            held += n
            picks.append((r["id"], r["t"]))
    chosen = F.broadcast(spark.createDataFrame(picks, "_pick string, _t long"))  # at most `sample` rows

    def run(batches):
        for b in batches:
            rows = []
            for y, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                x = encode_passages(t)
                rows.append((y, len(x), x.tobytes()))
            ys, ns, xs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int32()), pa.array(xs, pa.binary())], ["y", "n", "x"])

    told = rows.join(chosen, (F.col("id") == F.col("_pick")) & (F.col("t") == F.col("_t"))).dropDuplicates(["id", "t"])
    got = told.select("_y", "text").mapInArrow(run, "y int, n int, x binary").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))  # the order of arrival must not matter
    bags = [np.frombuffer(r["x"], np.float32).reshape(r["n"], DIM) for r in got]
    return fit(bags, np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with a double ``name`` (a column of that name is replaced). Null and empty text is one empty passage; equal texts
    score alike; other columns pass; an empty table stays empty."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        bags, rows, held = [], [], 0

        def flush():
            if bags:
                starts = np.cumsum([0, *(len(x) for x in bags[:-1])])
                out[rows] = model.forward(np.concatenate(bags).astype(np.float64), starts)[0]
                bags.clear(), rows.clear()

        for at in range(0, len(texts), 512):
            for i, t in enumerate(text_bytes(texts.slice(at, 512)), at):
                x = encode_passages(t)
                bags.append(x), rows.append(i)
                held += len(x)
                if held > 8192:
                    flush()
                    held = 0
        flush()
        hand_back()
        return pa.array(out)

    return docs.withColumn(name, run(F.coalesce(docs["text"].cast("string"), F.lit(""))))


THRESHOLD = 0.3


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return done.select(
        "doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier learnt from ``labels`` scores at ``threshold`` or more, with their own columns
    alone, whatever their names. Null and empty text counts as one empty passage; repeated rows stay or go alike; without labels
    every row has the same score; an empty table stays empty."""
    name = fresh("quality_score", docs.columns)
    return score(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)
