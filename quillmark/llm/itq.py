"""Embedding near-duplicates through iterative quantisation.

A rotation learnt on a bounded sample turns vectors into balanced 64-bit codes.
Codes are filed in several Hamming tables by some of their bits; vectors filed
alike are compared, first by code distance, then by cosine of the original
vectors in double precision. Bits of a key, number of tables and the distance
looked at follow from the table at hand: from the number of vectors, and from
how the codes of the sample's vectors differ from those of vectors exactly at
the wanted cosine to them. Equal vectors are one class before filing. A pair
counts in the first table in which it meets, so a bucket sends on sums of links
and a spanning forest, never its pairs. A bucket over ``max_bucket`` classes is
dealt to pairs of chunks. Every row is filed; only the rotation is from a sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_kind, table
from .components import connected_components

BITS = 64


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code: principal axes, then the rotation that brings them
    nearest to the corners of the cube. Axes beyond the dimensions are filled by further random rotations."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(d)
    parts = []
    _, vec = np.linalg.eigh((x - mean).T @ (x - mean) + 1e-9 * np.eye(d))
    while sum(p.shape[1] for p in parts) < bits:
        axes = vec[:, ::-1][:, : min(bits, d)]
        v = (x - mean) @ axes
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, proj: np.ndarray) -> np.ndarray:
    bits = np.packbits((x - mean) @ proj >= 0, axis=1, bitorder="little")
    return bits.view("<u8").ravel()


def table_masks(key_bits: int, tables: int, seed: int = 9) -> list[int]:
    """``key_bits`` bits of each table: the disjoint blocks of a shuffled order, then those of the next order."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < tables:
        order = rng.permutation(BITS)
        out += [sum(1 << int(b) for b in order[i : i + key_bits]) for i in range(0, BITS - key_bits + 1, key_bits)]
    return out[:tables]


@dataclass(frozen=True)
class Index:
    masks: tuple[int, ...]
    radius: int
    recall: float


def plan_index(n: int, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float, recall: float = 0.995, probes: int = 4000, most_tables: int = 128, seed: int = 13) -> Index:
    """Keys and radius with which vectors exactly at ``cosine`` meet and are looked at with a share of at least ``recall``, at
    the least work for ``n`` vectors that may be filed together.

    samples: (unit vectors, mean, projection) of each length of vectors. Each of up to ``probes`` sampled vectors gets a partner
    at that cosine in a random direction; their codes tell what share meets in the first t tables of keys of k bits, whatever
    the sample's mean and shape are. A key of k bits leaves n / 2**k vectors to compare a table, and a table costs the filing of every vector."""
    rng, diffs = np.random.default_rng(seed), []
    for x, mean, proj in samples:
        if len(x) and x.shape[1] > 1:
            a = x[rng.integers(0, len(x), probes)]
            u = rng.normal(size=a.shape)
            u -= (u * a).sum(1, keepdims=True) * a
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            diffs.append(codes(a, mean, proj) ^ codes(cosine * a + math.sqrt(1 - cosine * cosine) * u, mean, proj))
    if not diffs:
        return Index(tuple(table_masks(8, 1)), BITS, 1.0)
    best = None
    for k in range(4, 33):
        masks = np.array(table_masks(k, most_tables), np.uint64)
        met = [np.cumsum([((d & m) == 0) for m in masks], axis=0) > 0 for d in diffs]
        share = np.min([m.mean(axis=1) for m in met], axis=0)
        enough = np.flatnonzero(share >= recall)
        if len(enough):
            t = int(enough[0]) + 1
            work = t * (n / 2.0**k + 32)
            if best is None or work < best[0]:
                best = (work, t, masks, float(share[t - 1]))
    if best is None:  # codes say nothing about such vectors: one bucket, which is dealt to pairs of chunks
        return Index((0,), BITS, 1.0)
    radius = max(int(np.bitwise_count(d).max()) for d in diffs) + 1
    return Index(tuple(int(m) for m in best[2][: best[1]]), radius, best[3])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (the least number of each component so far) with the links i - j taken in."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _bucket(ids, codes_, vecs, weight, masks, t, side, cosine, radius) -> tuple[np.ndarray, list]:
    """Links of one bucket that meet first in table t: weighted link counts, and a star for each component that they make."""
    n = len(ids)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, 512):
        rows = slice(at, min(at + 512, n))
        diff = codes_[rows, None] ^ codes_[None, :]
        near = np.bitwise_count(diff) <= radius
        near[np.arange(rows.stop - at), np.arange(at, rows.stop)] = False
        if side is not None:
            near &= side[rows, None] != side[None, :]
        for m in masks[:t]:
            near &= (diff & m) != 0
        i, j = np.nonzero(near)
        for cut in range(0, len(i), 1 << 18):  # a dense bucket's pairs in parts
            a, b = at + i[cut : cut + (1 << 18)], j[cut : cut + (1 << 18)]
            ok = np.einsum("ij,ij->i", vecs[a], vecs[b]) >= cosine
            a, b = a[ok], b[ok]
            links += np.rint(np.bincount(a, weight[b], n)).astype(np.int64)
            label = _components(n, a, b, label)
    star = np.flatnonzero(label != np.arange(n))
    return links, list(zip(ids[star], ids[label[star]]))


def itq_links(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.995, sample: int = 8_000, group_pairs: int = 1 << 20, max_bucket: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label; other columns, whatever their
    names, are not read).

    Rows whose label is null, or whose vector is null, empty, zero or holds a null or non-finite component, link with
    nothing. Vectors of unlike length never link. Equal vectors of a label link (cosine 1). Rows with equal vec_id are
    vectors of their own with that id; a null vec_id is no smallest id. An empty table gives no rows. ``recall`` is the share of
    links exactly at ``cosine`` that the index is planned to find; ``sample`` bounds the vectors that rotation and plan are learnt from.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding")
    slim = vectors.select(F.col("vec_id").cast(id_kind(vectors, "vec_id")[0]).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.coalesce(
        (F.size(e) > 0) & F.col("label").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) & F.exists(e, lambda x: x != 0.0),
        F.lit(False),
    )
    # -0.0 and 0.0 are one vector. A class is named by two independent hashes of label and vector, and numbered once made.
    slim = slim.withColumn("fine", fine).withColumn("embedding", F.transform(e, lambda x: x + F.lit(0.0)))
    name = lambda *first: F.when(F.col("fine"), F.xxhash64(*first, "label", "embedding"))
    rows = scratch.keep(slim.withColumn("h1", name()).withColumn("h2", name(F.lit("second"))))
    alike = rows.where("fine").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    alike = scratch.keep(alike.withColumn("class", F.monotonically_increasing_id()))
    by_label = alike.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    n, most = by_label["all"] or 0, by_label["most"] or 0
    picked = alike.select("h1", "embedding").orderBy(F.xxhash64("h1", F.lit("sample"))).limit(sample) if n <= 4 * sample else (
        alike.where(F.pmod(F.xxhash64("h1", F.lit("sample")), F.lit(1_000_000)) < int(1.2 * sample / n * 1_000_000) + 1).select("h1", "embedding").orderBy(F.xxhash64("h1", F.lit("sample"))).limit(sample)
    )
    held = picked.toArrow()
    by_size: dict[int, list] = {}
    for v in held.column("embedding"):
        by_size.setdefault(len(v), []).append(v.values.to_numpy(zero_copy_only=False))
    del held
    models, samples = {}, []
    for d, xs in sorted(by_size.items()):
        x = np.array(xs)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        models[d] = learn_rotation(x)
        samples.append((x, *models[d]))
    index = plan_index(most, samples, cosine, recall)
    del by_size, samples

    def encode(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            unit = [None] * b.num_rows
            vecs = [np.array(v) for v in b.column(0).to_pylist()]
            for d in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == d]
                x = np.stack([vecs[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very small or large components hold
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                mean, proj = models.get(d) or learn_rotation(np.eye(d))
                out[at] = codes(x, mean, proj)
                for i, v in zip(at, x):
                    unit[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(out.view(np.int64)), pa.array(unit, pa.binary())], ["class", "label", "n", "code", "unit"])

    coded = scratch.keep(alike.select("embedding", "class", "label", "n").mapInArrow(encode, "class long, label string, n long, code long, unit binary"))
    masks = list(index.masks)
    filed = coded.select("class", "label", "code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    buckets = scratch.keep(filed.groupBy("label", "t", "key").agg(F.count("*").alias("m")).where("m > 1"))
    several = filed.join(buckets, ["label", "t", "key"]).select("class", "t", "m", F.xxhash64("label", "t", "key").alias("bucket"))
    chunks = F.when(F.col("m") > max_bucket, F.ceil(F.col("m") / F.lit(max_bucket // 2))).otherwise(F.lit(1)).cast("long")
    several = several.withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("class"), F.col("chunks")))
    several = several.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    several = several.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    # Work is dealt by pairs to compare: a bucket's rows stand for m / 2 each, or a chunk's size.
    several = scratch.keep(several.select("class", "t", "bucket", "chunks", "side", "i", "j", F.least("m", F.lit(max_bucket)).alias("cost")))
    groups = max(1, -(-int(several.agg(F.sum("cost")).first()[0] or 0) // group_pairs))
    dealt = several.join(coded.select("class", "code", "unit", "n"), "class").withColumn(
        "g", F.when(F.col("chunks") > 1, F.xxhash64("bucket", "i", "j")).otherwise(F.pmod(F.col("bucket"), F.lit(groups)))
    )
    np_masks = [np.uint64(m) for m in masks]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "i", "j", "class"], kind="stable")
        out = []
        for (_, i, j), b in pdf.groupby(["bucket", "i", "j"], sort=False):
            if len(b) < 2:
                continue
            for _, c in b.groupby(b["unit"].map(len)) if b["unit"].map(len).nunique() > 1 else [(0, b)]:
                ids = c["class"].to_numpy()
                side = c["side"].to_numpy() if i != j else None
                links, edges = _bucket(ids, c["code"].to_numpy().view(np.uint64), np.stack([np.frombuffer(u) for u in c["unit"]]), c["n"].to_numpy(), np_masks, int(c["t"].iloc[0]), side, cosine, index.radius)
                out += [(int(k), None, int(v)) for k, v in zip(ids, links) if v] + [(int(u), int(v), 0) for u, v in edges]
        return pd.DataFrame(out, columns=["u", "v", "links"]).astype({"u": "int64", "v": "Int64", "links": "int64"})

    found = scratch.keep(dealt.groupBy("g").applyInPandas(compare, "u long, v long, links long"))
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v is not null").select("u", "v"), scratch)
    rooted = alike.select("class", "h1", "h2", "least_id", "n").join(roots, F.col("class") == F.col("node"), "left").select("class", "h1", "h2", "least_id", "n", F.coalesce("root", "class").alias("root"))
    rooted = scratch.keep(rooted)
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least_id").alias("component")))
    told = (
        rooted.join(named, "root").join(links, F.col("class") == F.col("u"), "left")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    told = scratch.keep(told)
    done = rows.select("vec_id", "h1", "h2").join(told, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.when(F.col("_h1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return done.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_links(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.a, r.root FROM r JOIN p ON p.b = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""
