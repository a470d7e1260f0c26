"""Language-model scores by subword lattice likelihood.

Pieces of an existing vocabulary score all segmentations of a text: a forward
recursion in log space sums over them and returns the text's marginal
probability. As pieces that begin a word begin with the word mark, the lattice
of a text falls apart into those of its words, so each distinct word is run
through the recursion once. The vocabulary's own scores weigh the segmentations
at first; the pieces that are then expected in the training documents' words,
over all their segmentations (forward and backward), weigh them anew beside
those scores, for a few rounds.

Counts and word scores are tables that grow with the corpus and are never
gathered; only the ``head`` most frequent words (a bound, not a cut: the rest is
joined) are broadcast, which also keeps very frequent words out of the join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hand_back, id_crc, slices, table, text_bytes

MARK = "▁"
LN10 = math.log(10)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(code_points: np.ndarray) -> np.ndarray:
    x = code_points.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _prefix_hashes(code_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed code points times powers of a base, and the inverse powers: the hash of any stretch a to b is
    (sums[b] - sums[a]) * inverse[a], modulo 2 to the 64."""
    n = len(code_points)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE)]), dtype=np.uint64)[:n]
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(_mixed(code_points) * powers, dtype=np.uint64)]), inverse


class Vocabulary:
    """Pieces of a sentencepiece file with their ids; bytes by value."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        self.size = n
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: The file scores pieces by falling rank; as weights they are taken as a Zipf law over that rank.
        self.prior = np.zeros(n)
        for i in plain:
            self.prior[i] = 1 / (10 - m.get_score(i))
        self.prior[self.byte_ids] = self.prior[plain].min()
        self.prior /= self.prior.sum()
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()), np.int64)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces of one hash")

    @staticmethod
    def _hash(piece: str) -> int:
        return int(_prefix_hashes(np.array([ord(c) for c in piece], np.uint32))[0][-1])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def piece_logs(vocab: Vocabulary, counts: dict[int, float], ends: int, prior_share: float = 0.1) -> tuple[np.ndarray, float]:
    """Natural logs of piece probabilities and of the end of a text, which share one distribution. The vocabulary's own scores
    weigh ``prior_share`` of what the counts weigh, and as much as 1000 pieces at least."""
    n = np.zeros(vocab.size)
    for i, c in counts.items():
        n[i] += c
    weight = max(1000.0, prior_share * n.sum())
    total = n.sum() + weight + ends + 1
    with np.errstate(divide="ignore"):
        return np.log((n + weight * vocab.prior) / total), math.log((ends + 1) / total)


class Lattice:
    """The lattices of many words at once: positions of all words advance together, the longest words first."""

    def __init__(self, vocab: Vocabulary, logs: np.ndarray):
        self.vocab, self.logs = vocab, logs

    def _build(self, words: list[str]) -> None:
        v, n = self.vocab, len(words)
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        text = "".join([MARK + words[i] for i in self.order])
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.size = np.array([len(words[i]) + 1 for i in self.order])
        self.start = np.append(0, np.cumsum(self.size)[:-1]).astype(np.int64)
        self.of = np.repeat(np.arange(n), self.size)
        place = np.arange(len(chars)) - self.start[self.of]
        sums, inverse = _prefix_hashes(chars)
        # weight[l - 1, e]: log probability of the piece of l characters that ends with character e.
        self.weight = np.full((v.longest, len(chars)), -np.inf)
        self.arcs = []
        for length in range(1, min(v.longest, int(self.size[0])) + 1):
            e = np.flatnonzero(place >= length - 1)
            a = e - (length - 1)
            h = (sums[e + 1] - sums[a]) * inverse[a]
            at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            ok = v.hashes[at] == h
            e, piece = e[ok], v.hash_ids[at[ok]]
            self.weight[length - 1, e] = self.logs[piece]
            self.arcs.append((length, e, piece))
        # A character that is no piece is spelt in bytes.
        bare = np.ones(len(chars), bool)
        bare[self.arcs[0][1]] = False
        self.bare = np.flatnonzero(bare)
        self.bare_chars, which = np.unique(chars[self.bare], return_inverse=True)
        spelt = np.array([sum(self.logs[v.byte_ids[b]] for b in chr(c).encode()) for c in self.bare_chars])
        if len(self.bare):
            self.weight[0, self.bare] = spelt[which]
        self.bare_which = which

    @staticmethod
    def _sum(t: np.ndarray) -> np.ndarray:
        top = t.max(axis=0)
        return top + np.log(np.exp(t - top).sum(axis=0))

    def _forward(self) -> None:
        """alpha[start + word + i]: log probability of the first i characters of a word."""
        self.base = self.start + np.arange(len(self.start))
        self.alpha = np.zeros(len(self.of) + len(self.start))
        back = np.arange(1, self.vocab.longest + 1)[:, None]
        longer = np.searchsorted(-self.size, -np.arange(1, self.size[0] + 1), "right")  # words of at least i characters
        for i, k in enumerate(longer.tolist(), 1):
            m, b = min(i, self.vocab.longest), self.base[:k] + i
            self.alpha[b] = self._sum(self.weight[:m, self.start[:k] + (i - 1)] + self.alpha[b - back[:m]])
        self.total = self.alpha[self.base + self.size]

    def _backward(self) -> None:
        """beta: log probability of what follows a position."""
        self.beta = np.zeros_like(self.alpha)
        on = np.arange(1, self.vocab.longest + 1)[:, None]
        longer = np.searchsorted(-self.size, -np.arange(1, self.size[0] + 1), "right")
        for j, k in enumerate(longer.tolist(), 1):
            m, at = min(j, self.vocab.longest), self.size[:k] - j
            w = self.weight[on[:m] - 1, self.start[:k] + at + on[:m] - 1]
            self.beta[self.base[:k] + at] = self._sum(w + self.beta[self.base[:k] + at + on[:m]])

    def _blocks(self, words: list[str], most: int = 60_000):
        at = 0
        while at < len(words):
            to, n = at, 0
            while to < len(words) and (to == at or n + len(words[to]) < most):
                n += len(words[to]) + 1
                to += 1
            yield at, to
            at = to

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word summed over its segmentations."""
        out = np.zeros(len(words))
        for a, b in self._blocks(words):
            self._build(words[a:b])
            self._forward()
            out[a + self.order] = self.total
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each as often as it counts, over all their segmentations."""
        out = np.zeros(self.vocab.size)
        for a, b in self._blocks(words):
            self._build(words[a:b])
            self._forward()
            self._backward()
            n = counts[a:b][self.order]

            def share(e, length):
                w = self.of[e]
                return n[w] * np.exp(self.alpha[e + w + 1 - length] + self.weight[length - 1, e] + self.beta[e + w + 1] - self.total[w])

            for length, e, piece in self.arcs:
                out += np.bincount(piece, share(e, length), self.vocab.size)
            if len(self.bare):
                sums = np.bincount(self.bare_which, share(self.bare, 1), len(self.bare_chars))
                for c, x in zip(self.bare_chars, sums):
                    for byte in chr(c).encode():
                        out[self.vocab.byte_ids[byte]] += x
        return out


def count_words(docs: DataFrame, is_training) -> DataFrame:
    """word (UTF-8, A-Z lower-cased), n (in training documents), of every distinct word of ``docs``."""

    def run(batches):
        held: Counter = Counter()
        other: set = set()

        def flush():
            words = list(held) + [w for w in other if w not in held]
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([held.get(w, 0) for w in part], pa.int64())], ["word", "n"])
            held.clear(), other.clear()

        for b in slices(batches):
            for t, train in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                words = t.lower().split()
                if train:
                    held.update(words)
                else:
                    other.update(words)
                if len(held) + len(other) > 300_000:
                    yield from flush()
        yield from flush()
        hand_back()

    partial = docs.select(F.col("text").cast("string").alias("text"), is_training.alias("train")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


#: Expected counts are added up in units of this, as whole numbers, whose sum does not depend on the order.
_UNIT = 2.0**-20


def lattice_scores(docs: DataFrame, is_training, vocabulary_path: str, head: int = 50_000, rounds: int = 2, prior_share: float = 0.1) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read; other columns, whatever their names, are not): doc_id, training,
    n_tokens, n_known, train_tokens, base_score, score (log10 probabilities; base: words with add-one counts, score: the lattice).

    Tokens are the words of the whole text and its end. Null and empty text is its end alone. Repeated rows and rows with
    equal or null doc_id are scored each. Without training documents counts are zero and the prior alone speaks. An empty
    table gives no rows. ``rounds``: times that pieces are expected in all training words and weighed anew.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(is_training, F.lit(False)).alias("training"))
    counts = scratch.keep(count_words(rows, F.col("training")))
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    ends = rows.where("training").count()
    total, types = n_words + ends, n_types + (ends > 0)

    # Expected pieces: each distinct training word once, weighted by its count; at most one row a piece comes back.
    vocab = vocabulary(vocabulary_path)
    logs, end_log = piece_logs(vocab, {}, ends, prior_share)

    def expect(batches):
        lattice, got = Lattice(vocabulary(vocabulary_path), logs), 0.0
        for b in slices(batches, 10_000):
            got = got + lattice.expected(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float))
        units = np.rint(np.broadcast_to(got, lattice.vocab.size) / _UNIT).astype(np.int64)
        found = np.flatnonzero(units)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(units[found])], ["piece", "n"])

    for _ in range(rounds):
        pieces = counts.where("n > 0").mapInArrow(expect, "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        logs, end_log = piece_logs(vocab, {r["piece"]: float(r["n"]) * _UNIT for r in pieces}, ends, prior_share)
    floor = math.log10(total + types + 1)

    def weigh(batches):
        lattice = Lattice(vocabulary(vocabulary_path), logs)
        for b in slices(batches, 10_000):
            out = lattice.words(b.column(0).to_pylist()) / LN10
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["word", "n", "log10_p"])

    words = scratch.keep(counts.mapInArrow(weigh, "word string, n long, log10_p double"))

    # The head: words above a count that at most `head` words have.
    histogram = words.groupBy(F.floor(F.log2(F.col("n") + 1) * 16).alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()  # some hundred rows
    least, held = None, 0
    for r in sorted(histogram, key=lambda r: -r["b"]):
        if held + r["k"] > head:
            break
        held += r["k"]
        least = r["least"]
    top = words.where(F.col("n") >= least).collect() if least is not None else []
    known = {r["word"].encode(): (math.log10(r["n"] + 1), r["log10_p"], r["n"] > 0) for r in top}
    shared = spark.sparkContext.broadcast(known)

    def lookup(batches):
        table_ = shared.value
        for b in slices(batches):
            out = []
            for t in text_bytes(b.column(1)):
                seen = Counter(t.lower().split())
                n = known_n = 0
                base = lp = 0.0
                tail, tail_n = [], []
                for w, k in seen.items():
                    n += k
                    got = table_.get(w)
                    if got is None:
                        tail.append(w)
                        tail_n.append(k)
                    else:
                        base += k * got[0]
                        lp += k * got[1]
                        known_n += k * got[2]
                out.append((n, known_n, base, lp, tail, tail_n))
            n, known_n, base, lp, tail, tail_n = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(lp, pa.float64()),
                 pa.array(tail, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(tail_n, pa.list_(pa.int32()))],
                ["doc_id", "training", "n", "known", "base", "lp", "tail", "tail_n"],
            )

    id_type = dict(docs.dtypes)["doc_id"]
    parts = rows.mapInArrow(lookup, f"doc_id {id_type}, training boolean, n long, known long, base double, lp double, tail array<string>, tail_n array<int>")
    parts = scratch.keep(parts.withColumn("row", F.monotonically_increasing_id()))
    tails = parts.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    rare = words.where(F.col("n") < least) if least is not None else words
    tail_sums = (
        tails.join(rare, "word")
        .groupBy("row").agg(
            F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("base2"), F.sum(F.col("k") * F.col("log10_p")).alias("lp2"),
            F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known2"),
        ).withColumnRenamed("row", "_row")
    )
    end_known = 1 if ends else 0
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.join(tail_sums, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "training", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + z("known2") + end_known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + z("base2") + F.lit(math.log10(ends + 1)) - (F.col("n") + 1) * F.lit(floor)).alias("base_score"),
        (F.col("lp") + z("lp2") + F.lit(end_log / LN10)).alias("score"),
    )


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 7 == 2
    return lattice_scores(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
