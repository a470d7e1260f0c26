"""Sum-of-squares online packing of tokenised documents.

A document's full windows close at once; its remainder goes to the fill level
that keeps the sum of squared level counts smallest, looked up in an array of
those counts. Every partition packs its documents as they stream by, without a
shuffle. A packer leaves about a window a level open, however much it has
packed, so the pieces still open at a partition's end are carried to a second
stage, which places those of many partitions in one task by the same rule. What
is open after that is cut into windows whose lengths are powers of two, so that
nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

WINDOW = 2048
END_ID = 1


def _parts_at_spaces(spec: dict) -> bool:
    """Whether ids of a text are those of its chunks, one after the other, where a chunk begins at a blank between two characters
    that are no white space: byte-level pieces under the usual pattern, in which a blank only ever begins a piece there."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    added = spec.get("added_tokens") or []
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or t["content"].isalnum() for t in added)


#: Runs that the usual pattern takes for a piece each: Latin letters, ASCII digits, ASCII marks but the apostrophe, and a line end
#: between two of them. A blank before the first run goes with it.
_LATIN, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_RUN = re.compile(f"[{_LATIN}]+|[0-9]+|[{_MARKS}]+|\n")
_RUNS = re.compile(f"[{_LATIN}0-9{_MARKS}]+(?:\n[{_LATIN}0-9{_MARKS}]+)*")
_LETTERS = re.compile(f"[{_LATIN}]+")
_ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OF_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: White space to some engine; a word that begins or ends with one is not taken for a chunk.
_BLANK = re.compile("[\\s\u180e\u200b\ufeff]")


def _solid(word: str) -> bool:
    """Whether a word begins and ends with what is white space to no engine."""
    return bool(word) and (" " < word[0] < "\x7f" or not _BLANK.match(word[0])) and (" " < word[-1] < "\x7f" or not _BLANK.match(word[-1]))


class Encoder:
    """Ids of whole texts by a tokenizer file through its own library, as little-endian unsigned 32-bit bytes.

    Texts repeat their words, so a word behind a blank is encoded once and its ids are kept: about ``most`` of one run each, in two halves,
    of which the older goes. Words of several runs are put together from those for one call of ``encode`` at a time. A new word is given to the library's model piece by piece where its runs of letters, digits and marks are the pieces; the other new words
    are encoded in one call as a text of their own, and its ids are dealt to them by their offsets. Where blanks meet other white
    space, the words around are encoded together. Under a tokenizer whose ids do not part at blanks, whole texts are encoded."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.most = _parts_at_spaces(spec), most
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        #: Whether letters and marks behind them never hold an added token.
        self.free_ends = not any(re.fullmatch(f"[{_LATIN}]*[{_MARKS}]*", a) for a in self.added)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # those kept before these; what is met again moves on
        self.passing: list[str] = []  # words of several runs: put together anew for each call, as most are rare
        self.ends: dict[str, bytes] = {}  # runs behind the first one of a word: mostly a few marks, the same ones again and again

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        held = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(_OF_BYTE)
        return array("I", [t.id for t in self.model.tokenize(held)]).tobytes()

    def learn(self, words: list[str], at_once: int = 1024) -> None:
        """Ids of each of ``words`` behind a blank; those of first runs are kept as of words, as many words differ in their ends alone."""
        known, ends, others, longer, lead = self.known, self.ends, [], [], _OF_BYTE[32]
        if len(ends) > self.most // 8:
            ends.clear()
        for w in words:
            if w.isascii() and w.isalpha():
                known[w] = array("I", [t.id for t in self.model.tokenize(lead + w)]).tobytes()
            else:
                longer.append(w)
        for w in longer:
            head = w.rstrip(_ASCII_MARKS) if self.free_ends else ""
            if head and (head.isascii() and head.isalpha() or _LETTERS.fullmatch(head)):
                runs = (head, w[len(head) :]) if len(head) < len(w) else (head,)
            elif _RUNS.fullmatch(w) and not any(a in w for a in self.added):
                runs = _RUN.findall(w)
            else:
                others.append(w)
                continue
            ids = known.get(runs[0])
            if ids is None:
                ids = known[runs[0]] = self.piece(" " + runs[0])
            if len(runs) > 1:
                for run in runs[1:]:
                    held = ends.get(run)
                    if held is None:
                        held = ends[run] = self.piece(run)
                    ids += held
                known[w] = ids
                self.passing.append(w)
        for at in range(0, len(others), at_once):
            part = others[at : at + at_once]
            got = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = 4 * np.searchsorted(np.fromiter((o[0] for o in got.offsets), np.int64, len(ids)), starts)
            cuts[-1], held = 4 * len(ids), ids.tobytes()
            known.update((w, held[i:j]) for w, i, j in zip(part, cuts.tolist(), cuts[1:].tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.parts:
            yield from map(self.whole, texts)
            return
        for w in self.passing:
            del self.known[w]
        self.passing.clear()
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        split, known = [t.split(" ") for t in texts], self.known
        new = set().union(*split).difference(known)
        again = self.before.keys() & new
        known.update(zip(again, map(self.before.__getitem__, again)))
        new -= again
        plain = list(filter(_solid, new))
        self.learn(plain)
        odd = new.difference(plain)
        for words in split:
            if _solid(words[0]) and (not odd or odd.isdisjoint(words)):
                rest = words[1:]
                yield self.whole(words[0]) + (b"".join(itemgetter(*rest)(known)) if len(rest) > 1 else known[rest[0]] if rest else b"")
            else:
                yield self._pieces(words)

    def _pieces(self, words: list[str]) -> bytes:
        """Runs of words glued where one begins or ends with white space or is empty, and known words between them."""
        n = len(words)
        odd = [not _solid(w) for w in words]
        out, at = [], 0
        while at < n:
            to = at + 1
            while to < n and (odd[to] or odd[to - 1]):
                to += 1
            if to == at + 1 and at:
                out.append(self.known[words[at]])
            else:
                run = " ".join(words[at:to])
                out.append(self.whole(" " + run if at else run))
            at = to
        return b"".join(out)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, most: int = 400_000) -> Encoder:
    """One encoder a Python worker, path and bound, so that what it knows outlives a task."""
    if (path, most) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


class SumOfSquares:
    """Online packing of pieces of 1 to ``window`` - 1 tokens into windows."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level; the entry for full ones stays 0
        self.open: dict[int, list[list]] = {}

    def place(self, piece, length: int) -> list | None:
        """Put ``piece`` where the sum of squares grows least; the fullest level among equals. A window that is full is returned."""
        w, n = self.window, self.count
        # From level h to h + length: n[h]**2 falls by 2 n[h] - 1, n[h + length]**2 grows by 2 n[h + length] + 1.
        after = n[length : w + 1]
        cost = 2 * after + 1 - 2 * n[: w + 1 - length] + 1
        cost[n[: w + 1 - length] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * after[0] + 1  # a new window
        if cost[-1] != np.iinfo(np.int64).max:
            cost[-1] = 1 - 2 * n[w - length]  # one that this piece fills counts no more
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        bin_ = self.open[h].pop() if h else []
        bin_.append(piece)
        if h:
            n[h] -= 1
        if h + length == w:
            return bin_
        n[h + length] += 1
        self.open.setdefault(h + length, []).append(bin_)
        return None

    def rest(self) -> Iterator[list]:
        for h in sorted(self.open, reverse=True):
            yield from self.open[h]


def powers(length: int) -> list[int]:
    """``length`` as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


#: How a piece came to its window: a full window of one document, the level array of its partition, that of the second
#: stage, or the cut of what was left.
PLACED = ("whole", "levels", "carried", "cut")


def pack_stream(docs: Iterator[tuple], window: int = WINDOW) -> Iterator[tuple[int, list[tuple]]]:
    """docs: (doc_id, ids as bytes). Yields (how, window), a window being a list of pieces (doc_id, start, ids as bytes,
    doc_tokens). how is an index of PLACED, or -1 for windows open at the end."""
    packer, width = SumOfSquares(window), 4 * window
    for doc_id, ids in docs:
        tokens = len(ids) // 4
        full = len(ids) // width * width
        for at in range(0, full, width):
            yield 0, [(doc_id, at // 4, ids[at : at + width], tokens)]
        if full < len(ids):
            closed = packer.place((doc_id, full // 4, ids[full:], tokens), (len(ids) - full) // 4)
            if closed:
                yield 1, closed
    for bin_ in packer.rest():
        yield -1, bin_


def pack_open(carried: Iterator[tuple], window: int = WINDOW) -> Iterator[tuple[int, list[tuple]]]:
    """Pieces of open windows placed anew, one by one, whole; those still open at the end are laid end to end and cut at
    ``window`` tokens, and their remainder at powers of two. Yields (how, window) as pack_stream does."""
    packer = SumOfSquares(window)
    for piece in carried:
        closed = packer.place(piece, len(piece[2]) // 4)
        if closed:
            yield 2, closed
    pieces = [p for bin_ in packer.rest() for p in bin_]
    left = sum(len(p[2]) for p in pieces) // 4
    lengths = iter([window] * (left // window) + powers(left % window))
    room, seq = 0, []
    for doc_id, start, ids, tokens in pieces:
        at = 0
        while at < len(ids):
            if not room:
                room = next(lengths)
            n = min(room, len(ids) // 4 - at // 4)
            seq.append((doc_id, start + at // 4, ids[at : at + 4 * n], tokens))
            at += 4 * n
            room -= n
            if not room:
                yield 3, seq
                seq = []


def _rows(packed: Iterator[tuple[int, list[tuple]]], first: int, with_ids: bool, kinds: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of pieces; the ids of open windows go along, as they may still be cut."""
    rows: list[tuple] = []
    for k, (how, seq) in enumerate(packed):
        at = 0
        for doc_id, start, ids, tokens in seq:
            n = len(ids) // 4
            rows.append((doc_id, start, n, zlib.crc32(ids), tokens, first + k, at, how, ids if with_ids or how < 0 else None))
            at += n
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False, carry_tokens: int = 1 << 24, known_words: int = 400_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed_by (one of PLACED), and ids if
    asked for.

    A document's ids are those of its whole text and then id 1; null and empty text have that one alone. Rows with equal
    or null doc_id are documents of their own; other columns, whatever their names, are not read. sequence_id is the stage, the
    partition's number and the sequence's number in it. An empty table gives no pieces. The packing of a partition depends on its rows
    alone, so a lost task repeats it. ``carry_tokens``: tokens that one task of the second stage takes, about; long pieces come
    first, and the task streams them, so its memory does not depend on this. ``known_words``: words whose ids a Python worker keeps,
    some 200 bytes each.
    """
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "how", "ids"]
    id_type = "string" if dict(docs.dtypes)["doc_id"] == "string" else "long"
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, how int, ids binary"
    kinds = [pa.string() if id_type == "string" else pa.int64(), *[pa.int64()] * 6, pa.int32(), pa.binary()]

    def run(batches):
        enc = encoder(tokenizer_path, known_words)

        def stream():
            for b in slices(batches):
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                    yield doc_id, ids + end

        yield from _rows(pack_stream(stream(), window), TaskContext.get().partitionId() << 32, with_ids, kinds, names)

    def run_open(batches):
        def pieces():
            for b in slices(batches, 1024):
                yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))

        yield from _rows(pack_open(pieces(), window), (1 << 62) + (TaskContext.get().partitionId() << 32), with_ids, kinds, names)

    slim = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = Scratch(docs.sparkSession).keep(slim.mapInArrow(run, schema))
    open_ = placed.where("how < 0")
    tasks = max(1, -(-(open_.agg(F.sum("length")).first()[0] or 0) // carry_tokens))
    group = F.pmod(F.shiftright("sequence_id", 32), F.lit(tasks))
    carried = open_.repartition(tasks, group).sortWithinPartitions(F.col("length").desc(), "sequence_id", "offset").mapInArrow(run_open, schema)
    how = F.element_at(F.array(*map(F.lit, PLACED)), F.col("how") + 1).alias("placed_by")
    return placed.where("how >= 0").unionByName(carried).select(*names[:7], how, *(["ids"] if with_ids else []))


def op9_pack_sos(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
