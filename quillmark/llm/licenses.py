"""License scans by template-markup matching.

A template is license wording with markup: ``<<beginOptional>> ... <<endOptional>>``
may be absent, ``<<var;name=...;words=lo-hi>>`` stands for any lo to hi words, and
all other wording is mandatory. Templates compile into token automata; a text
is accepted where one of them matches its mandatory wording exactly. A text that
holds wording in part scores the longest run of it, from wherever in the
template it begins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

#: A-Z to lower case; all other ASCII but digits and a-z parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases whose every place is counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_OPT = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")

#: Label -> templates.
TEMPLATES = {
    "mit": [
        "<<beginOptional>>released<<endOptional>> under the mit license",
        """<<beginOptional>>the mit license<<endOptional>> <<beginOptional>>copyright c <<var;name=holder;words=1-12>><<endOptional>>
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation
        the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
        to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software""",
    ],
    "apache-2": [
        "<<beginOptional>>licensed under the<<endOptional>> apache license version 2 <<beginOptional>>0<<endOptional>>",
        """licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this file except in
        compliance with the license you may obtain a copy of the license at <<var;name=address;words=0-8>> unless required by applicable
        law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind""",
    ],
    "cc-by-nc": ["<<beginOptional>>licensed under<<endOptional>> cc by nc <<beginOptional>><<var;name=version;words=2-2>><<endOptional>>"],
    "cc-by": ["<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> creative commons attribution <<var;name=version;words=0-2>> <<beginOptional>>international<<endOptional>> license"],
    "gpl-3": [
        "<<beginOptional>><<var;name=work;words=0-3>> is<<endOptional>> licensed under the gnu general public license version 3",
        """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 3 of the license or <<beginOptional>>at your option<<endOptional>> any later version""",
    ],
    "isc": [
        """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies"""
    ],
    "bsd-2": [
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<var;name=bullet;words=0-1>> redistributions of source code must retain the above copyright notice this list of conditions
        and the following disclaimer <<var;name=bullet;words=0-1>> redistributions in binary form must reproduce the above copyright notice this list
        of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
    ],
}


@dataclass
class Automaton:
    """States are numbers; ``mandatory[s]`` counts the mandatory words read on the way to s."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    any_: list[list[int]] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    mandatory: list[int] = field(default_factory=list)
    final: int = 0
    required: list[bytes] = field(default_factory=list)
    #: Neighbouring mandatory words -> the states before the first of them.
    pairs: dict[tuple[bytes, bytes], list[int]] = field(default_factory=dict)
    _moves: dict = field(default_factory=dict)

    def state(self, mandatory: int) -> int:
        self.words.append({}), self.any_.append([]), self.skip.append([]), self.mandatory.append(mandatory)
        return len(self.words) - 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        """Sets of states are made as they are met and remembered where a named word leads."""
        key = (states, word)
        got = self._moves.get(key)
        if got is None:
            to = set()
            for s in states:
                if word in self.words[s]:
                    to.add(self.words[s][word])
                to.update(self.any_[s])
            got = self.closure(to)
            if len(self._moves) < 50_000:
                self._moves[key] = got
        return got

    @property
    def start(self) -> frozenset:
        return self.closure([0])

    def find_pairs(self) -> None:
        for s, edges in enumerate(self.words):
            for word, to in edges.items():
                if self.mandatory[to] > self.mandatory[s]:
                    for t in self.closure([to]):
                        for second, end in self.words[t].items():
                            if self.mandatory[end] > self.mandatory[t]:
                                self.pairs.setdefault((word, second), []).append(s)

    def longest_run(self, tokens: list[bytes], hits: list[int]) -> int:
        """The most mandatory words read in one go by any path of the automaton, from any state to any other. ``hits`` are the
        places of ``pairs``: a run begins with two mandatory words side by side."""
        best, at, live = 0, 0, {}
        for hit in hits:
            at = max(at, hit)
            while True:
                word, to = tokens[at], {}
                for s, n in live.items():
                    end = self.words[s].get(word)
                    for t, m in ([(end, n + self.mandatory[end] - self.mandatory[s])] if end is not None else []) + [(t, n) for t in self.any_[s]]:
                        if to.get(t, -1) < m:
                            to[t] = m
                if at + 1 < len(tokens):
                    for s in self.pairs.get((word, tokens[at + 1]), ()):
                        to[self.words[s][word]] = max(1, to.get(self.words[s][word], 0))
                todo = list(to)
                while todo:
                    s = todo.pop()
                    for t in self.skip[s]:
                        if to.get(t, -1) < to[s]:
                            to[t] = to[s]
                            todo.append(t)
                live, at = to, at + 1
                best = max(best, max(live.values(), default=0))
                if not live or at >= len(tokens):
                    break
            if at >= len(tokens):
                break
        return best if best > 1 else 0


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    at, optional, n = a.state(0), [], 0
    pos = 0

    def plain(text: str) -> None:
        nonlocal at, n
        for w in text.encode().translate(_FOLD).split():
            if not optional:
                n += 1
                a.required.append(w)
            to = a.state(n)
            a.words[at][w] = to
            at = to

    for m in _OPT.finditer(template):
        plain(template[pos : m.start()])
        pos = m.end()
        if m[1] == "beginOptional":
            # A state of its own, so that the way around does not meet a word's branch.
            to = a.state(n)
            a.skip[at].append(to)
            at = to
            optional.append(at)
        elif m[1] == "endOptional":
            to = a.state(n)
            a.skip[at].append(to)
            a.skip[optional.pop()].append(to)
            at = to
        else:
            lo, hi = map(int, re.search(r"words=(\d+)-(\d+)", m[2]).groups())
            ends = []
            for i in range(hi):
                if i >= lo:
                    ends.append(at)
                to = a.state(n)
                a.any_[at].append(to)
                at = to
            out = a.state(n)
            for s in [*ends, at]:
                a.skip[s].append(out)
            at = out
    plain(template[pos:])
    if optional or not n:
        raise ValueError(f"template of {label}: optional region left open, or no mandatory wording")
    a.final = at
    a.find_pairs()
    return a


class Scanner:
    def __init__(self, templates=None, base=None):
        self.automata = [compile_template(k, t) for k, v in (templates or TEMPLATES).items() for t in v]
        self.base = [(b" " + p.encode() + b" ", label) for p, label in (base or BASE).items()]
        #: A text without an automaton's longest mandatory word cannot be accepted.
        self.anchors = [max(a.required, key=len) for a in self.automata]
        self.base_anchors = [max(p.split(), key=len) for p, _ in self.base]
        self.pairs: dict[tuple[bytes, bytes], list[int]] = {}
        for i, a in enumerate(self.automata):
            for p in a.pairs:
                self.pairs.setdefault(p, []).append(i)

    def matches(self, tokens: list[bytes], a: Automaton) -> list[tuple[int, int]]:
        """Spans (first word, words) accepted, leftmost and longest."""
        start, out, past = a.start, [], 0
        firsts = {w for s in start for w in a.words[s]}
        open_ = any(a.any_[s] for s in start)
        for i, w in enumerate(tokens):
            if i < past or not open_ and w not in firsts:
                continue
            states, end = start, 0
            for j in range(i, len(tokens)):
                states = a.step(states, tokens[j])
                if not states:
                    break
                if a.final in states:
                    end = j + 1
            if end:
                out.append((i, end - i))
                past = end
        return out

    def share(self, tokens: list[bytes]) -> float:
        """The largest share of a template's mandatory words that the text holds in one run, gaps in neither."""
        pairs, hits = self.pairs, {}
        for i, p in enumerate(zip(tokens, tokens[1:])):
            if p in pairs:
                for a in pairs[p]:
                    hits.setdefault(a, []).append(i)
        return max((self.automata[a].longest_run(tokens, h) / len(self.automata[a].required) for a, h in hits.items()), default=0.0)

    def scan(self, text: bytes) -> dict:
        """n_words, places (first words of base phrases), base_labels, labels, spans (label, first word, words), score."""
        folded = text.translate(_FOLD)
        tokens = folded.split()
        out = {"n_words": len(tokens), "places": [], "base_labels": set(), "labels": set(), "spans": [], "score": 0.0}
        if any(x in folded for x in self.base_anchors):
            joined = b" " + b" ".join(tokens) + b" "
            for phrase, label in self.base:
                at = joined.find(phrase)
                before, word = 0, 0
                while at >= 0:
                    word += joined.count(b" ", before, at)
                    before = at
                    out["places"].append(word)
                    out["base_labels"].add(label)
                    at = joined.find(phrase, at + 1)
        for a, anchor in zip(self.automata, self.anchors):
            if anchor in folded:
                spans = self.matches(tokens, a)
                out["spans"] += [(a.label, i, n) for i, n in spans]
                if spans:
                    out["labels"].add(a.label)
        out["labels"] |= out["base_labels"]
        out["score"] = 1.0 if out["labels"] else self.share(tokens)
        return out


_SCAN_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,words:long>>"


def scan_licenses(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """doc_id and, for the whole text of every row, n_words, places of base phrases (n_base, first_word, last_word),
    base_labels, labels, score, spans. score is 1 where a template accepts or a base phrase stands, else the largest share of a
    template's mandatory words that stand in one run, wherever in the template it begins (with two of them side by side) and ends.

    Null text is empty: no words, null first and last, empty labels, score 0. Repeated rows are scanned each. Ids may be of any
    type (others than text are cast to long); other columns, whatever their names, are not read. An empty table gives no rows.
    """
    id_type = "string" if dict(docs.dtypes)["doc_id"] == "string" else "long"
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())])

    def run(batches):
        scanner = Scanner(templates, base)
        for b in slices(batches):
            found = [scanner.scan(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([len(f["places"]) for f in found], pa.int64()),
                    pa.array([min(f["places"], default=None) for f in found], pa.int64()),
                    pa.array([max(f["places"], default=None) for f in found], pa.int64()),
                    pa.array([",".join(sorted(f["base_labels"])) for f in found], pa.string()),
                    pa.array([",".join(sorted(f["labels"])) for f in found], pa.string()),
                    pa.array([f["score"] for f in found], pa.float64()),
                    pa.array([[dict(zip(("label", "first_word", "words"), s)) for s in f["spans"]] for f in found], pa.list_(span)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, {_SCAN_SCHEMA}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
