"""License scans by template markup.

A template is plain wording with markup: ``[optional words]`` and ``{lo-hi}`` for a region that lo to
hi words may replace. Templates are compiled into automata over word hashes; a text is accepted where a
run of its words spells all mandatory wording exactly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.session import fresh
from waymark.llm.words import hash_word, words

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of well-known notices and licenses, lower-cased, with markup.
TEMPLATES = (
    ("mit-notice", "released under the [terms of the] mit license"),
    ("mit-notice", "licensed under the [terms of the] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {1-12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 [the license]"),
    ("gpl-notice", "[this work is] licensed under the gnu general public license [version {1-2}]"),
    ("gpl-header", "is free software you can redistribute it and or modify it under the terms of the gnu [lesser] [affero] general public license as published by the free software foundation either version {1-2} of the license or at your option any later version"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "in the documentation and or other materials provided with the distribution [3] neither the name of {1-12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-notice", "licensed under a creative commons attribution {0-3} license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

_TOKEN = re.compile(r"\[|\]|\{(\d+)-(\d+)\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Automaton:
    """States 0.. of a template: ``step`` has (word hash or None for any word, next state), ``skip`` the free moves."""

    label: str
    step: tuple[tuple[int | None, int] | None, ...]
    skip: tuple[tuple[int, ...], ...]
    anchor: int
    must: frozenset[int]

    @property
    def last(self) -> int:
        return len(self.step)

    def _close(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                if s < self.last:
                    todo.extend(self.skip[s])
        return out

    def first(self) -> set[int]:
        return {self.step[s][0] for s in self._close({0}) if s < self.last}

    def match(self, hashes, at: int) -> int | None:
        """End of the longest accepted run that begins at word ``at``."""
        states, end = self._close({0}), None
        for i in range(at, len(hashes)):
            h = int(hashes[i])
            states = self._close({self.step[s][1] for s in states if s < self.last and self.step[s][0] in (None, h)})
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end


def compile_template(label: str, text: str) -> Automaton:
    step: list = []
    skip: list[list[int]] = []
    must: set[int] = set()
    longest, open_at = "", []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t == "[":
            open_at.append(len(step))
        elif t == "]":
            start = open_at.pop()
            skip[start].append(len(step))
        elif m[1] is not None:
            lo, hi = int(m[1]), int(m[2])
            begin = len(step)
            for _ in range(hi):
                step.append((None, len(step) + 1))
                skip.append([])
            for k in range(lo, hi):
                skip[begin + k].append(begin + hi)
        else:
            h = hash_word(t)
            step.append((h, len(step) + 1))
            skip.append([])
            if not open_at:
                must.add(h)
                longest = max(longest, t, key=len)
    if open_at or not must:
        raise ValueError(f"template {label!r}: unbalanced brackets or no mandatory word")
    a = Automaton(label, tuple(step), tuple(map(tuple, skip)), hash_word(longest), frozenset(must))
    if None in a.first() or a.last in a._close({0}):
        raise ValueError(f"template {label!r} must begin with a word")
    return a


def template_regex(text: str) -> str:
    """The same language as a regular expression over `` word word `` (for checks in SQL)."""
    out = ""
    for m in _TOKEN.finditer(text):
        out += {"[": "(?:", "]": ")?"}.get(m[0]) or (f"(?: [^ ]+){{{m[1]},{m[2]}}}" if m[1] is not None else f" {m[0]}")
    return out + " "


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words count from 0. ``matches`` has (label, first, last word) of accepted template runs, leftmost and
    longest, not overlapping for one template. ``score`` is 1 where a template accepts, 0.5 where only a base phrase
    stands, else 0. Null and empty texts have no words and no labels. One row comes out for each row in,
    whatever its id; columns of ``docs`` with the new names are left out.
    """
    new = [T.StructField(n, k) for n, k in (
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
        ("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    )]
    names = {f.name for f in new}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*keep, docs[text].alias(fresh(keep, "_text")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], *new])
    automata = [compile_template(*t) for t in templates]
    spelled = [(p.split(" "), [hash_word(x) for x in p.split(" ")], label) for p, label in phrases]

    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            base = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            own: list[set] = [set() for _ in range(n)]
            found: list[list] = [[] for _ in range(n)]
            for w in words(batch.column(batch.num_columns - 1)):
                count[w.lo:w.hi] = np.diff(w.at)
                for spell, codes, label in spelled:
                    hit = np.flatnonzero(w.hashes == codes[0])
                    for k, c in enumerate(codes[1:], 1):
                        hit = hit[hit + k < len(w.hashes)]
                        hit = hit[w.hashes[hit + k] == c]
                    for i in hit:
                        row = int(np.searchsorted(w.at, i, "right")) - 1
                        if i + len(codes) > w.at[row + 1] or any(w.text(i + k).lower() != x for k, x in enumerate(spell)):
                            continue
                        at = int(i - w.at[row])
                        row += w.lo
                        base[row] += 1
                        first[row], last[row] = min(first[row], at), max(last[row], at)
                        own[row].add(label)
                for a in automata:
                    for row in np.unique(np.searchsorted(w.at, np.flatnonzero(w.hashes == a.anchor), "right") - 1):
                        doc = w.hashes[w.at[row]:w.at[row + 1]]
                        if not np.isin(np.fromiter(a.must, np.uint64), doc).all():
                            continue
                        done = 0
                        for s in np.flatnonzero(np.isin(doc, np.fromiter(a.first(), np.uint64))):
                            if s >= done and (end := a.match(doc, int(s))):
                                done = end
                                found[w.lo + row].append({"label": a.label, "first": int(s), "last": end - 1})
            both = [",".join(sorted(o | {m["label"] for m in f})) for o, f in zip(own, found, strict=True)]
            score = [1.0 if f else 0.5 if o else 0.0 for o, f in zip(own, found, strict=True)]
            none = base == 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(count), pa.array(base), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([",".join(sorted(o)) for o in own], pa.string()), pa.array(both, pa.string()), pa.array(score, pa.float64()), pa.array(found, _MATCH)],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(scan, schema)
