"""License scans (6): a generalised suffix automaton of licence tokens.

One automaton accepts every run of words of every template. A text's words are streamed through
it, which gives for each word the longest run ending there that some template has: its matching
statistics. Words of runs of ``MIN_RUN`` or more are chained, by template and in template order:
of all chains the one that covers most counts, and overlapping runs share out their words. A label
is given where it covers ``MIN_SHARE`` of its template. Phrases
are templates of their own that must occur whole: each automaton state knows which phrases end
the run that it stands for.

The templates and phrases are parameters of a fixed, small size, sent with the function. Null
or empty texts have no words, no label and score 0. Very long texts are streamed; nothing grows
with a text but its words. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches
from .decontaminate import words_of

# fixed values: phrases and labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: opening or key passages of public licence texts
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
}
# fixed values: one-line notices that stand for a licence by themselves
NOTICES = {
    "licensed under the apache license version 2.0": "apache-2.0",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the gnu general public license": "gpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "bsd license": "bsd",
    "mozilla public license": "mpl-2.0",
}
MIN_RUN, MIN_SHARE = 5, 0.5


class SuffixAutomaton:
    """Of several word sequences. State 0 is the root; link, length and transitions by state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: (sequence, end) of one occurrence of each state
        self.place: list[tuple[int, int]] = [(-1, 0)]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word, (number, end))

    def _state(self, moves: dict[int, int], length: int, place: tuple[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, of: int, word: int, old: int, place: tuple[int, int]) -> int:
        """A copy of ``old`` for its runs that come after ``of``'s."""
        new = self._state(dict(self.next[old]), self.length[of] + 1, place)
        self.link[new], self.link[old] = self.link[old], new
        while of >= 0 and self.next[of].get(word) == old:
            self.next[of][word] = new
            of = self.link[of]
        return new

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        old = self.next[last].get(word)
        if old is not None:  # another sequence has this run
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old, place)
        new, at = self._state({}, self.length[last] + 1, place), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old, place)
        return new


class Scanner:
    """Phrases, notices and templates in one automaton."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], templates: dict[str, str]):
        self.ids: dict[bytes, int] = {}
        code = lambda s: [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(s.encode())]
        whole = [(code(p), label, base) for table, base in ((phrases, True), (notices, False)) for p, label in table.items()]
        self.templates = [(label, code(text)) for label, text in templates.items()]
        self.sam = SuffixAutomaton([w for w, _, _ in whole] + [t for _, t in self.templates])
        #: by template: where its runs of MIN_RUN words begin
        self.places: list[dict[tuple[int, ...], list[int]]] = [{} for _ in self.templates]
        for places, (_, words) in zip(self.places, self.templates):
            for at in range(len(words) - MIN_RUN + 1):
                places.setdefault(tuple(words[at : at + MIN_RUN]), []).append(at)
        ends: dict[int, list[tuple[int, str, bool]]] = {}
        for words, label, base in whole:
            state = 0
            for word in words:
                state = self.sam.next[state][word]
            ends.setdefault(state, []).append((len(words), label, base))
        #: by state: phrases that end its runs, own and inherited along suffix links
        self.ends: list[list[tuple[int, str, bool]]] = [[] for _ in self.sam.next]
        for state in sorted(range(1, len(self.sam.next)), key=self.sam.length.__getitem__):
            self.ends[state] = ends.get(state, []) + self.ends[self.sam.link[state]]

    def statistics(self, words: list[int]):
        """(position, run length, state) of each word that ends a run."""
        moves, link, length = self.sam.next, self.sam.link, self.sam.length
        state = run = 0
        for at, word in enumerate(words):
            if not word:
                state = run = 0
                continue
            while state and word not in moves[state]:
                state = link[state]
                run = length[state]
            state = moves[state].get(word, 0)
            run = run + 1 if state else 0
            if state:
                yield at, run, state

    def scan(self, text: bytes) -> dict:
        found = words_of(text)
        words = list(map(self.ids.get, found, [0] * len(found)))
        n_base, first, last, base, labels, hits, runs = 0, None, None, set(), set(), [], []
        for at, run, state in self.statistics(words) if any(words) else ():
            for m, label, is_base in self.ends[state]:
                if m <= run:
                    labels.add(label)
                    hits.append((at - m + 1, at + 1))
                    if is_base:
                        base.add(label)
                        n_base += 1
                        start = at - m + 1
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
            if run >= MIN_RUN:
                runs.append(at - MIN_RUN + 1)
        score = 1.0 if labels else 0.0
        spans = []
        for t, (label, template) in enumerate(self.templates):
            covered, span = self._chain(words, runs, t, template)
            if covered >= MIN_SHARE * len(template):
                labels.add(label)
                spans.append(span)
            score = max(score, covered / len(template))
        return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(1.0, score), "starts": [s for s, _ in sorted(spans + hits)], "ends": [e for _, e in sorted(spans + hits)]}

    def _chain(self, words: list[int], runs: list[int], t: int, template: list[int]) -> tuple[int, tuple[int, int]]:
        """Most words of a template that runs cover in its order, and the span of text that they take.

        ``runs`` are the beginnings of all runs of MIN_RUN words. Their words are paired with their
        places in the template; a chain goes forward in both, with gaps in the text of at most the
        template's length. By place, the chains that end there are held as (covered, begin, last):
        a later one is held besides an earlier one that covers more, as that goes out of reach first.
        """
        size, best = len(template), (0, 0, -1)
        held: list[list[tuple[int, int, int]]] = [[] for _ in template]
        places, waiting = self.places[t], {}
        for start in (*runs, len(words)):
            for at in sorted(k for k in waiting if k < start):
                for place in sorted(waiting.pop(at), reverse=True):
                    covered, begin = 0, at
                    for chains in held[:place]:
                        while chains and at - chains[0][2] - 1 > size:
                            chains.pop(0)
                        if chains and chains[0][:2] > (covered, begin):
                            covered, begin, _ = chains[0]
                    chains = held[place]
                    while chains and chains[-1][0] <= covered + 1:
                        chains.pop()
                    chains.append((covered + 1, begin, at))
                    if covered >= best[0]:
                        best = (covered + 1, begin, at)
            if best[0] == size:
                break
            for place in places.get(tuple(words[start : start + MIN_RUN]), ()):
                for k in range(MIN_RUN):
                    waiting.setdefault(start + k, set()).add(place + k)
        return best[0], (best[1], best[2] + 1)


KIND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,starts:array<bigint>,ends:array<bigint>>"


def scanner(phrases: dict, notices: dict, templates: dict):
    key = repr((phrases, notices, templates))

    def scan(texts: pa.Array) -> pa.Array:
        kept = K.kept("licenses")
        if key not in kept:
            kept[key] = Scanner(phrases, notices, templates)
        out = []
        for _, _, buf, offsets in K.groups(texts):
            whole = buf.tobytes()
            out += [kept[key].scan(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.array(out, KIND)

    return scan


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, templates=TEMPLATES) -> DataFrame:
    """A row for each document; spans (starts, ends) count words."""
    bounded_batches(docs.sparkSession)
    found = F.arrow_udf(scanner(phrases, notices, templates), DDL).asNondeterministic()(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", found.alias("r")).select("doc_id", *[f"r.{f.name}" for f in KIND])
