"""Licence labels by template markup: optional and replaceable regions become token automata.

A template is parsed to a small automaton over words: a mandatory word is one step, an optional region a
detour, a replaceable one a loop with bounds or a choice of words. A text is accepted where a run from
one of its words reaches the end, that is where all mandatory wording stands in order and nothing else
but what the markup allows. Runs start only at words that can begin a template and end with their last
live state. Texts are scanned whole, where they lie; words are compared by 64-bit hashes.

Nulls are empty texts: no words, no places, empty labels, score 0. Repeated rows give repeated results.
Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.license_templates import TEMPLATES
from pagelake.llm.words import FOLDED, NOT_ALNUM, Block, Spans, hashes, text_blocks, words

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
MARKUP = re.compile(r"<<(.*?)>>", re.S)
#: Mandatory words that a run which is not accepted must have met to count for the score.
LEAST_MET = 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places string"


def fold(text: str) -> list[str]:
    """Words of a text whose A-Z are lower-cased."""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def word_keys(found: list[str]) -> list[int]:
    """The words' hashes as they come up inside texts."""
    raw = [w.encode() for w in found]
    ends = np.cumsum([0, *map(len, raw)])
    block = Block(0, np.frombuffer(b"".join(raw), np.uint8), ends)
    return hashes(block, Spans(ends[:-1], ends[1:], np.arange(len(raw) + 1)), FOLDED).tolist() if raw else []


@dataclass
class Automaton:
    """States from 0 to ``end``; ``steps`` by word, ``skips`` without one, ``loops`` (any word, within bounds)."""

    steps: dict[int, dict[int, int]] = field(default_factory=dict)
    skips: dict[int, list[int]] = field(default_factory=dict)
    loops: dict[int, tuple[int, int]] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=dict)
    end: int = 0
    mandatory: int = 0

    def closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            s, used = todo.pop()
            ways = [(t, 0) for t in self.skips.get(s, ())]
            if s in self.loops and used >= self.loops[s][0]:
                ways.append((s + 1, 0))
            for way in ways:
                if way not in seen:
                    seen.add(way)
                    todo.append(way)
        return seen

    def starts(self) -> set[int]:
        """Words a run can begin with."""
        return {w for s, _ in self.closure({(0, 0)}) for w in self.steps.get(s, ())}

    def run(self, keys: list[int], at: int, stop: int) -> tuple[int, float]:
        """(end of the longest accepted run from word ``at``, else -1; share of the mandatory words met)."""
        live, last, deepest = self.closure({(0, 0)}), -1, 0
        i = at
        while True:
            if any(s == self.end for s, _ in live):
                last = i
            deepest = max(deepest, max((self.depth.get(s, 0) for s, _ in live), default=0))
            if i >= stop or not live:
                break
            w, following = keys[i], set()
            for s, used in live:
                t = self.steps.get(s, {}).get(w)
                if t is not None:
                    following.add((t, 0))
                if s in self.loops and used < self.loops[s][1]:
                    following.add((s, used + 1))
            live = self.closure(following)
            i += 1
        return last, 1.0 if last >= 0 else deepest / max(self.mandatory, 1) if deepest >= LEAST_MET else 0.0


def compile_template(markup: str) -> Automaton:
    """Automaton of a template. A loop state's way on is the state after it."""
    a, at, opened = Automaton(), 0, []
    a.depth[0] = 0
    for i, part in enumerate(MARKUP.split(markup)):
        if i % 2 == 0:
            for key in word_keys(fold(part)):
                a.steps.setdefault(at, {})[key] = at + 1
                a.mandatory += not opened
                a.depth[at + 1] = a.mandatory
                at += 1
        elif part == "beginOptional":
            opened.append(at)
        elif part == "endOptional":
            a.skips.setdefault(opened.pop(), []).append(at)
        else:
            match = part.split("match=", 1)[1]
            bounds = re.fullmatch(r"\.\{(\d+),(\d+)\}", match)
            if bounds:
                # A state of its own for the loop, so that words before it do not loop.
                a.skips.setdefault(at, []).append(at + 1)
                a.loops[at + 1] = int(bounds[1]), int(bounds[2])
                a.depth[at + 1] = a.depth[at + 2] = a.mandatory
                at += 2
            else:
                for key in word_keys(fold(match)):
                    a.steps.setdefault(at, {})[key] = at + 1
                a.mandatory += not opened
                a.depth[at + 1] = a.mandatory
                at += 1
    if opened:
        raise ValueError("an optional region is not closed")
    a.end = at
    return a


class Scanner:
    """All templates and base phrases, ready for blocks of texts."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.automata = {name: compile_template(t) for name, t in templates.items()}
        begins: dict[int, list[str]] = {}
        for name, a in self.automata.items():
            for w in a.starts():
                begins.setdefault(w, []).append(name)
        self.begins = begins
        self.first = np.array(sorted(begins), dtype=np.uint64)
        self.phrases = [(np.array(word_keys(p.split()), dtype=np.uint64), label) for p, label in PHRASES.items()]

    def block_rows(self, block: Block) -> Iterator[tuple]:
        found = words(block, NOT_ALNUM)
        h = hashes(block, found, FOLDED)
        row = found.rows()
        base: dict[int, list[tuple[int, str]]] = {}
        for keys, label in self.phrases:
            n = len(h) - len(keys) + 1
            if n > 0:
                hit = h[:n] == keys[0]
                for k in range(1, len(keys)):
                    hit &= h[k : n + k] == keys[k]
                hit &= row[:n] == row[len(keys) - 1 :]
                for i in np.flatnonzero(hit).tolist():
                    base.setdefault(int(row[i]), []).append((i - int(found.first[row[i]]), label))
        runs: dict[int, list[tuple[str, int, int]]] = {}
        best: dict[int, float] = {}
        for i in np.flatnonzero(np.isin(h, self.first)).tolist():
            r = int(row[i])
            start, stop = int(found.first[r]), int(found.first[r + 1])
            for name in self.begins[int(h[i])]:
                end, share = self.automata[name].run(_Lazy(h), i, stop)
                best[r] = max(best.get(r, 0.0), share)
                if end >= 0:
                    runs.setdefault(r, []).append((name, i - start, end - start))
        for r, n in enumerate(np.diff(found.first).tolist()):
            places, own = base.get(r, []), runs.get(r, [])
            at = [p for p, _ in places]
            base_labels = sorted({x for _, x in places})
            labels = sorted({*base_labels, *(name for name, _, _ in own)})
            yield (
                n, len(places), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels),
                max(best.get(r, 0.0), 0.5 if places else 0.0), ";".join(f"{name}:{a}-{b}" for name, a, b in sorted(own, key=lambda x: x[1:] + x[:1])),
            )


class _Lazy:
    """Word hashes as numbers, one at a time."""

    def __init__(self, h: np.ndarray) -> None:
        self.h = h

    def __getitem__(self, i: int) -> int:
        return int(self.h[i])


_SCANNERS: dict[tuple, Scanner] = {}


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, base places (n_base, first_word, last_word, base_labels), labels, score, places.

    ``labels`` adds the accepted templates to the base labels; ``places`` lists them as name:first-end in words.
    ``score`` is 1 where a template is accepted, else the largest share of mandatory words met in order, at least 0.5 with a base place;
    runs that met fewer than ``LEAST_MET`` mandatory words count nothing.
    """
    chosen = dict(templates or TEMPLATES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.setdefault(tuple(chosen.items()), Scanner(chosen))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for batch in batches:
            rows = [x for block in text_blocks(batch.column(1)) for x in scanner.block_rows(block)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)
