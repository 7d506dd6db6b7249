"""BPE encoding and decoding of byte-level merge lists with a tokenization automaton.

The merges are compiled, one gadget each, into a deterministic automaton whose arcs carry tokens and whose
paths are the sequences that merging can leave. It starts as one state with an arc for each byte. The gadget of
merge k, (u, v) to t: if v may follow u, every state with an arc u gets an arc t that ends where v ends, and the
end of u becomes a copy of its former end from which v, and all that will grow from v's left side, has no arc
(for u = v also t itself: the merge takes the leftmost pair). So arcs of one token all end in one state, a state is
a former one less a set of tokens, and the sets are kept as intervals: tokens are numbered so that those which grow
from one token by later merges stand together.

Encoding runs over a word's bytes by tables: a byte automaton gives the longest token that ends at each place, the
arc out of the state before that token decides whether it stands there, else the next shorter token is tried. Every prefix
of a word has exactly one path, so each place has one state, and the time grows with the bytes. Decoding emits the
arcs' labels. Words are cut by the pattern of byte-level models; each distinct word is encoded once per worker.

Nulls are empty texts and give no ids. Invalid UTF-8 is read with replacement marks. Texts that hold an added token's
string give that token's id there. Repeated rows give repeated results, an empty table an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagelake.llm.words import WordCache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Distinct words that a worker remembers, in two generations of this size.
LIMIT = 150_000
#: Words that are looked up together.
SLICE = 1 << 16
#: Arcs that a worker remembers.
ARCS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of ``merges`` (pairs of byte strings, most urgent first) over ``ids`` (byte string to id)."""

    def __init__(self, merges: Iterable[tuple[bytes, bytes]], ids: dict[bytes, int]) -> None:
        self.labels = [bytes([b]) for b in range(256)]
        token = {label: t for t, label in enumerate(self.labels)}
        left, right, made = [-1] * 256, [-1] * 256, [-1] * 256
        grown: list[list[int]] = [[] for _ in range(256)]
        rules: dict[tuple[int, int], int] = {}
        #: Per state its former state and the (token, merge) that it lost; state 0 lost nothing.
        former, lost = [0], [(-1, -1)]
        end = [0] * 256
        for k, (a, b) in enumerate(merges):
            u, v = token.get(a), token.get(b)
            if u is None or v is None:
                if a + b not in ids or a not in ids or b not in ids:
                    raise ValueError(f"merge {k} names a token that is not in the vocabulary")
                continue  # one side never stands, so the pair does not either
            if a + b in token:
                raise ValueError(f"merge {k} makes a token that an earlier one makes")
            if self._apart(u, v, rules, left, right, made):
                continue
            t = len(self.labels)
            token[a + b] = t
            self.labels.append(a + b)
            left.append(u), right.append(v), made.append(k), grown.append([])
            grown[u].append(t)
            rules[u, v] = k
            end.append(end[v])
            former.append(end[u]), lost.append((v, k))
            end[u] = len(former) - 1
        self.end, self.former, self.lost = end, former, lost
        self.size = [len(label) for label in self.labels]
        self.ids = [ids[label] for label in self.labels]
        self._number(grown, made)
        self._bytes()
        self.n = len(self.labels)
        self._rows: dict[int, tuple[list[int], list[int]]] = {}
        self._arcs: dict[int, int] = {}

    @staticmethod
    def _apart(u: int, v: int, rules: dict, left: list[int], right: list[int], made: list[int]) -> bool:
        """Whether an earlier merge across the border of u and v keeps v from following u."""
        z, until = u, len(made) + (1 << 30)
        while z >= 0:
            w, up_to = v, len(made) + (1 << 30)
            while w >= 0:
                k = rules.get((z, w))
                if k is not None and k < until and k <= up_to:
                    return True
                w, up_to = left[w], made[w]
            z, until = right[z], made[z]
        return False

    def _number(self, grown: list[list[int]], made: list[int]) -> None:
        """Numbers each token behind all that grow from its left side, by merge: what a state loses is one interval then."""
        number, low = [0] * len(grown), [0] * len(grown)
        count = 0
        for root in range(256):
            stack = [(root, 0)]
            while stack:
                t, i = stack.pop()
                if i == 0:
                    low[t] = count
                if i < len(grown[t]):
                    stack += [(t, i + 1), (grown[t][i], 0)]
                else:
                    number[t] = count
                    count += 1
        self.number = number
        self.gap = [(0, -1)]
        for w, k in self.lost[1:]:
            later = bisect_left(grown[w], k, key=made.__getitem__)
            self.gap.append((low[grown[w][later]] if later < len(grown[w]) else number[w], number[w]))

    def _bytes(self) -> None:
        """Tables of the byte automaton: next node by byte, longest token that ends at a node, next shorter token that ends with a token."""
        child: dict[int, int] = {}
        node_of = []
        depth: list[list[tuple[int, int, int]]] = []
        for label in self.labels:
            node = 0
            for d, b in enumerate(label):
                key = node << 8 | b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(child) + 1
                    if d == len(depth):
                        depth.append([])
                    depth[d].append((node, b, nxt))
                node = nxt
            node_of.append(node)
        n = len(child) + 1
        go = np.zeros((n, 256), np.int32)
        back = np.zeros(n, np.int64)
        longest = np.full(n, -1, np.int64)
        longest[node_of] = np.arange(len(node_of))
        shorter = np.full(len(node_of), -1, np.int64)
        for level in depth:
            parent, byte, own = (np.array(x, np.int64) for x in zip(*level, strict=True))
            # what a parent's row gives before its children are entered is where its longest proper suffix leads
            back[own] = np.where(parent == 0, 0, go[back[parent], byte])
            go[parent, byte] = own
            go[own] = go[back[own]]
            ends = longest[own] >= 0
            shorter[longest[own][ends]] = longest[back[own][ends]]
            longest[own] = np.where(ends, longest[own], longest[back[own]])
        # rows of a level are copied from shallower nodes, whose children were entered by then
        self.go = go.reshape(-1).data
        self.longest = longest.tolist()
        self.shorter = shorter.tolist()

    def _row(self, state: int) -> tuple[list[int], list[int]]:
        """Where the intervals of lost arcs start, sorted, and how far those that started so far reach."""
        found = self._rows.get(state)
        if found is None:
            own, s = [], state
            while s:
                own.append(self.gap[s])
                s = self.former[s]
            own.sort()
            reach, far = [], -1
            for _, hi in own:
                far = max(far, hi)
                reach.append(far)
            found = self._rows[state] = [lo for lo, _ in own], reach
        return found

    def arc(self, state: int, token: int) -> int:
        """The state that the arc of a token leads to; -1: there is none."""
        starts, reach = self._row(state)
        at = self.number[token]
        i = bisect_right(starts, at) - 1
        to = -1 if i >= 0 and reach[i] >= at else self.end[token]
        if len(self._arcs) > ARCS:
            self._arcs.clear()
        self._arcs[state * self.n + token] = to
        return to

    def path(self, word: bytes) -> list[int]:
        """The arcs (tokens) of a word."""
        go, longest, shorter, size, arcs, n = self.go, self.longest, self.shorter, self.size, self._arcs, self.n
        states, tokens = [0], [-1]
        node, place = 0, 0
        for b in word:
            place += 1
            node = go[node << 8 | b]
            t = longest[node]
            while True:
                s = states[place - size[t]]
                to = arcs.get(s * n + t)
                if to is None:
                    to = self.arc(s, t)
                if to >= 0:
                    break
                t = shorter[t]
            states.append(to)
            tokens.append(t)
        out = []
        while place:
            t = tokens[place]
            out.append(t)
            place -= size[t]
        out.reverse()
        return out

    def emit(self, path: Iterable[int]) -> bytes:
        labels = self.labels
        return b"".join([labels[t] for t in path])


class Tokenizer:
    """A byte-level BPE file: pattern, added tokens and the automaton of its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec["normalizer"] or cut["type"] != "ByteLevel":
            raise ValueError("only plain byte-level BPE without normalisation is supported")
        if cut["add_prefix_space"] or not cut["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("prefix blanks and added tokens that take blanks are not supported")
        byte = byte_letters()
        raw = lambda s: bytes([byte[c] for c in s])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(s): i for s, i in model["vocab"].items() if s not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton([(raw(a), raw(b)) for a, b in pairs], ids)
        self.label = {i: s for s, i in ids.items()} | {i: s.encode() for s, i in added.items()}
        self.added = {s: (str(i).encode(), 1, s.encode()) for s, i in added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.word = regex.compile(PATTERN)
        self.newer, self.plain = self._newer(path)
        self.cache = WordCache(self._value, LIMIT)

    @staticmethod
    def _newer(path: str) -> tuple[frozenset[str], dict[int, int]]:
        """Letters and digits of a Unicode version that the tokenizer does not know yet: it takes them as other characters.

        Only characters that Python's own tables do not name are in question; those are asked one by one.
        """
        import tokenizers

        cut = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        young = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        odd = [c for c in young if len(cut("a" + c)) == 2 and len(cut("1" + c)) == 2]
        return frozenset(odd), {ord(c): "\U000e0080" for c in odd}

    def words(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.word.findall(text)
        return [text[m.start() : m.end()] for m in self.word.finditer(text.translate(self.plain))]

    def _value(self, word: str) -> tuple[bytes, int, bytes]:
        """(ids as text, their count, the decoded bytes) of a word."""
        a = self.automaton
        path = a.path(word.encode())
        return b",".join([b"%d" % a.ids[t] for t in path]), len(path), a.emit(path)

    def values(self, text: str) -> Iterator[list[tuple[bytes, int, bytes]]]:
        """The values of a text's words in order, some at a time."""
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                yield [self.added[part]]
                continue
            words = self.words(part)
            for at in range(0, len(words), SLICE):
                yield self.cache.values(words[at : at + SLICE])

    def encode(self, text: str) -> list[int]:
        return [int(i) for some in self.values(text) for v in some for i in v[0].split(b",")]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any ids; bytes that are no UTF-8 give replacement marks, unknown ids nothing."""
        return b"".join([self.label.get(i, b"") for i in ids]).decode("utf-8", "replace")


_KNOWN: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once per worker."""
    if path not in _KNOWN:
        _KNOWN[path] = Tokenizer(path)
    return _KNOWN[path]


def _texts(column: pa.Array) -> Iterator[str]:
    for t in column.cast(pa.binary()):
        yield t.as_py().decode("utf-8", "replace") if t.is_valid else ""


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids and digests of ids (joined by commas) and of the decoded text.

    ``path`` must name the file on every executor. Documents are encoded where they lie, no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in _texts(batch.column(1)):
                count, known, emitted, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
                for some in own.values(text):
                    count += sum([v[1] for v in some])
                    known.update(comma + b",".join([v[0] for v in some]))
                    emitted.update(b"".join([v[2] for v in some]))
                    comma = b","
                n.append(count)
                ids.append(known.hexdigest())
                decoded.append(emitted.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(work, SCHEMA)


def id_lists(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            ids = [own.encode(text) for text in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, ids array<int>")


def decode_lists(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of ids; a null list is an empty one, null ids give nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            texts = [own.decode(i for i in ids if i is not None) for ids in ((x.as_py() or []) for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(rows[id_col].cast("bigint").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids")).mapInArrow(work, "doc_id bigint, text string")
