"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A text is cut before each run of blanks: no piece has a blank mark behind another character (checked
when the model is read), so no merge crosses these cuts. Each distinct chunk is encoded once per
worker: Aho-Corasick gives the longest piece at every place, the walk takes it if the pair with the
piece before survives re-merging and the place behind it has not failed, else the next shorter one,
else steps back and marks the place as failed. Pairs are judged once and remembered.

Nulls are empty texts. An empty text has the end id only. Characters without a piece become byte
pieces (or the unknown id where the model has none). Repeated rows give repeated results; further
columns are not read. Exactness is tested against the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelake.llm.words import ChunkCache, byte_set, chunks, hashes, text_blocks

MARK = "▁"
BLANK = byte_set(b" ")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Longest chunk that is kept for later; longer ones are encoded each time.
LIMIT = 200_000


class Model:
    """Pieces of a model file and the backtracking encoder over them."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models without text normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.piece, self.kind, self.score = [], [], []
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            self.piece.append(p.piece)
            self.kind.append(p.type)
            self.score.append(p.score)
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
            elif p.type == kinds.CONTROL:
                if p.piece == "</s>":
                    self.end = i
            elif p.type == kinds.NORMAL:
                self.ids[p.piece] = i
            else:
                raise ValueError(f"pieces of kind {p.type} are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a word's start")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Best merge first, leftmost among equals: how the model itself would cut a short text."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their joint text is merged anew."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest piece that is a proper prefix of a piece; -1: none."""
        known = self.shorter.get(token)
        if known is None:
            text = self.piece[token]
            known = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = known
        return known

    def _run(self, text: str, longest: list[int]) -> list[int]:
        """Pieces of a text of known characters only."""
        n = len(text)
        failed: set[int] = set()
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.piece[token])
                if end not in failed and (not out or self.fits(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                failed.add(at)
                if not out:
                    raise ValueError("a text of known characters has no valid cut")
                token = out.pop()
                at -= len(self.piece[token])
        return out

    def encode_chunk(self, text: str) -> tuple[list[int], bool]:
        """(ids of a chunk whose blanks are marks already, whether they are ordinary pieces only)."""
        longest = [-1] * len(text)
        for end, (token, size) in self.automaton.iter(text):
            start = end - size + 1
            if longest[start] < 0 or size > len(self.piece[longest[start]]):
                longest[start] = token
        out: list[int] = []
        at = 0
        while at < len(text):
            if text[at] not in self.ids:
                out += [self.byte_ids[b] for b in text[at].encode()] if self.byte_ids else [self.unknown]
                at += 1
                continue
            end = at
            while end < len(text) and text[end] in self.ids:
                end += 1
            if end - at == len(text):
                return self._run(text, longest), True
            part = text[at:end]
            out += self._run(part, [self._within(longest[at + i], end - at - i) for i in range(end - at)])
            at = end
        return out, False

    def _within(self, token: int, room: int) -> int:
        while token >= 0 and len(self.piece[token]) > room:
            token = self.next_shorter(token)
        return token

    def decode_ids(self, ids: list[int]) -> bytes:
        """Text of a chunk's ids: byte pieces give their bytes, marks are blanks, control ids nothing."""
        out = []
        for i in ids:
            if self.kind[i] == 6:
                out.append(bytes([int(self.piece[i][3:5], 16)]))
            elif self.kind[i] == 1:
                out.append(self.piece[i].replace(MARK, " ").encode())
            elif self.kind[i] == 2:
                out.append(" ⁇ ".encode())
        return b"".join(out)

    def chunk_values(self, texts: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """(ids as text, their count, decoded text) per chunk; ordinary pieces decode to the chunk they were cut from."""
        out = []
        for t in texts:
            marked = t.decode().replace(" ", MARK)
            ids, plain = self.encode_chunk(marked)
            out.append((" ".join(map(str, ids)).encode(), len(ids), marked.replace(MARK, " ").encode() if plain else self.decode_ids(ids)))
        return out


_MODELS: dict[str, tuple[Model, ChunkCache]] = {}


def _model(path: str) -> tuple[Model, ChunkCache]:
    if path not in _MODELS:
        model = Model(path)
        _MODELS[path] = model, ChunkCache(model.chunk_values, LIMIT)
    return _MODELS[path]


def encoded_rows(column: pa.Array, path: str) -> Iterator[tuple[list[bytes], int, bytes]]:
    """(id texts, count, decoded bytes) of each text of an Arrow column, end id included."""
    model, cache = _model(path)
    end = str(model.end).encode()
    marked = MARK.encode()
    for block in text_blocks(column):
        whole = None
        if model.prefix or block.data.size:
            raw = block.data.tobytes()
            if marked in raw:
                whole = np.array([marked in block.text(r) for r in range(block.rows)])
        spans = chunks(block, BLANK, whole)
        keys = hashes(block, spans)
        values, which = cache.values(block, spans, keys)
        first, which = spans.first.tolist(), which.tolist()
        for r in range(block.rows):
            own = [values[k] for k in which[first[r] : first[r + 1]]]
            if own and model.prefix:
                # The model puts one blank before the text, so the first chunk is another one than inside a text.
                own[0] = model.chunk_values([b" " + block.data[spans.start[first[r]] : spans.end[first[r]]].tobytes()])[0]
            decoded = b"".join([v[2] for v in own])
            yield [v[0] for v in own] + [end], sum([v[1] for v in own]) + 1, decoded[1:] if own and model.prefix else decoded


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids (end id included) and digests of ids and decoded text.

    ``model_path`` must name the model on every executor. Documents are encoded where they lie, no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, texts = [], [], []
            for tokens, count, decoded in encoded_rows(batch.column(1), model_path):
                n.append(count)
                ids.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                texts.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"cast({text_col} as string) text").mapInArrow(work, SCHEMA)


def id_lists(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids and texts themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for tokens, _, decoded in encoded_rows(batch.column(1), model_path):
                ids.append([int(x) for t in tokens for x in t.split()])
                texts.append(decoded.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
            )

    return docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"cast({text_col} as string) text").mapInArrow(
        work, "doc_id bigint, ids array<int>, decoded string"
    )
