"""Encoding and decoding with a pair-merge piece model, by a table of each prefix's last piece.

A pair-merge encoding is closed under prefixes: dropping the last pieces of an encoding leaves the encoding of the
text that is left. So every prefix of a text has one last piece, and a piece that ends there is that piece exactly
where it is compatible with the last piece of the prefix before it: where the two, merged alone, stay two. An
automaton gives all pieces that end at each place, the table keeps the compatible one, and ids are read off it
backwards. Time is linear in the text, also where a text holds no blank at all.

No piece crosses the border of a pre-token (``tokens.check_vocabulary`` proves it), so the table of a text is the
tables of its pre-tokens side by side, and a task works out each pre-token once.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from placekit.llm.common import slices
from placekit.llm.tokens import BLANK, check_vocabulary, pre_tokens

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
UNKNOWN_TEXT = " ⁇ "  # what the library writes for the unknown piece
NEVER = float("inf")

codecs.register_error("placekit-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A piece model: its merge order, the automaton of its pieces, and what each id decodes to."""

    ROOM = 2_000_000  # remembered pairs, then all are forgotten

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = [p.type for p in model.pieces]
        if kinds.count(BYTE) != 256 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models that spell foreign characters in bytes and mark no piece of their own are supported")
        names = {p.piece: i for i, p in enumerate(model.pieces)}
        self.begin, self.end = names[model.trainer_spec.bos_piece or "<s>"], names[model.trainer_spec.eos_piece or "</s>"]
        self.byte_ids = [names[f"<0x{b:02X}>"] for b in range(256)]
        self.kinds, self.texts = kinds, [p.piece for p in model.pieces]
        self.size, self.packed = [len(t) for t in self.texts], [i.to_bytes(4, "little") for i in range(len(kinds))]
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() if p.type == NORMAL
                        else UNKNOWN_TEXT.encode() if p.type == UNKNOWN else b"" for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # smaller is merged sooner; equal scores share an order and are merged from the left
        order = {s: n for n, s in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {s: order[model.pieces[i].score] for s, i in normal.items() if len(s) > 1}
        self.characters = {s: i for s, i in normal.items() if len(s) == 1}
        if {c for s in normal for c in s} - self.characters.keys():
            raise ValueError("a piece holds a character that is no piece")
        shared: dict[int, int] = {}
        for r in self.rank.values():
            shared[r] = shared.get(r, 0) + 1
        self.automaton = ahocorasick.Automaton()
        # per id: lives of the parts on its left and right edge, smallest first, as (part, order of the merge that ends it)
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        halves: dict[str, tuple[str, str]] = {}
        for s, i in sorted(normal.items(), key=lambda x: len(x[0])):
            if len(s) > 1:
                steps: list = []
                if len(self.merge(s, steps)) > 1:
                    continue  # never the outcome of merges, so in no encoding
                halves[s] = steps[-1]
                self.automaton.add_word(s, i)
            for side, edges in ((0, self.left), (1, self.right)):
                part, lives, until = s, [], NEVER
                while part is not None:
                    lives.append((part, until))
                    here = self.rank.get(part, -1)
                    # an order shared with other pieces, or smaller than that of a part, has no simple lives
                    if here != -1 and (shared[here] > 1 or here >= until):
                        lives = None
                        break
                    until, part = here, halves[part][side] if part in halves else None
                if lives is not None:
                    edges[i] = lives[::-1]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """Merges of a short text, one after the other: the model's definition."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            if steps is not None:
                steps.append((parts[k], parts[k + 1]))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Do pieces ``a`` and ``b``, side by side and merged alone, stay ``a`` and ``b``?"""
        if a not in self.right or b not in self.left:
            return self.merge(self.texts[a] + self.texts[b]) == [self.texts[a], self.texts[b]]
        # a merge across the border needs a right part of a and a left part of b that live at once, and comes before
        # the merges that end them; of two equal merges the left one comes first
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            r = self.rank.get(x + y)
            if r is not None and r < x_end and r <= y_end:
                return False
            if x_end == NEVER and y_end == NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def table(self, token: str) -> list[int | None]:
        """Per prefix of ``token`` the id of its last piece; None for a character outside the vocabulary, and for no prefix.

        The automaton holds pieces of two characters or more: where none of them is compatible, the last piece of a
        prefix is its last character.
        """
        last = [None, *map(self.characters.get, token)]
        pairs, compatible, size, found = self.pairs, self.compatible, self.size, -1
        for at, piece in self.automaton.iter(token):
            if at == found:
                continue  # a prefix has one last piece only
            before = last[at + 1 - size[piece]]
            if before is not None:
                key = before << 32 | piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= self.ROOM:
                        pairs.clear()
                    fits = pairs[key] = compatible(before, piece)
                if not fits:
                    continue
            last[at + 1] = piece
            found = at
        return last

    def ids(self, token: str) -> list[int]:
        """Ids of a pre-token, read off its table from the end."""
        last, at, out, size = self.table(token), len(token), [], self.size
        while at:
            piece = last[at]
            if piece is None:
                out += [self.byte_ids[b] for b in reversed(token[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                out.append(piece)
                at -= size[piece]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: control ids are nothing, the blank the encoder puts first goes,
        bytes that are no UTF-8 become one replacement character each."""
        start, open_ = 0, True  # skip what writes nothing, then the first blank
        lead = b""
        for t in ids:
            if self.kinds[t] == CONTROL:
                start, open_ = start + 1, True
                continue
            if self.kinds[t] == NORMAL and open_ and self.texts[t].startswith(BLANK):
                start, lead, open_ = start + 1, self.surface[t][1:], False
                if not lead:
                    continue
            break
        parts, runs = [lead], []
        for t in ids[start:]:
            if self.kinds[t] == CONTROL:
                runs.append(b"".join(parts))
                parts = []
            else:
                parts.append(self.surface[t])
        runs.append(b"".join(parts))
        return "".join(r.decode("utf-8", "placekit-each-byte") for r in runs)


class TokenIds(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, worked out once; when it grows too large it forgets what
    was not used since the last time."""

    ROOM = 300_000

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older = pieces, {}

    def __missing__(self, token: str) -> bytes:
        value = self.older.get(token)
        if value is None:
            value = b"".join(map(self.pieces.packed.__getitem__, self.pieces.ids(token.replace(" ", BLANK))))
        if len(token) <= 1000:
            if len(self) >= self.ROOM:
                self.older = dict(self)
                self.clear()
            self[token] = value
        return value


_loaded: dict[str, TokenIds] = {}


def _ids(path: str) -> TokenIds:
    """The model of this Python worker, read once."""
    if path not in _loaded:
        _loaded[path] = TokenIds(Pieces(path))
    return _loaded[path]


def _packed(table: TokenIds, text: str | None, begin: bool, end: bool) -> bytes:
    """Ids of a whole text as little-endian 32-bit integers."""
    p = table.pieces
    return b"".join([p.packed[p.begin] if begin else b"", *map(table.__getitem__, pre_tokens(text or "")), p.packed[p.end] if end else b""])


def _unpacked(packed: bytes) -> list[int]:
    return memoryview(packed).cast("I").tolist()


def encode(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids`` of each document: the ids of its whole text, with the model's begin and end ids on demand.

    ``docs`` needs ``doc_id, text``; other columns are ignored. A null text is an empty one. Rows that repeat each give a
    row. An empty table gives an empty result. ``model_path`` must be readable on every executor.
    """
    check_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ids(model_path)
        for batch in slices(batches, "text", 1_000_000):
            ids = [_unpacked(_packed(table, t, begin, end)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null or empty ids give an empty text, an id outside the model raises."""
    check_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _ids(model_path).pieces
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document, encoded with begin and end ids and decoded again.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8, so neither
    leaves the task. Inputs are handled as in ``encode``.
    """
    check_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ids(model_path)
        for batch in slices(batches, "text", 1_000_000):
            size, ids_hex, text_hex = [], [], []
            for text in batch.column("text").to_pylist():
                packed = _packed(table, text, True, True)
                size.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                text_hex.append(hashlib.sha256(table.pieces.decode(_unpacked(packed)).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
