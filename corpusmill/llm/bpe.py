"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can come last in that prefix's encoding: the
token t ending there for which the pair (last token before t, t) encodes to itself. Storing that
last token for each prefix gives the encoding by walking back from the end, makes appending exact
(old entries stay valid) and lets an edit be re-encoded from just before it.

Vocabulary files are a parameter; they are read on the driver (about 1 MB) and broadcast. Nulls and
empty texts encode to no ids. Repeated rows are encoded each for itself, ids may be null or repeat.
Other columns than those asked for are ignored; an empty table gives no rows. A very long text is
encoded whole, its long pieces in time linear in their bytes; there are no ties, as each prefix has
one valid last token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import share

CACHE = 200_000  # entries of each of a worker's memories: tens of MB
STEM = 7


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """ids of pieces, in two generations; the older is dropped when the younger is full."""

    def __init__(self, coder: PrefixBpe, old: dict[str, tuple[int, ...]]):
        super().__init__()
        self.coder, self.old = coder, old

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.old.get(piece)) is None:
            ids = self.coder.piece(piece)
        if len(piece) <= 48:
            self[piece] = ids
        return ids

    def __reduce__(self):  # what is remembered does not travel
        return (Pieces, (self.coder, {}))


#: Texts of these characters alone are split by the standard library's faster engine.
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER = re.compile(f"[^\t-\r -~{PLAIN}]")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts without OTHER characters, or None if it has classes besides L and N."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", PLAIN).replace(r"\p{N}", "0-9"), pattern)
    out = inside.replace(r"\p{L}", f"[{PLAIN}]").replace(r"\p{N}", "[0-9]")
    return None if re.search(r"\\[pPwWdDbBX]|\(\?[^!=:<]", out) else re.compile(out, re.ASCII)


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.plain = ranks, regex.compile(pattern), plain_pattern(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.length = {i: len(t) for t, i in ranks.items()}
        self.base = max(ranks.values(), default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.stems: dict[bytes, list[int]] = {}
        self.pieces = Pieces(self, {})

    def merge(self, data: bytes) -> list[bytes]:
        """Merges by lowest rank, leftmost first; decides single tokens and pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def reachable(self, token: bytes) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(token) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.bytes_of[left], self.bytes_of[right]
        if len(self.pairs) >= 2 * CACHE:
            self.pairs.clear()
        known = self.pairs[left * self.base + right] = self.merge(a + b) == [a, b]
        return known

    def table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the last token of the encoding of data[:i+1]. A given table is of a prefix of
        data, and is extended."""
        last = list(last or ())
        rank, pair, base, longest, length = self.ranks.get, self.pairs.get, self.base, self.longest, self.length
        grown = length[last[-1]] + 1 if last else 1
        for end in range(len(last) + 1, len(data) + 1):
            # often the last token has grown by a byte; as one token alone is valid, any order will do
            start = end - grown
            token = rank(data[start:end])
            if token is not None:
                if not start:
                    valid = self.reachable(data[:end])
                elif (valid := pair(last[start - 1] * base + token)) is None:
                    valid = self.compatible(last[start - 1], token)
                if valid:
                    last.append(token)
                    grown += 1
                    continue
            for start in range(end - longest if end > longest else 0, end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if not start:
                    valid = self.reachable(data[:end])
                elif (valid := pair(last[start - 1] * base + token)) is None:
                    valid = self.compatible(last[start - 1], token)
                if valid:
                    last.append(token)
                    grown = end - start + 1
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def prefix_table(self, data: bytes) -> list[int]:
        """The table of data's first STEM bytes is remembered, as many pieces begin alike."""
        stem = data[:STEM]
        if (last := self.stems.get(stem)) is None:
            if len(self.stems) >= CACHE:
                self.stems.clear()
            last = self.stems[stem] = self.table(stem)
        return self.table(data, last)

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= self.length[last[end - 1]]
        return out[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        """A piece that is a token is that token, as tiktoken has it; else the table decides."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.walk_back(self.prefix_table(data)))

    def encode(self, text: str) -> list[int]:
        split = self.pattern if self.plain is None or OTHER.search(text) else self.plain
        ids = list(chain.from_iterable(map(self.pieces.__getitem__, split.findall(text))))
        if len(self.pieces) > CACHE:
            self.pieces = Pieces(self, dict(self.pieces))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def edit(self, text: str, spans: list[tuple[int, int]], ids: list[tuple[int, ...]], start: int, end: int, new: str):
        """Replaces text[start:end] by `new`; (text, spans, ids of each span) before and after.

        A piece depends on its own characters and at most one after them, so pieces that end two
        or more before the edit stay. Splitting goes on from there until it meets an old border
        behind the edit, from where all old pieces stay.
        """
        after = text[:start] + new + text[end:]
        shift = len(after) - len(text)
        keep = 0
        while keep < len(spans) and spans[keep][1] + 1 < start:
            keep += 1
        old = {a + shift: k for k, (a, _) in enumerate(spans) if a >= end}
        at = spans[keep - 1][1] if keep else 0
        new_spans, new_ids = spans[:keep], ids[:keep]
        for m in self.pattern.finditer(after, at):
            if (k := old.get(m.start())) is not None and m.start() >= start + len(new):
                new_spans += [(a + shift, b + shift) for a, b in spans[k:]]
                new_ids += ids[k:]
                break
            new_spans.append(m.span())
            new_ids.append(self.pieces[m[0]])
        return after, new_spans, new_ids

    def spans(self, text: str):
        spans = [m.span() for m in self.pattern.finditer(text)]
        return spans, [self.pieces[text[a:b]] for a, b in spans]

    def append(self, text: str, spans, ids, more: str):
        return self.edit(text, spans, ids, len(text), len(text), more)


def _coder(df: DataFrame, vocabulary: str, pattern: str):
    """A coder for each worker process, which keeps what it has met from task to task."""
    return share(df.sparkSession, PrefixBpe(read_ranks(vocabulary), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep, n_tokens, ids array<int>: one row for each row; a narrow map."""
    make = _coder(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in batches:
            for i in range(0, b.num_rows, 64):  # ids of a few texts at a time
                part = b.slice(i, 64)
                ids = [coder.encode(t.as_py() or "") for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "n_tokens", "ids"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    src = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("__text"))
    return src.mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that the ids stand for; null ids give no bytes."""
    make = _coder(encoded, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in batches:
            data = pa.array([coder.decode(x.as_py() or []) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], names=["id", "data"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    src = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return src.mapInArrow(run, f"id {id_type}, data binary").withColumnRenamed("id", id_col)


def round_trip_digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The contract's columns: each text is encoded and its ids decoded by the coder of `encode`."""
    make = _coder(docs, vocabulary, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        decimal = {i: str(i) for i in coder.bytes_of}
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=names)

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
