"""Byte-level BPE: encoding by backtracking from longest matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from .memo import Memo

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Bytes that the memos of one task hold at most, about: matches with their ids, pairs with their verdict.
MATCH_BYTES, PAIR_BYTES = 96 << 20, 32 << 20


class ByteBPE:
    """Tokens of a rank table.  Bytes are mapped to the code points 0 to 255 (Latin-1) for the automaton."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in self.rank:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.window = max(map(len, ranks))
        self.prefix: dict[str, str] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits = Memo(self._fits, PAIR_BYTES)
        self.ids_text = Memo(self._ids_text, MATCH_BYTES)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def forget(self) -> None:
        """Empty the memos: a worker outlives its task, and holds no more than the vocabulary in between."""
        for memo in (self.fits, self.ids_text):
            memo.clear()

    def merged(self, piece: str, least: int = 1) -> list[str]:
        """Merges by rank until none or `least` parts are left: what an encoding is by definition; for short pieces only."""
        parts, rank = list(piece), self.rank
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens that merge into `token` when it is encoded by itself; None if no such merge comes after both."""
        if token not in self.halves:
            parts = self.merged(token, 2)
            regular = len(parts) == 2 and max(self.rank[p] for p in parts) < self.rank[token]
            self.halves[token] = tuple(parts) if regular else None
        return self.halves[token]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side.

        Merges are undone from the last one on.  Between the parts that then touch, a merge across must not come before
        the one undone; of equal ranks the one further left comes first.
        """
        a, b = pair
        rank, before = self.rank, 1 << 60
        while True:
            if rank.get(a + b, before) < before:
                return False
            if len(a) == len(b) == 1:
                return True
            left = len(b) == 1 or len(a) > 1 and rank[a] > rank[b]
            halves = self._halves(a if left else b)
            if halves is None:  # ranks do not tell the order of merges: go by the definition
                return self.merged(pair[0] + pair[1]) == list(pair)
            if left:
                before, a = min(before, rank[a]), halves[1]
            else:
                before, b = min(before, rank[b] + 1), halves[0]

    def _shorter(self, token: str) -> str:
        """The longest token that is a proper prefix of `token`; empty if there is none."""
        if token not in self.prefix:
            self.prefix[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), "")
        return self.prefix[token]

    def tokens(self, piece: str) -> list[str]:
        """Tokens of one match of the pattern, as Latin-1 text.

        From each place the longest token is tried first, then shorter ones; a token stands if it fits the one before
        it.  Where none does, the place is marked dead and the token before is shortened.  Tokens that fit pairwise are
        the encoding, and each place dies once at most, so that time is linear in the length.
        """
        if piece in self.rank:
            return [piece]
        fits, longest, n = self.fits, self.automaton.iter_long, len(piece)
        out: list[str] = []
        dead: set[int] = set()
        ahead = longest(piece)  # the longest token from where the one before ended
        at, last, token = 0, "", next(ahead)[1]
        while True:
            end = at + len(token)
            if end in dead or last and not fits[last, token]:
                token, ahead = self._shorter(token), None
                while not token:
                    dead.add(at)
                    token = out.pop()
                    at -= len(token)
                    token, last = self._shorter(token), out[-1] if out else ""
                continue
            out.append(token)
            if end == n:
                return out
            at, last = end, token
            if ahead is None and n > self.window:  # a search begun anew reads all it is given: here, one token's length
                token = next(longest(piece[at : at + self.window]))[1]
                continue
            ahead = ahead or longest(piece, at)
            token = next(ahead)[1]

    def encode_exactly(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern by itself."""
        rank = self.rank
        return [rank[t] for m in self.pattern.findall(text) for t in self.tokens(m.encode().decode("latin-1"))]

    def _ids_text(self, match: str) -> str:
        rank = self.rank
        return ",".join([str(rank[t]) for t in self.tokens(match.encode().decode("latin-1"))])

    def encode_text(self, text: str) -> str:
        """Decimal ids of a whole text joined by commas; memoised by match of the pattern."""
        return ",".join(map(self.ids_text.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode_text(self, ids: str) -> bytes:
        """Bytes of decimal ids joined by commas; an id that no token has is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_text(",".join(map(str, ids)))


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One per vocabulary and Python worker."""
    return ByteBPE.from_file(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (doc_id, ids array<int>); a null text gives an empty array.

    Row by row without a shuffle; a null id stays null, repeated rows each give a row, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, schema.field(1).type)], schema=schema)
        bpe.forget()

    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, "doc_id long, ids array<int>")


def encode_and_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sizes: Column | None = None) -> DataFrame:
    """Per document: n_tokens, SHA-256 of its decimal ids joined by commas, SHA-256 of the bytes decoded from the ids.

    Every whole text is encoded and its ids are decoded again, in one pass without a shuffle.  Null or empty text: no
    tokens, digests of nothing.  A null id stays null, repeated rows each give a row, an empty table gives none; other
    columns are not read, so their names cannot clash.  Memos have a bounded number of bytes and end with their task.
    `sizes`, if given, is a number of each row that goes along as n_bytes.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields if sizes is None else [*fields, ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode_text(text.as_py() or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), *batch.columns[2:]], schema=schema)
        bpe.forget()

    along = [] if sizes is None else [sizes.cast("long")]
    return df.select(df[id_col].cast("long"), df[text_col], *along).mapInArrow(run, SCHEMA + ", n_bytes long" * len(along))
