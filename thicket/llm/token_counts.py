"""Token counts of a sentence-piece BPE model: prefix dynamic programming, memoised by word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import Memo

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

#: Bytes that the memos of one task hold at most, about: words with their counts, pairs with their verdict.
WORD_BYTES, PAIR_BYTES = 96 << 20, 32 << 20

SPACE = "\u2581"


class PrefixCounter:
    """Counts tokens at every prefix of a text without encoding each prefix anew.

    The last token of a prefix's encoding is the one token that ends there and fits behind the encoding of what stands
    before it, so that count(i) = count(i - len(token)) + 1: one step per character over the tokens that end there.
    """

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece of this model goes on behind a space; words cannot be counted one by one")
        if model.encode(f"a  {SPACE}b\tc\n ", out_type=str) != model.encode(f"a   b\tc\n{SPACE}", out_type=str):
            raise ValueError("this model does not keep white space as it is")
        # a character that no longer piece has stands alone: text can be cut around it
        apart = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.score))
        self.words = re.compile(f" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p.replace(SPACE, " "), p.replace(SPACE, " "))
        self.automaton.make_automaton()
        self.rank = {p.replace(SPACE, " "): -s for p, s in self.score.items()}
        self.fits = Memo(self._fits, PAIR_BYTES)
        self.count = Memo(lambda w: self.prefixes(w)[-1], WORD_BYTES)

    def merged(self, piece: str) -> list[str]:
        """Merges of adjacent symbols, best score first and then leftmost: an encoding by definition; for short pieces."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], float("inf")))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == list(pair)

    def prefixes(self, word: str) -> list[int]:
        """Tokens of word[:i] for i from 0 to its length; characters that no piece has count their UTF-8 bytes."""
        last, counts, fits = [""], [0], self.fits
        for end, piece in self.automaton.iter(word):  # in order of their ends
            if len(last) == end + 2:
                continue  # the one token that ends here is found
            while len(last) <= end:
                self._single(word, last, counts)
            before = last[end + 1 - len(piece)]
            if not before or fits[before, piece]:
                last.append(piece)
                counts.append(counts[end + 1 - len(piece)] + 1)
        while len(last) <= len(word):
            self._single(word, last, counts)
        return counts

    @staticmethod
    def _single(word: str, last: list[str], counts: list[int]) -> None:
        """No piece ends at the next character: it stands alone, as its bytes."""
        c = word[len(last) - 1]
        last.append(c)
        counts.append(counts[-1] + len(c.encode()))

    def forget(self) -> None:
        """Empty the memos: a worker outlives its task, and holds no more than the model in between."""
        self.fits.clear()
        self.count.clear()

    def split(self, text: str) -> list[str]:
        """Words, each with the spaces before it, of the text behind the space that the model puts first."""
        return self.words.findall(f" {text}".replace(SPACE, " ")) if text else []

    def total(self, text: str) -> int:
        return sum(map(self.count.__getitem__, self.split(text)))

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of `text` that takes `budget` tokens at most."""
        at, used = -1, 0  # the model's own space comes first
        for word in self.split(text):
            n = self.count[word]
            if used + n > budget:
                within = self.prefixes(word)
                return max(0, at + max(i for i, k in enumerate(within) if used + k <= budget))
            at, used = at + len(word), used + n
        return len(text)

    def table(self, text: str) -> list[int]:
        """Tokens at every prefix of a text, from the empty one to the whole."""
        out, used = [0], 0
        for word in self.split(text):
            within = self.prefixes(word)
            out += [used + k for k in within[1:]]
            used += within[-1]
        return [0, *out[2:]]


@lru_cache(2)
def counter(model_file: str) -> PrefixCounter:
    """One per model and Python worker."""
    return PrefixCounter(model_file)


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a sentence-piece BPE model, without begin, end or special tokens.

    n_bytes: UTF-8 bytes.  over_limit: n_tokens > limit.  fit_chars: code points of the longest prefix of `limit` tokens
    at most, read off the prefix counts.  One pass without a shuffle; memos have a bounded number of bytes and end with
    their task.

    Null or empty text: 0 bytes, 0 tokens.  A null id stays null, repeated rows each give a row, an empty table gives
    none; other columns are not read, so their names cannot clash.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model_file)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                n = pieces.total(text)
                rows.append((n, n > limit, pieces.fit(text, limit) if n > limit else len(text)))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)
        pieces.forget()

    return df.select(df[id_col].cast("long"), df[text_col], n_bytes(df[text_col])).mapInArrow(run, SCHEMA)
