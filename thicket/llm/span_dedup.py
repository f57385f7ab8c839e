"""Substring dedup: runs of consecutive sentences, or pieces of long ones, that stand before elsewhere are removed."""

from __future__ import annotations

import re
from functools import partial
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame

from .unit_dedup import remove_later

#: Every run of so many consecutive sentences is compared, however short: any longer one is covered by those inside it.
SENTENCES = 3
#: So is every run of two or more units with so many words.  Sentences of so many words and more are cut into pieces, units
#: of their own, before the greatest word of any so many consecutive ones.
PIECE_WORDS = 16

# A sentence ends with its line, or at white space behind a full stop, question or exclamation mark.
_BETWEEN = re.compile(r"(?<=[.!?])\s+")


def cut_places(words: list[str]) -> list[int]:
    """Places of the greatest word, the last of equal ones, in each window of PIECE_WORDS words.

    A place hangs on the words of one window alone, so copies of a passage are cut alike but for less than a window at
    the ends, wherever the sentences around them begin and end; and no two places are further apart than a window.
    """
    places: list[int] = []
    at = -1
    for end in range(PIECE_WORDS, len(words) + 1):
        if at < end - PIECE_WORDS:
            best = max(words[end - PIECE_WORDS : end])
            at = end - 1
            while words[at] != best:
                at -= 1
            places.append(at)
        elif words[end - 1] >= words[at]:
            at = end - 1
            places.append(at)
    return places


def sentences_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without white space at its ends; time is linear in the length, blanks included."""
    out, at = [], 0
    for line in text.split("\n"):
        start = 0
        for gap in [*((m.start(), m.end()) for m in _BETWEEN.finditer(line)), (len(line), len(line))]:
            own = line[start : gap[0]]
            if core := own.strip():
                lead = at + start + len(own) - len(own.lstrip())
                out.append((lead, lead + len(core)))
            start = gap[1]
        at += len(line) + 1
    return out


def _pieces(words: list[str], text: str, start: int) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """A sentence that begins at `start` as units of at most PIECE_WORDS words: places in the text, and words."""
    cuts = sorted({0, *cut_places(words), len(words)})
    places, own, at, k = [], [], start, 0
    for a, b in zip(cuts, cuts[1:]):
        first = text.index(words[a], at)
        while k < b:
            at = text.index(words[k], at) + len(words[k])
            k += 1
        places.append((first, at))
        own.append(words[a:b])
    return places, own


def cut_sentences(text: str, sentences: int = SENTENCES, piece_words: int = PIECE_WORDS) -> tuple[list[tuple[int, int]], list[tuple[bytes, int, int]]]:
    """Units, and every run to compare.

    Units are sentences, long ones in pieces.  Runs: from each unit forwards and backwards the shortest run of two units or
    more with `piece_words` words; and every `sentences` consecutive sentences with fewer words, however short.  Those
    with more are covered by the others: the first of their units forwards and the last backwards.  Where a run
    begins and ends hangs on its own words alone, so copies of a passage have the same runs; those that end with the
    passage's last unit or begin with its first are among them.  A passage of three times `piece_words` words, cut
    out of whatever sentences, has a run.
    """
    units: list[tuple[int, int]] = []
    hashes: list[bytes] = []
    sizes: list[int] = []
    whole: list[int] = []  # the first unit of each sentence
    for start, end in sentences_in(text):
        words = text[start:end].split()
        whole.append(len(units))
        places, own = _pieces(words, text, start) if len(words) >= PIECE_WORDS else ([(start, end)], [words])
        units += places
        hashes += [xxhash.xxh3_128_digest(" ".join(w).encode()) for w in own]
        sizes += map(len, own)
    n = len(units)
    ends = [*whole[1:], n]
    upto = [0, *accumulate(sizes)]
    windows = ((whole[i], ends[i + sentences - 1]) for i in range(len(whole) - sentences + 1))
    spans = {(a, b - 1) for a, b in windows if upto[b] - upto[a] < piece_words or b - a == 1}
    first = total = 0  # the run from `first` to i: the shortest long enough that ends at i
    for i in range(n):
        total += sizes[i]
        while i > first + 1 and total - sizes[first] >= piece_words:
            total -= sizes[first]
            first += 1
        if i > first and total >= piece_words:
            spans.add((first, i))
    last, total = n - 1, 0
    for i in range(n - 1, -1, -1):
        total += sizes[i]
        while last > i + 1 and total - sizes[last] >= piece_words:
            total -= sizes[last]
            last -= 1
        if last > i and total >= piece_words:
            spans.add((i, last))
    return units, [(xxhash.xxh3_128_digest(b"".join(hashes[a : b + 1])), a, b) for a, b in sorted(spans)]


def dedup_spans(df: DataFrame, sentences: int = SENTENCES, piece_words: int = PIECE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove sentences in later copies of any run of several consecutive sentences, and so with pieces of long ones.

    Every run of three sentences, however short, and every shortest run of two or more units with 16 words, is compared
    with those of all documents; words count, white space does not.  A run's first place keeps it:
    that of the smallest doc_id, then the first in the text.  In all others the units it covers go, with the white space
    behind them, those of overlapping runs once.  Returns (doc_id, text, n_removed) for each row: the text left, the number
    of characters that went.  Up to 15 words at an end of a copy that lies inside a long sentence may stay.

    Null text stays null; texts without a run stay as they are.  A null id comes last.  Rows that share an id, or have none,
    come in order of the hash of their texts; those alike in both count as one place, so repeated rows all keep what is
    first with them.  An empty table gives none; other columns of `df` are not read.
    """
    return remove_later(df, partial(cut_sentences, sentences=sentences, piece_words=piece_words), id_col, text_col)
