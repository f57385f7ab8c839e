"""Line dedup: windows of three consecutive lines that stand before elsewhere are removed."""

from __future__ import annotations

from functools import partial

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unit_dedup import remove_in_place, remove_later

WINDOW = 3
#: White space at the ends of a line that does not count, beside the newline.
BLANK = " \t\x0b\x0c\r"


def cut_lines(text: str, window: int = WINDOW) -> tuple[list[tuple[int, int]], list[tuple[bytes, int, int]]]:
    """Lines that are not blank, and every window of consecutive ones; lines count without white space at their ends."""
    units, lines, at = [], [], 0
    for line in text.split("\n"):
        if own := line.strip(BLANK):
            units.append((at, at + len(line)))
            lines.append(xxhash.xxh3_128_digest(own.encode()))
        at += len(line) + 1
    return units, [(xxhash.xxh3_128_digest(b"".join(lines[i : i + window])), i, i + window - 1) for i in range(len(lines) - window + 1)]


def dedup_lines(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove lines in later copies of any window of three consecutive lines.

    Lines are cut at newlines; blank ones are passed over.  Every window is compared with those of all documents.  Its
    first place keeps it: that of the smallest doc_id, then the first in the text.  In all others, the lines it covers go
    with all up to the next line, those of overlapping windows once.  Returns (doc_id, text, n_removed) for each row: the
    text left, the number of characters that went.

    Null text stays null; texts of fewer than three lines stay as they are.  A null id comes last.  Rows that share an id,
    or have none, come in order of the hash of their texts; those alike in both count as one place, so repeated rows all
    keep what is first with them.  An empty table gives none; other columns of `df` are not read.
    """
    return remove_later(df, partial(cut_lines, window=window), id_col, text_col)


def dedup_lines_keeping_columns(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """`df` (with doc_id, text, n_chars) with the texts that `dedup_lines` leaves; n_chars follows; other columns stay.

    Nulls, ties and repeated rows as there; a null text keeps a null n_chars.  Documents of which nothing is left stay,
    with empty text.  No name of a further column clashes.
    """
    out = remove_in_place(df, partial(cut_lines, window=window))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
