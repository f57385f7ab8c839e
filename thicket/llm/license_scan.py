"""Licence scan: Aho-Corasick over identifier tags and notice phrases, shunting-yard over expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notices that name a licence more exactly; in words, as `words_of` gives them.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "server side public license": "sspl",
    "business source license": "busl",
    "sil open font license": "ofl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "public domain": "public-domain",
}

#: Words of the tag that an expression follows, and the tag as it stands in raw lower-case text.
TAG_WORDS, TAG = "spdx license identifier", "spdx-license-identifier:"

#: Restrictiveness, from free use to none, and at the end what is not known: nothing that stands beside it loosens it.
CLASSES = ("permissive", "weak copyleft", "strong copyleft", "network copyleft", "restricted", "unknown")
UNKNOWN = len(CLASSES) - 1
_VERSION = r"(-\d+(\.\d+)*)?(-only|-or-later)?\+?"
#: Families of licence identifiers by class; the first that matches counts.
FAMILIES = tuple(
    (rank, re.compile(rf"(?:{'|'.join(names)}){_VERSION}"))
    for rank, names in (
        (4, ("cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "sspl", "busl", "elastic", "polyform-[a-z-]+", "licenseref-.*", "documentref-.*", "proprietary")),
        (3, ("agpl", "osl", "rpl", "cpal")),
        (2, ("gpl", "cc-by-sa", "eupl", "cecill", "odbl", "gfdl")),
        (1, ("lgpl", "mpl", "epl", "cpl", "cddl", "apsl", "ms-rl", "ofl")),
        (0, ("0bsd", "afl", "apache", "artistic", "blueoak", r"bsd(-\d-clause)?(-patent|-clear)?", "bsl", "cc-by", "cc0", "curl", "isc", "libpng", r"mit(-0)?", "ms-pl", "ncsa", "openssl", "postgresql", "psf", "python", "unicode-dfs", "unlicense", "upl", "w3c", "wtfpl", "x11", "zlib", "zpl")),
    )
)
#: Exceptions that let other code link to code under the GPL.
LINKING = {"autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "linux-syscall-note"}
#: What stands for an expression that breaks off.
UNRESOLVED = "unresolved"

#: How sure a scan is that a text states a licence: by an expression, an exact notice, a base phrase.
W_EXPRESSION, W_NOTICE, W_BASE = 0.95, 0.6, 0.3

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, verdict string"
)

# A-Z to lower case, every other ASCII byte that is no word character to a space; bytes of other characters stay.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_LEXER = re.compile(r"\s*(\(|\)|(?:documentref-[a-z0-9.-]+:)?[a-z0-9]+(?:[.-]+[a-z0-9]+)*\+?)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_TO_WORDS).split()


def parse_expression(text: str) -> list[str] | None:
    """Postfix form of the licence expression that `text` (lower case) begins with; None if there is none or it breaks off.

    Shunting-yard: operands go to the output, operators wait on a stack until one that binds no tighter comes.  Any
    well-formed identifier is an operand.  The expression ends where two operands meet or an unopened bracket closes;
    after an operator, in an open bracket, or with ``with`` behind a bracket, it is broken and not cut short.
    """
    out: list[str] = []
    stack: list[str] = []
    at, operand, simple = 0, True, False
    while m := _LEXER.match(text, at):
        token, at = m[1], m.end()
        if operand:
            if token == "(":
                stack.append(token)
            elif token in _PRECEDENCE or token == ")":
                return None
            else:
                out.append(token)
                operand, simple = False, not (stack and stack[-1] == "with")
        elif token in _PRECEDENCE:
            if token == "with" and not simple:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
            simple = False
        else:
            break
    return None if operand or "(" in stack else out + stack[::-1]


def class_of(licence: str) -> int:
    return next((rank for rank, family in FAMILIES if family.fullmatch(licence)), UNKNOWN)


def evaluate(postfix: list[str]) -> int:
    """Restrictiveness of an expression: ``or`` takes the freer side, ``and`` the stricter.

    A linking exception turns the GPL into weak copyleft; other exceptions change nothing.  An unknown licence is stricter
    than all known ones.
    """
    stack: list[tuple[int, str]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((1 if left.startswith("gpl-") and right in LINKING else a, left))
            else:
                stack.append((max(a, b) if token == "and" else min(a, b), ""))
        else:
            stack.append((class_of(token), token))
    return stack[0][0]


def _line(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[at : end if end >= 0 else len(text)]


def licences_in(postfix: list[str]) -> list[str]:
    """The operands, without exceptions: these stand right before a ``with``."""
    return [x for x, after in zip(postfix, [*postfix[1:], ""]) if x not in _PRECEDENCE and after != "with"]


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG_WORDS: None}.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    tags.add_word(TAG, len(TAG))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> tuple:
    """All columns of SCHEMA but doc_id, for one whole text; a null text counts as empty."""
    phrases, tags = _automata()
    words = words_of(text or "")
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, labels, expressions = set(), set(), []
    n_base, first, last, tagged = 0, None, None, False
    seen_at = index = 0  # the word that begins at seen_at + 1 has this index
    for end, (size, label, is_base) in phrases.iter(joined):
        start = end - size + 1
        index += joined.count(" ", seen_at, start) if start >= seen_at else -joined.count(" ", start, seen_at)
        seen_at = start
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            n_base += 1
            first = index if first is None else min(first, index)
            last = index if last is None else max(last, index)
    notices = labels - base
    if tagged:
        # lower case for ASCII only: places stay the same
        raw = text.encode().lower().decode()
        for end, _ in tags.iter(raw):
            expressions.append(parse_expression(_line(raw, end + 1)))
    for postfix in expressions:
        labels.update(licences_in(postfix or []))
    missed = (1 - W_EXPRESSION) ** bool(expressions) * (1 - W_NOTICE) ** len(notices) * (1 - W_BASE) ** len(base)
    worst = max(UNKNOWN if x is None else evaluate(x) for x in expressions) if expressions else None
    return (
        len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - missed,
        "; ".join(dict.fromkeys(UNRESOLVED if x is None else " ".join(x) for x in expressions)), None if worst is None else CLASSES[worst],
    )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence statements of every document: one row of SCHEMA per row of `df`, in one pass without a shuffle.

    n_words: words of the whole text.  n_base, first_word, last_word: places where a BASE phrase stands, all of them, and
    the smallest and largest index of their first words (null without any).  base_labels, labels: distinct, sorted,
    joined by commas, empty without any; labels also has those of NOTICES and the licences of expressions behind a TAG.
    score: from 0 (nothing found) towards 1.  expressions: in postfix form, distinct; UNRESOLVED for one that breaks off.
    verdict: the strictest of them, null without a TAG; unknown licences and broken expressions are stricter than known ones.

    Null or empty text: no words, labels empty, score 0.  A null id stays null; repeated rows each give a row; an empty
    table gives none.  Other columns of `df` are not read, so their names cannot clash.
    """
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("verdict", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(list(c) for c in zip(*found))] if found else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, SCHEMA)
