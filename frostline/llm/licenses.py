"""License scans: exact phrases, and short notices with a bounded number of edits.

A text becomes words in lower case. Phrases are counted where their words stand one after the other. A notice may
differ by a few edits: it is split into one more part than edits are allowed, so that at least one part is untouched;
parts are found exactly with one Aho-Corasick automaton, and around each find the regex library's bounded-error
matching verifies the whole notice and reports its span and edits. A span begins and ends with a word, and the name of a
licence in it has no edit, so that neither "small rights reserved" nor a NIST licence is taken for what it isn't.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, batches, nonnull_text, utf8

#: Phrases of the base labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licences with their names in notices, their identifiers in SPDX lines, and labels; versions have labels of their own.
NAMES = {
    "mit": (["mit"], ["mit", "mit 0"]), "isc": (["isc"], ["isc"]), "zlib": (["zlib"], ["zlib"]), "boost": (["boost software"], ["bsl 1 0"]),
    "apache": (["apache"], ["apache 1 1", "apache 2 0"]), "apache-2.0": (["apache 2 0"], ["apache 2 0"]),
    "bsd": (["bsd", "2 clause bsd", "3 clause bsd", "new bsd", "simplified bsd", "modified bsd"], ["bsd 2 clause", "bsd 3 clause", "0bsd"]),
    "gpl": (["gnu general public", "gnu gpl", "gpl"], ["gpl 2 0", "gpl 3 0"]), "lgpl": (["gnu lesser general public", "gnu library general public", "lgpl"], ["lgpl 2 1", "lgpl 3 0"]),
    "agpl": (["gnu affero general public", "agpl"], ["agpl 3 0"]), "mpl": (["mozilla public", "mpl"], ["mpl 1 1", "mpl 2 0"]), "mpl-2.0": (["mozilla public license v 2 0"], ["mpl 2 0"]),
    "epl": (["eclipse public", "epl"], ["epl 1 0", "epl 2 0"]), "cddl": (["common development and distribution", "cddl"], ["cddl 1 0"]), "eupl": (["european union public", "eupl"], ["eupl 1 2"]),
    "artistic": (["artistic"], ["artistic 2 0"]), "unlicense": (["unlicense"], ["unlicense"]), "wtfpl": (["do what the fuck you want to public"], ["wtfpl"]), "openssl": (["openssl"], ["openssl"]),
    "psf": (["python software foundation"], ["psf 2 0", "python 2 0"]), "cc-by": (["creative commons attribution"], ["cc by 3 0", "cc by 4 0"]), "cc-by-sa": (["creative commons attribution sharealike"], ["cc by sa 3 0", "cc by sa 4 0"]),
    "cc-by-nc": (["creative commons attribution noncommercial"], ["cc by nc 4 0", "cc by nc 3 0"]), "cc-by-nd": (["creative commons attribution noderivatives"], ["cc by nd 4 0"]), "cc0": (["creative commons zero", "cc0"], ["cc0 1 0"]),
}
#: What stands around a name. The name itself, in braces, allows no edit.
FORMS = ["licensed under the {%s} license", "released under the {%s} license", "released under a {%s} license", "distributed under the {%s} license", "under the terms of the {%s} license", "available under the {%s} license"]
#: Notices that name no licence, or name it otherwise, in the words of their licences.
OTHERS = {
    "licensed under {cc by}": "cc-by", "licensed under {cc by sa}": "cc-by-sa", "licensed under {cc by nc}": "cc-by-nc", "licensed under {cc by nd}": "cc-by-nd", "licensed under {cc0}": "cc0",
    "licensed under a {creative commons attribution}": "cc-by", "licensed under the {apache} license {version 2 0}": "apache-2.0",
    "permission to use copy modify and or distribute this software for any purpose": "isc", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd", "subject to the terms of the {mozilla public} license": "mpl",
    "this is free and unencumbered software released into the public domain": "public-domain", "no rights reserved this work is in the public domain": "public-domain",
    "dedicated to the public domain": "public-domain", "all rights reserved": "reserved", "all rights are reserved": "reserved",
    "this program is free software you can redistribute it and or modify it": "gpl", "this library is free software you can redistribute it and or modify it": "lgpl",
    "{gnu general public} license as published by the free software foundation either {version 2}": "gpl-2.0", "{gnu general public} license as published by the free software foundation either {version 3}": "gpl-3.0",
    "{gnu general public} license {version 2}": "gpl-2.0", "{gnu general public} license {version 3}": "gpl-3.0", "{gnu lesser general public} license {version 3}": "lgpl-3.0", "{gnu affero general public} license {version 3}": "agpl-3.0",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "warranty",
}


def _notices() -> dict[str, str]:
    named = {form % name: label for label, (names, _) in NAMES.items() for name in names for form in FORMS}
    return named | {"spdx license identifier {%s}" % x: label for label, (_, ids) in NAMES.items() for x in ids} | OTHERS


#: Short notices and their labels; edits allowed: one for each 12 characters, 6 at most, none in braces.
NOTICES = _notices()
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """The words of a UTF-8 text in lower case, one space between them."""
    return b" ".join(text.translate(_WORDS).split())


def edits_for(notice: str) -> int:
    return max(1, min(6, len(plain(notice)) // 12))


def plain(notice: str) -> str:
    """A notice without braces."""
    return notice.replace("{", "").replace("}", "")


def _pattern(notice: str, k: int) -> str:
    """Names as they are, what stands between them with edits, from a word's begin to a word's end."""
    out = ["(?<![^ ])"]
    for i, part in enumerate(_BRACES.split(notice)):
        if part:
            out.append(f"(?<![^ ]){regex.escape(part)}(?![^ ])" if i % 2 else f"(?:{regex.escape(part)}){{e<={k}}}")
    return "".join([*out, "(?![^ ])"])


_BRACES = regex.compile(r"[{}]")
_BORDER = 64  # characters after a window in which a word's end is looked for: far more than edits could take up


class NoticeSearch:
    def __init__(self, notices: dict[str, str]) -> None:
        self.notices, self.seeds = [], ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            k, text = edits_for(notice), plain(notice)
            names = _BRACES.split(notice)[1::2]
            self.notices.append((text, label, k, names, regex.compile(_pattern(notice, k), regex.BESTMATCH)))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                owners.setdefault(text[a:b], []).append((n, a))
        for seed, who in owners.items():
            self.seeds.add_word(seed, (len(seed), who))
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices in a normal text, in order; characters from 0."""
        near: dict[int, set[int]] = {}
        for end, (length, who) in self.seeds.iter(text):
            for n, at in who:
                near.setdefault(n, set()).add(end + 1 - length - at)
        found = []
        for n, starts in near.items():
            notice, label, k, names, pattern = self.notices[n]
            own = []
            if all(name in text for name in names):
                for a, b in _windows(sorted(starts), len(notice), k, len(text)):
                    b = text.find(" ", b, b + _BORDER) if text.find(" ", b, b + _BORDER) >= 0 else min(len(text), b + _BORDER)
                    if not _hopeless(text, a, b, notice, k, names):
                        own += [(sum(m.fuzzy_counts), m.start(), m.end()) for m in pattern.finditer(text, a, b)]
            found += [(a, b, label, edits) for edits, a, b in _apart([s for s in own if s[0] <= k])]
        return sorted(set(found))


def _windows(starts: list[int], length: int, k: int, n: int) -> list[tuple[int, int]]:
    """Where a notice may lie whose seeds suggest these starts. Starts that are within the edits of each other are one
    place, with one window; windows may overlap, and what is found in two of them is told apart later."""
    out, first = [], None
    for s in starts:
        if first is not None and s - first <= k:
            out[-1] = (out[-1][0], min(n, s + length + k))
        else:
            first = s
            out.append((max(0, s - k), min(n, s + length + k)))
    return out


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (edits, start, end) that overlap, those with the fewest edits. Spans are about as long as each other, so
    that one overlaps a few neighbours at most."""
    spans, best = sorted(set(found), key=lambda s: (s[1], s[2])), []
    for span in spans:
        beaten = []
        while best and best[-1][2] > span[1] and span[0] < best[-1][0]:
            beaten.append(best.pop())
        if best and best[-1][2] > span[1]:
            best += beaten[::-1]
        else:
            best.append(span)
    return best


def _hopeless(text: str, a: int, b: int, notice: str, k: int, names: list[str]) -> bool:
    """A name isn't in the window, or too few of the notice's characters: each edit accounts for one of them at most."""
    part = text[a:b]
    return any(name not in part for name in names) or sum(max(0, c - part.count(ch)) for ch, c in _letters(notice)) > k


@lru_cache(maxsize=1024)
def _letters(notice: str) -> tuple[tuple[str, int], ...]:
    return tuple((ch, notice.count(ch)) for ch in sorted(set(notice)))


@lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str], ...]) -> NoticeSearch:
    return NoticeSearch(dict(notices))


def base_places(words: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(number of its first word, label) of every place of a phrase."""
    out = []
    for phrase, label in phrases.items():
        want = b" " + phrase.encode() + b" "
        if want.strip() not in words:
            continue
        padded, at, seen, n = b" " + words + b" ", -1, 0, 0
        while (at := padded.find(want, at + 1)) >= 0:
            seen, n = at, n + padded.count(b" ", seen, at)
            out.append((n, label))
    return out


_WORD = regex.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def document_spans(text: str, words: str, spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Spans of a normal text as places in the text that it was made from, characters from 0."""
    starts, begins, at = [m.start() for m in _WORD.finditer(text)], [], 0
    for word in words.split(" "):
        begins.append(at)
        at += len(word) + 1

    def place(a: int) -> int:
        i = bisect_right(begins, a) - 1
        return starts[i] + a - begins[i]

    return [(place(a), place(b - 1) + 1, label, edits) for a, b, label, edits in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (JSON
    list of [start, end, label, edits], in characters of the document's text).

    score is 1 for a phrase or an exact notice, 1 - edits / length for the nearest notice, else 0. Null and empty texts
    have no words and no labels: both label columns are empty strings, the first and last word null. An empty table
    gives no rows; other columns don't matter.
    """
    kept = tuple(notices.items())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(kept)
        for batch in batches(source, 1024):
            out = []
            for text in utf8(batch.column(batch.schema.get_field_index("_text"))):
                words = normal(text)
                base = base_places(words, phrases)
                plain = words.decode("utf-8", "replace")
                spans = search.spans(plain)
                places = document_spans(text.decode("utf-8", "replace"), plain, spans) if spans else []
                labels = {x for _, x in base}
                score = max([1.0] * bool(base) + [1 - e / (b - a + e) for a, b, _, e in spans], default=0.0)
                starts = [s for s, _ in base]
                both = ",".join(sorted(labels)), ",".join(sorted(labels | {x for _, _, x, _ in spans}))
                out.append((words.count(b" ") + 1 if words else 0, len(base), min(starts, default=None), max(starts, default=None), *both, score, json.dumps(places) if places else "[]"))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield append_columns(batch, ["_id"], {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    slim = docs.select(F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
    return out.withColumnRenamed("_id", id_col)
