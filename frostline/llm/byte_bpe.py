"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by an offset table.

The encoder never merges. An Aho-Corasick automaton gives the longest token that begins at each byte of a word; the
encoder goes from left to right, takes it, and takes the next shorter one where the token before it can't stand next to
it. Whether two tokens can is looked up in a table: they can if merging the bytes of both would not merge across the
border between them. The merges of a prefix are unique, so a place from which no token goes on is marked and never tried
again, and a word costs time in proportion to its length.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import append_columns, batches, nonnull_text, utf8
from .tokens import _AS_CHAR

#: The published pattern that splits a text into words before any merge (fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that are letters, marks or space in every Unicode version; texts of others are split by the library.
_KNOWN = regex.compile(r"[\t\n\r -~À-ÖØ-öø-ɏЀ-ҁҊ-ԣ–—‘’“”…一-龥]*+")
_NEVER = 1 << 62
LONG = 1 << 20  # characters of a text beyond which its words are taken a block at a time


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PairTable:
    """Which tokens can stand next to each other, from the merges alone."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], most: int = 1 << 20) -> None:
        """merges: for a pair its rank and the token it makes."""
        self.rank_of = {pair: rank for pair, (rank, _) in merges.items()}
        self.made = {token: (rank, pair) for pair, (rank, token) in merges.items()}
        self.known: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.most = most
        for rank, pair in self.made.values():
            if any(part in self.made and self.made[part][0] >= rank for part in pair):
                raise ValueError("a merge uses a token that is made later: not a trained list of merges")

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            found = self._apart(self._edge(left, 1), self._edge(right, 0))
            if len(self.known) < self.most:
                self.known[key] = found
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of token while it is merged, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.edges:
            until, found = _NEVER, [(token, _NEVER)]
            while token in self.made:
                until, pair = self.made[token]
                token = pair[side]
                found.append((token, until))
            self.edges[key] = found[::-1]
        return self.edges[key]

    def _apart(self, lefts: list[tuple[int, int]], rights: list[tuple[int, int]]) -> bool:
        """Merges go by rank, then from left to right: the border falls if a merge across it comes before the next one
        on either side. Of equal pairs the left side's comes first, the one across second, the right side's last."""
        i = j = 0
        while True:
            (left, left_ends), (right, right_ends) = lefts[i], rights[j]
            across = self.rank_of.get((left, right), _NEVER)
            if across < left_ends and across <= right_ends and across != _NEVER:
                return False
            if left_ends == right_ends == _NEVER:
                return True
            if left_ends <= right_ends:
                i += 1
            else:
                j += 1


def _read(path: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """A tokenizer file, the bytes of its tokens, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec.get("normalizer") or odd:
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take their surroundings are not known here")
    as_byte = {c: b for b, c in _AS_CHAR.items()}
    return spec, {token: bytes(as_byte[c] for c in text) for text, token in model["vocab"].items()}, {t["content"]: t["id"] for t in added}


class OffsetTable:
    """The decoder: all tokens' bytes in a row, and where each begins."""

    def __init__(self, path: str) -> None:
        _, spelled, added = _read(path)
        spelled |= {token: text.encode() for text, token in added.items()}
        size = max(spelled) + 1
        self.blob = np.frombuffer(b"".join(spelled.get(t, b"") for t in range(size)), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(spelled.get(t, b"")) for t in range(size)])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one after the other. Ids that are no tokens give none."""
        ids = ids[(ids >= 0) & (ids < len(self.starts) - 1)]
        out = []
        for block in (ids[i : i + (1 << 16)] for i in range(0, len(ids), 1 << 16)):
            first, n = self.starts[block], self.starts[block + 1] - self.starts[block]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(first - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class ByteBpe:
    """The encoder of one tokenizer file. Only plain byte-level BPE is taken; other files are an error."""

    def __init__(self, path: str, words: int = 200_000) -> None:
        spec, spelled, self.added = _read(path)
        names = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.table = PairTable({(names[a], names[b]): (rank, names[a + b]) for rank, (a, b) in enumerate(pairs)})
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self._index(spelled)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.words: dict[str, bytes] = {}
        self.most_words = words

    def _index(self, spelled: dict[int, bytes]) -> None:
        """The automaton, and for each token its length and the next shorter token that it begins with (or -1)."""
        token_of = {s: t for t, s in spelled.items()}
        if any(bytes([b]) not in token_of for b in range(256)):
            raise ValueError("a byte has no token")
        self.length = {t: len(s) for t, s in spelled.items()}
        self.shorter = {t: next((token_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in token_of), -1) for t, s in spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in token_of.items():
            self.automaton.add_word(s.decode("latin-1"), (t, len(s)))
        self.automaton.make_automaton()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian signed 32-bit numbers. Added tokens are found in the text before anything else."""
        out, at = [], 0
        if self.added and any(s in text for s in self.added):
            for m in self.splitter.finditer(text):
                out += [self._plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
                at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        return b"".join(self._block(words) for words in self._words(text))

    def _words(self, text: str) -> Iterable[list[str]]:
        if not _KNOWN.fullmatch(text):
            parts = self.library.pre_tokenize_str(text)
            return ([text[a:b] for _, (a, b) in block] for block in batched(parts, 1 << 16))
        if len(text) <= LONG:
            return [_WORDS.findall(text)]
        return ([m[0] for m in block] for block in batched(_WORDS.finditer(text), 1 << 16))

    def _block(self, words: list[str]) -> bytes:
        found = list(map(self.words.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.words.get(words[i]) or self._word(words[i])
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        out = array("i", self.merged(word.encode("utf-8", "replace"))).tobytes()
        if len(self.words) < self.most_words and len(word) <= 48:
            self.words[word] = out
        return out

    def merged(self, data: bytes) -> list[int]:
        """The tokens that the merges leave of data: the longest one after the other where all of them fit, or else what
        going back finds. Tokens that fit, each next to the one before, are always those."""
        text = data.decode("latin-1")
        out = [token for _, (token, _) in self.automaton.iter_long(text)]
        return out if all(map(self.table.fits, out, out[1:])) else self._backtracked(text)

    def _backtracked(self, text: str) -> list[int]:
        size = len(text)
        longest = [0] * size
        for end, (token, n) in self.automaton.iter(text):
            longest[end + 1 - n] = token  # ends rise, so the last that begins at a place is the longest
        out: list[int] = []
        dead = bytearray(size + 1)
        fits, length, shorter = self.table.fits, self.length, self.shorter
        at, token = 0, longest[0]
        while at < size:
            while token >= 0 and (dead[at + length[token]] or out and not fits(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            else:  # what stands before this place can't go on
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker, which Spark reuses from task to task."""
    return ByteBpe(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


def _kept(df: DataFrame, drop: str) -> tuple[list[str], str]:
    names = [c for c in df.columns if c != drop]
    return names, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != drop)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: id_col and ids, the tokens of the whole text as an array.

    The ids are those that the tokenizers library gives without special tokens around a text; such tokens inside one
    become their id, as there. A null or empty text has an empty array. Texts of any length are taken whole: one of over
    a million characters goes a block of words at a time. Rows with nulls, repeated rows and ties are encoded each for
    itself, an empty table gives no rows, and other columns don't matter, whatever they are called.
    """
    path = path or default_tokenizer()
    slim = docs.select(F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"))
    names, schema = _kept(slim, "_text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches(source, 256):
            ids = [bpe.encode(t.decode("utf-8", "replace")) for t in utf8(batch.column("_text"))]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield append_columns(batch, names, {"ids": pa.ListArray.from_arrays(pa.array(ends), values)})

    return slim.mapInArrow(run, f"{schema}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """tokens with the column decoded, the text of the ids; special tokens are written out.

    Null ids give a null text, none give an empty one, ids that are no tokens are left out. Bytes that aren't UTF-8 become
    replacement characters. A column decoded that is there already is replaced.
    """
    path = path or default_tokenizer()
    held = tokens.drop("decoded")
    names = held.columns
    slim = held.select(F.struct(*(held[c] for c in names)).alias("_row"), held[ids_col].alias("_ids"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = offset_table(path)
        for batch in batches(source, 256):
            texts = []
            for row in batch.column("_ids"):
                known = row.values if row.is_valid else None
                texts.append(None if known is None else table.decode(known.drop_null().to_numpy(zero_copy_only=False)).decode("utf-8", "replace"))
            yield append_columns(batch, ["_row"], {"_decoded": pa.array(texts, pa.string())})

    schema = f"_row {slim.schema['_row'].dataType.simpleString()}, _decoded string"
    return slim.mapInArrow(run, schema).select("_row.*", F.col("_decoded").alias("decoded"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of
    the text that the ids give when they are decoded), both in lowercase hex. Nulls and so on: as encode()."""
    back = decode(encode(docs, id_col, text_col, path), "ids", path)
    return back.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
