"""Cutting texts where a tokenizer would cut them anyway, and encoding every distinct chunk once per worker.

A chunk is a run of characters other than white space with the one space before it, or a run of white space. Tokenizers that
split words at white space (with the space leading the word, or dropped) never join what a chunk border parts, so the ids of
a text are the ids of its chunks in a row. Special tokens change the borders around them: texts that hold one go to the
library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from linkcurate.llm.common import once

#: The characters with Unicode's White_Space property.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_BORDER = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Characters at which str.split cuts though they are not White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WINDOW = 1 << 20
#: A word of Latin letters (without those that lower-case or compose in a way of their own) and marks after it.
_WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]*)")
#: Texts that Arrow does not cut as a byte-level tokenizer does: blanks in a row, other white space than spaces and line feeds, the mark.
_MARK = "\x01"
_UNEVEN = r"[ \n][ \n]|[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x01]"


def windows(text: str, size: int = _WINDOW) -> Iterator[str]:
    """A long text in parts that end where a chunk ends, so that one text never needs all its chunks in memory."""
    start = 0
    while len(text) - start > size:
        border = _BORDER.search(text, start + size)
        if not border:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:] if start else text


def by_size(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes in a column of texts, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
            yield batch.slice(i, j - i)
            i = j


class _Known(dict):
    """Chunk to ids; a chunk not met before is encoded on the way."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.make(chunk)
        return ids


class Encoder:
    """Ids of whole texts from a tokenizers file, without added special tokens; one per Python worker and file.

    `keep` bounds the distinct chunks in memory: the newest `keep` and the `keep` before them. It changes no result.
    """

    def __init__(self, path: str, keep: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.normalizer, self.cutter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.ascii = _ascii_rule(json.loads(self.tokenizer.to_str()))
        self.keep, self.known, self.older, self.pieces = keep, _Known(self._chunk), {}, {}
        self.met, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.firsts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def of(path: str) -> Encoder:
        return once(("encoder", path), lambda: Encoder(path))

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.specials)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; no text has none."""
        if not text:
            return b""
        if self.has_special(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) > _WINDOW:
            return b"".join(self._joined(self.cut(x)) for x in windows(text))
        return self._joined(self.cut(text))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (unsigned 32-bit), and where each text's begin (one entry more than there are texts).

        Ordinary texts are cut and their distinct chunks found by Arrow, and only those are looked up; others go one by one.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lower = bool(self.ascii and self.ascii[0])
        odd = pc.match_substring_regex(texts, r"[\x1c-\x1f]" if lower else _UNEVEN).to_numpy(zero_copy_only=False) if self.ascii else np.ones(len(texts), bool)
        for x in self.specials:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        odd |= pc.binary_length(texts).to_numpy(zero_copy_only=False) > _WINDOW
        plain = texts.filter(pa.array(~odd))
        if lower:
            lists = pc.utf8_split_whitespace(pc.ascii_lower(plain))
        else:
            marked = pc.replace_substring(pc.replace_substring(plain, "\n", f"{_MARK}\n{_MARK}"), " ", f"{_MARK} ")
            lists = pc.split_pattern(marked, _MARK)
        coded = pc.dictionary_encode(lists.flatten())
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.firsts[at] - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])]
        if not odd.any():
            return ids, edges
        parts, at = [], 0
        for i, alone in enumerate(odd):
            parts.append(np.frombuffer(self.ids(texts[i].as_py()), "<u4") if alone else ids[edges[at] : edges[at + 1]])
            at += not alone
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks in the table of chunks met; new ones are encoded and added. Beyond `keep` those not in `chunks` go."""
        at = pc.index_in(chunks, value_set=self.met)
        new = chunks.filter(at.is_null())
        if not len(new):
            return at.to_numpy()
        ids = self._encoded(new.to_pylist())
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        if len(self.met) + len(new) > self.keep:
            stay = at.drop_null().to_numpy()
            self.met, n, first = self.met.take(pa.array(stay)), self.lengths[stay], self.firsts[stay]
            self.firsts, self.lengths = np.cumsum(n) - n, n
            self.flat = self.flat[np.repeat(first - self.firsts, n) + np.arange(n.sum())]
        self.met = pa.concat_arrays([self.met, new])
        self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        return pc.index_in(chunks, value_set=self.met).to_numpy()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; words of plain letters with marks after them without the library's cutter."""
        out, known, (lower, _, letters) = [], self.pieces, self.ascii
        space, fullmatch = letters[0x20], _WORD.fullmatch
        for chunk in chunks:
            word = fullmatch(chunk)
            if not word:
                out.append(self._joined_pieces(self.pre_tokens(chunk)))
                continue
            word, marks = word.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            elif word[0] == " ":
                word = chr(space) + word[1:]
            ids = known.get(word) or self._piece(word)
            out.append(ids + (known.get(marks) or self._piece(marks)) if marks else ids)
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.keep // 2:
            self.pieces.clear()
        ids = self.pieces[piece] = b"".join([self.four[t.id] for t in self.model.tokenize(piece)])
        return ids

    def _joined_pieces(self, found: list[str]) -> bytes:
        return b"".join([self.pieces.get(x) or self._piece(x) for x in found])

    def cut(self, text: str) -> list[str]:
        """Chunks; without their white space where the tokenizer drops it, and in lower case where it lower-cases ASCII."""
        if self.ascii and self.ascii[0] and not _SEPARATORS.search(text):
            return (text.lower() if text.isascii() else text).split()
        return CHUNK.findall(text)

    def _joined(self, chunks: list[str]) -> bytes:
        if len(self.known) > self.keep:
            self.known, self.older = _Known(self._chunk), dict(self.known)
        if len(chunks) < 2:
            return self.known[chunks[0]] if chunks else b""
        return b"".join(itemgetter(*chunks)(self.known))

    def pre_tokens(self, chunk: str) -> list[str]:
        """What the library's normalizer and pre-tokenizer make of a chunk, in the letters its model reads."""
        if self.ascii and chunk.isascii():
            lower, cut, letters = self.ascii
            return [x.translate(letters) for x in cut(chunk.lower() if lower else chunk)]
        if self.normalizer is not None:
            chunk = self.normalizer.normalize_str(chunk)
        return [x for x, _ in self.cutter.pre_tokenize_str(chunk)] if chunk else []

    def _chunk(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            return ids
        return self._joined_pieces(self.pre_tokens(chunk))


def _ascii_rule(parts: dict):
    """Lower-case first or not, the cut and the letters of the model for chunks of ASCII, where they are plain; else None.

    Two shapes are known: byte-level words with the space before them, and lower-cased words without spaces. For others, and
    for other characters, the library's own normalizer and pre-tokenizer are called.
    """
    letters = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    cutter, normalizer = parts["pre_tokenizer"] or {}, parts["normalizer"]
    if cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"] and normalizer is None:
        blank = "\\t-\\r "
        return False, re.compile(f"{ends}| ?[A-Za-z]+| ?[0-9]+| ?[^{blank}A-Za-z0-9]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall, letters
    split = cutter.get("pretokenizers", [{}])[0]
    steps = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
    if split.get("type") == "Split" and split["pattern"] == {"Regex": f"{ends}|[\\p{{L}}]+|[\\p{{N}}]|[^\\s\\p{{L}}\\p{{N}}]+"} and steps == ["NFC", "Replace", "Lowercase"]:
        return True, re.compile(f"{ends}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+").findall, letters
    return None
