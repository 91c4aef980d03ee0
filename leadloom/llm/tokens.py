"""Token ids of whole texts, by a public tokenizer file.

The two kinds of file known here cut a text at white space before anything else,
so the ids of a text are those of its chunks in a row: the chunks of many texts
are told apart by Arrow, each distinct one is looked up or encoded, and the ids
are put together by position. The kind is told by the file's own normaliser and
pre-tokenizer; any other file gets whole texts through the library's call. So do
texts that hold one of the file's added tokens, U+0000, or the separators U+001C
to U+001F, which count as white space here and not in the tokenizers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leadloom.llm.common import resident

#: Ids are held and summed as little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")
#: Runs of letters and other pieces that a worker remembers (some 200 bytes each) before it starts anew.
CACHE_CHUNKS = 300_000
#: Bytes of text whose chunks are told apart together.
SLICE_BYTES = 4 << 20

# How the known kinds of file cut a text.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMAL = ["NFC", "Replace", "Lowercase"]

#: A chunk with the blank before it, or white space on its own (byte-level files).
KEEPS_SPACE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Latin letters (without U+0130, whose lower case ends in a combining mark), and
#: ASCII marks behind them: both kinds of file cut between the two.
LETTERS = r"^(?P<core> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Byte-level texts with these (white space other than single blanks and line feeds) are cut one by one.
ODD_SPACE = r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
_ODD = "\x00\x1c\x1d\x1e\x1f"
#: Byte-level files write a byte as itself if it is printable, the others as U+0100 and up in turn.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def kind_of(file: dict) -> str | None:
    """``byte`` or ``word`` for the files whose chunks can be encoded apart, None for others."""
    normal, cut = file.get("normalizer"), file.get("pre_tokenizer") or {}
    if file["model"]["type"] != "BPE" or file["model"].get("dropout") or any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
        return None
    if normal is None and cut == BYTE_LEVEL:
        return "byte"
    steps = cut.get("pretokenizers", [])
    if normal and [x["type"] for x in normal.get("normalizers", [])] == WORD_NORMAL and len(steps) == 2:
        split, level = steps
        if split.get("pattern") == {"Regex": WORD_LEVEL} and split["invert"] and split["behavior"] == "Removed" and level == BYTE_LEVEL | {"use_regex": False}:
            return "word"
    return None


class Encoder:
    """Ids of texts as arrays. Runs of letters go straight to the merges, marks behind them apart."""

    def __init__(self, path: str, chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks = Tokenizer.from_file(path), chunks
        file = json.loads(Path(path).read_text())
        self.kind = kind_of(file)
        self.whole_for = [*_ODD, *(x["content"] for x in file["added_tokens"])]
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}

    def letters(self, core: str) -> bytes:
        """Ids of a run of letters, which no file cuts further before the merges."""
        as_bytes = core.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([x.id.to_bytes(4, "little") for x in self.merge(as_bytes)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _pieces(self, strings: pa.Array, encode: Callable[[str], bytes]) -> list[bytes]:
        """The ids of distinct strings; an empty or null one has none."""
        if len(self.known) >= self.chunks:
            self.known.clear()
        known, found = self.known, []
        for x in strings.to_numpy(zero_copy_only=False):
            if (ids := known.get(x)) is None:
                ids = known[x] = encode(x) if x else b""
            found.append(ids)
        return found

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id behind it, and where they end."""
        ids, sizes = [], []
        for part in _slices(texts):
            found, n = self._slice(part, end)
            ids.append(found)
            sizes.append(n)
        if not ids:
            return np.empty(0, ID), np.empty(0, np.int64)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _slice(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and the number of ids of each text, of texts that are few enough to hold."""
        texts = pc.fill_null(texts, "")
        alone = np.ones(len(texts), bool)
        if self.kind is not None:
            odd = "|".join(map(re.escape, self.whole_for))
            alone = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
        kept = pc.if_else(pa.array(alone), "", texts)
        if self.kind == "byte":
            cut = pc.match_substring_regex(kept, ODD_SPACE)
            even = pc.replace_substring(pc.replace_substring(pc.if_else(cut, "", kept), " ", "\0 "), "\n", "\0\n\0")
            if pc.any(cut).as_py():
                rows = ["\0".join(KEEPS_SPACE.findall(t)) if c else e for t, c, e in zip(kept.to_pylist(), cut.to_pylist(), even.to_pylist(), strict=True)]
                even = pa.array(rows, pa.string())
            chunks = pc.split_pattern(even, "\0")
        else:
            chunks = pc.utf8_split_whitespace(kept)
        told = chunks.flatten().dictionary_encode()
        parts = pc.extract_regex(told.dictionary, LETTERS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        cores = pc.struct_field(parts, "core")
        cores = (pc.utf8_lower(cores) if self.kind == "word" else cores).dictionary_encode()
        marks = pc.struct_field(parts, "marks").dictionary_encode()
        others = told.dictionary.filter(pa.array(~plain))
        # a distinct chunk is two pieces: its letters or all of it, and the marks behind
        pieces = self._pieces(cores.dictionary, self.letters)
        first = np.empty(len(plain), np.int64)
        first[plain] = cores.indices.filter(pa.array(plain)).to_numpy()
        first[~plain] = len(pieces) + np.arange(len(others))
        pieces += self._pieces(others, self.whole)
        second = np.full(len(plain), len(pieces))
        second[plain] += 1 + marks.indices.filter(pa.array(plain)).to_numpy()
        pieces += [b"", *self._pieces(marks.dictionary, self.whole)]
        codes = told.indices.to_numpy()
        codes = np.stack([first[codes], second[codes]], axis=1).reshape(-1)
        ends, single = 2 * pc.list_value_length(chunks).to_numpy().cumsum(dtype=np.int64), np.nonzero(alone)[0]
        codes = np.insert(
            codes,
            np.concatenate([ends[single], ends]),
            np.concatenate([len(pieces) + 1 + np.arange(len(single)), np.full(len(ends), len(pieces))]),
        )
        pieces.append(end.to_bytes(4, "little"))
        pieces += [self.whole(texts[i].as_py()) for i in single.tolist()]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
        flat, begin = np.frombuffer(b"".join(pieces), ID), np.cumsum(size) - size
        sizes = size[codes]
        upto = np.cumsum(sizes)
        at = np.repeat((begin[codes] - upto + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        rows = upto[ends + np.arange(len(ends)) + np.cumsum(alone)] if len(ends) else upto
        return flat[at], np.diff(rows, prepend=0)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().cumsum(dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def encoder(path: str, chunks: int = CACHE_CHUNKS) -> Encoder:
    """One for each Python worker."""
    return resident(("encoder", path, chunks), lambda: Encoder(path, chunks))
