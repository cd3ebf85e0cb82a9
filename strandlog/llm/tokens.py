"""Token ids of whole texts, by the tokenizers library and a published vocabulary file.

A text is cut only where the pre-tokenizer of a byte-level BPE always cuts: before white space that
follows something else, before marks that follow a letter or digit, and around a line feed that
stands alone. The parts' ids one after another then are the text's ids. The cuts of a batch are
found in numpy and its parts numbered in Arrow, without copying; each distinct part is encoded once
by the library and kept in a table bounded in parts and in bytes, from which the ids of the batch are gathered.

The library's own handling of added tokens holds: a string such as ``<|endoftext|>`` inside a text
is that token. Texts that hold one, and texts with white space beyond ASCII, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlog.llm.common import text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts kept by an encoder, and bytes (a part's characters, its ids and about 150 for its objects); the table starts anew beyond either.
KEPT_PARTS, KEPT_BYTES = 1_000_000, 160 << 20
#: Words of Latin letters only: one pre-token each, so the model can be asked without the rest of the pipeline.
_LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Bytes of text whose parts are numbered together.
SLICE = 1 << 22
#: Classes of bytes: 1 white space, 2 letters and digits, 3 marks that never belong to a word, 4 line feed; 0 others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_CLASS[list(b".,;:!?*#$%&|\"")] = 3
_CLASS[10] = 4
#: White space beyond ASCII, in UTF-8: first byte and the bytes after it.
_WIDE = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the parts of all texts begin (and the end), in ascending order; every text's begin is among them."""
    kind = _CLASS[buf]
    space = (kind == 1) | (kind == 4)
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    word = kind == 2
    latin = buf[:-1] == 0xC3  # the Latin letters of two bytes that begin so, but for two signs
    latin &= (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    word[1:] |= latin
    cut[1:-1] |= (kind[1:] == 3) & word[:-1]
    feed = np.flatnonzero(kind == 4)
    feed = feed[(feed > 0) & (feed < len(buf) - 1)]
    cut[feed[~space[feed - 1] & ~space[feed + 1]] + 1] = True
    cut[offs] = True
    return np.flatnonzero(cut)


def wide_spaces(buf: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    out = []
    for lead, rests in _WIDE.items():
        at = np.flatnonzero(buf == lead)
        for rest in rests if len(at) else ():
            inside = at[at + len(rest) < len(buf)]
            same = np.ones(len(inside), bool)
            for i, x in enumerate(rest, 1):
                same &= buf[inside + i] == x
            out.append(inside[same])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_PARTS, kept_bytes: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept, self.kept_bytes, self.letters = kept, kept_bytes or KEPT_BYTES, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = 0  # of all parts kept
        self.ids, self.begin = array("I"), array("q", [0, 0])  # place i: ids[begin[i] : begin[i + 1]]; place 0 has none

    def held(self) -> int:
        """Bytes of the table, about."""
        return 150 * len(self.places) + self.chars + 4 * len(self.ids)

    def _place(self, ids) -> int:
        self.ids.extend(ids)
        self.begin.append(len(self.ids))
        return len(self.begin) - 2

    def _ask(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, parts: list[str]) -> None:
        """Gives parts not seen before their places."""
        latin = [p for p in parts if _LATIN.fullmatch(p)]
        forms = "\n".join(latin).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[10])) if latin else []
        model, ids, ends, at = self.tokenizer.model.tokenize, [], [], len(self.ids)
        for form in forms:
            ids += [t.id for t in model(form)]
            ends.append(at + len(ids))
        others = [p for p in parts if not _LATIN.fullmatch(p)] if len(latin) < len(parts) else []
        for p in others:
            ids += self._ask(p)
            ends.append(at + len(ids))
        self.chars += sum(map(len, parts))
        self.places.update(zip(latin + others, range(len(self.begin) - 1, len(self.begin) - 1 + len(parts))))
        self.ids.extend(ids)
        self.begin.extend(ends)

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts one after another, and where each text's ids begin (one more at the end); null is empty."""
        ids, first = [], [np.zeros(1, np.int64)]
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for i, j, buf, offs in text_slices(batch, size=SLICE):
            if not len(buf):
                first.append(np.full(j - i, first[-1][-1]))
                continue
            found, ends = self._slice(texts.slice(i, j - i), buf, offs)
            ids.append(found)
            first.append(first[-1][-1] + ends)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(first)

    def _slice(self, texts: pa.Array, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and where each text's ids end."""
        if len(self.places) > self.kept or self.held() > self.kept_bytes:
            self._forget()
        whole = np.zeros(len(texts), bool)
        for s in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        whole[np.searchsorted(offs, wide_spaces(buf), "right") - 1] = True
        at = cuts(buf, offs)
        first = np.searchsorted(at, offs)  # each text's first part
        parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buf))
        coded = parts.dictionary_encode()
        get = self.places.get
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter((get(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            words = [distinct[i] for i in new.tolist()]
            self._add(words)
            found[new] = [get(p) for p in words]
        place = found[coded.indices.to_numpy()]
        kept = len(self.begin), len(self.ids)
        for i in np.flatnonzero(whole).tolist():  # their ids are not kept
            place[first[i] : first[i + 1]] = 0
            place[first[i]] = self._place(self._ask(texts[i].as_py()))
        begin = np.frombuffer(self.begin, np.int64)
        n = begin[place + 1] - begin[place]
        ends = np.cumsum(n)
        where = np.arange(ends[-1], dtype=np.int32)
        where += np.repeat((begin[place] - (ends - n)).astype(np.int32), n)
        out = np.frombuffer(self.ids, np.uint32)[where]
        del begin
        if whole.any():
            del self.begin[kept[0] :], self.ids[kept[1] :]
        return out, np.append(0, ends)[first[1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, first = self.encode_arrow(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:])]

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_arrow, with an end id after each text."""
        ids, first = self.encode_arrow(texts)
        return np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first))


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, kept_bytes: int | None = None) -> Encoder:
    """One encoder for each worker process, file and size of table (else KEPT_BYTES)."""
    if (path, kept_bytes) not in _encoders:
        _encoders[path, kept_bytes] = Encoder(path, kept_bytes=kept_bytes)
    return _encoders[path, kept_bytes]


def gathered(batches, size: int = 1 << 22):
    """Batches put together to about ``size`` bytes, so that more of their parts coincide."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]
