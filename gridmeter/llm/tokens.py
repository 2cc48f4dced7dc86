"""Token ids of whole texts by a public byte-level BPE tokenizer, with a cache of the pieces texts are made of."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by a Python worker, and bytes for each of them on average.
CACHE, LONG = 600_000, 64
#: Bytes of the batches whose texts are encoded together: the more, the fewer look-ups start anew.
GROUP = 16 << 20
#: Pieces given to the tokenizer as one text, and pieces whose ids are laid out at once.
WORDS, STEP = 100, 1 << 18
#: Pieces that are one word to the tokenizer's own pattern, so that its model can take them as they are.
_WORD = r"^ ?(\pL+|[0-9]+|[!-/:-@\[-`{-~]+)$"
_BLANK, _LINE, _WHITE, _ALNUM, _MARK, _LEAD = range(1, 7)


def _kinds() -> bytes:
    out = bytearray(256)
    for i in range(128):
        c = chr(i)
        out[i] = _ALNUM if c.isalnum() else _WHITE if c.isspace() else _MARK if 32 < i < 127 else 0
    out[ord(" ")], out[ord("\n")] = _BLANK, _LINE
    # First bytes of the white space beyond ASCII.
    for i in (0xC2, 0xE1, 0xE2, 0xE3):
        out[i] = _LEAD
    return bytes(out)


def _shown() -> np.ndarray:
    """How byte-level BPE spells bytes: printable Latin-1 as it is, the others from U+0100 on."""
    out = np.arange(256, dtype="<u2")
    rest = [b for b in range(256) if b not in (*range(33, 127), *range(161, 173), *range(174, 256))]
    out[rest] = 256 + np.arange(len(rest))
    return out


_KIND, _SHOWN = _kinds(), _shown()


class Encoder:
    """Ids of many texts at once. Equal to encoding every text as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text that spells a special token is ordinary text
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.reset()

    def reset(self) -> None:
        # The empty piece stands for the end of a text.
        self.pieces, self.flat = pa.array([""]), np.zeros(1, dtype=np.uint32)
        self.size, self.begin, self.seen = np.ones(1, dtype=np.int32), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def forget(self) -> None:
        """Keep the pieces that were seen again, at most half of the cache."""
        seen = self.seen > max(1, np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2])
        seen[0] = True
        keep = np.flatnonzero(seen)
        self.flat = self.flat[np.repeat(seen, self.size)]
        self.pieces, self.size, self.seen = self.pieces.take(pa.array(keep)), self.size[keep], self.seen[keep] // 2
        self.begin = np.cumsum(self.size, dtype=np.int32) - self.size

    def encode(self, texts: list[str] | pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by `end`, and how many each has."""
        if len(self.pieces) > CACHE or self.pieces.nbytes > CACHE * LONG:
            self.forget()
        pieces, first = split(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        if len(new):
            at = at.copy()
            found = pieces.take(pa.array(new)).dictionary_encode()
            at[new] = self._learn(found.dictionary)[found.indices.to_numpy()]
        if end is not None:
            self.flat[0] = end
            at = np.insert(at, first[1:], 0)
            first = first + np.arange(len(first))
        self.seen += np.bincount(at, minlength=len(self.seen))
        ends = np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        for lo in range(0, len(at), STEP):
            part = at[lo : lo + STEP]
            size, to = self.size[part], out[ends[lo] : ends[lo + len(part)]]
            shift = self.begin[part] - (ends[lo : lo + len(part)] - ends[lo]).astype(np.int32)
            np.take(self.flat, np.repeat(shift, size) + np.arange(len(to), dtype=np.int32), out=to, mode="clip")
        return out, ends[first[1:]] - ends[first[:-1]]

    def _learn(self, pieces: pa.StringArray) -> np.ndarray:
        """Numbers of pieces that were not known."""
        is_word = pc.match_substring_regex(pieces, _WORD)
        word = is_word.to_numpy(zero_copy_only=False)
        found = self._word_ids(pieces.filter(is_word))
        if found is None:
            word, found = np.zeros(len(pieces), dtype=bool), (np.zeros(0, np.uint32), np.zeros(0, np.int32))
        rest = pieces.filter(pa.array(~word))
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(rest.to_pylist(), add_special_tokens=False)]
        size = np.concatenate([found[1], np.fromiter(map(len, whole), dtype=np.int32, count=len(whole))])
        flat = np.fromiter(chain.from_iterable(whole), dtype=np.uint32)
        before = len(self.pieces)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size, dtype=np.int32) - size])
        self.pieces = pa.concat_arrays([self.pieces, pieces.filter(pa.array(word)), rest])
        self.flat, self.size = np.concatenate([self.flat, found[0], flat]), np.concatenate([self.size, size])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), dtype=np.int64)])
        return before + np.where(word, np.cumsum(word) - 1, int(word.sum()) + np.cumsum(~word) - 1)

    def _word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words, many to a text with blanks between, and how many each has: as many as spell its bytes. None if the
        vocabulary does not spell them."""
        offsets, data = _bytes(words)
        n = np.diff(offsets)
        shown = np.full(len(data) + len(words), ord(" "), dtype="<u2")
        shown[np.arange(len(data)) + np.repeat(np.arange(len(words)), n)] = _SHOWN[data]
        begin = offsets + np.arange(len(offsets))
        cuts = [*range(0, len(words), WORDS), len(words)]
        texts = [shown[begin[a] : begin[b] - 1].tobytes().decode("utf-16-le") for a, b in zip(cuts, cuts[1:], strict=False)]
        coded = self.words.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), dtype=np.uint32)
        spelled = np.cumsum(self.bytes[ids])
        last = np.searchsorted(spelled, offsets[1:])
        if len(last) and (last[-1] != len(ids) - 1 or (spelled[last] != offsets[1:]).any()):
            return None
        return ids, np.diff(last, prepend=-1).astype(np.int32)


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends, and the bytes of all."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of texts that can be encoded one by one, and the number of pieces before each text and at the end.

    A cut is where no id can reach across, whatever stands around: before a lone blank, around a lone line end, and before
    an ASCII mark behind an ASCII letter or digit. The tokenizer's own pattern starts a new word there."""
    offsets, data = _bytes(texts)
    n = len(data)
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND)), dtype=np.uint8)
    _widen(kind, data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        cut[1:n] = (kind[1:] == _MARK) & (kind[:-1] == _ALNUM)
        white = (kind >= _BLANK) & (kind <= _WHITE)
        lone = ~white
        lone[1:-1] = ~white[:-2] & ~white[2:]
        lone[0], lone[-1] = False, False
        cut[:n] |= lone & ((kind == _BLANK) | (kind == _LINE))
        cut[1:] |= lone & (kind == _LINE)
    cut[offsets] = True
    cut[n] = True
    at = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return pieces, np.searchsorted(at, offsets)


def _widen(kind: np.ndarray, data: np.ndarray) -> None:
    """Tell the bytes of white space beyond ASCII."""
    lead = np.flatnonzero(kind == _LEAD)
    if not len(lead):
        return
    a = data[lead]
    b, c = data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    three = (a == 0xE2) & general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    for found, size in ((lead[two], 2), (lead[three], 3)):
        for i in range(size):
            kind[found + i] = _WHITE


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """The two columns of several batches at a time, keys and texts."""
    held, size = [], 0

    def joined() -> tuple[pa.Array, pa.StringArray]:
        return tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
