"""Exact ids of whole texts from the tokenizers library, with a cache of chunks.

Both vocabularies never merge across the place before a blank that follows a
non-blank, so a text is cut there, each distinct chunk is encoded once by the
library, and the ids of a text are those of its chunks in order.  A chunk that
is a word of letters with punctuation behind it has the word's ids and then the
punctuation's, so the word is encoded once whatever follows it.  Arrow cuts the
texts of a batch, finds the distinct words and gathers the ids; Python looks
each distinct word up.  Texts in which blanks stand side by side, or that hold
control characters, are encoded as they are.  The cache is per worker process and bounded; it only saves work.  With
two generations, the young one when full becomes the old one, whose chunks move
to the young one again as they are met; with one, it is begun anew.

Rows of ids are little-endian unsigned 32-bit integers throughout.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass(frozen=True)
class Budget:
    """What a worker may hold: chunks (and as many plain words) of a generation, generations, characters at once."""

    chunks: int
    generations: int
    chars: int


#: Where encoding is all that a worker does, and where other stages' workers share an executor.
LARGE = Budget(600_000, 1, 2_000_000)
SMALL = Budget(150_000, 2, 500_000)
_TAIL = ".,!?;:"
_TOGETHER = 400
#: Whether C's unsigned integers are the ids' form.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def _odd(text: str) -> bool:
    """Whether blanks or line ends stand side by side, or anything else stands there that does not print."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return not text.replace("\n", "").isprintable()


def _bytes(ids) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class _Kept:
    """Ids by string, bounded: a young generation and, where the budget allows two, an old one."""

    def __init__(self, budget: Budget):
        self.budget = budget
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, names: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """What belongs to each of the distinct names; ``make`` gives that of the names not met yet."""
        found = list(map(self.young.get, names))
        new = [n for n, ids in zip(names, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.young) + len(new) > self.budget.chunks:
            self.old = self.young if self.budget.generations > 1 else {}
            self.young = {}
        if self.old:
            again = [n for n in new if n in self.old]
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new = [n for n in new if n not in self.old]
        made = make(new)
        self.young.update(made)
        known = self.young
        return [known[n] if ids is None else ids for n, ids in zip(names, found, strict=True)]


class Encoder:
    """encode() gives the ids of each text as bytes; ``size`` is the number of ids of the vocabulary."""

    def __init__(self, path: str, budget: Budget = LARGE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.budget = budget
        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        names = self.whole.get_vocab(with_added_tokens=False)
        self.word_ends = self.whole.normalizer is not None
        if not self.word_ends and self.whole.pre_tokenizer.__class__.__name__ != "ByteLevel":
            raise ValueError("neither of the two kinds of vocabulary known here")
        # A tokenizer of the same model for plain words only: for these the
        # library's own normalisation and pattern change nothing.
        self.plain = Tokenizer(self.whole.model)
        split = pre_tokenizers.WhitespaceSplit() if self.word_ends else pre_tokenizers.Split(" ", "merged_with_next")
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.mark = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.mark[i] = name.endswith("</w>") if self.word_ends else name.startswith("Ġ")
        # Plain words, and no ids for others; chunks that are no plain word with a tail; tails.
        self.stems, self.chunks, self.tails = _Kept(budget), _Kept(budget), _Kept(budget)

    def _whole(self, text: str) -> bytes:
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _plain(self, stems: list[str]) -> dict[str, bytes]:
        """The ids of plain words; for the byte-level kind of the blank and the word."""
        out: dict[str, bytes] = {}
        lead = "" if self.word_ends else " "
        groups = [stems[i:i + _TOGETHER] for i in range(0, len(stems), _TOGETHER)]
        found = self.plain.encode_batch_fast([lead + " ".join(g) for g in groups], add_special_tokens=False)
        for group, enc in zip(groups, found, strict=True):
            ids = np.array(enc.ids, "<u4")
            marks = np.flatnonzero(self.mark[ids])
            if len(marks) != len(group):  # not expected; then one by one
                out.update((w, self._whole(lead + w)) for w in group)
                continue
            cut = np.append(0, marks + 1) if self.word_ends else np.append(marks, len(ids))
            raw, at = ids.tobytes(), (cut * 4).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(group, at, at[1:], strict=False))
        return out

    def _stems(self, stems: list[str]) -> dict[str, bytes]:
        """The ids of new stems, none for a stem that is no plain word."""
        # Letters that the library's normalisation only lower-cases, one by one.
        if self.word_ends:
            plain = [s for s in stems if s.isalpha() and (s.isascii() or max(s) <= "\xff")]
            ids = self._plain(list({s.lower() for s in plain}))
            made = {s: ids[s.lower()] for s in plain}
        else:
            plain = [s for s in stems if s.isalpha()]
            made = self._plain(plain)
        if len(plain) < len(stems):
            made = dict.fromkeys(stems, b"") | made
        return made

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        asked = chunks if self.word_ends else [c if c[:1] == "\n" else " " + c for c in chunks]
        found = self.whole.encode_batch_fast(asked, add_special_tokens=False)
        return {c: _bytes(enc.ids) for c, enc in zip(chunks, found, strict=True)}

    def _tails(self, tails: list[str]) -> dict[str, bytes]:
        return {t: self._whole(t) for t in tails}

    def _chunked(self, text: str) -> str:
        """The text with one blank between any two of its chunks."""
        if self.word_ends:
            return text.replace("\n", " ").strip(" ")
        # "\nWord" stands for a line's first word; the text's first
        # chunk is written as one, and the id of its line end dropped.
        return "\n" + text.replace("\n", " \n")

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [_odd(t) for t in texts]
        lines = pa.array([self._chunked(t) for t, o in zip(texts, odd, strict=True) if not o], pa.large_string())
        parts = pc.split_pattern(lines, " ")
        coded = parts.values.dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy()
        trimmed = pc.ascii_rtrim(chunks, _TAIL)
        stems = trimmed.dictionary_encode()
        ids = self.stems.find(_strings(stems.dictionary), self._stems)
        stem_at = stems.indices.to_numpy()
        plain = np.fromiter(map(len, ids), np.int64, len(ids))[stem_at] > 0
        # Other chunks are looked up whole.
        others = self.chunks.find(_strings(chunks.filter(pa.array(~plain))), self._chunks)
        first = stem_at.astype(np.int64)
        first[~plain] = len(ids) + np.arange(len(others))
        ids += others
        # The tails of plain ones; where there is none, no ids.
        ends = (pc.binary_length(chunks).to_numpy() - pc.binary_length(trimmed).to_numpy()) * plain
        second = np.full(len(chunks), len(ids))
        ids.append(b"")
        ended = np.flatnonzero(ends)
        tails = [c[-n:] for c, n in zip(_strings(chunks.take(pa.array(ended))), ends[ended].tolist(), strict=True)]
        place = {t: len(ids) + i for i, t in enumerate(dict.fromkeys(tails))}
        second[ended] = [place[t] for t in tails]
        ids += self.tails.find(list(place), self._tails)
        # The ids of all chunks one after another, and where each text's begin.
        order = np.stack([first[at], second[at]], axis=1).ravel()
        every = pa.array(ids, pa.large_binary()).take(pa.array(order))
        offsets = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1)
        starts = offsets[2 * parts.offsets.to_numpy()].tolist()
        raw, skip = memoryview(every.buffers()[2] or b""), 0 if self.word_ends else 4
        bounds = zip(starts, starts[1:], strict=False)
        out = []
        for t, o in zip(texts, odd, strict=True):
            if o:
                out.append(self._whole(t))
            else:
                a, b = next(bounds)
                out.append(raw[a + skip:b].tobytes())
        return out


_ENCODERS: dict[tuple[str, Budget], Encoder] = {}


def encoder(path: str, budget: Budget = LARGE) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (path, budget) not in _ENCODERS:
        _ENCODERS[path, budget] = Encoder(path, budget)
    return _ENCODERS[path, budget]


def forget() -> None:
    """Free what this process's encoders hold, where no text is encoded any more."""
    _ENCODERS.clear()


def public(name: str) -> Callable[[], str]:
    """The place of a public vocabulary file, looked up where it is used."""

    def place() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return place
