"""Token ids of whole texts, from a vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a lone space stands between two other characters, both vocabularies always start a new word.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: A space beside another white character isn't a lone one.
_BESIDE = (" \n", "\n ")
_WHITE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Nor are a lone line end and what is beside it.
_LINES = re.compile(r"\S+(?:\n\S+)+")
#: Letters and the marks after them are never in one token.
_MARKS = "!#$%&*+,.:;?|"
#: Up to here a letter is one to every version of Unicode and stays a single letter in lower case (the next one doesn't).
_LATIN = "\u012f"
#: Texts with white space beside white space or at an end, with other white space, or with a zero are encoded apart.
_ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[\0" + "".join(_WHITE) + "]"
#: About so many bytes of text are encoded together.
PART_BYTES = 4 << 20
#: So many words of letters alone are encoded as one text, spaces between them.
JOINED = 2_000
#: Words kept with their ids by each worker; the store starts anew when it is full.
STORE_WORDS = 1_000_000
#: Longer words aren't kept.
STORE_CHARS = 48


class Encoder:
    """Encodes texts word by word, so that a repeated word is encoded once.

    Ids are held as little-endian unsigned integers of ``dtype``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab()
        #: Whether white space is dropped, and words are told apart by their last token instead of their first one.
        self.closed = bool(suffix)
        self.bounds = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.bounds[[i for t, i in vocab.items() if (t.endswith(suffix) if suffix else t.startswith("Ġ"))]] = True

    def _learn(self, words: set[str]) -> None:
        """Words are cut into lines, and these into letters and the marks after them: the parts repeat more often than what
        they make up. The first word of a text or line has no space before it."""
        known = self.words
        new: dict[str, None] = {}
        marked: list[str] = []
        letters: list[str] = []
        marks: list[str] = []
        cut: dict[str, list[str]] = {}
        for w in words:
            if w.isalpha():
                new[w] = None
                continue
            stem = w.rstrip(_MARKS)
            if stem.isalpha() and stem[-1] <= _LATIN:
                marked.append(w)
                letters.append(stem)
                marks.append("\0" + w[len(stem) :])
                continue
            parts = cut[w] = []
            for n, line in enumerate(w.split("\n") if "\n" in w and _LINES.fullmatch(w) else (w,)):
                if n:
                    parts.append("\n\n")
                    line = "\0" + line
                stem = line.rstrip(_MARKS)
                if stem and stem != line and stem[-1] <= _LATIN and stem[-1].isalpha():
                    parts += (stem, "\0" + line[len(stem) :])
                else:
                    parts.append(line)
        new |= dict.fromkeys(set(letters).union(marks, *cut.values()).difference(known))
        plain = [p for p in new if p.isalpha() or (self.closed and p[1:].isalpha() and p[0] == "\0")]
        for at in range(0, len(plain), JOINED):
            self._joined(plain[at : at + JOINED])
        self._apart([p for p in new if p not in known])
        for w, stem, after in zip(marked, letters, marks, strict=True):
            known[w] = known[stem] + known[after]
        for w, ps in cut.items():
            if len(ps) > 1:
                known[w] = b"".join([known[p] for p in ps])

    def _joined(self, parts: list[str]) -> None:
        """Each of these words of letters is at least one word to the vocabulary; if as many come out as went in, each is one."""
        text = " " + " ".join([p.lstrip("\0") for p in parts] if self.closed else parts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(self.bounds[ids]) + int(self.closed)
        if len(cuts) != len(parts):
            self._apart(parts)
            return
        cuts = (np.insert(cuts, 0, 0) if self.closed else np.append(cuts, len(ids))) * self.dtype.itemsize
        raw, cuts = ids.tobytes(), cuts.tolist()
        self.words.update(zip(parts, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def _apart(self, parts: list[str]) -> None:
        texts = ["\n" if p == "\n\n" else p[1:] if p[:1] == "\0" else " " + p for p in parts]
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.words[p] = array(self.code, e.ids).tobytes()

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """For each text its ids, as bytes. Parts of about ``PART_BYTES`` of text are encoded together."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        before = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            size = max(1, int(np.searchsorted(before, before[at] + PART_BYTES)) - at)
            out += self._encode_part(texts.slice(at, size))
        return out

    def _encode_part(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        regular = iter(self._regular(texts.filter(pa.array(~odd))))
        others = iter(self._others(texts.filter(pa.array(odd)).to_pylist()))
        return [next(others) if o else next(regular) for o in odd.tolist()]

    def _known(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > STORE_WORDS:
            self.words, new = {}, words
        if new:
            self._learn(new)

    def _regular(self, texts: pa.Array) -> list[bytes]:
        """Of texts whose words stand apart by lone spaces or line ends. Each distinct word is an optional line end, a stem and the
        marks after it; only distinct stems and marks are looked up, the rest is arithmetic on their places."""
        if not len(texts):
            return []
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        places = lists.flatten().dictionary_encode()
        words = places.dictionary
        line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        words = pc.replace_substring_regex(words, "^\n", "\0") if line.any() else words
        stems = pc.ascii_rtrim(words, characters=_MARKS)
        cut = pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        ends = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        plain = np.array([e != "" and e <= _LATIN and e.isalpha() for e in _strings(ends.dictionary)], dtype=bool)
        cut &= plain[ends.indices.to_numpy()] if len(plain) else False
        stems = pc.if_else(pa.array(cut), stems, words).dictionary_encode()
        own, after = _strings(stems.dictionary), {"": 0}
        at = np.flatnonzero(cut)
        marks = np.zeros(len(words), dtype=np.int64)
        lengths = pc.utf8_length(stems.dictionary).to_numpy()[stems.indices.to_numpy()[at]].tolist()
        marks[at] = [after.setdefault("\0" + w[n:], len(after)) for w, n in zip(_strings(words.take(pa.array(at))), lengths, strict=True)]
        del after[""]
        self._known({*own, *after, "\n\n"})
        parts = [b"", self.words["\n\n"], *map(self.words.__getitem__, own), b"", *map(self.words.__getitem__, after)]
        chosen = np.stack([line.astype(np.int64), stems.indices.to_numpy() + 2, marks + 2 + len(own)], axis=1)
        flat = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        flat, sizes = _gathered(flat, size, chosen.ravel())
        ids, sizes = _gathered(flat, sizes.reshape(-1, 3).sum(axis=1), places.indices.to_numpy())
        cuts = (np.append(0, np.cumsum(sizes))[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        self._forget(own)
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _others(self, texts: list[str]) -> list[bytes]:
        split = [_words(text) for text in texts]
        seen = set().union(*split)
        self._known(seen)
        ids = [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        self._forget(seen)
        return ids

    def _forget(self, words: Iterable[str]) -> None:
        for w in words:
            if len(w) > STORE_CHARS or "\n" in w:
                self.words.pop(w, None)


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()  # in one go, which to_pylist isn't


def _gathered(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, which have these sizes, in the order chosen; and their sizes."""
    starts, own = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + own, own) + np.arange(total)], own


def _words(text: str) -> list[str]:
    """``text`` cut before each lone space; after the first, words stand for themselves with a space before them."""
    if not text:
        return []
    if "\0" in text:
        return ["\0" + text]
    words = text.split(" ")
    if "" in words or any(x in text for x in _BESIDE) or any(x in text for x in _WHITE):
        words = _GAP.split(text)
    words[0] = "\0" + words[0]
    return words


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each vocabulary file and worker process."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """The place of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
