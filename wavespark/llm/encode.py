"""Token ids by public tokenizers, with each distinct word encoded once.

A tokenizer of the tokenizers library cuts a text before it merges. Where a cut is certain, a text
is cut here, cheaply, and the ids of a part are kept: words repeat, so most parts are found. A part
that is a word of ASCII or Latin letters is one piece for the merges, so such parts go to the
library's model many at a time, past its slower cutting; other new parts go to the whole
tokenizer. A text whose white space makes the cuts uncertain, or that has an added token such as
`<|endoftext|>` in it, goes there uncut. Ids come as bytes, unsigned 32-bit little-endian.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .common import held

#: Parts kept for a whole process, with spaces and without; beyond those, new parts are kept for one group of texts.
ROOM = {True: 900_000, False: 300_000}

#: Bytes of text that are cut and looked up together, with spaces and without.
GROUP = {True: 8_000_000, False: 4_000_000}

#: White space other than single spaces and line ends: one byte, and in UTF-8 more.
_CONTROLS = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_ODD = re.compile(b"[" + _CONTROLS + b"]|" + b"|".join(_WIDE))

#: A line end or none, letters, ASCII signs or none. Letters: ASCII, Latin-1 and Latin Extended-A, in UTF-8, without
#: the two signs among them and without U+0130, whose lower case is two characters.
_FORM = re.compile(
    b"(\n?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+)([!-/:-@\\[-`{-~]*)"
)

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Known(dict):
    """The number of each part; a new part gets the next one and is noted."""

    def __init__(self):
        self.count, self.new = 0, []

    def __missing__(self, part: bytes) -> int:
        n = self[part] = self.count
        self.count = n + 1
        self.new.append(part)
        return n


class _Encoder:
    """before: what stands before a word's letters as the model sees it; after: what ends them.

    Part n has the ids flat[start[n] : start[n] + size[n]].
    """

    before, after = "", ""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: Added tokens, which the library finds in a text before it cuts it; in any case, since words are cut in lower case.
        self.added = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.model.normalizer = None
        sizes = {i: len(t) for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.sizes = np.zeros(max(sizes) + 1, dtype=np.int64)
        self.sizes[list(sizes)] = list(sizes.values())
        self.letters = {k: v for k, v in byte_letters().items() if k != 32}
        self.known = _Known()
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        # Parts that only others are made of: nothing, and a line end.
        self.nothing, self.line = self.known[b"\0nothing"], self.known[b"\0line"]
        self.known.new.clear()
        self._store(np.array([self.line]), *self._whole(["\n"]))

    def whole(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self._whole(texts)
        ends, data = (4 * np.cumsum(sizes)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, one after another, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _words(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _whole, of parts that are words of letters: pieces of the model are as long as their letters."""
        table, before, form, ids, sizes = self.letters, self.before, self.form, [], []
        for at in range(0, len(parts), 5000):
            line = " ".join([form(p[1:]) if p[0] == 32 else before + form(p) for p in parts[at : at + 5000]]).translate(table)
            got = np.array(self.model.encode(line, add_special_tokens=False).ids, dtype="<u4")
            words = line.split(" ")
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + len(self.after))
            ids.append(got)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.sizes[got]), ends) + 1, prepend=0))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _store(self, parts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of these parts."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known.count > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[parts] = self.used + np.cumsum(sizes) - sizes
        self.size[parts] = sizes
        self.used += len(ids)

    def _gather(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after another, and how many each has."""
        sizes = self.size[parts]
        place = np.repeat(self.start[parts] - (np.cumsum(sizes) - sizes), sizes)
        place += np.arange(len(place))
        return self.flat[place], sizes

    def _learn(self, new: list[bytes]) -> set[int]:
        """Finds the ids of new parts; the numbers of those that are odd, which have none.

        A part is a word, or a line end, a word and ASCII signs, each a token's bound, or else.
        """
        known, match = self.known, _FORM.fullmatch
        begin = known.count - len(new)
        odd = {n for n, p in enumerate(new, begin) if self.odd(p)} if self.some_odd(new) else set()
        words, rest, made, lines = ([], []), ([], []), [], []
        for n, p in enumerate(new, begin):
            if p.isalpha():
                words[0].append(p)
                words[1].append(n)
            elif (m := match(p)) is None:
                if n not in odd:
                    rest[0].append(p)
                    rest[1].append(n)
            else:
                line, word, signs = m.groups()
                if line or signs:
                    made.append(n)
                    lines.append(self.line if line else self.nothing)
                    lines.append(known[self.bare(word) if line else word])
                    lines.append(known[self.bare(signs)] if signs else self.nothing)
                else:
                    words[0].append(p)
                    words[1].append(n)
        for n, p in enumerate(known.new[len(new) :], begin + len(new)):  # words and signs that parts above are made of
            kind = words if match(p.removeprefix(b" ")) else rest
            kind[0].append(p)
            kind[1].append(n)
        self._store(np.array(words[1], dtype=np.int64), *self._words(words[0]))
        self._store(np.array(rest[1], dtype=np.int64), *self._whole([self.text(p) for p in rest[0]]))
        ids, sizes = self._gather(np.array(lines, dtype=np.int64))
        self._store(np.array(made, dtype=np.int64), ids, sizes.reshape(-1, 3).sum(axis=1))
        return odd

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > GROUP[bool(self.before)]:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some) if some else out

    def _some(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        count, used = known.count, self.used
        special = {i for i, t in enumerate(texts) for low in (t.lower(),) if any(a in low for a in self.added)}
        cut = [[] if i in special else self.cut(t) for i, t in enumerate(texts)]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        parts = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        new = list(known.new)
        odd = self._learn(new) if new else set()
        bounds = np.cumsum(n)
        ids, sizes = self._gather(parts)
        ends = (4 * np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], bounds])]).tolist()
        data = ids.tobytes()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        if odd or special:
            own = np.repeat(np.arange(len(texts)), n)
            uncut = sorted(special.union(own[np.isin(parts, list(odd))].tolist()))
            for i, ids in zip(uncut, self.whole([texts[i].decode() for i in uncut]), strict=True):
                out[i] = ids
        if count > ROOM[bool(self.before)]:
            for p in known.new:
                del known[p]
            known.count, self.used = count, used
        elif odd:
            for p in known.new:
                if known[p] in odd:
                    del known[p]
        known.new.clear()
        return out

    def bare(self, part: bytes) -> bytes:
        """The part's name where no space stands before it."""
        return part

    def some_odd(self, parts: list[bytes]) -> bool:
        return False

    def odd(self, part: bytes) -> bool:
        return False

    def form(self, part: bytes) -> str:
        """A word's bytes as characters of one byte each, as the model takes them."""
        return part.decode("latin-1")


class _Spaced(_Encoder):
    """Byte-level BPE whose words take the space before them along."""

    before = "Ġ"

    def cut(self, text: bytes) -> list[bytes]:
        parts = text.replace(b"\n", b" \n").split(b" ")
        if parts[0][:1] not in (b"", b"\n"):
            parts[0] = b" " + parts[0]  # marks a part without a space before it
        elif not parts[0]:
            del parts[0]
        return parts

    def text(self, part: bytes) -> str:
        if part[:1] == b" ":
            return part[1:].decode()
        return part.decode() if part[:1] == b"\n" else " " + part.decode()

    def bare(self, part: bytes) -> bytes:
        return b" " + part

    def some_odd(self, parts: list[bytes]) -> bool:
        every = b"|".join(parts)
        return b"" in parts or b"\n" in parts or len(every.translate(None, _CONTROLS)) < len(every) or any(w in every for w in _WIDE)

    def odd(self, part: bytes) -> bool:
        """Whether runs of white space, or any but spaces and line ends, touch the part."""
        return part in (b"", b"\n") or _ODD.search(part) is not None


class _Words(_Encoder):
    """BPE over lower-case words; white space only separates."""

    after = "</w>"

    def cut(self, text: bytes) -> list[bytes]:
        return text.lower().split()

    def text(self, part: bytes) -> str:
        return part.decode()

    def form(self, part: bytes) -> str:
        return part.decode("latin-1") if part.isascii() else part.decode().lower().encode().decode("latin-1")


def encoder(path: str, spaced: bool) -> _Encoder:
    """The encoder of a file, one a process. spaced: byte-level with spaces, else words."""
    return held("encoder", path, lambda: (_Spaced if spaced else _Words)(path))
