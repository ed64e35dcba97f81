"""Token ids of texts by the tokenizers library, each distinct chunk of text being encoded once."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Ends every document.
END_ID = 2
#: Chunks a worker remembers; when there are more it forgets all and goes on, so this bounds memory, not results.
KNOWN_PIECES = 1_300_000

# Byte-level BPE first cuts a text into words, numbers, marks and white space; a single space belongs to what follows
# it. So some places are always cut, and what lies between them can be encoded on its own: around a line break that
# stands between visible characters, before a space unless white space is on both of its sides, and between a letter
# and a mark at the end of a chunk.
_CUTS = re.compile(r"(?<=\S)(?= )|(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)").split
_RARE_SPACE = re.compile(r"[^\S \n]").search
_SPACE = re.compile(r"\s").search
#: Chunks that go to the library as one text.
_TOGETHER = 100


def _plainly_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between visible characters."""
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
        or _RARE_SPACE(text)
    )


def _ends_in_mark(chunk: str) -> bool:
    return chunk[-1] in ".," and chunk[-2:-1].isalpha() and chunk[-2] < "\u0250"


class Encoder:
    """Encodes whole texts; the ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text that holds the string of an added token, as ``<|endoftext|>``, is encoded whole, as the library gives such
    a string its own id. Other texts are cut into chunks, whose ids are remembered: a word with the space before it,
    under the word; the first word of a line with the line break before it, under both.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # other pieces, as they are
        self.end = np.array([END_ID], "<u4").tobytes()
        self.marks = dict(zip(".,", self._ids([".", ","]), strict=True))
        self.line_break = self._ids(["\n"])[0]
        assert len(self.line_break) == 4

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _learn(self, chunks: Iterable[str]) -> None:
        """Remember the ids of chunks without inner white space, many of which the library gets as lines of one text."""
        known = self.known
        new = set(chunks).difference(known)
        ends = [c for c in new if _ends_in_mark(c)]
        if ends:
            new.difference_update(ends)
            new.update({c[:-1] for c in ends}.difference(known))
        listed = list(new)
        groups = [listed[i : i + _TOGETHER] for i in range(0, len(listed), _TOGETHER)]
        # every chunk begins with one line break: its own, or one before the space
        texts = ["".join([c if c[0] == "\n" else "\n " + c for c in g]) for g in groups]
        breaks = np.frombuffer(self.line_break, "<u4")[0]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            starts = 4 * np.flatnonzero(ids == breaks)
            raw, stops = ids.tobytes(), [*starts[1:].tolist(), 4 * len(ids)]
            for c, a, b in zip(group, starts.tolist(), stops, strict=True):
                known[c] = raw[a:b] if c[0] == "\n" else raw[a + 4 : b]
        for c in ends:
            known[c] = known[c[:-1]] + self.marks[c[-1]]

    def _oddly_spaced(self, text: str) -> bytes:
        pieces = [p for p in _CUTS(text) if p]
        words = [p[1:] if p[0] == " " and len(p) > 1 and not _SPACE(p, 1) else None for p in pieces]
        self._learn([w for w in words if w and w not in self.known])
        others = list({p for p, w in zip(pieces, words, strict=True) if not w and p not in self.odd})
        self.odd.update(zip(others, self._ids(others), strict=True))
        known, odd = self.known, self.odd
        return b"".join([known[w] if w else odd[p] for p, w in zip(pieces, words, strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids with the end id, as little-endian unsigned 32-bit integers; null is an empty text."""
        if len(self.known) + len(self.odd) > KNOWN_PIECES:
            self.known.clear()
            self.odd.clear()
        get = self.known.get
        out: list = []  # of a text its ids, or those of its chunks
        open_: list[tuple[int, list[str], list[int]]] = []  # texts with chunks that are not known: their places
        missing: list[str] = []
        collecting = gc.isenabled()
        gc.disable()  # the lists below are many and short-lived
        try:
            for text in texts:
                if not text:
                    out.append(b"")
                elif any(a in text for a in self.added):
                    out.append(self._ids([text])[0])
                elif _plainly_spaced(text):
                    chunks = ("\n" + text.replace("\n", " \n")).split(" ")
                    ids = list(map(get, chunks))
                    if None in ids:
                        places = [i for i, x in enumerate(ids) if x is None]
                        missing += [chunks[i] for i in places]
                        open_.append((len(out), chunks, places))
                        out.append(ids)
                    else:
                        out.append(b"".join(ids)[4:])  # the first chunk's line break is not the text's
                else:
                    out.append(self._oddly_spaced(text))
            self._learn(missing)
            known = self.known
            for at, chunks, places in open_:
                ids = out[at]
                for i in places:
                    ids[i] = known[chunks[i]]
                out[at] = b"".join(ids)[4:]
        finally:
            if collecting:
                gc.enable()
        return [x + self.end for x in out]


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(spec)


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's text (some MB), read on the driver so that executors need not have the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def text_list(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
