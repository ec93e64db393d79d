"""Exact, fast use of a public tokenizer on whole texts: a text is cut only where the tokenizer itself always cuts, and pieces that recur are looked up.

A piece's ids do not depend on its neighbours, so the ids of a text are the joined ids of its pieces. Texts for which that does not hold
(odd white space, special strings, long runs of spaces) go to the tokenizer whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np

from isoline.llm.common import held

ODD_ASCII = ("<|", *"\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = re.compile(r"[ \n]{3}|[ \n]{2}\Z")
#: a stop or comma after another mark: the tokenizer may take the two together
GLUED = re.compile(r"[.,](?<=[^\w \n].|_.)")
#: the ASCII marks but the apostrophe, which may start an ending such as 's; and Latin letters with such marks after them
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARKED = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[{re.escape(MARKS)}]+")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _latin(text: str) -> bool:
    """No character beyond Latin-1: lower case is then one character for one, and nothing is there to normalise."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """Ids of texts, through a bounded table of pieces.

    drops_space: the tokenizer drops white space (pieces are what stands between spaces and line ends); else a piece starts with its space.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.drops_space = self.tok.encode("a b", add_special_tokens=False).ids == self.tok.encode("a\n  b", add_special_tokens=False).ids
        self.limit, self.ids, self.older = limit // 2, {}, {}
        #: does neither case nor a space before a stop or comma change the ids?
        same = lambda a, b: self.tok.encode(a, add_special_tokens=False).ids == self.tok.encode(b, add_special_tokens=False).ids
        self.folds = self.drops_space and same("A\u00c0\u00de. b,c", "a\u00e0\u00fe . b ,c")
        #: ids that end a pre-token, for tokenizers that mark word ends
        self.ends = np.array([str(self.tok.id_to_token(i)).endswith("</w>") for i in range(self.tok.get_vocab_size())]) if self.drops_space else None
        #: are marks one pre-token, apart from the letters before them?
        self.parts = self.drops_space and self.ends[self.tok.encode("a" + MARKS, add_special_tokens=False).ids].sum() == 2

    def pieces(self, text: str) -> list[str] | None:
        """None: encode it whole."""
        if self.drops_space:  # white space and special strings inside a piece are then the tokenizer's own affair
            if self.folds and _latin(text):
                text = text.lower()
                if not GLUED.search(text):
                    text = text.replace(".", " .").replace(",", " ,")
            return text.replace("\n", " ").split(" ")
        if any(map(text.__contains__, ODD_ASCII)) or not text.isascii() and ODD.search(text) or RUNS.search(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _learn(self, cut: list[list[str] | None]) -> None:
        """Makes self.ids hold every piece. Two generations bound the table: pieces that were not met for one generation are forgotten."""
        every: set[str] = set()
        for x in cut:
            if x:
                every.update(x)
        if len(self.ids) > self.limit:
            self.older, self.ids = self.ids, {}
        ids, older = self.ids, self.older
        new = every.difference(ids)
        if older:
            again = new.intersection(older)
            ids.update(zip(again, map(older.__getitem__, again), strict=True))
            new -= again
        new = list(new)
        if self.drops_space and new:
            new = self._learn_words(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, e in zip(part, self.many(part, add_special_tokens=False), strict=True):
                ids[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _learn_words(self, new: list[str]) -> list[str]:
        """Learns words of Latin letters, marks after them or none, joined by spaces and encoded at once; the others are returned.

        A run of letters is one pre-token, marks after it are another, and the last id of a pre-token says that it ends, so the ids can be dealt out.
        """
        ids, plain, runs, rest = self.ids, [], [], []
        for w in new:
            if w.isalpha() and max(w) < "\u0100":
                plain.append(w)
                runs.append(1)
            elif self.parts and MARKED.fullmatch(w):
                plain.append(w)
                runs.append(2)
            else:
                rest.append(w)
        for at in range(0, len(plain), 1000):
            words, last = plain[at : at + 1000], np.cumsum(runs[at : at + 1000])
            got = np.array(self.many([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[got]) + 1)
            if len(ends) != last[-1]:
                rest += words
                continue
            raw, start = got.tobytes(), 0
            for w, stop in zip(words, ends[last - 1].tolist(), strict=True):
                ids[w] = raw[start:stop]
                start = stop
        return rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        self._learn(cut)
        get = self.ids.__getitem__
        return [b"".join(map(get, x)) if x is not None else self._whole(t) for x, t in zip(cut, texts, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encode(texts)]

    def _whole(self, text: str) -> bytes:
        i = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(i)}I", *i)


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker and file; its table lives until the worker is asked for another one."""
    return held(("encoder", path), lambda: PieceEncoder(path))
