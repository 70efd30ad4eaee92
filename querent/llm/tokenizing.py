"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

A text may be cut where the tokenizer itself always cuts, so pieces are encoded once and looked up after
that; texts in which a cut could change the result are encoded whole. The ids equal Tokenizer.encode's.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from array import array
from collections import defaultdict
from itertools import count, islice


#: Pieces in one generation of the cache; two generations are kept, and used pieces move to the newer.
CACHE_PIECES = 500_000
#: Longer pieces are not kept.
CACHE_LENGTH = 48

#: White space other than a space and a line feed, as Python sees it (more than the tokenizers do).
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NOT_SPACE_EVERYWHERE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case doesn't depend on their neighbours and that never combine.
_UNUSUAL = re.compile("[\u0130\u0180-\U0010ffff]")


#: Letters and then ASCII signs other than an apostrophe.
_LETTERS_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others
    follow from U+0100 on in order. A line feed is left out, as it divides words here."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 0x0A}


class Encoder:
    """encode_batch(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    leading_space: the tokenizer keeps white space and joins one space to the word after it (byte-level
    BPE); otherwise white space is dropped (word BPE). add_special_tokens is always off.
    """

    def __init__(self, path: str, leading_space: bool, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.leading_space, self.cache_pieces = leading_space, cache_pieces
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        mark = self.model.encode("\0".translate(self.letters), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # no word of letters and signs holds it
        self.lower_case = not leading_space and self._whole("ABCÉ") == self._whole("abcé")
        letters = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and (not self.lower_case or c.lower() == c))
        self.usual = re.compile(f"[{letters}]+").fullmatch
        self._restart({}, [])
        self.older: dict[str, int] = {}
        self.older_ids: list[bytes] = []
        self.signs: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # no cycles here, and many objects to look through
        try:
            return self._encode_batch(texts)
        finally:
            if collects:
                gc.enable()

    def _restart(self, known: dict[str, int], ids: list[bytes]) -> None:
        """known numbers pieces as they are looked up; ids has the ids of each number."""
        self.known: defaultdict[str, int] = defaultdict(count(len(ids)).__next__, known)
        self.ids = ids

    def _encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.cache_pieces:
            self.older, self.older_ids = dict(self.known), self.ids
            self._restart({}, [])
        known, ids, older, older_ids = self.known, self.ids, self.older, self.older_ids
        before = len(known)
        numbers = [list(map(known.__getitem__, self._pieces(t or ""))) for t in texts]
        new = list(islice(reversed(known), len(known) - before))  # the last ones that were numbered
        new.reverse()
        if new:
            olds = list(map(older.get, new))
            fresh = self._encode_pieces([p for p, k in zip(new, olds) if k is None] if older else new)
            ids += [fresh[p] if k is None else older_ids[k] for p, k in zip(new, olds)]
            for w in fresh.keys() - known.keys():
                known[w]  # numbers it
                ids.append(fresh[w])
        out = [b"".join(map(ids.__getitem__, n)) for n in numbers]
        for p in new:
            if len(p) > CACHE_LENGTH:
                ids[known.pop(p)] = b""
        return out

    def forget(self, keep: int = 250_000) -> None:
        """Frees memory between tasks; pieces that came first are the frequent ones and stay."""
        ids = self.ids[: min(keep, self.cache_pieces // 2)]
        self._restart({p: n for p, n in islice(self.known.items(), len(ids)) if n < len(ids)}, ids)
        self.older, self.older_ids = {}, []
        with contextlib.suppress(OSError, AttributeError):  # what was freed goes back to the system where it can
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Pieces of plain letters, maybe with signs after them, are divided as the tokenizer
        divides them: the words of many pieces go to its model in one text, with a mark after each, and signs follow
        their word's ids. Words that only stood with signs so far are given as well."""
        import numpy as np

        space = " " if self.leading_space else ""
        known, ids, older, older_ids = self.known, self.ids, self.older, self.older_ids
        done = len(ids)  # pieces with this number or a larger one have no ids yet
        out: dict[str, bytes] = {}
        words, signed, rest = [], [], pieces
        if self.mark is not None:
            rest, mixed = [], not self.lower_case
            usual = lambda w: w.isascii() and (mixed or w.islower()) or self.usual(w)
            for p in pieces:
                if p.isalpha():
                    (words if usual(p) else rest).append(p)
                elif len(p) <= CACHE_LENGTH and (m := _LETTERS_SIGNS(p)) and usual(m[1]):
                    signed.append((p, m[1], m[2]))
                else:
                    rest.append(p)
            if signed:
                words += {w for _, w, _ in signed}.difference(words, known, older)
        if words:
            # ASCII stands for itself in the vocabulary, but for the space and the mark
            between, texts = "\n\0\n".translate(self.letters) + space.translate(self.letters), []
            for i in range(0, len(words), 1000):
                some = words[i : i + 1000]
                text = between.join(some)
                if not text.isascii() and not "".join(some).isascii():
                    text = between.join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some])
                texts.append(between[3:] + text + between[:2])
            found = np.concatenate([np.frombuffer(array("I", e.ids), dtype="<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
            ends = 4 * np.flatnonzero(found == self.mark)
            raw = found.tobytes()
            out.update(zip(words, [raw[i:j] for i, j in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]))
        if signed:
            if len(self.signs) > self.cache_pieces // 10:
                self.signs.clear()
            for signs in {x for _, _, x in signed}.difference(self.signs):
                self.signs[signs] = array("I", self._whole(signs)).tobytes()
            signs_ids = self.signs
            for p, w, x in signed:
                own = out.get(w)
                if own is None:
                    k = known.get(w, done)
                    own = ids[k] if k < done else older_ids[older[w]]
                out[p] = own + signs_ids[x]
        if rest:
            encoded = self.tokenizer.encode_batch_fast([self._text(p) for p in rest], add_special_tokens=False)
            out.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, encoded))
        return out

    def _pieces(self, text: str) -> list[str]:
        """The text in pieces that are encoded apart; a piece stands for _text(piece)."""
        if any(s in text for s in self.special):
            return ["  " + text]
        if not self.leading_space:
            if _NOT_SPACE_EVERYWHERE.search(text):
                return ["  " + text]
            return (text.lower() if self.lower_case and (text.isascii() or not _UNUSUAL.search(text)) else text).split()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            return ["  " + text]  # runs of white space are divided by what stands around them
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "  " + pieces[0]
        return pieces

    def _text(self, piece: str) -> str:
        """Pieces hold no spaces; two mark one that is taken as it is, and others but for new lines follow a space."""
        if piece.startswith("  "):
            return piece[2:]
        return " " + piece if self.leading_space and not piece.startswith("\n") else piece


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, leading_space: bool, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder per Python worker, vocabulary file and size of cache."""
    key = (path, leading_space, cache_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
