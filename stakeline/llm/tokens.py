"""Token ids of whole texts by a tokenizer file, with a memory of pieces seen before."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Strings of a generation of a worker's memory, which holds two (a text may add some).
SEEN = 200_000
# Characters encoded at once.
CHARS = 2 << 20
# What regular expressions of the tokenizers library call white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Stands between pieces in texts that don't hold it.
MARK = "\x1f"

_spaced = f"[{SPACE}] "
_to_space = f"([^{SPACE}])([{SPACE}])"
_piece = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# Words end between a letter and a mark that starts none of "'s", "'t" and so on.
_letter_mark = r"([A-Za-z])([!-&(-/:-@\[-`{-~])"

# The words of the public tokenizers' patterns, for texts of plain Latin letters.
_letter = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_latin = re.compile(f"[\\x00-\\x7f{_letter}]*")
_blank = "\t-\r "
_spaced_words = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_letter}]+| ?[0-9]+| ?[^{_blank}{_letter}0-9]+|[{_blank}]+(?![^{_blank}])|[{_blank}]+"
)
_stripped = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letter}]+|[0-9]|[^{_blank}{_letter}0-9]+")


@cache
def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it shows, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def public_tokenizer(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode`` gives the ids that the tokenizers library gives for the whole text.

    Byte-pair tokenizers first cut a text into words, and no word reaches from a character into the
    white space after it, or from an ASCII letter into an ASCII mark. So texts are cut there, many at
    once, and the ids of pieces seen before are looked up. New pieces are cut into words as the library
    cuts them, and the library's model merges the words not seen before. With
    ``strip`` the tokenizer drops white space, and pieces lose the spaces between them.
    """

    def __init__(self, path: str, strip: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.strip = strip
        # Ids of pieces and of words (a word is a piece too): used lately, and before that.
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pieces(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text."""
        if self.strip:
            return pc.split_pattern(pc.replace_substring_regex(texts, _letter_mark, r"\1 \2"), " ")
        marked = pc.replace_substring(texts, " ", f"{MARK} ")
        spaced = pc.match_substring_regex(texts, _spaced)
        if pc.any(spaced).as_py():
            marked = pc.if_else(spaced, pc.replace_substring_regex(texts, _to_space, rf"\1{MARK}\2"), marked)
        cut = pc.split_pattern(pc.replace_substring_regex(marked, _letter_mark, rf"\1{MARK}\2"), MARK)
        held = pc.match_substring(texts, MARK)
        if pc.any(held).as_py():
            found = [_piece.findall(t) if h else None for t, h in zip(texts.to_pylist(), held.to_pylist())]
            cut = pc.if_else(held, pa.array(found, cut.type), cut)
        return cut

    def _words(self, piece: str) -> list[str]:
        """The words of a piece as the model takes them, by the library."""
        normalizer = self.tokenizer.normalizer
        text = normalizer.normalize_str(piece) if normalizer else piece
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word that the memory in use lacks; remembers it."""
        ids = self.before.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():
                shown = word.replace(" ", _byte_chars()[0x20])
            else:
                shown = word.encode().decode("latin-1").translate(_byte_chars())
            ids = self._ids(shown)
        self.seen[word] = ids
        return ids

    def _learn(self, new: Iterable[str]) -> None:
        """Ids, as bytes, of new pieces.

        Pieces of plain Latin letters, digits and ASCII marks are cut here as the library would.
        """
        seen, before = self.seen, self.before.get
        known, plain, cut = seen.get, _latin.fullmatch, (_stripped if self.strip else _spaced_words).findall
        for piece in new:
            ids = before(piece)
            if ids is not None:
                seen[piece] = ids
            elif plain(piece):
                words = cut(piece.lower() if self.strip else piece)
                ids = [known(w) or self._word(w) for w in words]
                if words != [piece]:
                    seen[piece] = b"".join(ids)
            else:
                seen[piece] = b"".join(map(self._ids, self._words(piece)))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for NULL or an empty text."""
        cut = self.pieces(pa.array(texts, pa.large_string()).fill_null(""))
        found = cut.flatten().dictionary_encode()
        pieces = found.dictionary.to_pylist()
        if len(self.seen) > SEEN:
            self.seen, self.before = {}, self.seen
        self._learn([p for p in pieces if p not in self.seen])
        each = pa.array(list(map(self.seen.__getitem__, pieces)), pa.large_binary()).take(found.indices)
        _, ends, data = each.buffers()
        ids = np.frombuffer(data or b"", dtype="<u4")
        bounds = np.frombuffer(ends, dtype=np.int64)[cut.offsets.to_numpy()] // 4
        return [ids[start:stop] for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def batches(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """``encode`` for many texts, a bounded number of characters at a time."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= CHARS:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)


@cache
def encoder(path: str, strip: bool) -> Encoder:
    """One encoder per worker process; what it remembers serves all tasks that run there."""
    return Encoder(path, strip)
