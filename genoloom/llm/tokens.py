"""Byte-level BPE ids with the tokenizers library, one call per distinct word.

A text is cut at single line ends and single spaces; a word with its leading
space (or none, at a line's start) tokenises the same wherever it stands, because
the vocabulary's pre-tokeniser never joins a word to what follows it, and a line
end between two words is a piece of its own. Only other runs of blanks need
context, so a text with an empty word, a line that begins or ends with a blank, or
two empty lines in a row goes through the library whole. A new word in Latin letters goes straight to the library's BPE
model, which is several times faster than its whole pipeline; any other new
word takes the pipeline. The ids are the library's own in every case.

Many texts at once (``encode_many``) are cut, their pieces found among those met
before and the ids gathered by Arrow, some megabytes of text at a time; only
pieces not met before are handled one by one.
"""

from __future__ import annotations

import os
from array import array

#: Words met again, and words met once, that are kept with their ids; beyond that only those used since, or met last, stay (results don't change).
CACHE_WORDS, CACHE_ONCE = 340_000, 170_000
#: Letters up to here belong to the same classes in every version of Unicode.
LAST_LATIN = "\u024f"
#: Characters encoded together, and pieces kept for that, some 30 bytes each; beyond, only those met again stay (results don't change).
TOGETHER, KNOWN = 8_000_000, 800_000
_ENCODERS: dict = {}


def byte_alphabet() -> str:
    """The character that byte-level BPE writes for each byte 0-255.

    Printable bytes of Latin-1 stand for themselves; the others take the
    characters from U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


class Words(dict):
    """Ids of a word with ``before`` (a space or nothing) before it, found when first asked for.

    Most words of a corpus occur once, so a word becomes an item when it is met
    again; until then it waits in ``once``. ``kind``: the array type code of
    ids, two bytes or four.
    """

    def __init__(self, tokenizer, kind: str, before: str) -> None:
        import public_tokenizers
        import regex

        self.model = tokenizer.model.tokenize
        self.whole = tokenizer.encode
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.before = before
        self.space = self.alphabet[0x20] if before else ""
        self.kind = kind
        self.old: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.before_once: dict[str, bytes] = {}
        self.marks = {m: array(kind, [t.id for t in self.model(m)]).tobytes() for m in ".,;:!?"}

    def renew(self, most: int, most_once: int) -> None:
        """Beyond ``most`` words, or ``most_once`` met once, begins a new generation; words of the last one come back when asked for."""
        if len(self) > most:
            self.old.clear()
            self.old.update(self)
            self.clear()
        if len(self.once) > most_once:
            self.once, self.before_once = {}, self.once

    def __missing__(self, word: str) -> bytes:
        found = self.once.pop(word, None) or self.old.pop(word, None) or self.before_once.pop(word, None)
        if found is not None:
            self[word] = found
            return found
        if word[-1:] in self.marks and word[:-1].isalpha():
            self.once[word] = found = self[word[:-1]] + self.marks[word[-1]]
        else:
            self.once[word] = found = self.find(word)
        return found

    def find(self, word: str) -> bytes:
        """Ids of a word, which isn't remembered."""
        if word.isalpha():
            if word.isascii():
                ids = [t.id for t in self.model(self.space + word)]
            elif max(word) <= LAST_LATIN:
                ids = [t.id for t in self.model(self.space + word.encode().decode("latin-1").translate(self.alphabet))]
            else:
                ids = self.whole(self.before + word, add_special_tokens=False).ids
        elif not word or word[0].isspace():
            raise KeyError(word)
        elif word[-1] in self.marks and word[:-1].isalpha():
            # letters and one mark are two pieces
            return self.find(word[:-1]) + self.marks[word[-1]]
        elif word.isascii() or max(word) <= LAST_LATIN:
            ids = [t.id for p in self.pieces(self.before + word) for t in self.model(p.encode().decode("latin-1").translate(self.alphabet))]
        else:
            ids = self.whole(self.before + word, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()


class Encoder:
    """Gives each text's ids as little-endian unsigned bytes of type ``dtype``: two an id where the vocabulary allows, else four."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "I"
        self.dtype = f"<u{array(self.kind).itemsize}"
        self.words, self.heads = Words(self.tokenizer, self.kind, " "), Words(self.tokenizer, self.kind, "")
        self.line = self.whole("\n")
        self.known = None
        space = self.words.space
        vocabulary = self.tokenizer.get_vocab()
        # tokens that begin with a space, and whether none holds one after something that isn't blank (Latin words hold no U+00A0)
        self.firsts = {i for t, i in vocabulary.items() if t[:1] == space}
        blank = "\u00a0".encode().decode("latin-1").translate(self.words.alphabet)
        self.apart = not any(space in t.lstrip(space) and t.replace(blank, "").strip(space) for t in vocabulary)

    def whole(self, text: str) -> bytes:
        """Through the library's whole pipeline."""
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_one(self, text: str) -> bytes:
        if any(mark in text for mark in self.added) or "\n\n\n" in text or text.endswith("\n\n"):
            return self.whole(text)
        words, heads = self.words, self.heads
        words.renew(CACHE_WORDS, CACHE_ONCE)
        heads.renew(CACHE_WORDS // 4, CACHE_ONCE // 4)
        heads[""] = b""
        out = []
        try:
            for line in text.split("\n"):
                if line[:1].isspace() or line[-1:].isspace():
                    return self.whole(text)
                first, *rest = line.split(" ")
                out.append(heads[first] + b"".join(map(words.__getitem__, rest)))
        except KeyError:
            return self.whole(text)
        return self.line.join(out)

    def _piece(self, piece: str) -> bytes | None:
        """Ids of what lies between two spaces, a line end before a text's first piece; None if it needs context."""
        first = piece[:1] == "\n"
        before, *after = (piece[1:] if first else piece).split("\n")
        starts = [before, *after] if first else after
        ends = [before, *after][:-1]
        if any(x[:1].isspace() for x in starts) or any(x[-1:].isspace() for x in ends):
            return None
        try:
            return self.line.join([self.heads[before] if first else self.words[before], *map(self.heads.__getitem__, after)])
        except KeyError:
            return None

    def _plain(self, text: str) -> bool:
        """No blanks that need context, but for what ``_piece`` finds."""
        return not (
            any(mark in text for mark in self.added) or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text
            or text.endswith("\n\n") or text[:1] == " " or text[-1:] != "\n" and text[-1:].isspace())

    def encode_many(self, texts):
        """``encode_one`` of each text of an iterable, in order, some at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of Latin words, a space before each, in one call of the model: no merge crosses a space that follows a letter."""
        run = " ".join(["", *words]).encode().decode("latin-1").translate(self.words.alphabet)
        ids = array(self.kind, [t.id for t in self.words.model(run)])
        raw, size = ids.tobytes(), ids.itemsize
        at = [size * i for i, x in enumerate(ids) if x in self.firsts]
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]

    def _learn(self, new: list[str]) -> list[bytes | None]:
        """Ids of pieces not met before."""
        self.words.renew(CACHE_WORDS, CACHE_ONCE)
        self.heads.renew(CACHE_WORDS // 4, CACHE_ONCE // 4)
        self.heads[""] = b""
        found, find, marks = [], self.words.find, self.words.marks
        plain, places = [], []
        for piece in new:
            try:
                word = piece[:-1] if piece[-1] in marks else piece
                if self.apart and word.isalpha() and (word.isascii() or max(word) <= LAST_LATIN):
                    plain.append(word)
                    places.append(len(found))
                    found.append(b"" if word is piece else marks[piece[-1]])
                else:
                    found.append(self._piece(piece) if "\n" in piece else find(piece))
            except KeyError:
                found.append(None)
        for at in range(0, len(plain), 100):
            for place, ids in zip(places[at : at + 100], self._words(plain[at : at + 100])):
                found[place] = ids + found[place]
        return found

    def _together(self, texts: list[str]):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.known is None:
            # pieces, their ids (null if they need context), and which were met again
            self.known, self.ids, self.again = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)
        plain = [self._plain(x) for x in texts]
        cut = pc.split_pattern(pa.array(["\n" + x for x, ok in zip(texts, plain) if ok], pa.large_string()), " ")
        pieces = cut.flatten()
        at = pc.index_in(pieces, value_set=self.known)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().copy()
        new = pieces.take(pa.array(missing)).dictionary_encode()
        at[missing] = new.indices.to_numpy() + len(self.known)
        # pieces hold no space, so one string of them is cut faster than each is read
        row = pa.ListArray.from_arrays(pa.array([0, len(new.dictionary)], pa.int32()), new.dictionary)
        words = pc.binary_join(row, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(new.dictionary) else []
        known = pa.concat_arrays([self.known, new.dictionary])
        ids = pa.concat_arrays([self.ids, pa.array(self._learn(words), pa.large_binary())])
        found = ids.take(pa.array(at))
        met = np.bincount(at, minlength=len(known))
        fresh = np.arange(len(known)) >= len(self.known)
        again = np.concatenate([self.again, np.zeros(len(new.dictionary), bool)]) | (met > fresh)
        # pieces with a line end hardly come again
        keep = ~pc.match_substring(known, "\n").to_numpy(zero_copy_only=False)
        if keep.sum() > KNOWN:
            keep &= again
            again = np.zeros(len(known), bool)
            keep &= 2 * keep.sum() <= KNOWN
        self.known, self.ids, self.again = known.filter(pa.array(keep)), ids.filter(pa.array(keep)), again[keep]
        starts = cut.offsets.to_numpy() if len(cut) else np.zeros(1, int)
        places = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1) if len(found) else np.zeros(1, "<i8")
        ends = places[starts].tolist()
        odd = np.zeros(len(cut), bool)
        if found.null_count:
            odd[np.searchsorted(starts, np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)), "right") - 1] = True
        raw, i = memoryview(found.buffers()[2] or b""), 0
        for text, ok in zip(texts, plain):
            if ok:
                i += 1
            yield bytes(raw[ends[i - 1] : ends[i]]) if ok and not odd[i - 1] else self.whole(text)


def forget() -> None:
    """Free the words that this worker remembers, and what Arrow keeps for later."""
    import pyarrow

    _ENCODERS.clear()
    pyarrow.default_memory_pool().release_unused()


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
