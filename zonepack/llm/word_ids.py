"""Token ids of whole texts from a public tokenizer file, each distinct word encoded once per worker.

A text's ids are those of its white-space separated words in turn, because the tokenizer drops
white space before it merges, and neither its normalizer nor its splitter joins characters across
it. Batches of texts are split and their words numbered by Arrow; only distinct words are looked up, and
ids are put in their places by numpy. A worker keeps the ids of the words it has met; the library
encodes only new ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import weakref
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes that a generation of a worker's word store may hold, and what an entry takes besides its characters.
MOST_BYTES = 28 << 20
ENTRY_BYTES = 160
LONGEST_KEPT = 64


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch of texts, separated by ASCII white space: the distinct ones, for each word in
    turn which of them it is, and where the words of each text end. A null text has none."""
    lists = pc.ascii_split_whitespace(column.fill_null(""))
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy()
    if (blank := pc.index(words, "").as_py()) >= 0:  # before leading and after trailing white space
        full = index != blank
        index, ends = index[full], np.concatenate([[0], np.cumsum(full)])[ends]
    return words, index, ends


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class _Kept(dict):
    """Values by word, made on first use, in at most about twice ``most`` bytes.

    There are two generations. When this one is full it takes the place of the old one, which is dropped;
    a word that is found in the old one comes up again. So frequent words stay and rare ones go.
    """

    def __init__(self, make, most: int = MOST_BYTES):
        self.make, self.most, self.held, self.old = make, most, 0, {}
        _stores.append(weakref.ref(self))

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_KEPT:
            self.held += ENTRY_BYTES + len(word) + (len(value) if isinstance(value, bytes) else 0)
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                super().clear()
            self[word] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old, self.held = {}, 0


_stores: list[weakref.ref] = []
_turn: list[str] = [""]


def take_turn(operator: str) -> None:
    """Empty the stores that another operator has filled in this worker: workers outlive jobs."""
    if _turn[0] != operator:
        _turn[0] = operator
        for store in [s for ref in _stores if (s := ref()) is not None]:
            store.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library keeps freed memory otherwise
            ctypes.CDLL(None).malloc_trim(0)


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()
#: ASCII symbols; at the end of a word they make one piece.
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below this letters are composed already and lower-case one by one.
_LATIN_END = "\u0250"


def by_letters(words: pa.Array, letters: dict, odd: dict) -> list:
    """Values of distinct words. Most are letters and perhaps symbols after them: a piece each, whose values are
    looked up in ``letters`` and added; the others are looked up whole in ``odd``."""
    plain = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)
    found = np.empty(len(words), dtype=object)
    low = pc.ascii_lower(words.filter(pa.array(plain))).dictionary_encode()
    values = np.empty(len(low.dictionary), dtype=object)
    values[:] = list(map(letters.__getitem__, strings(low.dictionary)))
    found[plain] = values[low.indices.to_numpy()]
    rest = []
    for word in strings(words.filter(pa.array(~plain))):
        core = word.rstrip(SYMBOLS)
        low = core.lower()
        if not core.isalpha() or not core.isascii() and (max(core) >= _LATIN_END or not low.isalpha()):
            rest.append(odd[word])
        elif len(core) == len(word):
            rest.append(letters[low])
        else:
            rest.append(letters[low] + letters[word[len(core) :]])
    values = np.empty(len(rest), dtype=object)
    values[:] = rest
    found[~plain] = values
    return found.tolist()


def byte_level(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)


class WordTokenizer:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _Kept(lambda low: self._piece(byte_level(low)))
        self.odd = _Kept(self._odd)
        self.plain = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.library.model.tokenize(piece)]).tobytes()

    def split(self, word: str) -> list[str] | None:
        """The pieces of one word that are merged by themselves; None if it holds a special token."""
        if "<" in word and any(s in word for s in self.special):
            return None
        if word.isascii() and word.isprintable():
            return self.plain.findall(word.lower())
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def _odd(self, word: str) -> bytes:
        pieces = self.split(word)
        if pieces is None:
            return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self._piece, pieces))

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and where each text's ids end. ``end_id`` closes each."""
        words, index, word_ends = words_of(column)
        found = by_letters(words, self.letters, self.odd)
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.cumsum(each)
        out = ids[np.repeat(starts[index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        text_ends = np.concatenate([[0], ends])[word_ends]
        if end_id is None:
            return out, text_ends
        return np.insert(out, text_ends, end_id), text_ends + np.arange(1, len(text_ends) + 1)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode(pa.array([text]))[0].tobytes()


_open: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for this file; opened once."""
    take_turn("ids")
    if path not in _open:
        _open.clear()
        _open[path] = WordTokenizer(path)
    return _open[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
