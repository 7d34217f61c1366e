"""Token ids of whole texts with a public word-level BPE file, remembered word by word.

The word tokenizer drops white space and never merges across it, so a text's ids are its words' ids one
after the other. The byte tokenizer takes one space before a word into the word's tokens, so there the units start at
spaces. Units repeat a lot; each Python worker remembers the ids of units it has seen (``memo.Memo``, bounded by bytes; it
lives in a broadcast value, hence across tasks) and encodes only new ones.
"""

from __future__ import annotations

from collections.abc import Callable

import re

import regex
from pyspark.sql import SparkSession

from quillspark.llm.memo import Memo

#: Bytes that each of the two memories (of units, and of the runs that they consist of) takes in a Python worker.
MEMO_BYTES = 160 << 20

# Fixed values of the tokenizer file: its split pattern and the byte alphabet of byte-level BPE.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Separators that Python's str.split() takes for white space and the tokenizer does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Words whose normal form is plain lower case and that hold no special token.
PLAIN = regex.compile("[\x21-\x3b\x3d-ɏ]+")
# The same for the byte-level file: its split pattern, and pieces that hold only characters every Unicode version classes alike.
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BYTE_PLAIN = re.compile("[\x20-\x7e\n¡-ɏ]+")
# The letters and numbers of such a text, so that one pass of the standard library's ``re`` finds its runs.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
BYTE_RUNS = re.compile(f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: A space within a run of white space that is not the last before a word.
SPACES = re.compile(r"\s (?:\s|\Z)")
BEFORE_SPACES = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)}


class _Encoder:
    """Shared by both tokenizers: ids as little-endian 32-bit bytes, of whole texts or of runs that no merge crosses."""

    def __init__(self, tokenizer_json: str, memo_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.runs = Memo(self.run, memo_bytes).__getitem__
        self.units = Memo(self.unit, memo_bytes).__getitem__

    def whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def run(self, run: str) -> bytes:
        spelled = run.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])


class _Words(_Encoder):
    """Units are words; case is folded and white space dropped."""

    def unit(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return b"".join(map(self.runs, SPLIT.findall(word.lower())))
        return self.whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.units, text.split()))


class _Bytes(_Encoder):
    """A text of plain characters is cut into its runs at once. In others units start at a space; only within a run of white
    space may a token hold a space that is not its first."""

    def __init__(self, tokenizer_json: str, memo_bytes: int):
        super().__init__(tokenizer_json, memo_bytes)
        self.runs = Memo(self.run, memo_bytes * 2).__getitem__
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def run(self, run: str) -> bytes:
        if run.isascii() and run[1:].isalpha():  # such characters but the space stand for themselves in the byte alphabet
            run = self.alphabet[32] + run[1:] if run[0] == " " else run
            packed = self.packed
            return b"".join([packed[t.id] for t in self.model.tokenize(run)])
        return super().run(run)

    def unit(self, rest: str) -> bytes:
        return self.piece(" " + rest)

    def piece(self, piece: str) -> bytes:
        if BYTE_PLAIN.fullmatch(piece):
            return b"".join(map(self.runs, BYTE_SPLIT.findall(piece)))
        return self.whole(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if BYTE_PLAIN.fullmatch(text):
            return b"".join(map(self.runs, BYTE_RUNS.findall(text)))
        if SPACES.search(text):  # a unit that starts within a run of white space would cut it: units start before the run
            return b"".join(map(self.piece, BEFORE_SPACES.split(text)))
        first, *rest = text.split(" ")
        return self.piece(first) + b"".join(map(self.units, rest))


def _shipped(kind: type[_Encoder], spark: SparkSession, tokenizer_path: str, memo_bytes: int) -> Callable[[], Callable]:
    with open(tokenizer_path, encoding="utf-8") as f:
        state = spark.sparkContext.broadcast({"json": f.read()})

    def encoder() -> Callable[[str | None], bytes]:
        kept = state.value
        if "encode" not in kept:
            kept["encode"] = kind(kept["json"], memo_bytes).encode
        return kept["encode"]

    return encoder


def word_encoder(spark: SparkSession, tokenizer_path: str, memo_bytes: int = MEMO_BYTES) -> Callable[[], Callable]:
    """For use in tasks: returns a function that gives the encoder ``text -> id bytes`` of this worker, for the word-level file.

    The tokenizer file is read on the driver and shipped (1.6 MB), so executors need no copy of it.
    """
    return _shipped(_Words, spark, tokenizer_path, memo_bytes)


def byte_encoder(spark: SparkSession, tokenizer_path: str, memo_bytes: int = MEMO_BYTES) -> Callable[[], Callable]:
    """The same for the byte-level file. The string of a special token in a text is that token, as the library has it."""
    return _shipped(_Bytes, spark, tokenizer_path, memo_bytes)
