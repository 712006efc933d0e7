"""Token ids by a public tokenizer, with documents cut losslessly into pieces."""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, only_memory

MAX_TOKENS = 4096
END_ID = 1
#: Bytes of words and ids that a Python worker remembers, twice, and what an entry takes besides.
REMEMBERED_BYTES, ENTRY_BYTES = 130_000_000, 190
#: Python splits at these four, the tokenizer's \s doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on what stands beside them or is two letters.
_ODD_CASE = re.compile("[\u0130\u03a3]")

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words, found when first asked for. Beyond the limit the words not
    asked for lately go."""

    def __init__(self, tokenizer):
        self.tokenizer, self.old, self.letters, self.size = tokenizer, {}, _byte_letters(), 0
        self.limit = REMEMBERED_BYTES
        self.merge = tokenizer.model.tokenize

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            core = word.rstrip(".,")
            if core != word and core.isalpha():
                found = self[core] + self[word[len(core) :]]  # letters and marks never share a token
            elif word.isalpha() and is_normalized("NFC", word) and not _ODD_CASE.search(word):
                # what normalising and splitting leave of it is the word itself, lower-cased
                small = word.lower()
                if not small.isascii():
                    small = small.encode().decode("latin-1").translate(self.letters)
                found = array("I", [x.id for x in self.merge(small)]).tobytes()
            else:
                found = self.raw(word)
        if len(word) <= 64:
            self[word] = found
            self.size += len(word) + len(found) + ENTRY_BYTES
        return found

    def trim(self) -> None:
        if self.size > self.limit:
            self.old = {}
            self.old = dict(self)
            self.clear()
            self.size = 0

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words, and each frequent word is encoded once. Texts with one of
    the four control characters that only Python splits at are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.known.trim()
        look, raw = self.known.__getitem__, self.known.raw
        return [b"" if not t else raw(t) if _NOT_SPACE.search(t) else b"".join(map(look, t.split())) for t in texts]


_held: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str, remembered: int = REMEMBERED_BYTES) -> WordTokenizer:
    """One tokenizer per worker and file, which remembers twice so many bytes of words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _held:
        _held[path] = WordTokenizer(path)
    _held[path].known.limit = remembered
    only_memory(f"tokens {path}", _held[path].known.forget)
    return _held[path]


def tokenize(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of all documents.

    ids: the text's ids, then ``end_id``, as little-endian unsigned 32-bit integers.
    Only documents of more than ``max_tokens`` ids are cut; the last piece may be
    shorter. ``remembered``: bytes of words that a Python worker keeps, twice; fewer cost
    time alone. Null and empty texts give the end id alone; a null doc_id stays null;
    repeated rows give repeated pieces; other columns are ignored; an empty table
    gives no pieces."""
    path = path or default_tokenizer()
    end, width = end_id.to_bytes(4, "little"), max_tokens * 4

    def cut(batches):
        names = ["doc_id", "piece", "start", "length", "ids"]
        coder = tokenizer_of(path, remembered)
        for batch in chunks(batches, 500):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)
