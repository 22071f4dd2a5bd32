"""Token ids of whole texts by a tokenizer file of the tokenizers library, word by word."""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a byte-level tokenizer writes as the character of the same number (fixed values).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Letters followed by ASCII punctuation: the two parts are tokenized independently.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
#: The split pattern for which cutting at white space is known to change nothing (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHED_WORDS = 250_000


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class _Cache(dict):
    """word -> id bytes, in two generations, so that its size stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got

    def trim(self):
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """encode(text bytes) -> ids as little-endian bytes, equal to the library's on the whole text.

    A tokenizer that drops white space and works on each word by itself (checked by its file) is
    asked once per distinct word; a plain word goes straight to its merge model.  Any other
    tokenizer gets the whole text.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.by_word = self._independent_words(spec)
        chars = {b: chr(b) for b in PRINTABLE}
        chars |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in chars)}
        self.chars = [chars[b] for b in range(256)]
        self.model = self.tokenizer.model.tokenize
        self.words = _Cache(self._word)

    @staticmethod
    def _independent_words(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        return (spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
                and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed"
                and split.get("invert") is True and pre["pretokenizers"][1].get("add_prefix_space") is False
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]
                            for t in spec.get("added_tokens", [])))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, letters: str) -> bytes:
        piece = "".join([self.chars[b] for b in letters.lower().encode()])
        return np.array([t.id for t in self.model(piece)], self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        parts = SIMPLE.fullmatch(text)
        if not parts:
            return self.whole(text)
        if parts[2]:
            return self.words[parts[1].encode()] + self.words[parts[2].encode()]
        return self._plain(text)

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self.whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, text.split()))

    def trim(self) -> None:
        self.words.trim()


def encoder(content: str) -> TextEncoder:
    """The encoder of this worker process, kept for its later tasks."""
    state = sys.modules.setdefault("_text_encoders", types.ModuleType("_text_encoders")).__dict__
    found = state.get("last")
    if found is None or found[0] != content:
        found = state["last"] = (content, TextEncoder(content))
    return found[1]


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer file; read once on the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encode_batches(batches, content: str, end_id: int | None):
    """Batches (key, id, n, ids) of batches (key, id, text)."""
    enc = encoder(content)
    end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
    width = np.dtype(enc.dtype).itemsize
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids = [enc.encode(t) + end for t in part.column(2).cast(pa.binary()).to_pylist()]
            enc.trim()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(x) // width for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["key", "id", "n", "ids"])


def token_rows(rows: DataFrame, content: str, end_id: int | None, then=None) -> DataFrame:
    """``(key, id, n, ids)`` of ``(key, id, text)``: ids of the whole text as little-endian
    unsigned 16-bit (vocabularies over 65,536: 32-bit) integers, ``end_id`` appended.

    ``then`` may change the batches within the same task; it keeps the columns.
    """
    shared = rows.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        encoded = encode_batches(batches, shared.value, end_id)
        return then(encoded) if then else encoded

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("key", "id", "text").mapInArrow(run, f"key long, id {kind}, n long, ids binary")
