"""Encoding and decoding of texts with public tokenizers (problem 7)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

DEFAULT = "byte_bpe_50k"
FOLDER = "/opt/tokenizers"
_loaded: dict[str, object] = {}


def tokenizer(name: str = DEFAULT, folder: str = FOLDER):
    """The tokenizer of a file, one per process. Strings like special tokens are ordinary text."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _loaded and not os.path.exists(path):
        raise ValueError(f"{folder} has no {name}.json")
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies.

    Bytes that print keep their own character; the others take the characters from U+0100 on, in
    order of the bytes.
    """
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in prints}
    rest = [b for b in range(256) if b not in set(prints)]
    return table | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of at most *most* characters each, or of a single text."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_BEFORE_WORD = re.compile("(?= [A-Za-z])")
CACHED_CHARS, CACHED_WORDS = 64, 400_000  # memory of a worker; what isn't kept is encoded again


class WordCoder:
    """Ids of texts by a byte-level tokenizer, each distinct word encoded once.

    Byte-level vocabularies part a text before each blank that a Latin letter follows, whatever stands before it,
    so the ids of a text are those of the pieces between such places, one after the other. Tokenizers of other kinds, with
    a normalizer or an added blank, get whole texts.
    """

    def __init__(self, coder):
        self.coder, self.kept = coder, {}
        made = json.loads(coder.to_str())
        split = made.get("pre_tokenizer") or {}
        self.parts = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if not self.parts:
            return self._whole(texts)
        pieces = [_BEFORE_WORD.split(t) for t in texts]
        kept = self.kept
        new = list({p for text in pieces for p in text if p not in kept})
        extra = dict(zip(new, self._whole(new), strict=True))
        if len(kept) + len(extra) <= CACHED_WORDS:
            kept.update((p, i) for p, i in extra.items() if len(p) <= CACHED_CHARS)
        made = []
        for text in pieces:
            ids: list[int] = []
            for p in text:
                ids += kept[p] if p in kept else extra[p]
            made.append(ids)
        return made


def word_coder(name: str = DEFAULT, folder: str = FOLDER) -> WordCoder:
    """The WordCoder of a file, one per process."""
    key = os.path.join(folder, f"{name} by words")
    if key not in _loaded:
        _loaded[key] = WordCoder(tokenizer(name, folder))
    return _loaded[key]


def encode(texts: DataFrame, text: str = "text", name: str = DEFAULT, folder: str = FOLDER, output: str = "ids", offsets: bool = False, batch_chars: int = 2_000_000) -> DataFrame:
    """All rows of *texts* with *output*, the token ids of the whole text, without special tokens.

    Null and empty texts give an empty list. With *offsets* there's also `<output>_offsets`: per
    token start and end in characters, as the tokenizer gives them (the tokens of a character that
    is split share its range). One narrow pass over Arrow batches, in steps of *batch_chars*
    characters so that memory doesn't follow the length of a batch. Repeated rows are each encoded; an
    empty table gives no rows; further columns are kept, those of the new names replaced.
    """
    added = [StructField(output, ArrayType(IntegerType()))]
    if offsets:
        added.append(StructField(f"{output}_offsets", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))))
    texts = texts.drop(*[f.name for f in added if f.name.lower() != text.lower()])
    out = StructType([*texts.schema.fields, *added])
    place = texts.columns.index(text)
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, by_words = tokenizer(name, folder), word_coder(name, folder)
        for batch in batches:
            column = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in _chunks(column, batch_chars):
                part = batch.slice(a, b - a)
                if offsets:
                    done = coder.encode_batch(column[a:b], add_special_tokens=False)
                    more = [pa.array([e.ids for e in done], pa.list_(pa.int32())), pa.array([[{"start": s, "end": t} for s, t in e.offsets] for e in done], pairs)]
                else:
                    more = [pa.array(by_words(column[a:b]), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=out.names)

    return texts.mapInArrow(run, out)


def counter(name: str = DEFAULT, folder: str = FOLDER):
    """A function from a list of texts to their numbers of tokens, by whichever library reads the file."""
    path = os.path.join(folder, name)
    if path in _loaded:
        return _loaded[path]
    if os.path.exists(f"{path}.json"):
        by_words = word_coder(name, folder)
        made = lambda texts: [len(ids) for ids in by_words(texts)]
    elif os.path.exists(f"{path}.tiktoken"):
        import base64

        import tiktoken

        # Fixed value: how byte-level vocabularies part a text before pairs are merged.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        made = lambda texts: [len(coding.encode_ordinary(t)) for t in texts]
    elif os.path.exists(f"{path}.model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=f"{path}.model")
        made = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    else:
        raise ValueError(f"{folder} has no tokenizer {name}")
    _loaded[path] = made
    return made


def count_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT, folder: str = FOLDER, batch_chars: int = 2_000_000) -> DataFrame:
    """*key* and `tokens`, the number of tokens of the whole text; 0 for null and empty texts."""
    out = StructType([texts.schema[key], StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name, folder)
        for batch in batches:
            column = [t or "" for t in batch.column(1).to_pylist()]
            sizes: list[int] = []
            for a, b in _chunks(column, batch_chars):
                sizes += count(column[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=out.names)

    return texts.select(key, text).mapInArrow(run, out)


def decode(encoded: DataFrame, ids: str = "ids", name: str = DEFAULT, folder: str = FOLDER, output: str = "decoded") -> DataFrame:
    """All rows with *output*, the text of the ids by the reversed byte table.

    A character that is split over tokens is whole again, as bytes are joined before they're read.
    An empty or null list gives the empty string; a column named *output* is replaced; ids that the vocabulary lacks raise ValueError;
    bytes that are no UTF-8 (a cut list) become U+FFFD.
    """
    encoded = encoded.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(name, folder)
        table = byte_table()
        pieces = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in coder.get_vocab().items()}
        for batch in batches:
            texts = []
            for row in batch.column(place).to_pylist():
                try:
                    texts.append(b"".join([pieces[i] for i in row or ()]).decode("utf-8", "replace"))
                except KeyError as e:
                    raise ValueError(f"the vocabulary has no id {e}") from None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    place, names = encoded.columns.index(ids), [*encoded.columns, output]
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(output, StringType())]))


def round_trip_losses(texts: DataFrame, key: str, text: str, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """The *key* of texts that decoding doesn't give back; none for a lossless tokenizer."""
    back = decode(encode(texts.select(key, text), text, name, folder), "ids", name, folder)
    return back.filter(F.coalesce(F.col(text), F.lit("")) != F.col("decoded")).select(key)
