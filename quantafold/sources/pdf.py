"""Words and spans of PDF files, as far as a reader without fonts can tell.

Content streams that are plain or deflated are read; text is placed by the matrices and offsets of their operators. Widths are taken as half
a letter's height, as fonts aren't read; texts in encodings of embedded fonts come out as their bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
WIDTH = 0.5


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def spans_of(content: bytes) -> Iterator[tuple[int, int, str, float, str, float, float, float, float]]:
    """(page, span, text, size, font, x0, y0, x1, y1) of each string shown, y upwards from the page's foot; pages are streams that show text, in order."""
    page = 0
    for m in _STREAM.finditer(content):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or not re.search(rb"T[jJ]|['\"]", body):
            continue
        page += 1
        stack: list = []
        size, font, leading, x, y, left, span = 0.0, "", 0.0, 0.0, 0.0, 0.0, 0
        for token in _TOKEN.findall(body):
            if token[:1] in b"(</[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                stack.append(token)
                continue
            numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
            shown = [_text(t) for t in stack if t[:1] in b"(<"]
            if token == b"BT":
                x = y = left = 0.0
            elif token == b"Tf" and numbers:
                size, font = numbers[-1], next((t[1:].decode("latin-1") for t in stack if t[:1] == b"/"), font)
            elif token == b"TL" and numbers:
                leading = numbers[-1]
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                left, y = left + numbers[-2], y + numbers[-1]
                x, leading = left, -numbers[-1] if token == b"TD" else leading
            elif token == b"Tm" and len(numbers) >= 6:
                x = left = numbers[-2]
                y = numbers[-1]
            elif token in (b"T*", b"'", b'"'):
                x, y = left, y - leading
            if token in (b"Tj", b"TJ", b"'", b'"') and shown:
                text = "".join(shown)
                width = len(text) * size * WIDTH
                if text.strip():
                    yield page, span, text, size, font, x, y, x + width, y + size
                    span += 1
                x += width
            stack = []


def pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `page`, `span`, `text`, `size`, `font`, x0, y0, x1, y1 of the spans of PDF files; one file at a time is held."""
    names = ["page", "span", "text", "size", "font", "x0", "y0", "x1", "y1"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                made = pd.DataFrame(list(spans_of(content)), columns=names)
                made.insert(0, "path", name)
                yield made

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "path string, page int, span int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double")


def pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `page`, `block` (the span), `word_no` in it, `word` and its box."""
    spans = pdf_spans(spark, path).withColumn("w", (F.col("x1") - F.col("x0")) / F.char_length("text"))
    words = spans.select("path", "page", F.col("span").alias("block"), "x0", "y0", "y1", "w", F.posexplode(F.split("text", " ", -1)).alias("k", "word"), "text")
    before = F.aggregate(F.slice(F.split("text", " ", -1), F.lit(1), F.col("k")), F.lit(0), lambda s, v: s + F.char_length(v) + 1)
    placed = words.withColumn("a", F.col("x0") + before * F.col("w")).filter("word <> ''")
    return placed.select("path", "page", "block", F.col("k").alias("word_no"), "word", F.col("a").alias("x0"), "y0", (F.col("a") + F.char_length("word") * F.col("w")).alias("x1"), "y1")
