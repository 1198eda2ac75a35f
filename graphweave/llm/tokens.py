"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut, small_batches

#: Word pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Vocabulary used unless another is named.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts above this length are encoded in pieces cut at white space, which bounds a task's memory; the pattern cuts there too.
PIECE_CHARS = 1 << 20

_loaded: dict[str, object] = {}


def vocabulary_dir() -> str:
    """Folder of the vocabulary files: TOKENIZERS_DIR, else the installed package, else /opt/tokenizers."""
    if d := os.environ.get("TOKENIZERS_DIR"):
        return d
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


def encoder(path: str):
    """The encoder of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count(encode, text: str | None) -> int:
    if not text:
        return 0
    total, at = 0, 0
    while len(text) - at > PIECE_CHARS:  # the last line break of the piece goes to the next one, as in the pattern
        to = text.rfind("\n", at + 1, at + PIECE_CHARS)
        while to > at + 1 and text[to - 1].isspace():
            to -= 1
        to = to if to > at + 1 else at + PIECE_CHARS
        total += len(encode(text[at:to]))
        at = to
    return total + len(encode(text[at:]))


def token_sizes(df: DataFrame, text: str, keep: list[str], *, vocabulary: str | None = None, name: str = "tokens") -> DataFrame:
    """keep and the number of tokens of the text of each row; null and empty texts have 0. Computed at once, so that a
    text is encoded once however often the sizes are used.

    vocabulary: path of a rank file, by default byte_bpe_50k.tiktoken of the installed tokenizers. A clashing column
    called as the result is replaced only if it isn't kept."""
    path = vocabulary or f"{vocabulary_dir()}/{VOCABULARY}"
    fields = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = np.fromiter((count(encode, t.as_py()) for t in texts), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes)], names=[*keep, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    sizes = df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, `{name}` bigint")
    with small_batches(df.sparkSession):
        return cut(sizes)
