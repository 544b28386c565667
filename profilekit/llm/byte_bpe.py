"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file is read once on the driver (its size is checked) and broadcast, so workers
need no copy of it. Texts longer than ``PIECE_CHARS`` are handed to the library in pieces
that end where a match of the splitting pattern must end: between a character that is
not white space and one that is. Runs of white space longer than ``PIECE_CHARS``, on which
the library's regex engine overflows its stack, are cut out and encoded as the one match
they are. The ids equal those of the whole text in every case.

Defined cases: null is the empty text; the empty text has no ids; repeated rows and ids
give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from profilekit.llm.common import id_and_text, per_text, sha256_hex

PIECE_CHARS = 1 << 16
MAX_RANK_FILE_BYTES = 64 << 20

#: White space as the splitting pattern's \s sees it (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BOUND = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_LONG_RUN = re.compile(f"[{_SPACE}]{{{PIECE_CHARS},}}")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; larger files than a vocabulary can be are refused."""
    if os.path.getsize(path) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_bytes: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines()) if token}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, is one match) in order; ``text`` is their concatenation."""
        start = 0
        while start < len(text):
            bound = _BOUND.search(text, start + PIECE_CHARS) if len(text) - start > PIECE_CHARS else None
            end = bound.start() if bound else len(text)
            run = _LONG_RUN.search(text, start, end) if end - start >= PIECE_CHARS else None
            if run is None:
                yield text[start:end], False
                start = end
                continue
            if run.start() > start:
                yield text[start:run.start()], False
            # Before other text, the run's last character belongs to the next match.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():stop], True
            start = stop

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece, single in self.pieces(text):
            ids += self._encoding._encode_single_piece(piece) if single else self._encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, valid UTF-8 or not."""
        return self._encoding.decode_bytes(ids)


_LOADED: dict[str, ByteBpe] = {}


def loaded(rank_bytes: bytes, pattern: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    key = sha256_hex(rank_bytes + pattern.encode())
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(rank_bytes, pattern)
    return _LOADED[key]


def encode_texts(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def make():
        bpe = loaded(shared.value, pattern)
        return lambda ids, texts: {"doc_id": ids, "ids": [bpe.encode(t) for t in texts]}

    return per_text(id_and_text(df, id_col, text_col), make, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the raw bytes of every row's ids; null ids count as none."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def make():
        bpe = loaded(shared.value, pattern)
        return lambda ids, lists: {"doc_id": ids, "data": [bpe.decode(x or []) for x in lists]}

    return per_text(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col]), make, "doc_id long, data binary")


def round_trip_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and keep only digests of both.

    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (the decoded bytes). Encoding and decoding share one pass, so ids,
    which are as large as the texts, never leave the task.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def make():
        bpe = loaded(shared.value, pattern)

        def work(doc_ids, texts):
            out = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = bpe.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256_hex(np.array(ids, dtype="<u4").tobytes()))
                out["decoded_sha256"].append(sha256_hex(bpe.decode(ids)))
            return out

        return work

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(id_and_text(df, id_col, text_col), make, ddl)
