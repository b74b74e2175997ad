"""Token ids of whole texts under the public tokenizers, with offsets and decoding.

Vocabulary files stay where they are; their folder is a parameter, and every Python worker
loads a tokenizer once. Texts are encoded over Arrow batches in slices of bounded size.

Defined results: a null text and an empty text both have the empty list of ids; special
tokens are never added, and their strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of text that one call of a tokenizer gets at most (a longer text goes alone).
SLICE_CHARS = 1 << 20


@functools.lru_cache(maxsize=4)
def load(name: str, folder: str = TOKENIZER_DIR):
    """An encoder list[str] -> list[list[int]] of the file `name` (without ending) in `folder`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for ending in (".json", ".tiktoken", ".model"):
        path = f"{folder}/{name}{ending}"
        if os.path.exists(path):
            break
    else:
        raise FileNotFoundError(f"no tokenizer {name} in {folder}")
    if ending == ".json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    if ending == ".tiktoken":
        import importlib.util

        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(t) for t in texts]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: sp.encode(texts, num_threads=1)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of at most `limit` characters together, or of one text."""
    start, chars = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if chars and chars + n > limit:
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def encode_texts(texts: list, name: str, folder: str = TOKENIZER_DIR) -> list[list[int]]:
    encode = load(name, folder)
    out: list[list[int]] = []
    for a, b in slices(texts):
        out += encode([t or "" for t in texts[a:b]])
    return out


def encode(df: DataFrame, id: str, text: str, name: str, folder: str = TOKENIZER_DIR, counts_only: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, or (id, n_tokens int) with `counts_only`.

    One narrow stage, whole texts. Rows come out as often as they come in.
    """
    id_type = df.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = encode_texts(texts[a:b], name, folder)
                lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
                if counts_only:
                    col: pa.Array = pa.array(lengths)
                else:
                    flat = np.fromiter((x for row in ids for x in row), dtype=np.int32, count=int(lengths.sum()))
                    col = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), col], names=["id", "out"])

    schema = f"id {id_type.simpleString()}, out {'int' if counts_only else 'array<int>'}"
    out = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id), F.col("out").alias("n_tokens" if counts_only else "ids"))


# ---- bytes, offsets, decoding of byte-level tokenizers ---------------------------------

@functools.lru_cache(maxsize=1)
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(rest)) for b in range(256))


@functools.lru_cache(maxsize=2)
def token_bytes(name: str, folder: str = TOKENIZER_DIR) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level tokenizer (.json)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    back = {c: b for b, c in enumerate(byte_table())}
    out = []
    for k in range(t.get_vocab_size()):
        token = t.id_to_token(k) or ""
        out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
    return tuple(out)


def decode_ids(ids: list[int], name: str, folder: str = TOKENIZER_DIR) -> tuple[str, int, int]:
    """Text of ids, and the number of bytes at its start and end that belong to a character split by the cut.

    Those bytes are left out of the text, so the texts of successive pieces of one id list
    lose nothing but characters that a cut splits; bytes invalid in between become U+FFFD.
    """
    table = token_bytes(name, folder)
    raw = b"".join(table[k] for k in ids)
    head = 0
    while head < min(3, len(raw)) and raw[head] & 0xC0 == 0x80:
        head += 1
    tail = 0
    for back in range(1, min(4, len(raw) - head) + 1):
        b = raw[-back]
        if b & 0xC0 != 0x80:
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            tail = back if need > back else 0
            break
    return raw[head:len(raw) - tail].decode("utf-8", "replace"), head, tail


def token_offsets(ids: list[int], text: str, name: str, folder: str = TOKENIZER_DIR) -> tuple[list[int], list[int]]:
    """Start and end character of every token; a token that ends inside a character ends after it."""
    table = token_bytes(name, folder)
    ends = np.cumsum([len(table[k]) for k in ids]) if ids else np.empty(0, dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    upto = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters begun before each byte
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    begun = upto[np.minimum(starts + 1, len(raw))] - 1
    return begun.astype(int).tolist(), upto[np.minimum(ends, len(raw))].astype(int).tolist()


def round_trip(df: DataFrame, id: str, text: str, name: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, n_tokens, n_bytes, same, split_tokens): whether decoding gives the text back, and how many tokens end inside a character.

    `same` is null for a null text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(name, folder)
        size = np.array([len(b) for b in table])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for t, ids in zip(texts, encode_texts(texts, name, folder)):
                raw = (t or "").encode()
                ends = np.cumsum(size[ids])[:-1] if ids else np.empty(0, dtype=np.int64)
                inside = int(np.sum((np.frombuffer(raw, dtype=np.uint8)[ends] & 0xC0) == 0x80)) if len(ends) else 0
                rows.append((len(ids), len(raw), None if t is None else decode_ids(ids, name, folder)[0] == t, inside))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32())],
                                             names=["id", "n_tokens", "n_bytes", "same", "split_tokens"])

    schema = f"id {df.schema[id].dataType.simpleString()}, n_tokens int, n_bytes bigint, same boolean, split_tokens int"
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)
