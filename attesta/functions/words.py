"""Words of whole batches of texts, for use inside tasks: the same as tokenize(), by arrays of bytes."""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_")]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words ([A-Za-z0-9_]+ in lower case) of all texts, one after another, and for each the number of its text. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]  # a word ends with its text
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    kept = _LOWER[data[inside]]
    starts = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return np.searchsorted(ends, at, side="right").astype(np.int64) - 1, words.dictionary_encode()


def counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, the distinct words of all, and for each text and distinct word of it both numbers and how often it is there."""
    of, words = words_of(texts)
    width = max(1, len(words.dictionary))
    pairs, tf = np.unique(of * width + words.indices.to_numpy(), return_counts=True)
    return np.bincount(of, minlength=len(texts)), words.dictionary, pairs // width, pairs % width, tf


def hashed(words: list[str], dim: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word among dim, and its sign."""
    digests = [md5(w.encode()).digest() for w in words] if mode == "md5" else [blake2b(w.encode(), digest_size=8).digest() for w in words]
    heads = np.frombuffer(b"".join([h[:5] for h in digests]) or bytes(0), dtype=np.uint8).reshape(-1, 5).astype(np.int64)
    return (heads[:, :4] @ [1 << 24, 1 << 16, 1 << 8, 1]) % dim, 1 - 2 * (heads[:, 4] % 2)
