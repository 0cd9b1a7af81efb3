"""BPE encoding by dynamic programming over prefixes, and decoding.

A word is a string of base symbols, the last with its word-end mark. An automaton over the vocabulary finds, at each
position, every token that is a suffix of the prefix read so far. The last token of a prefix's encoding is unique: it is
the one whose predecessor (the last token of the shorter prefix) forms a compatible pair with it, that is, the two
tokens' own text encodes to just them. It is stored for each prefix, and back-pointers from the whole word give the ids.
Distinct words are encoded once per task and kept in a bounded cache of two generations: a full one becomes the old one,
and words that are met again move back, so that frequent words are never encoded anew.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; a null
doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm._common import prepare

#: Of texts with only these characters, `re` and str.lower() split and fold as the tokenizers library does.
PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ž‐-‧‰-›€]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
CACHE_WORDS, CACHE_CHARS = 200_000, 40


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.vocab, self.added = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letter = [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.packed(a), self.packed(b)): k for k, (a, b) in enumerate(pairs)}
        self.ids = {self.packed(t): i for t, i in self.vocab.items() if t not in self.added}
        text = {i: t for t, i in self.vocab.items()}
        self.id_of = {t: str(i) for t, i in self.ids.items()}
        self.text_of = {t: text[i] for t, i in self.ids.items()}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            # only tokens that encode to themselves can stand in an encoding
            if self.merged(t) == [t]:
                self.automaton.add_word(t, (t, len(t)))
        self.automaton.make_automaton()
        # word -> number of ids, ids, token texts (each joined by a space): three tables for the new generation, one for the old
        self.counts: dict[str, int] = {}
        self.id_texts: dict[str, str] = {}
        self.token_texts: dict[str, str] = {}
        self.old: tuple[dict[str, int], dict[str, str], dict[str, str]] = ({}, {}, {})

    def packed(self, token: str) -> str:
        """A token with its word-end mark folded into the last symbol, so that each symbol is one character."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0xE000)
        return token

    def merged(self, symbols: str) -> list[str]:
        """Plain merging by rank, for token texts only (to build the automaton and test pairs)."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens' own text encodes to just them; remembered."""
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        known = self.compatible[a, b] = self.merged(a + b) == [a, b]
        return known

    def last_tokens(self, symbols: str) -> list[str]:
        """The tokens of a word's symbols: the last token of every prefix, then back-pointers."""
        last: list[str | None] = [None] * len(symbols)
        known = self.compatible.get
        for at, (token, size) in self.automaton.iter(symbols):
            # the automaton reports a position's suffixes from the longest; the first compatible one is the only one
            if last[at] is None:
                if size > at:
                    last[at] = token
                elif (before := last[at - size]) is not None:
                    fit = known((before, token))
                    if self.fits(before, token) if fit is None else fit:
                        last[at] = token
        out, at = [], len(symbols) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                raise ValueError("the vocabulary lacks a base symbol")
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids and token texts (each joined by a space) of a split word."""
        letters = word if word.isascii() and word.isalnum() else "".join(map(self.letter.__getitem__, word.encode("utf-8", "replace")))
        tokens = self.last_tokens(letters[:-1] + chr(ord(letters[-1]) + 0xE000) if self.end else letters)
        return len(tokens), " ".join(map(self.id_of.__getitem__, tokens)), " ".join(map(self.text_of.__getitem__, tokens))

    def learn(self, words: set[str]) -> list[str]:
        """Put words into the new generation; those too long to stay there are returned."""
        counts, ids, tokens = self.counts, self.id_texts, self.token_texts
        old_counts, old_ids, old_tokens = self.old
        for w in words:
            if w in old_counts:
                counts[w], ids[w], tokens[w] = old_counts[w], old_ids[w], old_tokens[w]
            else:
                counts[w], ids[w], tokens[w] = self.word(w)
        return [w for w in words if len(w) > CACHE_CHARS]

    def forget(self, words: list[str]) -> None:
        for table in (self.counts, self.id_texts, self.token_texts):
            for w in words:
                del table[w]
        if len(self.counts) >= CACHE_WORDS:
            self.old = (self.counts, self.id_texts, self.token_texts)
            self.counts, self.id_texts, self.token_texts = {}, {}, {}

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return SPLIT.findall(text.lower())
        # any other text is folded and split by the library itself
        folded = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letter)}
        return [bytes(back[c] for c in piece).decode("utf-8", "replace") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by a space, and the decoded text."""
        n, ids, tokens, at = 0, [], [], 0
        marks = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special and "<|" in text else []
        for begin, end in [*marks, (len(text), len(text))]:
            if begin > at:
                words = self.words(text[at:begin])
                long = self.learn(set(words).difference(self.counts))
                n += sum(map(self.counts.__getitem__, words))
                if words:
                    ids.append(" ".join(map(self.id_texts.__getitem__, words)))
                    tokens.append(" ".join(map(self.token_texts.__getitem__, words)))
                self.forget(long)
            if end > begin:
                n += 1
                ids.append(str(self.added[text[begin:end]]))
                tokens.append(text[begin:end])
            at = end
        return n, " ".join(ids), " ".join(tokens)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids and decoded as strings."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        digest = lambda s: sha256(s.encode("utf-8", "replace")).hexdigest()
        for b in batches:
            n, i, d, texts = [], [], [], []
            for t in b.column("text").to_pylist():
                count, ids, decoded = bpe.encode(t or "")
                n.append(count)
                i.append(digest(ids))
                d.append(digest(decoded))
                if keep_text:
                    texts.append((ids, decoded))
            more = [pa.array([x[k] for x in texts], pa.string()) for k in (0, 1)] if keep_text else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep_text)
