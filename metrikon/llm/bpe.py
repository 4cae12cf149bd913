"""BPE encoding and decoding by batched numpy merge rounds.

The merge table is two sorted arrays: pair keys (left id, right id) and their ranks.
Symbols of many words lie in one flat array. A round looks all neighbouring pairs up
by binary search, takes each word's lowest rank and merges its occurrences from left
to right; finished words leave. Only words that a bounded cache lacks are encoded.

The vocabulary file is a parameter; its normaliser, split pattern and word-end mark
are those of a lower-casing BPE with word ends (NFC, white space runs to one space,
letter by letter lower case).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for PLAIN characters, on which both engines' classes agree; this engine is faster.
PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
PLAIN = re.compile("[\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*")
CACHE = 150_000
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        # If a token's own pairs rank after every pair that makes it, equal pairs of a word can merge in one round.
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.at_once = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.path, self.library, self.room = path, None, cache

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the non-empty words and the number for each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            key = np.concatenate([ids[:-1] << 32 | ids[1:], [-1]])
            key[:-1][word[1:] != word[:-1]] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(first, append=len(ids)))
            hit = (rank == least) & (rank < NONE)
            where = np.flatnonzero(hit)
            # Of overlapping or (if need be) all occurrences of a word, the leftmost counts: every other one of a run.
            if self.at_once:
                new = np.concatenate([[True], np.diff(where) > 1])
                begin = np.maximum.accumulate(np.where(new, np.arange(len(where)), 0)) if len(where) else where
                where = where[(np.arange(len(where)) - begin) % 2 == 0]
            else:
                where = where[np.concatenate([[True], np.diff(word[where]) > 0])] if len(where) else where
            idle = least == NONE
            done_ids.append(ids[idle])
            done_word.append(word[idle])
            ids[where] = self.made[at[where]]
            keep = ~idle
            keep[where + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), sizes
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder is read; unknown ids are left out."""
        return " ".join(t for t in map(self.tokens.get, ids) if t is not None)

    def pieces(self, text: str) -> list[str]:
        """Words of a text, special tokens among them."""
        if any(t in text for t in self.special):
            out = []
            for k, part in enumerate(self.cut.split(text)):
                out += [part] if k % 2 else self.pieces_of(part)
            return out
        return self.pieces_of(text)

    def pieces_of(self, text: str) -> list[str]:
        if text.isascii():
            return PLAIN_SPLIT.findall(text.lower()) if PLAIN.fullmatch(text) else self.split.findall(text.lower())
        if max(text) > "\u0530" and (not unicodedata.is_normalized("NFC", text) or any(unicodedata.category(c) == "Cn" for c in set(text))):
            return self.library_pieces(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (PLAIN_SPLIT if PLAIN.fullmatch(text) else self.split).findall(text)

    def library_pieces(self, text: str) -> list[str]:
        """For texts on which the interpreter's and the tokenizers library's Unicode tables can differ: the library's own."""
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        byte = {c: b for b, c in enumerate(byte_letters())}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, x)).decode() for x, _ in split]

    def learn(self, words: set[str]) -> None:
        """Encodes the words that the cache lacks."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.room:  # what this batch uses stays
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        special = [w for w in new if w in self.special]
        self.cache |= {w: (np.uint32(self.special[w]).astype("<u4").tobytes(), w) for w in special}
        new = [w for w in new if w not in self.special]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            ids, sizes = self.merge([w.encode("utf-8", "surrogatepass") for w in part])
            ends = np.cumsum(sizes).tolist()
            flat, low, tokens = ids.astype("<u4").tobytes(), ids.tolist(), self.tokens
            begin = 0
            for w, end in zip(part, ends, strict=True):
                self.cache[w] = flat[4 * begin : 4 * end], " ".join([tokens[i] for i in low[begin:end]])
                begin = end

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and their decoding."""
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and size < 1 << 20:
                words.append(self.pieces(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set(chain.from_iterable(words)))
            found = self.cache
            for w in words:
                both = [found[x] for x in w]
                yield b"".join([x[0] for x in both]), " ".join([x[1] for x in both])


@functools.cache
def coder_of(path: str) -> Bpe:
    """One for each worker process, which keeps its cache from task to task."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded string) or, without keep, their digests instead.

    Null and empty texts have no tokens. Rows, repeated ones too, stay as they are; doc_id may
    be null; other columns are ignored. A very long text is one unit of memory.
    """
    last = ("ids", "decoded") if keep else ("ids_sha256", "decoded_sha256")
    schema = "doc_id long, n_tokens long, " + ("ids binary, decoded string" if keep else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # so many rows at a time, so that a batch's texts are not held twice
                part, n, one, two = b.slice(at, 256), [], [], []
                for ids, text in coder.encode([x or "" for x in part.column(1).to_pylist()]):
                    n.append(len(ids) // 4)
                    one.append(ids if keep else hashlib.sha256(ids).hexdigest())
                    two.append(text if keep else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.binary() if keep else pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", *last])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
