"""BPE encoding and decoding.

A word's symbols form a doubly linked list; the merges that could be made wait in a priority queue by rank (then place).
A popped merge is skipped when one of its two symbols has changed since it was queued. Decoding strings together the
vocabulary's strings of the ids. Each worker keeps the encodings of recent words, a bounded number.

Nulls and empty texts have no tokens and an empty decoding. Texts of any length are encoded whole. Repeated rows each give
a row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm._shared import only, slices, small_batches

#: Most words, and most tokens between white space, whose encoding a worker remembers, in each of two generations.
REMEMBERED_WORDS, REMEMBERED_TOKENS = 120_000, 40_000
#: Longer words are encoded afresh each time.
LONGEST_REMEMBERED = 64
#: A queued merge is one integer: the merge, then so many bits for the place of its left symbol.
PLACES = 40
LAST_PLACE = (1 << PLACES) - 1
#: str.split() also splits at these four, which are no white space to the vocabulary's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")


def load(path: str) -> dict:
    """What encoding needs from a tokenizers JSON file: vocabulary, merge ranks, whole-text tokens, the splitting pattern. Checked for the features implemented here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["unk_token"] is not None:
        raise ValueError(f"{path}: not a word BPE of the kind supported here")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {
        "vocab": model["vocab"],
        "merges": merges,
        "suffix": model["end_of_word_suffix"] or "",
        "whole": {x["content"]: x["id"] for x in spec["added_tokens"]},
        "late": late_characters(),
        "split": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


def late_characters() -> str:
    """Letters and numbers of Unicode versions later than Python's own, as the inside of a pattern's class: neither letters nor numbers to the tokenizers library."""
    found = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]))) if unicodedata.category(c) == "Cn"]
    spans: list[list[int]] = []
    for c in map(ord, found):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Memory:
    """Remembers up to twice `most` results, the recent ones: when one generation is full, the one before it goes."""

    def __init__(self, make, most: int) -> None:
        self.new, self.old, self.make, self.most = {}, {}, make, most

    def __call__(self, word: str) -> tuple[int, str, str]:
        if (got := self.new.get(word)) is None:
            if (got := self.old.get(word)) is None:
                got = self.make(word)
                if len(word) > LONGEST_REMEMBERED:
                    return got
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got


class Codec:
    """Encodes and decodes with the vocabulary that load() returned."""

    def __init__(self, spec: dict) -> None:
        self.vocab, self.suffix, self.whole = spec["vocab"], spec["suffix"], spec["whole"]
        self.strings = {i: s for s, i in {**self.vocab, **self.whole}.items()}
        if max(self.vocab.values()) > 0xFFFF:
            raise ValueError("ids beyond 16 bits are not supported")
        # two neighbours' ids, 16 bits each -> the merge: its rank, then 16 bits for the id of what they become
        self.ranks = {self.vocab[a] << 16 | self.vocab[b]: rank << 16 | self.vocab[a + b] for rank, (a, b) in enumerate(spec["merges"])}
        self.pattern = regex.compile(spec["split"])
        self.late = regex.compile(f"[{late}]") if (late := spec["late"]) else None
        self.late_pattern = regex.compile(spec["split"].replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{late}])").replace("[\\p{L}]", f"(?:(?![{late}])\\p{{L}})").replace("[\\p{N}]", f"(?:(?![{late}])\\p{{N}})"))
        self.parts = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.whole, key=len, reverse=True)) + ")") if self.whole else None
        self.inner = [self.vocab[c] for c in byte_characters()]
        self.final = [self.vocab[c + self.suffix] for c in byte_characters()]
        self.word, self.token = Memory(self._word, REMEMBERED_WORDS), Memory(self._token, REMEMBERED_TOKENS)

    def merged(self, word: str) -> list[int]:
        """The ids of one word, by merging neighbours, lowest rank first."""
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n, get = len(ids), self.ranks.get
        if n == 1:
            return ids
        # the end, reached from both sides of the list, is a symbol with which nothing merges
        ids.append(-1)
        before, after = [n, *range(n)], [*range(1, n + 1), n]
        queue = [found << PLACES | at for at in range(n - 1) if (found := get(ids[at] << 16 | ids[at + 1]))]
        heapq.heapify(queue)
        while queue:
            first = heapq.heappop(queue)
            at, merge = first & LAST_PLACE, first >> PLACES
            right = after[at]
            if get(ids[at] << 16 | ids[right]) != merge:
                continue  # stale: one of the two symbols was merged meanwhile
            ids[at], ids[right] = made, _ = merge & 0xFFFF, -1
            after[at] = beyond = after[right]
            before[beyond] = at
            if found := get(made << 16 | ids[beyond]):
                heapq.heappush(queue, found << PLACES | at)
            left = before[at]
            if found := get(ids[left] << 16 | made):
                heapq.heappush(queue, found << PLACES | left)
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> tuple[int, str, str]:
        """How many ids a word has, the ids as text, and their decoding."""
        ids = self.merged(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _token(self, token: str) -> tuple[int, str, str]:
        """The same for what stands between white space: one or more words."""
        pattern = self.late_pattern if self.late and not token.isascii() and self.late.search(token) else self.pattern
        found = [self.word(w) for w in pattern.findall(token)]
        if len(found) == 1:
            return found[0]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def encoded(self, text: str | None) -> list[tuple[int, str, str]]:
        """For each token of a text, in order: how many ids, the ids as text, their decoding."""
        out: list[tuple[int, str, str]] = []
        for part in self.parts.split(text) if self.parts and text else [text or ""]:
            if part in self.whole:
                out.append((1, str(self.whole[part]), part))
                continue
            # lower case goes character by character, so that a final sigma is like any other
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            tokens = SPACES.split(plain) if SEPARATORS.search(plain) else plain.split()
            get, slow = self.token.new.get, self.token
            out += [get(t) or slow(t) for t in tokens if t]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.encoded(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of the ids, one space between (the files of this kind have no decoder of their own)."""
        return " ".join([self.strings[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec_of(name: str, spec) -> Codec:
    """The codec of a vocabulary (a broadcast), made once a worker, so that its memory serves the next tasks; a worker keeps one."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(spec.value)
    return _codecs[name]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, if with_ids), ids_sha256 of the decimal ids joined by one space, and decoded_sha256 of the decoded text. One narrow pass; the vocabulary (a file of fixed size) is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    loaded = load(path)
    spec = spark.sparkContext.broadcast(loaded)
    name = hashlib.sha256(repr(sorted(loaded.items(), key=str)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.bpe import codec_of  # the worker's own module, which outlives the task

        codec = codec_of(name, spec)
        for b in slices(batches):
            n, all_ids, ids_sha, text_sha = [], [], [], []
            for text in b.column("text").to_pylist():
                found = codec.encoded(text)
                n.append(sum([x[0] for x in found]))
                ids_text = " ".join([x[1] for x in found]).encode()
                ids_sha.append(hashlib.sha256(ids_text).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids_text.split(), np.int32))
            columns = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            columns |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return only(docs, "doc_id", "text").mapInArrow(run, schema)
