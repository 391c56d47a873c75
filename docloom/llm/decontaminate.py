"""Benchmark decontamination with an FM-index of each shard of the training texts.

A shard is some MB of texts of one task. Its words become symbols: one for each word of the benchmark, one for all other
words, and an end after each document. Their suffixes are sorted (by prefix doubling), the Burrows-Wheeler transform goes
into a wavelet matrix, and the suffix positions are sampled every SAMPLE words of a document. A window of the benchmark (10
consecutive words; all words of a shorter item) is searched backwards, a word a step, by ranks in the wavelet matrix; its
occurrences are located by stepping back to a sampled position; the words that any window covers merge to removal spans.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, compared by 64-bit hash and
length. Null and empty texts have no words. Null item_ids count as the empty string; repeated items count once; an item
without words has no window. Repeated documents each give a row. An empty benchmark hits nothing; an empty table gives no rows. Texts are read whole; a
text of any length is in one shard. Extra columns are ignored, or carried along by remove().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import ALNUM, hashed, keeps_names, only, slices, small_batches, utf8, words

WINDOW = 10
SAMPLE = 8
#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text that are searched for at a time.
PHRASE_BYTES = 4 << 20
END, OTHER, FIRST = 0, 1, 2


class Phrases:
    """The windows of some benchmark items: as symbols, by length, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        texts = pa.array([t for _, t in items], pa.string())
        raw, offsets = utf8(texts)
        s, e, row = words(raw, offsets, ALNUM)
        keys = hashed(raw, s, e) if len(s) else np.zeros(0, np.uint64)
        self.vocabulary, at, back = np.unique(keys, return_index=True, return_inverse=True)
        self.lengths = (e - s)[at].astype(np.int64)
        symbols = back.astype(np.int32) + FIRST
        self.ids = [i for i, _ in items]
        first = np.searchsorted(row, np.arange(len(items) + 1))
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(1, n - window + 1), 0)  # windows of each item
        owner = np.repeat(np.arange(len(items)), many)
        start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(n[owner], window)
        # a window stands at the end of its row, END before it
        column = np.arange(window)
        at = start[:, None] + column - (window - size)[:, None]
        rows = np.where(column >= (window - size)[:, None], symbols[np.clip(at, 0, max(0, len(symbols) - 1))] if len(symbols) else END, END).astype(np.int32)
        self.table, which = np.unique(rows, axis=0, return_inverse=True)
        self.size = (self.table != END).sum(axis=1)
        pair = np.unique(which.ravel().astype(np.int64) * max(1, len(items)) + owner)  # a window's items, each once
        self.owner = (pair % max(1, len(items))).astype(np.int32)
        self.owner_start = np.searchsorted(pair, np.arange(len(self.table) + 1) * max(1, len(items)))

    def symbols(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols of words, given by hash and length."""
        if not len(self.vocabulary):
            return np.full(len(keys), OTHER, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        same = (self.vocabulary[at] == keys) & (self.lengths[at] == lengths)
        return np.where(same, at + FIRST, OTHER).astype(np.int32)


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions of a text in the order of their suffixes. Each END (at the positions `ends`) is below all words and below later ENDs."""
    n = len(symbols)
    value = symbols.astype(np.int64) + len(ends)
    value[ends] = np.arange(len(ends))
    bits = max(1, int(value.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        if k < n:
            key[: n - k] |= value[k:]
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n, np.int32)
    del value

    def regroup(slots: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
        """Rank the positions in these slots by the first slot with their key; returns the slots that are still tied."""
        new = np.ones(len(slots), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        heads = np.flatnonzero(new)
        rank[order[slots]] = slots[heads][np.cumsum(new) - 1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        return slots[~alone]

    tied = regroup(np.arange(n, dtype=np.int32), key[order])
    while len(tied):
        at = order[tied]
        after = at.astype(np.int64) + step
        key = rank[at].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        tied = regroup(tied, key[by])
        step *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence, a bit of the symbols a level, highest first."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.bits = max(1, (symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        at = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(at) - int(ones[-1]))
            at = np.concatenate([at[~bit], at[bit]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][place]
            bit = (symbol >> (self.bits - 1 - level)) & 1
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        return self._down(symbol, place) - self.first[symbol]

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at the place, and how often it stands before."""
        symbol = np.zeros(len(place), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            before = ones[place].astype(np.int64)
            bit = ones[place + 1] - before
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, self.zeros[level] + before, place - before)
        return symbol, place - self.first[symbol]


class Index:
    """The FM-index of a shard. symbols: the words of its documents, an END after each; offset: of each position in its document."""

    def __init__(self, symbols: np.ndarray, offset: np.ndarray, kinds: int) -> None:
        order = suffix_order(symbols, np.flatnonzero(symbols == END))
        self.matrix = WaveletMatrix(symbols[order - 1], kinds)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])[:-1]
        kept = offset[order] % SAMPLE == 0
        self.kept, self.kept_before, self.samples, self.n = kept, (np.cumsum(kept) - kept).astype(np.int32), order[kept], len(symbols)

    def search(self, table: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur, and their ranges of suffixes. A window stands at the end of its row."""
        which = np.arange(len(table))
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        out = []
        for step in range(1, table.shape[1] + 1):
            c = table[which, table.shape[1] - step]
            low, high = self.below[c] + self.matrix.rank(c, low), self.below[c] + self.matrix.rank(c, high)
            found = low < high
            done = found & (size[which] == step)
            out.append((which[done], low[done], high[done]))
            going = found & ~done
            which, low, high = which[going], low[going], high[going]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to a sampled one, word by word. The first word of a document is sampled, so no step leaves it."""
        position = np.empty(len(place), np.int64)
        going, steps = np.arange(len(place)), 0
        while len(going):
            here = self.kept[place]
            position[going[here]] = self.samples[self.kept_before[place[here]]] + steps
            going, place = going[~here], place[~here]
            if len(going):
                symbol, rank = self.matrix.symbol_and_rank(place)
                place = self.below[symbol] + rank
            steps += 1
        return position


def one_by_one(blocks: list) -> Iterator[Phrases]:
    """The values of broadcasts; of several, a worker holds one at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)  # it is read from disk again


def hits(raw: np.ndarray, offsets: np.ndarray, blocks: Iterable[Phrases]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Of a shard's texts: start, end and row of each word, whether it is hit, and the ids of the items found in each row."""
    s, e, row = words(raw, offsets, ALNUM)
    rows = len(offsets) - 1
    hit, items = np.zeros(len(s), bool), [set() for _ in range(rows)]
    if not len(s):
        return s, e, row, hit, items
    keys, lengths = hashed(raw, s, e), e - s
    count = np.bincount(row, minlength=rows)
    place = np.arange(len(s)) + row  # an END after each row
    first = np.cumsum(count) - count + np.arange(rows)
    n = len(s) + rows
    owner = np.repeat(np.arange(rows), count + 1)
    offset = np.arange(n) - first[owner]
    for phrases in blocks:
        if not len(phrases.table):
            continue
        text = np.zeros(n, np.int32)
        text[place] = phrases.symbols(keys, lengths)
        index = Index(text, offset, FIRST + len(phrases.vocabulary))
        which, low, high = index.search(phrases.table, phrases.size)
        many = high - low
        if not many.sum():
            continue
        window = np.repeat(which, many)
        suffix = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at = index.locate(suffix)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.size[window], -1)
        hit |= (np.cumsum(change)[:-1] > 0)[place]
        for r, w in np.unique(np.stack([owner[at], window], axis=1), axis=0).tolist():
            items[r].update(phrases.ids[k] for k in phrases.owner[phrases.owner_start[w] : phrases.owner_start[w + 1]])
    return s, e, row, hit, items


def spans_of(s: np.ndarray, e: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, from the first one's start to the last one's end."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(s[np.flatnonzero(edge == 1)].tolist(), e[np.flatnonzero(edge == -1) - 1].tolist(), strict=True))


def phrase_blocks(benchmark: DataFrame) -> list:
    """The benchmark's windows as broadcasts, PHRASE_BYTES of text each; the driver gets one block at a time."""
    spark = benchmark.sparkSession
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // PHRASE_BYTES
    return [spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("id", "text").collect()])) for k in range(blocks)]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and spans (start and end of each removal span in code points, end exclusive) of each row of docs."""
    small_batches(docs.sparkSession)
    blocks = phrase_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SHARD_BYTES):
            raw, offsets = utf8(b.column("text"))
            s, e, row, hit, items = hits(raw, offsets, one_by_one(blocks))
            n = np.bincount(row, minlength=b.num_rows)
            n_hit = np.bincount(row[hit], minlength=b.num_rows)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for r in np.flatnonzero(n_hit):
                mine = slice(*np.searchsorted(row, [r, r + 1]))
                points = np.concatenate([[0], np.cumsum((raw[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
                spans[r] = [{"start": int(points[x - offsets[r]]), "end": int(points[y - offsets[r]])} for x, y in spans_of(s[mine], e[mine], hit[mine])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of what find() returns."""
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@keeps_names
def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs with the removal spans cut out of text, n_chars being the new length; other columns and rows without hits stay as they are."""
    small_batches(docs.sparkSession)
    blocks = phrase_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SHARD_BYTES):
            column = b.schema.get_field_index("text")
            raw, offsets = utf8(b.column(column))
            s, e, row, hit, _ = hits(raw, offsets, one_by_one(blocks))
            dirty = np.unique(row[hit])
            if len(dirty):
                texts = b.column(column).to_pylist()
                size_at = b.schema.get_field_index("n_chars")  # -1 without that column
                n_chars = b.column(size_at).to_pylist() if size_at >= 0 else [None] * b.num_rows
                for r in dirty.tolist():
                    mine = slice(*np.searchsorted(row, [r, r + 1]))
                    left, at = [], offsets[r]
                    for x, y in spans_of(s[mine], e[mine], hit[mine]):
                        left.append(raw[at:x].tobytes())
                        at = y
                    left.append(raw[at : offsets[r + 1]].tobytes())
                    texts[r] = b"".join(left).decode()
                    n_chars[r] = len(texts[r])
                b = b.set_column(column, b.schema.field(column), pa.array(texts, b.schema.field(column).type))
                if size_at >= 0:
                    b = b.set_column(size_at, b.schema.field(size_at), pa.array(n_chars, pa.int64()))
            yield b

    return docs.mapInArrow(run, docs.schema)


