"""Language-model scores by online logistic context mixing, beside an add-one unigram base.

Texts are scored as their tokens: lower-case words, each with a space behind it, then an end symbol.

Symbols. A symbol is coded by the decisions along its path in a Huffman tree over the training symbols behind the same letter. Predictors of a
decision (the last 3 letters, and all letters, of the word so far) look up hashed slots of decision counts over all
training rows. Their logits are mixed by weights that a gate chooses (depth in the tree, and whether either context
has been seen); every STEP tokens the weights move along the gradient of the coding cost. They are carried through the whole text, whatever its length. Contexts end at the word's start, so a slice's
distinct words are hashed and looked up once.

Tokens. Three experts give a token's probability: its symbols; its count in the corpus; and how often it followed the
two words before it. Every token is coded by its symbols, whatever the others say. The experts' weights, by how often those two words were seen, are refined after every FEW tokens by
each expert's share in what was coded. Counts of tokens and word triples grow with the corpus and are never gathered
in one place: a slice of documents sends each of its distinct keys once, dealt over buckets by hash, and gets totals back.
A training text is scored by the counts of the others: its own tokens are taken off. (The slots, of fixed size, count
it in.) Words are told apart by 128-bit hashes, triples by 32 bits and the bucket.

Null texts count as empty: one end token. Repeated rows get equal scores and each counts in training. Without training
rows decisions have probability 1/2 at first. Tables without rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, fold, mapped, ranges, reuse_memory, slices, stored, table, utf8
from .simhash_pigeonhole import word_spans

END = 0xFF  # no byte of UTF-8
#: Predictors as (letters of context, hash bits of its slots); 8 stands for the whole word so far (its last 8 letters and length).
PREDICTORS = ((3, 20), (8, 22))
WEIGHTS = (0.55, 0.55)
SCALE = 15.0  # logits are kept in steps of 1/SCALE
RATE, FLOOR = 0.02, 1 / 4096
GATES = 24
#: Tokens of a text between two updates, and tokens that are worked on at once (their decisions fit a processor's cache).
STEP, GROUP = 16, 1 << 11
#: Bytes of text of a slice, and bytes of keys of a bucket.
SLICE, BUCKET = 6 << 20, 32 << 20
#: Tokens between two updates of the experts' weights; their first weights without and with known words before.
FEW = 16
EXPERTS = np.array([[0.8, 1.2, 0.0], [0.5, 0.8, 0.2], [0.5, 0.8, 0.2], [0.5, 0.8, 0.3]])
RANGES = 32
#: Texts are packed once, and lie on disk twice.
TEXT_LEVEL = 3

F4 = np.float32


def _pack(raw: bytes | np.ndarray, level: int = 1) -> bytes:
    """Compressed; numbers of an array by their bytes, all lowest ones first. In front: how many parts there are, and their sizes."""
    zstd = zstandard.ZstdCompressor(level=level)
    if isinstance(raw, np.ndarray):
        parts = [zstd.compress(x.tobytes()) for x in np.ascontiguousarray(raw).view(np.uint8).reshape(-1, raw.itemsize).T]
    else:
        parts = [zstd.compress(raw)]
    return b"".join([bytes([len(parts)]), np.array([len(x) for x in parts], "<u4").tobytes(), *parts])


def _unpack(raw: bytes, kind=np.uint8) -> np.ndarray:
    zstd, raw, width = zstandard.ZstdDecompressor(), memoryview(raw), raw[0]
    ends = np.cumsum(np.frombuffer(raw, "<u4", width, 1), dtype=np.int64) + 1 + 4 * width
    parts = [np.frombuffer(zstd.decompress(raw[a:b]), np.uint8) for a, b in zip([1 + 4 * width, *ends[:-1]], ends)]
    return (parts[0] if width == 1 else np.stack(parts, 1).reshape(-1)).view(kind)


# --- words and their symbols


class Words:
    """Texts given as words with a space behind each: number of every word, and the distinct words' symbols (letters, then
    the space). Last comes an entry for the end of a text, with the end symbol alone."""

    def __init__(self, text: np.ndarray):
        width = np.diff(np.flatnonzero(text == 32), prepend=-1) - 1
        coded = binaries(text[text != 32], np.concatenate([[0], np.cumsum(width)])).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        at, letters = utf8(coded.dictionary)
        self.size = np.append(np.diff(at) + 1, 1)
        self.at = np.cumsum(self.size) - self.size
        self.symbols = np.full(int(self.size.sum()), 32, np.uint8)
        self.symbols[ranges(self.at[:-1], self.size[:-1] - 1)] = letters
        self.symbols[-1] = END
        before = np.concatenate([[32], self.symbols[:-1]]).astype(np.int64)
        before[self.at] = 32
        self.pairs = before << 8 | self.symbols  # each symbol with the one before it in its word, or a space

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol the letters of its word before it: the last 8 as a number, and how many there are."""
        length = np.arange(len(self.symbols)) - np.repeat(self.at, self.size)
        padded = np.concatenate([np.zeros(8, np.uint8), self.symbols])
        before = np.ndarray(len(self.symbols), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        return before & MASKS[np.minimum(length, 8)], length


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashed(k: int, letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A predictor's 32-bit context hash."""
    size = PREDICTORS[k][0]
    x = letters & MASKS[size]
    x += np.minimum(length, size if size < 8 else 255).astype(np.uint64) << np.uint64(56)
    x *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def slot(k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = context + node * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(32 - PREDICTORS[k][1])).astype(np.int64)


class Tree:
    """Paths of Huffman trees over the symbols, one for each symbol before (a space at a word's start): each decision as
    node, bit and depth. counts: [before, symbol]."""

    def __init__(self, counts: np.ndarray):
        every, paths = counts.sum(0), []
        for own in counts:
            heap = [(int(c) * 256 + 1, k) for k, c in enumerate(own if own.any() else every)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            for made in range(256, 511):
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x], parent[y] = (made, 0), (made, 1)
                heapq.heappush(heap, (a + b, made))
            for k in range(256):
                path = []
                while k in parent:
                    k, bit = parent[k]
                    path.append((k - 256, bit))
                paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths])
        self.at = np.cumsum(self.size) - self.size
        self.codes = np.array([node | bit << 8 | depth << 9 for p in paths for depth, (node, bit) in enumerate(p)], np.uint32)

    def decisions(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions of each pair (before << 8 | symbol); node, bit and depth of each decision."""
        size = self.size[pairs]
        code = self.codes[ranges(self.at[pairs], size)]
        return size, code & np.uint32(255), (code >> np.uint32(8) & np.uint32(1)).astype(F4), (code >> np.uint32(9)).astype(np.int64)


def _slots(tree: Tree, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For pieces of the distinct words' symbols, which fit a processor's cache: number of decisions of each symbol; of each
    decision its symbol, bit and depth; and its slots of each predictor."""
    letters, length = words.contexts()
    contexts = [hashed(k, letters, length) for k in range(len(PREDICTORS))]
    for a in range(0, len(words.symbols), 1 << 13):
        here = slice(a, a + (1 << 13))
        count, node, bit, depth = tree.decisions(words.pairs[here])
        of = np.repeat(np.arange(len(count)), count)
        yield count, of + a, bit, depth, [slot(k, c[here][of], node) for k, c in enumerate(contexts)]


def prepared(tables: list[np.ndarray], tree: Tree, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct word's first decision and number of decisions; of a decision the inputs, and gate << 1 | bit, as 4 bytes."""
    counts = tree.size[words.pairs]
    out, at = np.zeros((int(counts.sum()), 4), np.int8), 0
    for _, of, bit, depth, slots in _slots(tree, words):
        own = out[at : at + len(of)]
        at += len(of)
        for k, t in enumerate(tables):
            own[:, k] = t[slots[k]]
        gate = np.minimum(depth, 5) * 4 + (np.abs(own[:, 1]) > 7) * 2 + (np.abs(own[:, 0]) > 7)
        own[:, 3] = gate << 1 | bit.astype(np.int64)
    size = np.add.reduceat(counts, words.at)
    return np.cumsum(size) - size, size, out.view(np.uint32)[:, 0]


def symbol_costs(tables: list[np.ndarray], tree: Tree, words: Words, tokens: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """log2 probability of every token by its symbols. tokens: entries of words, the end of each text included."""
    first, size, packed = prepared(tables, tree, words)
    four = packed.view(np.int8).reshape(-1, 4)
    # as _group_costs() takes them: inputs count against the bit that comes, and the gate alone
    sign = np.int8(1) - ((four[:, 3] & np.int8(1)) << np.int8(1))
    for k in range(2):
        four[:, k] *= sign
    four[:, 3] >>= 1
    at = np.cumsum(n_tokens) - n_tokens
    out = np.zeros(len(tokens))
    order = np.argsort(-n_tokens, kind="stable")[: np.count_nonzero(n_tokens)]
    some = GROUP // STEP
    for a in range(0, len(order), some):
        _group_costs(first, size, packed, tokens, at[order[a : a + some]], n_tokens[order[a : a + some]], out)
    out *= -1 / np.log(2)
    return out


def _group_costs(first, size, packed, tokens, at, n_tokens, out) -> None:
    """Costs (natural logarithms) of some texts, the longest first, STEP tokens of each at a time."""
    cells = len(n_tokens) * GATES
    weights = np.full(cells, complex(*WEIGHTS) / SCALE, np.complex64)  # both weights of a cell side by side: one lookup
    for step in range(0, int(n_tokens[0]), STEP):
        n = int(np.searchsorted(-n_tokens, -step, "left"))  # texts that are longer than step
        m = np.minimum(STEP, n_tokens[:n] - step)
        places = ranges(at[:n] + step, m)
        word = tokens[places]
        count = size[word]
        heads = np.cumsum(count) - count
        spots = np.repeat(first[word] - heads, count)
        spots += np.arange(len(spots))
        four = packed[spots].view(np.int8).reshape(-1, 4)
        gate = np.repeat(np.repeat(np.arange(n) * GATES, m), count)
        gate += four[:, 3]
        inputs = [four[:, k].astype(F4) for k in range(2)]
        own = weights[gate]
        z = own.real * inputs[0]
        z += own.imag * inputs[1]
        np.clip(z, -9, 9, out=z)
        np.exp(z, out=z)
        z += F4(1)  # 1 / probability of the bit that comes
        error = np.reciprocal(z)
        np.subtract(F4(1), error, out=error)
        np.minimum(z, F4(1 / FLOOR), out=z)
        out[places] = np.add.reduceat(np.log(z, out=z), heads, dtype=np.float64)
        for part, x in zip((weights.real, weights.imag), inputs):
            x *= error
            part -= (np.bincount(gate, x, cells) * (RATE / SCALE**2)).astype(F4)


# --- slices of documents


SLICES = "slice long, doc_ids array<{kind}>, held array<boolean>, n_bytes array<long>, n_words array<long>, pairs array<int>, pair_counts array<long>, text binary"


def sliced(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out): one row for each slice, its texts as words with single spaces, packed; pairs: neighbouring symbols of training texts with their counts."""
    schema = SLICES.format(kind=dict(docs.dtypes)["doc_id"])
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, j in slices(utf8(batch.column(1))[0], SLICE):
                part = batch.slice(i, j - i)
                offsets, data = utf8(part.column(1))
                raw, starts, ends, words = word_spans(offsets, data)
                sizes = np.diff(np.concatenate([[0], np.cumsum(ends - starts + 1)])[np.concatenate([[0], np.cumsum(words)])])
                text = np.frombuffer(raw, np.uint8)  # words with one space behind each, nothing else
                learn = ~part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                pairs = _neighbours(text[np.repeat(learn, sizes)])
                pairs[32 << 8 | END] += int(learn.sum())
                some = np.flatnonzero(pairs)
                lists = [part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.array(words), pa.array(some.astype(np.int32)), pa.array(pairs[some])]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(_one(x) for x in lists), pa.array([_pack(raw, TEXT_LEVEL)], pa.binary())], names=names)
                number += 1

    return mapped(docs.select("doc_id", "text", "held_out"), run, schema)


def _neighbours(text: np.ndarray) -> np.ndarray:
    """How often each symbol stands behind each (before << 8 | symbol), counted by pieces; a space stands before the first."""
    pairs, before = np.zeros(1 << 16, np.int64), np.uint8(32)
    for a in range(0, len(text), 1 << 18):
        own = text[a : a + (1 << 18)].astype(np.int64)
        pairs += np.bincount(np.concatenate([[before], own[:-1]]) << 8 | own, minlength=1 << 16)
        before = own[-1]
    return pairs


def _one(values: pa.Array) -> pa.ListArray:
    """The values as the only list of an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# --- the slots of the predictors


def _slot_counts(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, cells): decision counts of a task's training texts, packed by ranges of slots."""
        reuse_memory()
        total = [np.zeros(2 << bits, np.int32) for _, bits in PREDICTORS]
        for batch in batches:
            for held, n_words, text in zip(*(batch.column(k) for k in range(3))):
                words, n_words = Words(_unpack(text.as_py())), np.asarray(n_words.values)
                learn = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
                times = np.append(np.bincount(words.code[np.repeat(learn, n_words)], minlength=len(words.distinct)), learn.sum())
                times = np.repeat(times, words.size).astype(np.int32)
                # added to the counts by pieces: a copy of all counts for each slice would take three times their memory
                for _, of, bit, _, slots in _slots(tree, words):
                    bit, n = bit.astype(np.int64), times[of]
                    for t, x in zip(total, slots):
                        x *= 2
                        x += bit
                        np.add.at(t, x, n)
        for k, t in enumerate(total):
            for r, own in enumerate(t.reshape(RANGES, -1)):
                at = np.flatnonzero(own)
                if len(at):
                    cells = _pack(np.concatenate([np.diff(at, prepend=0), own[at]]).astype("<i4"))
                    yield pa.RecordBatch.from_arrays([pa.array([k * RANGES + r], pa.int32()), pa.array([cells], pa.binary())], names=["part", "cells"])

    return run


def _slot_logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: each part's logits."""

    def done(part, total):
        ones, zeros = total[1::2], total[::2]
        logit = np.clip(np.rint(SCALE * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(logit.tobytes())], pa.binary())], names=["part", "logits"])

    part, total = None, None
    for batch in batches:
        for p, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != part:
                if part is not None:
                    yield done(part, total)
                part, total = p, np.zeros((2 << PREDICTORS[p // RANGES][1]) // RANGES, np.int64)
            cells = _unpack(cells.as_py(), "<i4")
            at, n = np.split(cells, 2)
            total[np.cumsum(at, dtype=np.int64)] += n
    if part is not None:
        yield done(part, total)


def train(rows: DataFrame, tree: Tree) -> list[np.ndarray]:
    """The predictors' logits by slot: of fixed size, and so is what is collected."""
    cells = mapped(rows.select("held", "n_words", "text"), _slot_counts(tree), "part int, cells binary")
    got = mapped(cells.repartition("part").sortWithinPartitions("part"), _slot_logits, "part int, logits binary").collect()
    out = [np.zeros(1 << bits, np.int8) for _, bits in PREDICTORS]
    for r in got:
        own = out[r.part // RANGES].reshape(RANGES, -1)
        own[r.part % RANGES] = _unpack(bytes(r.logits), np.int8)
    return out


# --- keys of words and word triples


class Keys:
    """A slice's tokens as keys: 128-bit hashes of its distinct words, in their order; and 64-bit hashes of each token with
    two words before it, as the bucket and 32 bits. Hash order is bucket order."""

    def __init__(self, words: Words, n_words: np.ndarray, buckets: int):
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join(map(digest, words.distinct.to_numpy(zero_copy_only=False))), ">u8").reshape(-1, 2).astype(np.uint64)
        by = np.argsort(raw[:, 0], kind="stable")
        self.words = raw[by]
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.word = back[words.code]  # number of each word in self.words
        self.of_words = np.searchsorted(_place(self.words[:, 0], buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        self.doc = np.repeat(np.arange(len(n_words)), n_words)
        self.tokens = n_words + 1  # words, then one end for each text
        self.first = np.cumsum(self.tokens) - self.tokens
        self.word_at = np.arange(len(words.code)) + self.doc  # place of a word among the tokens
        self.token_doc = np.repeat(np.arange(len(n_words)), self.tokens)
        h = np.full(len(self.token_doc), np.uint64(0xD6E8FEB86659FD93))
        h[self.word_at] = raw[words.code, 1]
        self.at = np.flatnonzero(np.arange(len(h)) - np.repeat(self.first, self.tokens) >= 2)  # tokens with two words before them
        two = (h[self.at - 2] * np.uint64(0x9E3779B97F4A7C15) ^ h[self.at - 1]) * np.uint64(0xBF58476D1CE4E5B9)
        two ^= two >> np.uint64(31)
        three = (two ^ h[self.at]) * np.uint64(0x94D049BB133111EB)
        three ^= three >> np.uint64(29)
        self.two, self.three = _place(two * np.uint64(0x9E3779B97F4A7C15), buckets), _place(three * np.uint64(0x9E3779B97F4A7C15), buckets)


def _place(key: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits of the place within it, of key * buckets >> 32; ascends with the key. Up to 2 ** 31 buckets."""
    n = np.uint64(buckets)
    return (key >> np.uint64(32)) * n + ((key & np.uint64(0xFFFFFFFF)) * n >> np.uint64(32))


def _sent(buckets: int):
    def one(number, held, n_words, text) -> pa.RecordBatch:
        """(bucket, slice, words, word_counts, grams, gram_counts): a slice's keys of each bucket with their counts in training texts."""
        n_words = np.asarray(n_words.values)
        keys = Keys(Words(_unpack(text.as_py())), n_words, buckets)
        learn = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
        words = np.bincount(keys.word[learn[keys.doc]], minlength=len(keys.words)).astype("<i4")
        grams = np.concatenate([keys.two, keys.three])
        taught = np.tile(learn[keys.token_doc[keys.at]], 2)
        # sorted with the teaching mark as the lowest bit
        grams = np.sort(grams << np.uint64(1) | taught.astype(np.uint64))
        taught, grams = (grams & np.uint64(1)).astype(np.int64), grams >> np.uint64(1)
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        count = np.add.reduceat(taught, new) if len(new) else np.zeros(0, np.int64)
        # the lowest bit says that a text which does not teach asks for it
        count = (count << 1 | (np.diff(new, append=len(taught)) > count)).astype("<i4")
        grams = grams[new]
        of_grams = np.searchsorted(grams >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in range(buckets):
            w, g = slice(*keys.of_words[b : b + 2]), slice(*of_grams[b : b + 2])
            if w.stop > w.start or g.stop > g.start:
                low = (grams[g] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rows.append((b, number.as_py(), keys.words[w].tobytes(), _pack(words[w]), _pack(np.diff(low, prepend=0).astype("<u4")), _pack(count[g])))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["bucket", "slice", "words", "word_counts", "grams", "gram_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            for x in zip(*(batch.column(k) for k in range(4))):
                yield one(*x)  # nothing of a slice stays while the next is worked on

    return run


def _grouped(key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Number of each key's group of equals, and how many groups there are. more: a second half of the keys."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    if more is not None:
        differ = more[order][1:] != more[order][:-1]
        if (differ & ~new[1:]).any():  # first halves agree, second halves do not
            order = np.lexsort((more, key))
            new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        else:
            new[1:] |= differ
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, int(new.sum())


BACK = "slice long, bucket int, n_distinct long, words binary, grams binary, gram_counts binary"


def _word_totals(words: tuple[bytes, ...], counts: tuple[bytes, ...]) -> tuple[int, list[bytes]]:
    """Distinct words that training texts hold, and each slice's totals."""
    sizes = [len(w) // 16 for w in words]
    flat = np.frombuffer(b"".join(words), "<u8").reshape(-1, 2)
    group, size = _grouped(flat[:, 0], flat[:, 1])
    del flat
    total = np.bincount(group, np.concatenate([_unpack(c, "<i4") for c in counts]), size).astype("<i8")
    return int((total > 0).sum()), [_pack(total[g]) for g in np.split(group, np.cumsum(sizes)[:-1])]


def _gram_totals(grams: tuple[bytes, ...], counts: tuple[bytes, ...]) -> tuple[list[bytes], list[bytes]]:
    """Each slice's n-grams that go back, and their totals. Keys of 32 bits are sorted in place with their place as the lower bits."""
    counts = [_unpack(c, "<i4") for c in counts]
    ends = np.cumsum([len(c) for c in counts])
    n = int(ends[-1])
    both = np.empty(n, np.uint64)
    for g, c, end in zip(grams, counts, ends):
        both[end - len(c) : end] = np.cumsum(_unpack(g, "<u4"), dtype=np.uint64)
    both <<= np.uint64(32)
    both |= np.arange(n, dtype=np.uint32)
    both.sort()
    at = both.astype(np.uint32)  # the places
    both >>= np.uint64(32)
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if n else np.zeros(0, np.int64)
    del both
    held = np.concatenate(counts) >> 1
    sums = np.add.reduceat(held[at], new, dtype=np.int64) if n else np.zeros(0, np.int64)
    del held
    total = np.empty(n, np.int64)
    total[at] = np.repeat(sums, np.diff(new, append=n))
    del at, new, sums
    of_grams, of_counts = [], []
    for g, mine, end in zip(grams, counts, ends):
        t = total[end - len(mine) : end]
        use = (t >= 2) | (t == 1) & (mine & 1 == 1)
        key = np.cumsum(_unpack(g, "<u4"), dtype=np.int64)
        of_grams.append(_pack(np.diff(key[use], prepend=0).astype("<u4")))
        of_counts.append(_pack(t[use].astype("<i8")))
    return of_grams, of_counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: BACK, the totals of each slice's words in the order in which it sent them, and its n-grams that
    training texts hold twice or more (or once, where a text that does not teach asks), with their totals."""

    def done(bucket, held):
        number, words, word_counts, grams, gram_counts = zip(*held)
        held.clear()
        distinct, of_words = _word_totals(words, word_counts)
        del words, word_counts
        # the number of distinct words stands in the bucket's first row
        distinct = [distinct] + [0] * (len(number) - 1)
        of_grams, of_counts = _gram_totals(grams, gram_counts)
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        columns = [number, [bucket] * len(number), distinct, of_words, of_grams, of_counts]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in BACK.split(", ")])

    held, bucket = [], None
    for batch in batches:
        for k, b in enumerate(batch.column(0).to_pylist()):
            if b != bucket and held:
                yield done(bucket, held)
                held = []
            bucket = b
            held.append([c[k].as_py() for c in batch.columns[1:]])  # one bucket as Python values at a time
    if held:
        yield done(bucket, held)


def totals_of(keys: Keys, back: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the slice's words; and of each token with two words before it, of those two and of all three."""
    if not back:
        return np.zeros(len(keys.words), np.int64), np.zeros(len(keys.at), np.int64), np.zeros(len(keys.at), np.int64)
    words = np.concatenate([_unpack(x["words"], "<i8") for x in back])
    known = np.concatenate([np.cumsum(_unpack(x["grams"], "<u4"), dtype=np.uint64) | np.uint64(x["bucket"] << 32) for x in back])
    n = np.concatenate([_unpack(x["gram_counts"], "<i8") for x in back])
    # a bit for each known key's hash: most keys are not known and need no search
    filter_ = np.zeros(1 << 24, bool)
    spot = lambda key: ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
    filter_[spot(known)] = True

    def look(key):
        out = np.zeros(len(key), np.int64)
        may = np.flatnonzero(filter_[spot(key)])
        at = np.minimum(np.searchsorted(known, key[may]), max(len(known) - 1, 0))
        hit = known[at] == key[may] if len(known) else np.zeros(0, bool)
        out[may[hit]] = n[at[hit]]
        return out

    return words, look(keys.two), look(keys.three)


# --- scores


def without_own(key: np.ndarray, doc: np.ndarray, total: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Totals without what the text itself, if it taught, put in: equal (key, doc) are counted by sorted 40-bit hashes."""
    at = np.flatnonzero((total > 0) & learn[doc])
    both = (key[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    both *= np.uint64(0x94D049BB133111EB)
    out = total.copy()
    if len(at) >> 24:  # one very long text: places take more than 24 bits
        group, size = _grouped(both)
        out[at] -= np.bincount(group, minlength=size)[group]
    elif len(at):
        both = np.sort(both >> np.uint64(24) << np.uint64(24) | np.arange(len(at), dtype=np.uint64))
        hashes = both >> np.uint64(24)
        n = np.diff(np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])), append=len(at))
        out[at[(both & np.uint64((1 << 24) - 1)).astype(np.int64)]] -= np.repeat(n, n)
    return np.maximum(out, 0)


def known_chances(keys: Keys, learn: np.ndarray, c: np.ndarray, two: np.ndarray, three: np.ndarray, tokens: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its share of all tokens, its share behind the two words before it, and how often these were seen (0 to 3),
    in the texts that teach, but the own. learn: texts that teach; c: totals of the slice's words; two, three: of totals_of()."""
    size = keys.tokens
    teach = np.maximum(tokens - np.where(learn, size, 0), 0) + 1.0
    word = np.zeros(len(keys.token_doc))
    word[keys.word_at] = without_own(keys.word, keys.doc, c[keys.word], learn)
    word[keys.first + size - 1] = np.maximum(texts - learn, 0)
    word /= teach[keys.token_doc]
    doc = keys.token_doc[keys.at]
    two, three = without_own(keys.two, doc, two, learn), without_own(keys.three, doc, three, learn)
    two = np.maximum(two, three)  # else only where hashes clash
    follow, seen = np.zeros(len(word)), np.zeros(len(word), np.int64)
    follow[keys.at] = np.minimum(three / np.maximum(two, 1), 1.0)
    seen[keys.at] = np.select([two <= 0, two == 1, two <= 4], [0, 1, 2], 3)
    return word, follow, seen


def token_scores(keys: Keys, cost: np.ndarray, word: np.ndarray, follow: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log2 probability of each text. cost: of each token's symbols; the others as of known_chances()."""
    docs, size = len(keys.tokens), keys.tokens
    chance = np.column_stack([np.where(cost < -1000, 0.0, np.exp2(cost)), word, follow])
    share = np.tile(EXPERTS, (docs, 1, 1)).reshape(-1, 3)
    out, order = np.zeros(docs), np.argsort(-size, kind="stable")
    first, size = keys.first[order], size[order]
    for step in range(0, int(size[0]) if docs else 0, FEW):
        n = int(np.searchsorted(-size, -step, "left"))
        m = np.minimum(FEW, size[:n] - step)
        at = ranges(first[:n] + step, m)
        who = np.repeat(order[:n], m)
        gate = who * 4 + seen[at]
        weight = share[gate]
        part = weight * chance[at]
        total = part.sum(1)
        # a chance too small for a number: its symbols alone
        small = total < 1e-290
        bits = np.log2(np.where(small, 1.0, total)) - np.log2(weight.sum(1))
        bits[small] = cost[at][small] + np.log2(weight[small, 0] / weight[small].sum(1))
        out += np.bincount(who, bits, docs)
        part /= np.where(small, 1.0, total)[:, None]
        for e in range(3):
            share[:, e] += np.bincount(gate, part[:, e], len(share))
    return out


RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scores(df: DataFrame, held_out, text: str = "text") -> DataFrame:
    """doc_id and RESULT. held_out: a boolean column; the other rows train base and model. bits_per_byte: by bytes of the text itself."""
    docs = df.select("doc_id", F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = dict(df.dtypes)["doc_id"]
    rows = stored(sliced(docs))
    # 65,536 sums at most, and the sums of three lists; nothing grows with the rows
    pairs = np.zeros(1 << 16, np.int64)
    for r in rows.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("x")).groupBy("x.pairs").agg(F.sum("x.pair_counts").alias("n")).collect():
        pairs[r[0]] = r[1]
    add = lambda column: F.coalesce(F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0).cast("long"))
    learn = F.transform("held", lambda h: (~h).cast("long"))
    texts, train_words, all_words = rows.agg(add(learn), add(F.zip_with("n_words", learn, lambda a, b: a * b)), add("n_words")).first()
    tokens = train_words + texts
    tree = Tree(pairs.reshape(256, 256))
    buckets = int(max(4, -(-all_words * 12 // BUCKET)))  # BUCKET bytes of keys each, however many words there are

    sent = mapped(rows.select("slice", "held", "n_words", "text"), _sent(buckets), "bucket int, slice long, words binary, word_counts binary, grams binary, gram_counts binary")
    # one bucket a task: dealt by hash, some tasks would get several
    back = stored(mapped(sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket"), _counted, BACK))
    distinct = back.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0] + (texts > 0)
    of_slice = back.groupBy(F.col("slice").alias("of_slice")).agg(F.array_sort(F.collect_list(F.struct("bucket", "words", "grams", "gram_counts"))).alias("back"))
    full = rows.drop("pairs", "pair_counts").join(of_slice, F.col("slice") == F.col("of_slice"), "left")
    shared = df.sparkSession.sparkContext.broadcast(train(rows, tree))
    whole = np.log10(float(tokens + distinct + 1))
    names = ["doc_id", *(x.split(" ")[0] for x in RESULT.split(", "))]

    def one(ids, held, n_bytes, n_words, packed, got) -> pa.RecordBatch:
        words, n_words = Words(_unpack(packed.as_py())), np.asarray(n_words.values)
        learn = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
        keys = Keys(words, n_words, buckets)
        c, two, three = totals_of(keys, got.as_py() or [])
        word, follow, seen = known_chances(keys, learn, c, two, three, tokens, texts)
        entries = np.full(len(keys.token_doc), len(words.distinct))
        entries[keys.word_at] = words.code
        cost = symbol_costs(shared.value, tree, words, entries, keys.tokens)
        bits = token_scores(keys, cost, word, follow, seen)
        base = np.bincount(keys.doc, np.log10(c[keys.word] + 1.0), len(n_words)) + np.log10(texts + 1) - (n_words + 1) * whole
        known = np.bincount(keys.doc, c[keys.word] > 0, len(n_words)).astype(np.int64) + (texts > 0)
        n = np.asarray(n_bytes.values)
        columns = [ids.values, held.values, n_words + 1, known, np.full(len(n), tokens), base, bits * np.log10(2), -bits / np.maximum(n, 1)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            for x in zip(*(batch.column(k) for k in range(6))):
                yield one(*x)

    return mapped(full.select("doc_ids", "held", "n_bytes", "n_words", "text", "back"), run, f"doc_id {kind}, {RESULT}")


def op9_context_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fold("doc_id", 7) == 2)
