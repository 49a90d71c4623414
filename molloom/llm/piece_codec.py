"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a slice are cut before each run of spaces (no piece has a space after another character, so no merge
crosses a cut); each distinct word is encoded once. All words are flat symbol arrays. A round finds each word's
lowest pair rank, merges that pair's occurrences from the left in all words at once, and compacts the arrays;
words without a pair leave. Where merging an occurrence opens a pair of the same or a lower rank (runs of spaces,
whose pieces share one rank), only the word's leftmost occurrence is merged, which is the order of the library.

Null and empty texts encode to the begin and end ids and decode to ''. Repeated rows give repeated results; columns
of the input named like an added column are replaced, all others are kept. Tables without rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, binaries, keep_columns, mapped, ranges, slices, table, utf8, word_index

SPACE = "▁"
WORDS = re.compile(" *[^ ]+| +")
NEVER = np.iinfo(np.int32).max


class PieceModel:
    """Pair ranks and piece bytes of a BPE model with byte fallback, read through the library's own accessors."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = {text[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, i in normal.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        pairs: dict[int, int] = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = normal.get(piece[:k]), normal.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = rank[self.made] if len(self.made) else np.zeros(0, np.int32)
        self.of_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.byte_id = np.array([sp.is_byte(i) for i in range(n)])
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_size)])[:-1]
        self.piece_data = np.frombuffer(b"".join(raw), np.uint8)
        self.of_words = WordIds(self.encode_words)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbours; NEVER where they do not merge."""
        if not len(self.keys):
            return np.full(len(a), NEVER, np.int32), np.zeros(len(a), np.int32)
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of words in which spaces stand for the space mark."""
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4")
        sym = self.of_point[points]
        strange = np.flatnonzero(sym < 0)  # these never merge; their bytes follow at the end
        sym[strange] = -1 - np.arange(len(strange))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        rank, made = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NEVER
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = low != NEVER
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made, low = sym[live], word[live], rank[live], made[live], low[live]
                if not len(sym):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            # of overlapping occurrences every other one merges, from the left
            head = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
            new = self._merged(sym, word, rank, made, at)
            risk = (new[4] <= low[at]) | (new[5] <= low[at])
            touch = np.flatnonzero((np.diff(at) == 2) & (word[at[:-1]] == word[at[1:]]))  # the next merge takes the right neighbour away
            risk[touch] |= self.pair(made[at[touch]], sym[at[touch] + 2])[0] <= low[at[touch]]
            risky = np.unique(word[at][risk])
            if len(risky):
                first = np.concatenate([[True], np.diff(word[at]) > 0])
                at = at[first | ~np.isin(word[at], risky)]
                new = self._merged(sym, word, rank, made, at)
            sym, word, rank, made = new[:4]
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            raw = [np.frombuffer(chr(points[strange[-int(s) - 1]]).encode(), np.uint8) for s in sym[odd]]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(x) for x in raw]
            at = np.concatenate([[0], np.cumsum(size)])
            word = np.repeat(word, size)
            sym = np.repeat(sym, size)
            sym[ranges(at[odd], size[odd])] = self.of_byte[np.concatenate(raw)]
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def _merged(self, sym, word, rank, made, at):
        """Arrays after merging at, at + 1; last the new ranks to the left and right of each merge."""
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym = sym.copy()
        sym[at] = made[at]
        to = np.cumsum(keep) - 1
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        here = to[at]
        mark = np.zeros(len(sym), bool)
        mark[here] = mark[np.maximum(here - 1, 0)] = True
        edge = np.flatnonzero(mark)
        rank[edge] = NEVER
        inner = edge[edge + 1 < len(sym)]
        inner = inner[word[inner] == word[inner + 1]]
        rank[inner], made[inner] = self.pair(sym[inner], sym[inner + 1])
        left = np.where((here > 0) & (word[here - 1] == word[here]), rank[here - 1], NEVER)
        return sym, word, rank, made, left, rank[here]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, begin and end included, and offsets of each text."""
        odd = pc.match_substring_regex(pc.fill_null(texts, ""), f"^$|^ | $|  |{SPACE}").to_numpy(zero_copy_only=False)
        body, ends = self.of_words(*word_index(texts, odd, lambda t: WORDS.findall(" " + t.replace(SPACE, " ")) if t else []))
        offsets = ends + 2 * np.arange(len(ends))
        out = np.empty(int(offsets[-1]), np.int32)
        out[offsets[:-1]], out[offsets[1:] - 1] = self.begin, self.end
        inside = np.ones(len(out), bool)
        inside[offsets[:-1]] = inside[offsets[1:] - 1] = False
        out[inside] = body
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of flat ids: pieces joined, a first space mark dropped, bytes that are no UTF-8 replaced one by one."""
        size = self.piece_size[ids]
        data = self.piece_data[ranges(self.piece_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        texts = []
        marked = (self.piece_size > 0) & ~self.byte_id & (np.arange(len(self.byte_id)) != self.unknown) & (self.piece_data[np.minimum(self.piece_at, len(self.piece_data) - 1)] == 32)
        seen = np.flatnonzero(size > 0)
        first = seen[np.minimum(np.searchsorted(seen, offsets[:-1]), len(seen) - 1)] if len(seen) else np.zeros(len(offsets) - 1, np.int64)
        drop = (marked[ids[first]] & (first >= offsets[:-1]) & (first < offsets[1:])).tolist() if len(seen) else [False] * (len(offsets) - 1)
        for a, b, mark in zip(ends, ends[1:], drop):
            raw = data[a + mark : b]
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:
                texts.append(replaced(raw))
        return texts


def replaced(raw: bytes) -> str:
    """Decoded with one replacement character for each byte that does not belong to a character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        if not n:
            out.append("�")
        i += n or 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens (long) and token_ids (binary: little-endian unsigned 32-bit ids, begin and end included)."""
    kept = keep_columns(df, "n_tokens", "token_ids")
    schema = df.select(kept).withColumns({"n_tokens": F.lit(0).cast("long"), "token_ids": F.lit(None).cast("binary")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = batch.column(kept.index(text))
            for i, j in slices(utf8(texts)[0]):
                ids, at = m.encode(texts.slice(i, j - i))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(at)), binaries(ids.astype("<u4").view(np.uint8), at * 4)], names=schema.names)
        m.of_words.forget()

    return mapped(df.select(kept), run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "token_ids") -> DataFrame:
    """Adds decoded (string) for packed ids; a null gives ''."""
    kept = keep_columns(df, "decoded")
    schema = df.select(kept).withColumn("decoded", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            packed = batch.column(kept.index(ids))
            for i, j in slices(utf8(packed)[0]):
                at, data = utf8(packed.slice(i, j - i))
                texts = m.decode(np.ascontiguousarray(data).view("<u4").astype(np.int64), at // 4)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(texts, pa.string())], names=schema.names)

    return mapped(df.select(kept), run, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_piece_codec(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path).drop("text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
