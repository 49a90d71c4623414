import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molloom.llm import mpeg_audio, piece_codec, token_orc

from .data import CASES, frame, made

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = CASES + made(400) + [" " * n + "ab" for n in range(1, 60)]
    df = frame(spark, texts).selectExpr("*", "'x' AS DECODED")
    got = {r.doc_id: r for r in piece_codec.decode(piece_codec.encode(df, path), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == want, repr(t)
        assert got[i].n_tokens == len(want) and got[i].decoded == sp.decode(want)


def test_decoding_of_any_ids():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.model(path), random.Random(2)
    for _ in range(300):
        ids = [r.randint(0, 300) if r.random() < 0.7 else r.randint(0, 31999) for _ in range(r.randint(0, 12))]
        if all(i > 2 for i in ids):
            assert m.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [sp.decode(ids)]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = CASES + made(500, 3) + ["a<|endoftext|>b", "<|endoftext|>", "x" + " " * 1_200_000 + "y", "\u3000" * 3000, "z" * 200_000]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    for k, ranks in enumerate((paths[1], None)):
        token_orc.write(frame(spark, texts), f"file://{tmp_path}/{k}", paths[0], ranks)
        rows = token_orc.crc32_of_ids(token_orc.read(spark, f"file://{tmp_path}/{k}")).orderBy("doc_id").collect()
        start = 0
        for r, text in zip(rows, texts, strict=True):
            want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            assert (r.start, r.n_tokens) == (start, len(want)), repr(text)[:99]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(want)}I", *want)), repr(text)[:99]
            start += len(want)
        assert [r.doc_id for r in token_orc.lookup(spark, f"file://{tmp_path}/{k}", [3, 7]).orderBy("doc_id").collect()] == [3, 7]


def test_starts_of_repeated_ids(spark, tmp_path):
    """One id in many rows: the starts follow one order of rows, whatever the partitions, and leave no gap."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(7, f"w{k} " * (k % 9)) for k in range(300)] + [(None, "a b"), (1, "a")], "doc_id long, text string")
    seen = []
    for k, n in enumerate((3, 8)):
        token_orc.write(df.repartition(n), f"file://{tmp_path}/{k}", *paths)
        rows = token_orc.crc32_of_ids(token_orc.read(spark, f"file://{tmp_path}/{k}")).orderBy("start").collect()
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
        assert [r.doc_id for r in rows] == [None, 1] + [7] * 300
        seen.append([tuple(r) for r in rows])
    assert seen[0] == seen[1]


def rows_read(df):
    """Rows that the scan of a collected frame gave out, by its own metric."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    """40,000 even ids in one file: the row index leaves one group of 2,000 rows for an id, Bloom filters none for an odd id."""
    df = spark.range(0, 80_000, 2).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).coalesce(1)
    path = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    token_orc.write(df, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows_read(token_orc.lookup(spark, path, [40_000])) == 2000
    assert [rows_read(token_orc.lookup(spark, path, [x])) for x in (1, 30_001, 50_001, 79_001)].count(0) >= 3
    assert rows_read(token_orc.lookup(spark, path, [100_000])) == 0


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, ["a"]).limit(0)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert piece_codec.decode(piece_codec.encode(docs, path), path).count() == 0
    token_orc.write(docs, f"file://{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.read(spark, f"file://{tmp_path}/none").count() == 0
    assert mpeg_audio.features(mpeg_audio.encode(docs)).count() == 0


def test_audio_round_trip(spark):
    texts = CASES + made(50, 4) + ["x" * n for n in (191, 192, 193, 5000)]
    for r in mpeg_audio.features(mpeg_audio.encode(frame(spark, texts))).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert r.n_bytes == len(raw) and bytes(r.info.payload) == want
        n = len(want) // 192
        assert (r.info.frames, r.info.vbr_frames, r.info.crc_checked, r.info.crc_broken, r.info.skipped_bytes) == (n, n, n, 0, 0)
        assert r.info.seek_error == 0
        assert r.info.duration_s == pytest.approx(n * 0.024) and len(r.info.seek_offsets) == n


def test_audio_faults():
    good = mpeg_audio.pack(b"word " * 300)
    junk = good[:500] + b"\xff\xfb\x00junk" + good[500:]
    assert len(mpeg_audio.probe(junk)["offsets"]) in (7, 8) and mpeg_audio.probe(junk)["skipped"] > 0
    flipped = bytearray(good)
    flipped[int(mpeg_audio.probe(good)["offsets"][2]) + 10] ^= 1
    assert mpeg_audio.probe(bytes(flipped))["broken"] == 1
    for odd in (b"", b"ID3", b"\xff" * 50, b"TAG" + bytes(125), bytes(10)):
        assert len(mpeg_audio.probe(odd)["offsets"]) == 0
    assert hashlib.sha256(mpeg_audio.pack(b"a")).digest() == hashlib.sha256(mpeg_audio.pack(b"a")).digest()


def plain_frame(first=0xFB, kbits=9, fill=0):
    """A 44.1 kHz stereo frame without (0xFB) or with (0xFA) checksum."""
    size = 144 * mpeg_audio.KBITS[3][kbits] * 1000 // 44100
    return bytes([0xFF, first, kbits << 4, 0]) + bytes([fill]) * (size - 4)


def test_audio_tables():
    frames = plain_frame() * 5
    quality_only = bytearray(plain_frame())
    quality_only[36:48] = b"Xing" + struct.pack(">II", 8, 77)
    got = mpeg_audio.probe(bytes(quality_only) + frames)
    assert got["table"] == {"frames": None, "bytes": None, "seek": None} and len(got["offsets"]) == 5
    vbri = bytearray(plain_frame())
    vbri[36:54] = b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 4321, 5)
    got = mpeg_audio.probe(bytes(vbri) + frames)
    assert (got["table"]["frames"], got["table"]["bytes"], len(got["offsets"])) == (5, 4321, 5)
    cut = bytes([0xFF, 0xFB, 1 << 4, 0xC0]) + bytes(17) + b"Xing"
    assert len(mpeg_audio.probe(cut)["offsets"]) == 0
    footed = b"ID3\x04\0\x10" + mpeg_audio.synchsafe(0) + b"3DI\x04\0\x10" + mpeg_audio.synchsafe(0) + frames
    assert mpeg_audio.probe(footed)["skipped"] == 0 and len(mpeg_audio.probe(footed)["offsets"]) == 5
    moved = bytearray(mpeg_audio.pack(b"word " * 4000))
    at = moved.index(b"Xing") + 16
    moved[at + 50] ^= 0x40
    assert mpeg_audio.probe(bytes(moved))["seek_error"] == 64


def test_audio_checksums_frame_by_frame():
    """One frame without a checksum, or a false header in junk, does not turn off the others' verification."""
    good = mpeg_audio.pack(b"word " * 300)
    offsets = mpeg_audio.probe(good)["offsets"].tolist()
    mixed = good[: offsets[3]] + plain_frame() + good[offsets[3] :]
    assert mpeg_audio.probe(mixed)["checked"] == len(offsets) and mpeg_audio.probe(mixed)["broken"] == 0
    junk = good[: offsets[3]] + b"\xff\xfb\x90\x00junk" + good[offsets[3] :]
    assert mpeg_audio.probe(junk)["checked"] >= len(offsets) - 1
    broken = bytearray(mixed)
    broken[offsets[1] + 8] ^= 1
    assert mpeg_audio.probe(bytes(broken))["broken"] == 1


def test_audio_of_any_bytes():
    import random

    r = random.Random(6)
    good = mpeg_audio.pack(b"text " * 200)
    for k in range(400):
        data = bytearray(good if k % 2 else r.randbytes(r.randint(0, 900)))
        for _ in range(r.randint(0, 12)):
            if data:
                at = r.randrange(len(data))
                data[at : at + r.randint(0, 3)] = r.choice([b"\xff\xfb", b"ID3\x03", b"Xing", b"VBRI", r.randbytes(2), b""])
        data = bytes(data[: r.randint(0, len(data))])
        got = mpeg_audio.probe(data)
        assert got["broken"] <= got["checked"] <= len(got["offsets"]) and 0 <= got["skipped"] <= len(data)


def test_the_library_is_loaded_for_odd_texts_only():
    """A worker holds one vocabulary until a text needs the other encoder; ids are the library's with and without it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert token_orc.special_tokens(path) == special and special
    encode = token_orc.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for texts, loaded in ((["plain words", None, "", "żó 1\n 2"], False), (["a" + special[0] + "b", "c"], True)):
        ids, at = encode(pa.array(texts, pa.string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
        assert (encode.loaded is not None) == loaded
