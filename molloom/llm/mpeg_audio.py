"""Media columns of MPEG audio (MPEG-1 layer III, 48 kHz, mono, with checksums).

pack() stores any bytes without loss as frames: after header, checksum and side information each frame carries 192
payload bytes, so it lasts 24 ms exactly; every eighth frame has a higher bitrate, and a first frame holds a
variable-bitrate table (frame and byte counts, 100 seek points). An ID3v2 tag stands in front with the unpadded size
and an ID3v1 tag at the end. probe() takes any bytes: it parses tags, finds frame headers again after foreign bytes (a header counts if the
frame ends at another header, a tag or the end), reads variable-bitrate tables and holds their seek points against the
frames, verifies each frame's checksum and gives the exact duration and each frame's offset.

Null and empty data are packed as one frame of spaces. Equal bytes give equal streams. Streams without a frame have
zero counts and no payload. Added columns replace columns of their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, keep_columns, slices, stored, table, utf8

UNIT, FILL = 192, 32
SAMPLES = {3: 1152, 2: 576, 0: 576}  # of a layer III frame by version
# Fixed values of the format: bitrates in kbit/s of layer III, by version, and sampling rates.
KBITS = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = {(3, False): 32, (3, True): 17, (2, False): 17, (2, True): 9}  # bytes of side information: (version, mono)
BASE, EXTRA = 6, 7  # bitrate indexes of the written frames: 80 and 96 kbit/s
HEAD = 4 + 2 + 17  # header, checksum, side information


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksums of equally long rows of bytes: the last two header bytes, then the side information."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        c = (c << 8 & 0xFFFF) ^ CRC[(c >> 8) ^ column]
    return c


def frame_size(version: int, kbit: int, rate: int, pad: int) -> int:
    return SAMPLES[version] // 8 * kbit * 1000 // rate + pad


SIZES = {k: frame_size(3, KBITS[3][k], 48000, 0) for k in (BASE, EXTRA)}


def synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def pack(data: bytes) -> bytes:
    """The stream of padded data."""
    payload = data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(rows)
    index = np.where(np.arange(n) % 8 == 7, EXTRA, BASE)
    size = np.where(index == EXTRA, SIZES[EXTRA], SIZES[BASE])
    frames = np.zeros((n, SIZES[EXTRA]), np.uint8)
    frames[:, :4] = [0xFF, 0xFA, 0, 0xC0]
    frames[:, 2] = index << 4 | 1 << 2
    frames[:, HEAD : HEAD + UNIT] = rows
    sums = crc16(np.concatenate([frames[:, 2:4], frames[:, 6:HEAD]], axis=1))
    frames[:, 4], frames[:, 5] = sums >> 8, sums & 255
    body = frames[np.arange(SIZES[EXTRA]) < size[:, None]].tobytes()
    total = len(body) + SIZES[BASE]
    ends = SIZES[BASE] + np.concatenate([[0], np.cumsum(size)])
    seek = bytes(np.minimum(255, ends[np.arange(100) * n // 100] * 256 // total).astype(np.uint8))
    head = bytes([0xFF, 0xFA, BASE << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    first = head + int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0]).to_bytes(2, "big") + side
    first += b"Xing" + struct.pack(">III", 7, n, total) + seek
    name = b"TXXX" + synchsafe(len(note := b"\x03bytes\x00" + str(len(data)).encode())) + b"\0\0" + note
    tag = b"ID3\x04\0\0" + synchsafe(len(name)) + name
    return tag + first.ljust(SIZES[BASE], b"\0") + body + b"TAG".ljust(128, b"\0")


def header(data: bytes, at: int) -> tuple[int, int, int, int, bool, bool] | None:
    """(version, kbit, rate, frame size, mono, has checksum) of a layer III header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    version, kbit, rate = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or kbit in (0, 15) or rate == 3:
        return None
    kbit, rate = KBITS[3 if version == 3 else 2][kbit], RATES[version][rate]
    return version, kbit, rate, frame_size(version, kbit, rate, data[at + 2] >> 1 & 1), data[at + 3] >> 6 == 3, not data[at + 1] & 1


def synchsafe_value(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0)))


def text_frames(body: bytes, version: int) -> dict[str, str]:
    """User text frames (TXXX) of an ID3v2.3 or v2.4 tag: description to value. Other frames, and broken ones, are passed over."""
    found, at = {}, 0
    while at + 10 <= len(body) and body[at : at + 1] != b"\0":
        raw = body[at + 4 : at + 8]
        size = synchsafe_value(raw) if version >= 4 else int.from_bytes(raw, "big")
        content = body[at + 10 : at + 10 + size]
        if body[at : at + 4] == b"TXXX" and content[:1] in (b"\0", b"\x03"):
            name, _, value = content[1:].decode("latin-1" if content[0] == 0 else "utf-8", "replace").partition("\0")
            found[name] = value.split("\0")[0]
        at += 10 + size
    return found


def bitrate_table(data: bytes, at: int, h: tuple, end: int) -> dict | None:
    """The table of a first frame: Xing or Info (fields as its flags say), or VBRI; None without one or where it is cut off."""
    x = at + 4 + 2 * h[5] + SIDE[3 if h[0] == 3 else 2, h[4]]
    frame = data[: min(at + h[3], end)]
    if frame[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(frame):
        flags, x = int.from_bytes(frame[x + 4 : x + 8], "big"), x + 8
        out: dict = {"frames": None, "bytes": None, "seek": None}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100)):
            if flags & bit:
                if x + size > len(frame):
                    return None
                out[name] = frame[x : x + size] if name == "seek" else int.from_bytes(frame[x : x + size], "big")
                x += size
        return out
    v = at + 4 + 32  # always 32 bytes behind the header
    if frame[v : v + 4] == b"VBRI" and v + 18 <= len(frame):
        return {"frames": int.from_bytes(frame[v + 14 : v + 18], "big"), "bytes": int.from_bytes(frame[v + 10 : v + 14], "big"), "seek": None}
    return None


def seek_error(table_: dict | None, offsets: np.ndarray, base: int) -> int | None:
    """The largest distance, in 256ths of the stream, of the table's seek points from the frames' true places; None without points."""
    if not table_ or table_["seek"] is None or not table_["bytes"] or not len(offsets):
        return None
    true = np.minimum(255, (offsets[np.arange(100) * len(offsets) // 100] - base) * 256 // table_["bytes"])
    return int(np.abs(true - np.frombuffer(table_["seek"], np.uint8).astype(np.int64)).max())


def probe(data: bytes) -> dict:
    """What a stream holds: tags, variable-bitrate table, frames (offsets, sizes, samples), checksums and payload.

    Takes any bytes. Headers count if their frame ends at another header, a tag or the end; what does not is skipped.
    Each frame that has a checksum is verified by itself. The payload is read from the frames that pack() writes: MPEG-1
    layer III with a checksum and room for it; streams with other frames have none.
    """
    at, end, tags, said, skipped = 0, len(data), [], -1, 0
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size, version, footer = synchsafe_value(data[at + 6 : at + 10]), data[at + 3], data[at + 5] & 0x10
        digits = text_frames(data[at + 10 : at + 10 + size], version).get("bytes", "")
        said = int(digits) if digits.isascii() and digits.isdigit() else said
        tags.append("id3v2")
        at = min(at + 10 + size + (10 if footer and version >= 4 else 0), end)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags.append("id3v1")
        end -= 128
    offsets, kinds, known = [], [], {}
    table_, base = None, at
    while at + 4 <= end:
        # constant parts of a stream have few headers: look each up once
        h = known.get(key := data[at : at + 4], 0)
        if h == 0:
            h = known[key] = header(data, at)
        size = h[3] if h else 0
        if not h or at + size > end or at + size + 4 <= end and header(data, at + size) is None:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            skipped += step - at
            at = step
            continue
        if table_ is None and not offsets:
            table_ = bitrate_table(data, at, h, end)
            if table_ is not None:
                base, at = at, at + size
                continue
        offsets.append(at)
        kinds.append(key)
        at += size
    skipped += max(end - at, 0)
    out = {"tags": tags, "said": said, "table": table_, "skipped": skipped, "offsets": np.array(offsets, np.int64), "checked": 0, "broken": 0, "kbits": {}, "seconds": 0.0, "rate": 0, "payload": b"", "seek_error": None}
    if offsets:
        heads = [known[k] for k in kinds]
        flat, place = np.frombuffer(data, np.uint8), out["offsets"]
        out["rate"] = heads[0][2]
        samples: dict[int, int] = {}
        for h in heads:
            samples[h[2]] = samples.get(h[2], 0) + SAMPLES[h[0]]
            out["kbits"][h[1]] = out["kbits"].get(h[1], 0) + 1
        out["seconds"] = sum(n / rate for rate, n in samples.items())
        side = np.array([SIDE[3 if h[0] == 3 else 2, h[4]] if h[5] else 0 for h in heads])
        for n in set(side.tolist()) - {0}:  # frames with a checksum, by length of what it covers
            own = place[(side == n) & (place + 6 + side <= len(flat))]
            rows = flat[own[:, None] + np.r_[2:4, 6 : 6 + n]]
            good = crc16(rows) == (flat[own + 4].astype(np.uint32) << 8 | flat[own + 5])
            out["checked"] += len(good)
            out["broken"] += int((~good).sum())
        if all(h[0] == 3 and h[4] and h[5] and h[3] >= HEAD + UNIT for h in heads):
            out["payload"] = flat[(place + HEAD)[:, None] + np.arange(UNIT)].tobytes()
        out["seek_error"] = seek_error(table_, out["offsets"], base)
    return out


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes (long) and media (binary)."""
    kept = keep_columns(df, "n_bytes", "media")
    schema = df.select(kept).withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(None).cast("binary")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(utf8(batch.column(kept.index(text)))[0]):
                at, data = utf8(batch.column(kept.index(text)).slice(i, j - i))
                raw = data.tobytes()
                media = [pack(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(np.diff(at)), pa.array(media, pa.binary())], names=schema.names)

    return df.select(kept).mapInArrow(run, schema)


INFO = "payload binary, duration_s double, sample_rate int, frames int, seek_offsets array<int>, crc_checked int, crc_broken int, skipped_bytes int, tags array<string>, vbr_frames long, kbits array<int>, seek_error int"


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds info (struct INFO): the payload read back, durations, checksums, tags and the offset of each frame."""
    kept = keep_columns(df, "info")
    schema = df.select(kept).withColumn("info", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in INFO.split(', '))}>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["info"].dataType)
        for batch in batches:
            column = batch.column(kept.index(media))
            for i, j in slices(utf8(column)[0]):
                at, data = utf8(column.slice(i, j - i))
                raw, found = data.tobytes(), []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    x = probe(raw[a:b])
                    found.append((x["payload"], x["seconds"], x["rate"], len(x["offsets"]), x["offsets"].astype(np.int32), x["checked"], x["broken"], x["skipped"], x["tags"], x["table"]["frames"] if x["table"] else None, sorted(x["kbits"]), x["seek_error"]))
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*found), kind)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.StructArray.from_arrays(columns, fields=list(kind))], names=schema.names)

    return df.select(kept).mapInArrow(run, schema)


def op5_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    media = stored(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    i = F.col("info")
    payload = i["payload"]
    feature = F.concat_ws(
        ";", F.concat(F.lit("mpeg1-layer3/"), i["sample_rate"]), F.format_string("%.3fs", i["duration_s"]), F.format_string("frames=%d/%d", i["frames"], i["vbr_frames"]),
        F.format_string("crc=%d-%d", i["crc_checked"], i["crc_broken"]), F.concat(F.lit("kbits="), F.array_join(i["kbits"].cast("array<string>"), ",")), F.concat(F.lit("tags="), F.array_join(i["tags"], ",")),
        F.concat(F.lit("skipped="), i["skipped_bytes"]), F.concat(F.lit("last="), F.element_at(i["seek_offsets"], -1)),
    )
    return features(media).select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), i["duration_s"].alias("duration_s"),
    )
