"""Media columns: MPEG audio streams as binary columns.

``parse`` reads a stream the way players have to: skip tags, find the first frame
header whose successor is a header too, follow the frames, look for the next
header where one is missing, check the CRC of protected frames of all layers, and read
the variable-bitrate table (Xing or VBRI) of the first frame. Durations are exact: samples and
sample rate, never a rounded number. ``mux`` writes a payload into the main data
of Layer III frames, a variable-bitrate stream with tags, table and checksums.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the MPEG audio format (ISO 11172-3, 13818-3): kbit/s by bitrate index 1-14, Hz by rate index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Side information bytes of Layer III by (MPEG-1, mono).
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
CRC_POLY = 0x8005

RATE_INDEX, SIDE_BYTES = 1, 17  # what mux writes: MPEG-1 Layer III, 48 kHz, mono, protected
_HEAD = 4 + 2 + SIDE_BYTES


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ CRC_POLY) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


def crc16(data: bytes, more: tuple[bytes, int] = (b"", 0)) -> int:
    """The frame checksum: over the header's last two bytes and the first bits of what follows it."""
    body, bits = more
    c = 0xFFFF
    for b in data + body[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for i in range(bits % 8):
        high = (c >> 15) ^ (body[bits // 8] >> (7 - i) & 1)
        c = (c << 1 & 0xFFFF) ^ (CRC_POLY if high else 0)
    return c


def header(word: bytes) -> tuple | None:
    """(layer, sample rate, samples, frame bytes, protected, side bytes, kbit/s) of a frame header, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    mpeg1 = version == 3
    kbps = KBPS[1 if mpeg1 else 2, layer][rate - 1]
    samples = 384 if layer == 1 else 1152 if mpeg1 or layer == 2 else 576
    pad = word[2] >> 1 & 1
    size = (12 * kbps * 1000 // HZ[version][hz] + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // HZ[version][hz] + pad
    side = SIDE[mpeg1, word[3] >> 6 == 3] if layer == 3 else 0
    return layer, HZ[version][hz], samples, size, not word[1] & 1, side, kbps


def _id3_size(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """End of an ID3v2 tag and its user text frames."""
    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, tags
    end, at = min(len(data), 10 + _id3_size(data[6:10])), 10
    while at + 10 <= end and data[at] and (size := struct.unpack(">I", data[at + 4 : at + 8])[0]):
        if data[at : at + 4] == b"TXXX":
            name, _, value = data[at + 11 : at + 10 + size].partition(b"\0")
            tags[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + size
    return end, tags


def _tag_v1(data: bytes, at: int) -> bool:
    """Whether an ID3v1 tag stands here, at the end. (Only asked where a frame has ended: a payload may hold the same letters.)"""
    return len(data) - at == 128 and data[at : at + 3] == b"TAG"


def parse(data: bytes | None) -> dict:
    """Frames, exact duration, seek offsets and payload of a stream; garbage and empty input give no frames."""
    data = data or b""
    at, tags = _tags(data)
    stop = len(data)
    offsets, samples, rate, skipped, bad_crc, kbits, table, body = [], 0, None, 0, 0, 0, None, []
    synced = False
    while at + 4 <= stop:
        h = header(data[at : at + 4])
        # a header counts once the next frame begins where this one ends, or the stream ends there
        if h and h[3] > 4 and at + h[3] <= stop and (synced or at + h[3] == stop or header(data[at + h[3] : at + h[3] + 4]) or _tag_v1(data, at + h[3])):
            layer, hz, n, size, protected, side, kbps = h
            rate, synced = rate or hz, True
            start = at + 4 + 2 * protected
            if protected:
                covered = protected_bits(layer, data[at : at + size], side)
                if covered is None or crc16(data[at + 2 : at + 4], covered) != int.from_bytes(data[at + 4 : at + 6]):
                    bad_crc += 1
            main = start + side
            first = vbr_table(data[at : at + size], main - at) if not offsets and table is None else None
            if first:
                table = first
            else:
                offsets.append(at)
                samples += n
                kbits += kbps
                body.append(data[main : at + size])
            at += size
        elif synced and _tag_v1(data, at):
            at = stop
        else:
            found = data.find(b"\xff", at + 1, stop)
            found = stop if found < 0 else found
            skipped, synced, at = skipped + found - at, False, found
    payload = b"".join(body)
    if tags.get("payload_bytes", "").isdecimal():
        payload = payload[: int(tags["payload_bytes"])]
    return {"frames": len(offsets), "samples": samples, "rate": rate, "offsets": offsets, "skipped": skipped, "bad_crc": bad_crc, "kbits": kbits, "table": table, "tags": tags, "payload": payload}


def vbr_table(frame: bytes, main: int) -> dict | None:
    """Frame count, byte count and seek points of the Xing or VBRI table in a frame whose main data begins at ``main``; None where there is none."""
    xing, vbri = frame[main:], frame[36:]
    if xing[:4] in (b"Xing", b"Info") and len(xing) >= 8:
        at, out = 8, {"frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if xing[7] & bit and at + 4 <= len(xing):
                out[name] = int.from_bytes(xing[at : at + 4])
                at += 4
        return out | {"toc": list(xing[at : at + 100])} if xing[7] & 4 else out
    if vbri[:4] == b"VBRI" and len(vbri) >= 26:  # always 32 bytes after the header
        size, points, width = int.from_bytes(vbri[10:14]), int.from_bytes(vbri[18:20]), int.from_bytes(vbri[22:24])
        toc = [int.from_bytes(vbri[26 + i * width : 26 + (i + 1) * width]) for i in range(points) if 26 + (i + 1) * width <= len(vbri)] if width else []
        return {"frames": int.from_bytes(vbri[14:18]), "bytes": size, "toc": toc}
    return None


#: Fixed values of the format (ISO 11172-3, 13818-3): Layer II bits of allocation by subband, (subbands, bits) in order, of each table.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def protected_bits(layer: int, frame: bytes, side: int) -> tuple[bytes, int] | None:
    """What the frame's checksum covers after the header: bytes and how many of their bits count. None where the frame is too short."""
    mode, version = frame[3] >> 6, frame[1] >> 3 & 3
    channels = 1 if mode == 3 else 2
    if layer == 3:
        bits = side * 8
    else:
        bound = (frame[3] >> 4 & 3) * 4 + 4 if mode == 1 else 32  # subbands above it share one allocation
        if layer == 1:
            bits = 4 * (channels * min(bound, 32) + 32 - min(bound, 32))
        else:
            widths = [w for n, w in ALLOCATION[_layer2_table(version, frame, channels)] for _ in range(n)]
            bound = min(bound, len(widths))
            shared = channels == 2 and mode == 1
            fields = [(w, c) for i, w in enumerate(widths) for c in range(1 if shared and i >= bound else channels)]
            bits = sum(w for w, _ in fields)
            # two bits of scale factor selection for each channel of a subband that has samples
            at = 48
            word = int.from_bytes(frame)
            for i, w in enumerate(widths):
                for _ in range(1 if shared and i >= bound else channels):
                    if at + w > len(frame) * 8:
                        return None
                    taken = word >> (len(frame) * 8 - at - w) & ((1 << w) - 1)
                    bits += 2 * (channels if shared and i >= bound else 1) * bool(taken)
                    at += w
    body = frame[6 : 6 + (bits + 7) // 8]
    return (body, bits) if len(body) * 8 >= bits else None


def _layer2_table(version: int, frame: bytes, channels: int) -> str:
    if version != 3:
        return "lsf"
    rate, hz = KBPS[1, 2][(frame[2] >> 4) - 1] // channels, HZ[3][frame[2] >> 2 & 3]
    if rate <= 48:
        return "d" if hz == 32000 else "c"
    return "a" if hz == 48000 or rate <= 80 else "b"


def _frame_sizes() -> list[tuple[int, int]]:
    return [(144 * k * 1000 // HZ[3][RATE_INDEX], i + 1) for i, k in enumerate(KBPS[1, 3])]


_SIZES = _frame_sizes()
_FULL, _FULL_INDEX = _SIZES[-1]


def _frame_head(index: int) -> bytes:
    word = bytes([0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0])
    return word + struct.pack(">H", crc16(word[2:] + bytes(SIDE_BYTES))) + bytes(SIDE_BYTES)


_HEADS = {index: _frame_head(index) for _, index in _SIZES}


def mux(payload: bytes) -> bytes:
    """A variable-bitrate Layer III stream that holds ``payload`` in its main data, with tag, seek table and checksums."""
    room = _FULL - _HEAD
    full, rest = divmod(len(payload), room)
    block = np.empty((full, _FULL), np.uint8)
    block[:, :_HEAD] = np.frombuffer(_HEADS[_FULL_INDEX], np.uint8)
    block[:, _HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    frames, last = full, b""
    if rest:
        size, index = next(x for x in _SIZES if x[0] - _HEAD >= rest)
        last = _HEADS[index] + payload[full * room :].ljust(size - _HEAD, b"\0")
        frames += 1
    total = full * _FULL + len(last)
    # seek points: where the frame at each hundredth of the duration begins, in 256ths of the bytes
    toc = bytes(min(255, frames * i // 100 * _FULL * 256 // total) if total else 0 for i in range(100))
    head = next(x for x in _SIZES if x[0] - _HEAD >= 120)
    first = (_HEADS[head[1]] + b"Xing" + struct.pack(">III", 7, frames, total) + toc).ljust(head[0], b"\0")
    text = b"\0payload_bytes\0%d" % len(payload)
    frame = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    n = len(frame)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame + first + block.tobytes() + last


MEDIA = T.StructType([
    T.StructField("frames", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("rate", T.IntegerType()), T.StructField("seek", T.ArrayType(T.LongType())),
    T.StructField("skipped", T.LongType()), T.StructField("bad_crc", T.LongType()), T.StructField("kbits", T.LongType()), T.StructField("vbr_frames", T.LongType()), T.StructField("vbr_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _columns(data: list[bytes | None]) -> pa.Array:
    found = [parse(x) for x in data]
    rows = [{"frames": p["frames"], "samples": p["samples"], "rate": p["rate"], "seek": p["offsets"], "skipped": p["skipped"], "bad_crc": p["bad_crc"], "kbits": p["kbits"], "vbr_frames": (p["table"] or {}).get("frames"), "vbr_bytes": (p["table"] or {}).get("bytes"), "payload": p["payload"]} for p in found]
    return pa.array(rows, _arrow_type(MEDIA))


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Columns ``row`` (struct of the input's columns) and ``audio`` (frames, exact duration as samples and rate, seek offsets, payload ...).

    Null, empty and foreign bytes have no frames, rate null and an empty payload; a broken
    tag or table counts as none. Streams of any length, repeated rows and an empty
    table are no special cases; extra columns travel in ``row``.
    """
    base = df.select(F.struct("*").alias("row"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), _columns(batch.column("row").field(media_col).to_pylist())], names=["row", "audio"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("audio", MEDIA)]))


def store_media(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Columns ``row`` and ``media`` (binary): the payload as an MPEG audio stream. Null counts as empty."""
    base = df.select(F.struct("*").alias("row"))

    def run(batches):
        for batch in batches:
            media = [mux(x or b"") for x in batch.column("row").field(payload_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(media, pa.binary())], names=["row", "media"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("media", T.BinaryType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every text stored as an MPEG audio stream, read back, with its features."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.octet_length("text")
    pad = F.when(n == 0, F.lit(64)).otherwise(F.pmod(-n, F.lit(64)))
    payload = F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("00"), pad)))
    stored = store_media(docs.select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload")))
    media = stored.select("row.doc_id", "row.n_bytes", "media")
    read = read_media(media)
    a = F.col("audio")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), a["frames"]),
        F.concat(F.lit("duration="), a["samples"], F.lit("/"), a["rate"]),
        F.concat(F.lit("kbps="), F.expr("audio.kbits div audio.frames")),
        F.concat(F.lit("vbr="), a["vbr_frames"], F.lit("/"), a["vbr_bytes"]),
        F.concat(F.lit("crc_bad="), a["bad_crc"]),
        F.concat(F.lit("seek="), F.element_at(a["seek"], 1), F.lit(".."), F.element_at(a["seek"], -1)),
    )
    return read.select(
        "row.doc_id",
        "row.n_bytes",
        F.octet_length(a["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(a["payload"], 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(audio.payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("row.media").cast("long").alias("media_bytes"),
        F.sha2("row.media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


