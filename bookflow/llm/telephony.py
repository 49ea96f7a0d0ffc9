"""Telephony audio: G.711 and IMA ADPCM in WAV containers, expanded to linear PCM.

Mu-law and A-law bytes are expanded by lookup tables of 256 entries, made from
the rules of the coding. ADPCM is sequential inside a block, but blocks are
independent, so the decoder walks the samples of all blocks of a batch side by
side with numpy. PCM at 8 kHz is resampled to 16 kHz.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import parts_of, stored
from bookflow.llm.kernels import text_bytes

UNIT = 192
RATE = 8000
OUT_RATE = 16000
#: WAVE format tags.
TAGS = {"ulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = ("ulaw", "alaw", "adpcm")
#: Data bytes of an ADPCM block here, header of 4 bytes not counted.
BLOCK = UNIT


def mu_law_table() -> np.ndarray:
    """Linear value of each mu-law byte."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear value of each A-law byte."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, fraction = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, fraction + 8, (fraction + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_LAW, A_LAW = mu_law_table(), a_law_table()

# Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of equally long IMA ADPCM blocks (rows: header of 4 bytes, then data), decoded across the rows."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    data = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * data.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(data.shape[1]):
        for half in (0, 1):
            code = (data[:, k] >> (4 * half) & 15).astype(np.int32)
            step = STEPS[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
            out[:, 1 + 2 * k + half] = value
    return out


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file that holds the payload's bytes as its samples (ADPCM: as the data of its blocks)."""
    if codec == "adpcm":
        rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data = np.concatenate([np.zeros((len(rows), 4), np.uint8), rows], axis=1).tobytes()
        align, bits, extra = BLOCK + 4, 4, struct.pack("<HH", 2, 1 + 2 * BLOCK)
        rate = RATE * align // (1 + 2 * BLOCK)
    else:
        data, align, bits, extra, rate = payload, 1, 8, struct.pack("<H", 0), RATE
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, bytes of a block and data chunk of a WAV file of one channel, found by walking its chunks; codec "" where the file is damaged or of another kind."""
    at, codec, align = 12, "", 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(media):
            tag, channels, _, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag and channels == 1), "")
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            if codec == "adpcm":  # a last block that is cut short holds no whole header and data
                return (codec, align, data[: len(data) // align * align]) if align > 4 else ("", 1, b"")
            return (codec, 1, data) if codec else ("", 1, b"")
        at += 8 + size + (size & 1)
    return "", 1, b""


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled up with spaces to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: each new sample is the mean of its neighbours, the last one is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    after = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def feature_of(codec: str, pcm: np.ndarray) -> str:
    """Length, energy, peak, zero crossings and a checksum of resampled PCM, all whole numbers."""
    if not len(pcm):
        return f"{codec or 'damaged'};rate={OUT_RATE};samples=0"
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec};rate={OUT_RATE};samples={len(x)};energy={int((x * x).sum() // len(x))};peak={int(np.abs(x).max())};crossings={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts_of(batches, "text"):
        data, bounds = text_bytes(batch.column("text"))
        raw = data.tobytes()
        media = []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            text = raw[a:z]
            media.append(wav(CODECS[zlib.crc32(text) % len(CODECS)], payload_of(text)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes stored losslessly as telephony audio in a WAV file.

    The text's checksum picks the codec, so equal texts give equal files.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def decoded(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, stored payload and PCM at RATE of each file; all ADPCM blocks of the list advance together."""
    opened = [unwav(m) for m in media]
    out: list[tuple[str, bytes, np.ndarray]] = [("", b"", np.zeros(0, np.int16))] * len(media)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (codec, align, data) in enumerate(opened):
        raw = np.frombuffer(data, np.uint8)
        if codec == "adpcm":
            blocks.setdefault(align, []).append((i, raw.reshape(-1, align)))
        elif codec:
            out[i] = (codec, data, (MU_LAW if codec == "ulaw" else A_LAW)[raw])
    for alike in blocks.values():
        samples = adpcm_samples(np.concatenate([b for _, b in alike]))
        at = 0
        for i, b in alike:
            out[i] = ("adpcm", b[:, 4:].tobytes(), samples[at : at + len(b)].reshape(-1))
            at += len(b)
    return out


def _decoder(keep_pcm: bool):
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()} | ({"pcm": pa.binary()} if keep_pcm else {})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "media", 1 << 21):
            media = part.column("media").to_pylist()
            rows: dict[str, list] = {k: [] for k in kinds}
            for file, (codec, payload, pcm) in zip(media, decoded(media), strict=True):
                out = doubled(pcm)
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
                rows["media_bytes"].append(len(file))
                rows["media_sha256"].append(hashlib.sha256(file).hexdigest())
                rows["feature"].append(feature_of(codec, out))
                if keep_pcm:
                    rows["pcm"].append(out.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(rows[k], kind) for k, kind in kinds.items())], names=["doc_id", "n_bytes", *kinds])

    return decode


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Read files of `encoded` and expand them; `pcm` is the resampled 16-bit PCM, left out on request."""
    return media.mapInArrow(_decoder(keep_pcm), RESULT + (", pcm binary" if keep_pcm else ""))


def audio(docs: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Store every text as telephony audio in a table of the shared folder, read the stored bytes back, expand and resample them.

    Returns RESULT and, with keep_pcm, the resampled PCM, 4 bytes or more for each
    byte of text.

    * null text counts as empty: a payload of UNIT spaces
    * each row is handled on its own; repeated rows and ids repeat their result
    * nothing is ordered, so there are no ties; a very long text is one file, coded and expanded in one task
    * an empty table gives no rows; other columns are ignored
    """
    return read_back(stored(encoded(docs), "media"), keep_pcm)
