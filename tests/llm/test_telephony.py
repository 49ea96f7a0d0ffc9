"""Stored audio: every column against a plain encoder and decoder, and files of other makers."""

import hashlib
import struct
import zlib

import numpy as np

from bookflow.llm import telephony
from tests.llm.test_texts import docs, empty, rows, texts  # noqa: F401


def plain_pcm(codec, payload):
    if codec == "adpcm":
        out = []
        for k in range(0, len(payload), 192):
            value = index = 0
            out.append(value)
            for byte in payload[k : k + 192]:
                for code in (byte & 15, byte >> 4):
                    step = int(telephony.STEPS[index])
                    change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                    value = min(max(value - change if code & 8 else value + change, -32768), 32767)
                    index = min(max(index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7], 0), 88)
                    out.append(value)
        return out
    return [int((telephony.MU_LAW if codec == "ulaw" else telephony.A_LAW)[b]) for b in payload]


def plain_wav(codec, payload):
    if codec == "adpcm":
        payload = b"".join(bytes(4) + payload[k : k + 192] for k in range(0, len(payload), 192))
        fmt = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 196 // 385, 196, 4, 2, 385)
    else:
        fmt = struct.pack("<HHIIHHH", {"ulaw": 7, "alaw": 6}[codec], 1, 8000, 8000, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_every_column_equals_a_plain_version(docs):  # noqa: F811
    want = []
    for i, t in texts():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        codec = ("ulaw", "alaw", "adpcm")[zlib.crc32(raw) % 3]
        pcm, media = plain_pcm(codec, payload), plain_wav(codec, payload)
        out = [x for a, b in zip(pcm, pcm[1:] + pcm[-1:], strict=True) for x in (a, (a + b) >> 1)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
        feature = f"{codec};rate=16000;samples={len(out)};energy={sum(x * x for x in out) // len(out)};peak={max(map(abs, out))};crossings={crossings};crc={zlib.crc32(struct.pack(f'<{len(out)}h', *out))}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in names)) for r in rows(telephony.audio(docs)))


def test_files_of_other_makers():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    blocks[:, 2] %= 89
    data = blocks.tobytes()

    def wav(tag, channels, align, content, before=b""):
        fmt = struct.pack("<HHIIHH", tag, channels, 8000, 8000, align, 8)
        body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(content)) + content
        return b"RIFF" + struct.pack("<I", len(body)) + body

    note = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = [wav(17, 1, 40, data + b"cut"), wav(7, 1, 1, b"abc", note), wav(1, 1, 2, b"abcd"), wav(6, 2, 2, b"abcd"), b"RIFF", b"", wav(17, 1, 0, data), telephony.wav("ulaw", b"x" * 192)[:30]]
    got = telephony.decoded(files)
    assert got[0][0] == "adpcm" and got[0][2].tolist() == telephony.adpcm_samples(blocks).reshape(-1).tolist()
    assert got[1][:2] == ("ulaw", b"abc")
    assert all(g[0] == "" and g[1] == b"" and len(g[2]) == 0 for g in got[2:])
    assert telephony.feature_of("", telephony.doubled(got[2][2])).startswith("damaged")
