"""Ciphers and the decryption of protected documents (standard library only)."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
import zlib
from functools import lru_cache
from operator import xor
from xml.etree import ElementTree

from .containers import CompoundFile, write_zip


class WrongPassword(ValueError):
    """The password does not open the document."""


class UnsupportedCipher(ValueError):
    """A protection that is recognised but not opened."""


# AES, with its tables made from the field's arithmetic.


def _double(a: int) -> int:
    return (a << 1 ^ 0x11B) & 0xFF if a & 0x80 else a << 1


@lru_cache(maxsize=1)
def _aes_tables():
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = [0] * 256
    for a in range(256):
        inverse = power[(255 - log[a]) % 255] if a else 0
        y = inverse
        for turn in range(1, 5):
            y ^= (inverse << turn | inverse >> 8 - turn) & 0xFF
        box[a] = y ^ 0x63
    back = [0] * 256
    for a, s in enumerate(box):
        back[s] = a
    times = {f: [power[(log[f] + log[a]) % 255] if a else 0 for a in range(256)] for f in (2, 3, 9, 11, 13, 14)}
    turned = lambda t: [t] + [[w >> 8 * n | (w << 32 - 8 * n) & 0xFFFFFFFF for w in t] for n in (1, 2, 3)]
    # A round's substitution and mixing of a column at once, for each of its bytes.
    forth = turned([times[2][a] << 24 | a << 16 | a << 8 | times[3][a] for a in box])
    mixed = turned([times[14][a] << 24 | times[9][a] << 16 | times[13][a] << 8 | times[11][a] for a in range(256)])
    undo = turned([mixed[0][a] for a in back])
    return box, back, forth, undo, mixed


_WORDS = struct.Struct(">4I")


class Aes:
    """One key; blocks of 16 bytes."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("key length")
        box, *_, mixed = _aes_tables()
        words, n = [list(key[i : i + 4]) for i in range(0, len(key), 4)], len(key) // 4
        self.rounds, constant = n + 6, 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = list(words[i - 1])
            if i % n == 0:
                w = [box[b] for b in w[1:] + w[:1]]
                w[0] ^= constant
                constant = _double(constant)
            elif n > 6 and i % n == 4:
                w = [box[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        whole = [int.from_bytes(bytes(w), "big") for w in words]
        self.keys = [tuple(whole[4 * r : 4 * r + 4]) for r in range(self.rounds + 1)]
        unmixed = lambda w: mixed[0][w >> 24] ^ mixed[1][w >> 16 & 255] ^ mixed[2][w >> 8 & 255] ^ mixed[3][w & 255]
        self.back_keys = [self.keys[-1], *[tuple(map(unmixed, k)) for k in self.keys[-2:0:-1]], self.keys[0]]

    def decrypt(self, block: bytes) -> bytes:
        _, box, _, (t0, t1, t2, t3), _ = _aes_tables()
        a, b, c, d = map(xor, _WORDS.unpack(block), self.back_keys[0])
        for k in self.back_keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[d >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[b & 255] ^ k[0], t0[b >> 24] ^ t1[a >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[c & 255] ^ k[1],
                t0[c >> 24] ^ t1[b >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[d & 255] ^ k[2], t0[d >> 24] ^ t1[c >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[a & 255] ^ k[3],
            )
        last = ((a, d, c, b), (b, a, d, c), (c, b, a, d), (d, c, b, a))
        return _WORDS.pack(*[(box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k for (w, x, y, z), k in zip(last, self.back_keys[-1])])

    def encrypt(self, block: bytes) -> bytes:
        box, _, (t0, t1, t2, t3), _, _ = _aes_tables()
        a, b, c, d = map(xor, _WORDS.unpack(block), self.keys[0])
        for k in self.keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        last = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
        return _WORDS.pack(*[(box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k for (w, x, y, z), k in zip(last, self.keys[-1])])


def aes_ecb_decrypt(key: bytes, data: bytes) -> bytes:
    aes = Aes(key)
    return b"".join(aes.decrypt(data[i : i + 16]) for i in range(0, len(data) - 15, 16))


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append((int.from_bytes(aes.decrypt(block), "big") ^ int.from_bytes(iv, "big")).to_bytes(16, "big"))
        iv = block
    return b"".join(out)


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        iv = aes.encrypt(bytes(map(xor, data[i : i + 16], iv)))
        out.append(iv)
    return b"".join(out)


# Blowfish; its constants are the binary digits of pi.


@lru_cache(maxsize=1)
def _pi_words() -> list[int]:
    """The first 1042 words of 32 bits of pi's fraction, by Machin's formula."""
    bits = 1042 * 32 + 64
    one = 1 << bits

    def arctan(n: int) -> int:
        total = term = one // n
        k, sign = 1, -1
        while term:
            term //= n * n
            k += 2
            total += sign * (term // k)
            sign = -sign
        return total

    fraction = (4 * (4 * arctan(5) - arctan(239)) & one - 1) >> 64
    return [fraction >> 32 * (1041 - i) & 0xFFFFFFFF for i in range(1042)]


class Blowfish:
    def __init__(self, key: bytes):
        words = _pi_words()
        self.p, self.s = list(words[:18]), [list(words[18 + 256 * i : 274 + 256 * i]) for i in range(4)]
        for i in range(18):
            self.p[i] ^= int.from_bytes(bytes(key[(4 * i + j) % len(key)] for j in range(4)), "big")
        left = right = 0
        for table in (self.p, *self.s):
            for i in range(0, len(table), 2):
                left, right = self._pair(left, right)
                table[i], table[i + 1] = left, right

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        s = self.s
        for i in range(16):
            left ^= self.p[i]
            right ^= ((s[0][left >> 24] + s[1][left >> 16 & 255] & 0xFFFFFFFF ^ s[2][left >> 8 & 255]) + s[3][left & 255]) & 0xFFFFFFFF
            left, right = right, left
        left, right = right, left
        return left ^ self.p[17], right ^ self.p[16]

    def encrypt(self, block: bytes) -> bytes:
        return struct.pack(">II", *self._pair(*struct.unpack(">II", block)))


def blowfish_cfb_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    cipher, out = Blowfish(key), []
    for i in range(0, len(data), 8):
        block = data[i : i + 8]
        out.append(bytes(a ^ b for a, b in zip(block, cipher.encrypt(iv))))
        iv = block
    return b"".join(out)


# OpenDocument


def _attr(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _entry(node) -> dict:
    """Parameters of an entry's encryption-data."""
    out: dict = {"path": _attr(node, "full-path"), "size": int(_attr(node, "size") or 0)}
    for child in node.iter():
        tag = child.tag.rpartition("}")[2]
        if tag == "encryption-data":
            out |= {"checksum_type": _attr(child, "checksum-type"), "checksum": base64.b64decode(_attr(child, "checksum") or "")}
        elif tag == "algorithm":
            out |= {"cipher": _attr(child, "algorithm-name"), "iv": base64.b64decode(_attr(child, "initialisation-vector") or "")}
        elif tag == "key-derivation":
            out |= {"derivation": _attr(child, "key-derivation-name"), "key_size": int(_attr(child, "key-size") or 16), "rounds": int(_attr(child, "iteration-count") or 1024), "salt": base64.b64decode(_attr(child, "salt") or "")}
        elif tag == "start-key-generation":
            out["start"] = _attr(child, "start-key-generation-name")
    return out


def _open_entry(data: bytes, spec: dict, password: str) -> bytes:
    start = hashlib.sha256 if "sha256" in spec.get("start", "").lower() else hashlib.sha1
    if "argon2" in spec.get("derivation", "").lower():
        raise UnsupportedCipher("argon2id")
    key = hashlib.pbkdf2_hmac("sha1", start(password.encode()).digest(), spec["salt"], spec["rounds"], spec["key_size"])
    cipher = spec["cipher"].lower()
    if "aes" in cipher and "cbc" in cipher:
        plain = aes_cbc_decrypt(key, spec["iv"], data)
    elif "blowfish" in cipher:
        plain = blowfish_cfb_decrypt(key, spec["iv"], data)
    else:
        raise UnsupportedCipher(spec["cipher"])
    kind = spec.get("checksum_type", "").lower()
    if kind:
        digest = hashlib.sha256 if "sha256" in kind else hashlib.sha1
        # Padding may or may not be counted: the checksum is of the first 1024 bytes of what was compressed.
        body = plain[: -plain[-1]] if "aes" in cipher and plain and 0 < plain[-1] <= 16 else plain
        if spec["checksum"] not in (digest(p[:1024]).digest() for p in (body, plain)) and len(plain) > 0:
            raise WrongPassword("checksum differs")
    try:
        return zlib.decompressobj(-15).decompress(plain)
    except zlib.error as error:
        raise WrongPassword("no deflate stream") from error


def decrypt_odf(data: bytes, password: str) -> bytes:
    """The archive with its encrypted entries in plain; the smallest one tells whether the password is right."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(archive.read("META-INF/manifest.xml"))
    specs = {s["path"]: s for s in (_entry(n) for n in root if n.tag.rpartition("}")[2] == "file-entry") if "cipher" in s}
    order = sorted((p for p in specs if p in archive.namelist()), key=lambda p: archive.getinfo(p).file_size)
    plain = {p: _open_entry(archive.read(p), specs[p], password) for p in order}
    for node in root:
        for child in [c for c in node if c.tag.rpartition("}")[2] == "encryption-data"]:
            node.remove(child)
    entries = []
    for info in archive.infolist():
        if info.is_dir():
            continue
        body = plain.get(info.filename) if info.filename in plain else archive.read(info)
        if info.filename == "META-INF/manifest.xml":
            body = ElementTree.tostring(root)
        entries.append((info.filename, body, None if info.filename == "mimetype" else 6))
    return write_zip(entries)


# Office Open XML, standard encryption

_SPIN = 50_000


def decrypt_ooxml(data: bytes, password: str) -> bytes:
    """The package inside an encrypted compound file; only the standard scheme with AES is opened."""
    file = CompoundFile(data)
    info, package = file.stream("/EncryptionInfo"), file.stream("/EncryptedPackage")
    if info is None or package is None:
        raise UnsupportedCipher("no encrypted package")
    major, minor = struct.unpack_from("<HH", info)
    if minor != 2:
        raise UnsupportedCipher(f"version {major}.{minor}")
    size = struct.unpack_from("<I", info, 8)[0]
    key_bits = struct.unpack_from("<I", info, 12 + 16)[0] or 128
    at = 12 + size
    salt_size = struct.unpack_from("<I", info, at)[0]
    salt, verifier = info[at + 4 : at + 4 + salt_size], info[at + 4 + salt_size : at + 20 + salt_size]
    check = info[at + 24 + salt_size : at + 56 + salt_size]
    digest = hashlib.sha1(salt + password.encode("utf-16-le")).digest()
    for i in range(_SPIN):
        digest = hashlib.sha1(struct.pack("<I", i) + digest).digest()
    digest = hashlib.sha1(digest + b"\0\0\0\0").digest()
    pad = lambda byte: hashlib.sha1(bytes(byte ^ (digest[i] if i < 20 else 0) for i in range(64))).digest()
    key = (pad(0x36) + pad(0x5C))[: key_bits // 8]
    if hashlib.sha1(aes_ecb_decrypt(key, verifier)).digest() != aes_ecb_decrypt(key, check)[:20]:
        raise WrongPassword("verifier differs")
    length = struct.unpack_from("<Q", package)[0]
    return aes_ecb_decrypt(key, package[8:])[:length]
