"""The standard security handler: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

# Fixed value: the padding string of the password algorithms.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Denied(Exception):
    """No password given opens the file, or its security handler is not supported."""


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, c in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = (j + a + c) & 255
        s[i], s[j] = s[j], a
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[k] = c ^ s[(a + b) & 255]
    return bytes(out)


# ---- AES: tables made by rule, blocks of a message worked on side by side ----


def _xtime(a: int) -> int:
    return (a << 1 ^ 0x1B) & 0xFF if a & 0x80 else a << 1


def _tables():
    logs, powers, x = [0] * 256, [0] * 255, 1
    for i in range(255):
        powers[i], logs[x] = x, i
        x ^= _xtime(x)
    box = []
    for a in range(256):
        inverse = powers[-logs[a] % 255] if a else 0
        v = inverse
        for shift in range(1, 5):
            v ^= (inverse << shift | inverse >> (8 - shift)) & 0xFF
        box.append(v ^ 0x63)
    times = lambda a, b: powers[(logs[a] + logs[b]) % 255] if a and b else 0
    return np.array(box, np.uint8), {k: np.array([times(a, k) for a in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}


_BOX, _MULTIPLY = _tables()
_UNBOX = np.argsort(_BOX).astype(np.uint8)
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


_SUBSTITUTE = _BOX.tolist()


def _columns(box: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    """What a byte of row r gives to its column, substituted and mixed: four tables one behind the other."""
    out = np.empty((4, 256, 4), np.uint8)
    for r in range(4):
        for row in range(4):
            f = factors[(r - row) % 4]
            out[r, :, row] = box if f == 1 else _MULTIPLY[f][box]
    return out.reshape(1024, 4).view(np.uint32).ravel()


_FORWARD, _BACKWARD = _columns(_BOX, (2, 3, 1, 1)), _columns(_UNBOX, (14, 11, 13, 9))
_PLAIN_MIX = _columns(np.arange(256, dtype=np.uint8), (14, 11, 13, 9))
_TABLE_OF = np.tile(np.arange(4, dtype=np.intp) * 256, 4)


def _round_keys(key: bytes) -> np.ndarray:
    words = list(struct.unpack(f">{len(key) // 4}I", key))
    n, rounds, r = len(words), len(words) + 6, 1
    box = _SUBSTITUTE
    for i in range(n, 4 * (rounds + 1)):
        w = words[-1]
        if i % n == 0:
            w = (w << 8 | w >> 24) & 0xFFFFFFFF
        if i % n == 0 or (n > 6 and i % n == 4):
            w = box[w >> 24] << 24 | box[w >> 16 & 255] << 16 | box[w >> 8 & 255] << 8 | box[w & 255]
        if i % n == 0:
            w ^= r << 24
            r = _xtime(r)
        words.append(words[i - n] ^ w)
    return np.array(words, ">u4").view(np.uint8).reshape(rounds + 1, 16)


def _mixed(state: np.ndarray, order: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One round but for its key: bytes moved, substituted and mixed, as n x 4 words."""
    g = table.take(state.take(order, 1) + _TABLE_OF).reshape(-1, 4, 4)
    return g[:, :, 0] ^ g[:, :, 1] ^ g[:, :, 2] ^ g[:, :, 3]


_IN_PLACE = np.arange(16)


def _decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    keys = _round_keys(key)
    between = _mixed(keys[1:-1], _IN_PLACE, _PLAIN_MIX)
    state = blocks ^ keys[-1]
    for k in between[::-1]:
        state = (_mixed(state, _UNSHIFT, _BACKWARD) ^ k).view(np.uint8)
    return _UNBOX[state[:, _UNSHIFT]] ^ keys[0]


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks only; padding is not looked at."""
    whole = len(data) // 16 * 16
    if not whole:
        return b""
    blocks = np.frombuffer(data[:whole], np.uint8).reshape(-1, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], blocks[:-1]])
    return (_decrypt_blocks(key, blocks) ^ before).tobytes()


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    return cbc_encrypt_many([key], [iv], [data])[0]


def cbc_encrypt_many(keys: list[bytes], ivs: list[bytes], data: list[bytes]) -> list[bytes]:
    """Whole blocks of messages under keys of one length; a message's blocks follow one another, messages go side by side."""
    counts = np.array([len(d) // 16 for d in data], np.intp)
    if not len(data) or not counts.any():
        return [b""] * len(data)
    blocks = np.frombuffer(b"".join(d[: len(d) // 16 * 16] for d in data), np.uint8).reshape(-1, 16)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")  # longest first: those still running are the first ones
    first, lengths = starts[order], counts[order]
    rounds = np.ascontiguousarray(np.stack([_round_keys(keys[j]) for j in order.tolist()], axis=1))  # round x message x 16
    words = rounds.view(np.uint32)
    last = np.frombuffer(b"".join(ivs[j] for j in order.tolist()), np.uint8).reshape(-1, 16)
    out = np.empty_like(blocks)
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
    for step, m in enumerate(running):
        at = first[:m] + step
        state = blocks[at] ^ last[:m] ^ rounds[0, :m]
        for k in range(1, len(rounds) - 1):
            state = (_mixed(state, _SHIFT, _FORWARD) ^ words[k, :m]).view(np.uint8)
        out[at] = last = _BOX[state[:, _SHIFT]] ^ rounds[-1, :m]
    return [out[a : a + n].tobytes() for a, n in zip(starts.tolist(), counts.tolist())]


def aes_data(key: bytes, data: bytes) -> bytes:
    """Leading vector, then blocks; the last byte is padding if it is 1 to 16."""
    if len(data) < 16:
        return b""
    out = cbc_decrypt(key, data[:16], data[16:])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


# ---- keys -------------------------------------------------------------------


def hash_2b(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        n += 1
        e = cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def _legacy_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, size: int, metadata: bool) -> bytes:
    seed = (password + PAD)[:32] + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    if revision >= 4 and not metadata:
        seed += b"\xff" * 4
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def _opens(key: bytes, user: bytes, file_id: bytes, revision: int) -> bool:
    if revision == 2:
        return rc4(key, PAD) == user[:32]
    check = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        check = rc4(bytes(b ^ i for b in key), check)
    return check == user[:16]


def _user_password(password: bytes, owner: bytes, revision: int, size: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    out = owner[:32]
    for i in reversed(range(20 if revision >= 3 else 1)):
        out = rc4(bytes(b ^ i for b in key[:size]), out)
    return out


@lru_cache(256)
def _legacy_open(passwords: tuple[bytes, ...], owner: bytes, user: bytes, permissions: int, file_id: bytes, revision: int, size: int, metadata: bool) -> bytes | None:
    """The key of the first password that opens the file, as user or owner; files of one entry are tried once."""
    for password in passwords:
        for candidate in (lambda: password, lambda: _user_password(password, owner, revision, size)):
            key = _legacy_key(candidate(), owner, permissions, file_id, revision, size, metadata)
            if _opens(key, user, file_id, revision):
                return key
    return None


class Security:
    """Decrypts the strings and streams of one file."""

    def __init__(self, entry: dict, file_id: bytes, passwords: tuple[bytes, ...] = (b"",)):
        get = lambda k, d: d if entry.get(k) is None else entry[k]
        if get("Filter", "Standard") != "Standard":
            raise Denied("unknown security handler")
        version, self.revision = int(get("V", 0)), int(get("R", 0))
        self.strings, self.streams = self._method(entry, version, "StrF"), self._method(entry, version, "StmF")
        if self.strings == self.streams == "Identity":
            self.key = b""
            return
        owner, user = bytes(get("O", b"")), bytes(get("U", b""))
        if version >= 5 or self.revision >= 5:
            self.key = self._modern(passwords, owner, user, bytes(get("OE", b"")), bytes(get("UE", b"")))
            return
        size = 5
        if self.revision >= 3:
            size = int(get("Length", 40)) // 8
            if version == 4 and "Length" not in entry:
                size = 16
            size = min(16, max(5, size))
        permissions, metadata = int(get("P", 0)), get("EncryptMetadata", True) is not False
        key = _legacy_open(tuple(passwords), owner, user, permissions, file_id, self.revision, size, metadata)
        if key is None:
            raise Denied("wrong password")
        self.key = key

    @staticmethod
    def _method(entry: dict, version: int, which: str) -> str:
        if version < 4:
            return "V2"
        name = str(entry.get(which) or "Identity")
        if name == "Identity":
            return "Identity"
        filters = entry.get("CF")
        own = filters.get(name) if isinstance(filters, dict) else None
        method = str((own or {}).get("CFM") or "None")
        return {"None": "Identity"}.get(method, method)

    def _modern(self, passwords, owner, user, owner_key, user_key) -> bytes:
        for password in passwords:
            password = password[:127]
            if hash_2b(password, user[32:40], b"", self.revision) == user[:32]:
                return cbc_decrypt(hash_2b(password, user[40:48], b"", self.revision), bytes(16), user_key[:32])
            if hash_2b(password, owner[32:40], user[:48], self.revision) == owner[:32]:
                return cbc_decrypt(hash_2b(password, owner[40:48], user[:48], self.revision), bytes(16), owner_key[:32])
        raise Denied("wrong password")

    def _apply(self, method: str, data: bytes, number: int, generation: int) -> bytes:
        if method == "Identity":
            return data
        if method == "AESV3":
            return aes_data(self.key, data)
        seed = self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2]
        aes = method == "AESV2"
        key = hashlib.md5(seed + (b"sAlT" if aes else b"")).digest()[: min(16, len(self.key) + 5)]
        return aes_data(key, data) if aes else rc4(key, data)

    def string(self, data: bytes, number: int, generation: int) -> bytes:
        return self._apply(self.strings, data, number, generation)

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._apply(self.streams, data, number, generation)
