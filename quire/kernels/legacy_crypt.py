"""Keys of the standard security handler, revisions 2 to 4."""

from __future__ import annotations

from hashlib import md5

#: Fixed value: what passwords are padded with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def file_key(password: bytes, owner: bytes, rights: int, file_id: bytes, revision: int, size: int, metadata: bool = True) -> bytes:
    more = b"\xff\xff\xff\xff" if revision >= 4 and not metadata else b""
    key = md5(padded(password) + owner[:32] + (rights & 0xFFFFFFFF).to_bytes(4, "little") + file_id + more).digest()
    if revision >= 3:
        for _ in range(50):
            key = md5(key[:size]).digest()
    return key[:size]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """/U as the key makes it; from revision 3 on its first 16 bytes."""
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, md5(PAD + file_id).digest())
    for k in range(1, 20):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def _owner_key(password: bytes, revision: int, size: int) -> bytes:
    key = md5(padded(password)).digest()
    if revision >= 3:
        for _ in range(50):
            key = md5(key).digest()
    return key[:size]


def owner_entry(owner_password: bytes, user_password: bytes, revision: int, size: int) -> bytes:
    key = _owner_key(owner_password or user_password, revision, size)
    out = rc4(key, padded(user_password))
    for k in range(1, 20 if revision >= 3 else 1):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def unlocked(password: bytes, owner: bytes, user: bytes, rights: int, file_id: bytes, revision: int, size: int, metadata: bool) -> tuple[bytes, bool] | None:
    """(file key, whether as owner) for the password as the user's, for an empty one, or for it as the owner's; None if none fits."""
    length = 32 if revision == 2 else 16

    def fits(p: bytes) -> bytes | None:
        key = file_key(p, owner, rights, file_id, revision, size, metadata)
        return key if user_entry(key, file_id, revision)[:length] == user[:length] else None

    for p in dict.fromkeys((password, b"")):
        if (key := fits(p)) is not None:
            return key, False
    key = _owner_key(password, revision, size)
    inner = owner[:32]
    for k in reversed(range(20 if revision >= 3 else 1)):
        inner = rc4(bytes(b ^ k for b in key), inner)
    found = fits(inner)
    return None if found is None else (found, True)
