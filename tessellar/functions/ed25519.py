"""Ed25519 signatures (RFC 8032) in plain Python: small messages such as manifests, on the driver."""

from __future__ import annotations

import hashlib

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, P - 2, P) % P

Point = tuple[int, int, int, int]


def _x_of(y: int, sign: int) -> int:
    """The coordinate x of sign's parity on the curve; an error if there is none."""
    if y >= P:
        raise ValueError("no point")
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or not x and sign:
        raise ValueError("no point")
    return P - x if x & 1 != sign else x


def _point(x: int, y: int) -> Point:
    return x, y, 1, x * y % P


BASE = _point(_x_of(BASE_Y, 0), BASE_Y)


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _packed(p: Point) -> bytes:
    inverse = pow(p[2], P - 2, P)
    x, y = p[0] * inverse % P, p[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpacked(raw: bytes) -> Point:
    value = int.from_bytes(raw, "little")
    y = value & (1 << 255) - 1
    return _point(_x_of(y, value >> 255), y)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    if len(seed) != 32:
        raise ValueError("a seed has 32 bytes")
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _secret(seed)
    own = _packed(_times(scalar, BASE))
    r = _digest(prefix, message) % ORDER
    first = _packed(_times(r, BASE))
    return first + ((r + _digest(first, own, message) * scalar) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    s = int.from_bytes(signature[32:], "little")
    try:
        a, r = _unpacked(public), _unpacked(signature[:32])
    except ValueError:
        return False
    if s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(r, _times(_digest(signature[:32], public, message) % ORDER, a))
    return _packed(left) == _packed(right)
