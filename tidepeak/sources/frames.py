"""Binary frames of the live protocol: a wire decoder as an Arrow function, its encoder for fixtures, and messages by method."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers, names and kinds of a frame's fields.
FIELDS = {
    1: ("seq_id", int), 2: ("log_id", int), 3: ("service", int), 4: ("method", int), 6: ("payload_encoding", str), 7: ("payload_type", str),
    8: ("payload", bytes), 9: ("log_id_new", str), 10: ("server_timing", str), 11: ("msg_id", str), 12: ("frame_type", int),
}
HEADERS = 5
#: Methods of messages and the type of row that they give.
METHODS = {"WebcastChatMessage": "chat", "WebcastGiftMessage": "gift", "WebcastLikeMessage": "like", "WebcastMemberMessage": "member", "WebcastSocialMessage": "social", "WebcastRoomStatsMessage": "roomStats"}
_KIND = {int: ("bigint", pa.int64(), 0), str: ("string", pa.string(), ""), bytes: ("binary", pa.binary(), b"")}
SCHEMA = "struct<" + ",".join(f"{n}:{_KIND[k][0]}" for n, k in FIELDS.values()) + ",headers:map<string,string>>"


def varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("varints are not negative")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    """Signed number of a zigzag code."""
    return n >> 1 if n % 2 == 0 else -(n >> 1) - 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; fields of fixed width are passed over, and what is cut off or of an unknown kind ends it."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while at < len(data):
            byte = data[at]
            at += 1
            value += (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        return value

    while at < len(data):
        tag = number()
        kind = tag % 8
        if kind == 0:
            yield tag // 8, number()
        elif kind == 2:
            size = number()
            yield tag // 8, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            return


def decode(data: bytes | None) -> dict | None:
    """A frame as a dict with defaults for absent fields; null stays null."""
    if data is None:
        return None
    out = {n: _KIND[k][2] for n, k in FIELDS.values()} | {"headers": []}
    for number, value in fields(data):
        if number == HEADERS and isinstance(value, bytes):
            entry = dict(fields(value))
            out["headers"].append(tuple(entry.get(i, b"").decode("utf-8", "replace") if isinstance(entry.get(i, b""), bytes) else "" for i in (1, 2)))
        elif number in FIELDS:
            name, kind = FIELDS[number]
            if kind is int and isinstance(value, int):
                out[name] = value & (1 << 63) - 1
            elif kind is not int and isinstance(value, bytes):
                out[name] = value.decode("utf-8", "replace") if kind is str else value
    out["headers"] = [*dict(out["headers"]).items()]
    return out


def encode(frame: dict) -> bytes:
    """Wire bytes of a frame, for fixtures."""
    chunk = lambda number, raw: varint(number * 8 + 2) + varint(len(raw)) + raw
    out = b""
    for number, (name, kind) in FIELDS.items():
        if value := frame.get(name):
            out += varint(number * 8) + varint(value) if kind is int else chunk(number, value.encode() if kind is str else value)
    for k, v in dict(frame.get("headers", {})).items():
        out += chunk(HEADERS, chunk(1, k.encode()) + chunk(2, v.encode()))
    return out


def decode_column(data: Column) -> Column:
    @F.arrow_udf(SCHEMA)
    def decode_frames(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(n, _KIND[k][1]) for n, k in FIELDS.values()] + [("headers", pa.map_(pa.string(), pa.string()))])
        for frames in batches:
            yield pa.array([decode(x) for x in frames.to_pylist()], kind)

    return decode_frames(data)


def message_type(method: Column) -> Column:
    return F.coalesce(*[F.when(method == m, F.lit(t)) for m, t in METHODS.items()], F.lit("unknown"))


def method_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(message_type(F.col("method")).alias("type"), "method").agg(F.count(F.lit(1)).alias("n"))
