"""Codecs as column expressions: text, key/value, URL framing, gzip, JSON, registry frames.

Nulls stay null. What the reference data flow would panic on (short frames, bad magic bytes,
corrupt gzip) raises and fails the task.
"""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_decode(v: Column) -> Column:
    """Bytes as they are; unlike decode(), a cast never rejects them."""
    return v.cast("string")


def text_encode(v: Column) -> Column:
    return v.cast("binary")


def kv_nil_key(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(F.lit(None).cast("binary").alias("key"), v.alias("value")))


def kvm_no_meta(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(F.lit(None).cast("binary").alias("key"), v.alias("value"), F.create_map().cast("map<string,binary>").alias("headers")))


def kv_value(v: Column) -> Column:
    return v["value"]


def headers_last_wins(pairs: Column) -> Column:
    """A list of (key, value) headers as a map in which a later key overwrites an earlier one."""
    entry = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:binary>>"), lambda acc, p: F.array_append(F.filter(acc, lambda e: e["key"] != p["key"]), F.struct(p["key"].cast("string").alias("key"), p["value"].cast("binary").alias("value"))))
    return F.map_from_entries(entry)


def _le(n: Column, width: int) -> Column:
    """A number as `width` little-endian bytes."""
    code = F.lpad(F.right(F.hex(n.cast("bigint")), F.lit(2 * width)), 2 * width, "0")
    return F.concat(*(F.unhex(F.substring(code, 2 * i - 1, 2)) for i in range(width, 0, -1)))


def url_encode(v: Column) -> Column:
    """Three strings, each after its length as four little-endian bytes, then the time as eight."""
    parts = []
    for name in ("proto", "path", "name"):
        raw = v[name].cast("binary")
        parts += [_le(F.octet_length(raw), 4), raw]
    return F.concat(*parts, _le(v["mod"], 8))


def _url_decode(series: pd.Series) -> pd.DataFrame:
    rows = []
    for frame in series:
        if frame is None:
            rows.append((None,) * 4)
            continue
        at, strings = 0, []
        for _ in range(3):
            (n,) = struct.unpack_from("<I", frame, at)
            if len(frame) < at + 4 + n:
                raise ValueError("the frame ends within a string")
            strings.append(bytes(frame[at + 4 : at + 4 + n]).decode())
            at += 4 + n
        rows.append((*strings, *struct.unpack_from("<q", frame, at)))
    out = pd.DataFrame(rows, columns=["proto", "path", "name", "mod"])
    return out.astype({"mod": "Int64"})


def url_decode(v: Column) -> Column:
    return F.pandas_udf(_url_decode, "proto string, path string, name string, mod bigint")(v)


def _each(fn):
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else fn(bytes(x)))

    return run


def gzip_encode(v: Column) -> Column:
    return F.pandas_udf(_each(lambda b: gzip.compress(b, 6, mtime=0)), "binary")(v)


def gzip_decode(v: Column) -> Column:
    return F.pandas_udf(_each(gzip.decompress), "binary")(v)


def json_encode(v: Column) -> Column:
    return F.to_json(v, {"ignoreNullFields": "false"})


def registry_frame(v: Column) -> Column:
    """A registry's frame: a zero byte, the schema's id as four big-endian bytes, the payload."""
    ok = (F.octet_length(v) >= 5) & (F.hex(F.substring(v, 1, 1)) == "00")
    bad = F.raise_error(F.lit("no registry frame: the first of at least five bytes must be 0")).cast("struct<schema_id:bigint,data:binary>")
    return F.when(v.isNull(), F.lit(None)).when(ok, F.struct(F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("bigint").alias("schema_id"), F.substring(v, F.lit(6), F.octet_length(v)).alias("data"))).otherwise(bad)


def registry_wrap(schema_id: Column, payload: Column) -> Column:
    """A registry's frame around a payload; an id that four bytes don't hold raises."""
    number = schema_id.cast("bigint")
    wide = F.raise_error(F.lit("a registry frame has four bytes for an id")).cast("string")
    code = F.when(number.between(0, 0xFFFFFFFF), F.lpad(F.hex(number), 8, "0")).when(number.isNotNull(), wide)
    return F.concat(F.unhex(F.lit("00")), F.unhex(code), payload)


def custom_frame(v: Column, magic: str = "0101") -> Column:
    """A two-byte magic before the payload."""
    ok = F.hex(F.substring(v, 1, 2)) == magic
    return F.when(ok, F.substring(v, F.lit(3), F.octet_length(v))).otherwise(F.when(v.isNotNull(), F.raise_error(F.lit("wrong magic")).cast("binary")))


def literal_split(v: Column, separator: str) -> Column:
    """Parts between occurrences of a literal separator: empty ones stay; an empty separator gives characters."""
    if separator == "":
        return F.filter(F.split(v, "", -1), lambda c: c != "")
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(v, quoted, -1)


def text_lines(v: Column) -> Column:
    """Lines that aren't empty; only a line feed ends one, so carriage returns stay."""
    return F.filter(F.split(v, "\n", -1), lambda x: F.octet_length(x) > 0)
