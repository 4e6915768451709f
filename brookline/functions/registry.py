"""The codec registry and the search for the codecs that lead from one type to another."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column

from brookline.functions import basic, xml
from brookline.types import BINARY, KV, KVM, STREAM, STRING, URL, XML, Kind


class Codec(NamedTuple):
    name: str
    takes: Kind
    gives: Kind
    apply: Callable[[Column], Column]


DEFAULT = (
    Codec("xml_decode", BINARY, XML, lambda v: xml.checked(basic.text_decode(v))),
    Codec("xml_encode", XML, BINARY, basic.text_encode),
    Codec("text_decode", BINARY, STRING, basic.text_decode),
    Codec("text_encode", STRING, BINARY, basic.text_encode),
    Codec("url_encode", URL, BINARY, basic.url_encode),
    Codec("url_decode", BINARY, URL, basic.url_decode),
    Codec("kv_nil_key", BINARY, KV, basic.kv_nil_key),
    Codec("kvm_no_meta", BINARY, KVM, basic.kvm_no_meta),
    Codec("kv_ignore_key", KV, BINARY, basic.kv_value),
    Codec("kvm_ignore_meta", KVM, BINARY, basic.kv_value),
)
GZIP = (Codec("gzip_encode", BINARY, BINARY, basic.gzip_encode), Codec("gzip_decode", BINARY, BINARY, basic.gzip_decode))
DEPTH = 5


def path(given: Kind, wanted: Kind, codecs: Sequence[Codec] = DEFAULT) -> list[Codec]:
    """The shortest chain of codecs, earlier ones in the list first; TypeError if there is none within DEPTH."""
    queue, seen = deque([(given, [])]), {given}
    while queue:
        kind, chain = queue.popleft()
        if len(chain) == DEPTH:
            continue
        for codec in codecs:
            if codec.takes == kind and codec.gives not in seen:
                if codec.gives == wanted:
                    return [*chain, codec]
                seen.add(codec.gives)
                queue.append((codec.gives, [*chain, codec]))
    raise TypeError(f"no codecs lead from {given} to {wanted}")


__all__ = ["DEFAULT", "GZIP", "STREAM", "Codec", "path"]
