"""Logical types of a flow's elements and their Spark types."""

from __future__ import annotations

from typing import NamedTuple


class Kind(NamedTuple):
    name: str
    ddl: str | None

    def __repr__(self) -> str:
        return self.name


ANY = Kind("any", None)
BINARY = Kind("binary", "binary")
STRING = Kind("string", "string")
LONG = Kind("long", "bigint")
INT = Kind("int", "int")
SHORT = Kind("short", "smallint")
DOUBLE = Kind("double", "double")
XML = Kind("xml", "string")
KV = Kind("kv", "struct<key:binary,value:binary>")
KVM = Kind("kvm", "struct<key:binary,value:binary,headers:map<string,binary>>")
URL = Kind("url", "struct<proto:string,path:string,name:string,mod:bigint>")
STREAM = Kind("bytestream", "binary")
AVRO = Kind("avro", "struct<schema_id:int,schema:string,data:binary>")

PYTHON = {str: STRING, bytes: BINARY, int: LONG, float: DOUBLE, bool: Kind("boolean", "boolean")}


def record(ddl: str) -> Kind:
    """A named-column element."""
    return Kind(f"record<{ddl}>", ddl)


def assignable(given: Kind, wanted: Kind) -> bool:
    return wanted == ANY or given == wanted
