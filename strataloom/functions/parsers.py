"""Scalar functions that need a library: Arrow-batched, never row by row over the JVM border."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def client_key(raw: str) -> str:
    """Limiter key of an address: IPv4 in IPv6 as IPv4, other IPv6 by its /64; what is no address stays."""
    try:
        ip = ipaddress.ip_address(raw.strip())
    except ValueError:
        return raw
    if ip.version == 6 and ip.ipv4_mapped:
        return str(ip.ipv4_mapped)
    return str(ip) if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False))


@F.pandas_udf(T.StringType())
def rate_key(ip: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else client_key(x) for x in ip], dtype="object")


def string_leaves(text: str) -> list[str]:
    """All strings in a JSON value, in the order of the text, whatever they are nested in."""
    out, todo = [], [json.loads(text)]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, (list, dict)):
            todo.extend(reversed(v if isinstance(v, list) else list(v.values())))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(texts: pd.Series) -> pd.Series:
    """The strings of each JSON text; null where it is not JSON."""

    def one(t):
        try:
            return None if t is None else string_leaves(t)
        except ValueError:
            return None

    return texts.map(one)
