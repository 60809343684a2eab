"""Hashes, signatures, canonical JSON and keys."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def short_sha(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def short_md5(c: Column, n: int) -> Column:
    return F.substring(F.md5(c), 1, n)


def snapshot_key(sha: Column) -> Column:
    """citations/ab/cd/<sha>/snapshot.json"""
    return F.concat(F.lit("citations/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2),
                    F.lit("/"), sha, F.lit("/snapshot.json"))


def _pad(key_hex: Column, byte: int) -> Column:
    """Key block (64 bytes) xor one byte, as hex text: one nibble pair at a time through a small map."""
    table = F.array(*[F.lit(f"{i ^ byte:02X}") for i in range(256)])
    padded = F.rpad(key_hex, 128, "0")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(
        table, F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return F.unhex(F.array_join(pairs, ""))


def hmac_sha256_hex(message: Column, secret: Column) -> Column:
    """HMAC-SHA256 from the built-in digest: H((K^opad) || H((K^ipad) || message))."""
    raw = secret.cast("binary")
    key_hex = F.when(F.octet_length(raw) > 64, F.upper(F.sha2(raw, 256))).otherwise(F.hex(raw))
    inner = F.sha2(F.concat(_pad(key_hex, 0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(_pad(key_hex, 0x5C), F.unhex(inner)), 256)


def signature_ok(message: Column, secret: Column, signature: Column) -> Column:
    """Accepts the bare hex form and the 'sha256=' form."""
    return hmac_sha256_hex(message, secret).eqNullSafe(F.regexp_replace(signature, "^sha256=", ""))


def sorted_json(**fields: Column) -> Column:
    """Compact JSON object of the given columns with sorted keys; nulls are kept out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _ascii(c: Column) -> Column:
    """Characters above 127 as \\u escapes in lower case, a pair of them beyond the first plane."""
    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(ch: Column) -> Column:
        n = F.ascii(ch)
        high, low = F.floor((n - 0x10000) / 1024) + 0xD800, (n - 0x10000) % 1024 + 0xDC00
        return F.when(n < 128, ch).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def iso_time(c: Column) -> Column:
    """A timestamp as 2024-01-31T00:00:00, with six digits of a second if there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def canonical_object(fields: dict[str, Column], types: dict[str, str]) -> Column:
    """JSON object with sorted keys and no blanks, ASCII, nulls kept, times in ISO form."""
    cols = [(iso_time(fields[k]) if types.get(k, "").startswith("timestamp") else fields[k]).alias(k) for k in sorted(fields)]
    return _ascii(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


@F.arrow_udf(T.StringType())
def canonical_json(v: pa.Array) -> pa.Array:
    """Any JSON text with sorted keys, compact and ASCII; text that is no JSON stays as it is."""
    out = []
    for s in v.to_pylist():
        try:
            out.append(None if s is None else json.dumps(
                json.loads(s), separators=(",", ":"), sort_keys=True, ensure_ascii=True))
        except ValueError:
            out.append(s)
    return pa.array(out, pa.string())


def search_cache_key(query: Column, engines: Column, language: Column, max_results: Column) -> Column:
    """search:<slug20>:<hash16> over the normalised parameters."""
    q = F.lower(F.trim(query))
    body = sorted_json(query=q, engines=F.array_sort(engines), language=language, max_results=max_results)
    slug = F.regexp_replace(F.substring(q, 1, 20), r"[^a-z0-9]+", "-")
    return F.concat(F.lit("search:"), slug, F.lit(":"), short_sha(body, 16))
