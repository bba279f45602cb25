"""Calls rows from a decoded request and its response; shared by both ingest paths. Plain Python: the exact JSON text can't come from a built-in."""

from __future__ import annotations

import gzip
import json
import zlib
from typing import Any


def decoded(raw: bytes | None, encoding: str = "") -> str:
    """Body text: the content encoding undone as named, or by its magic bytes; what can't be undone is empty, bad UTF-8 is replaced."""
    if not raw:
        return ""
    names = [e.strip().lower() for e in (encoding or "").split(",") if e.strip()]
    try:
        for name in reversed(names):
            raw = _undone(raw, name)
        if not names:
            raw = _undone(raw, "gzip" if raw[:2] == b"\x1f\x8b" else "zstd" if raw[:4] == b"\x28\xb5\x2f\xfd" else "")
    except Exception:  # noqa: BLE001 - a broken body counts as none
        return ""
    return raw.decode("utf-8", "replace")


def _undone(raw: bytes, name: str) -> bytes:
    if name in ("gzip", "x-gzip"):
        return gzip.decompress(raw)
    if name == "deflate":
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return zlib.decompress(raw, -zlib.MAX_WBITS)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name == "br":
        try:
            import brotli
        except ImportError:
            return raw  # without the library the bytes are read as they are
        return brotli.decompress(raw)
    return raw


def compact(value: Any) -> str:
    """JSON without spaces: key order kept, non-ASCII escaped."""
    return json.dumps(value, separators=(",", ":"))


def _parsed(text: str) -> list[dict] | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def call_count(text: str) -> int | None:
    """How many objects a request's body holds, None if it is no JSON."""
    found = _parsed(text)
    return None if found is None else len(found)


def _whole(code: Any) -> int | None:
    try:
        number = int(code)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if -(2**63) <= number < 2**63 else None


def _hashable(value: Any) -> bool:
    return not isinstance(value, (list, dict))


def build_rows(flow_id: int, request: str, response: str, *, start: float | None, end: float | None, status: int | None, host: str | None, path: str | None) -> list[tuple]:
    """Rows in the order of the schema's columns.

    A request that isn't JSON, or holds no object, gives no row. Answers are found by id (of equal ids the last), else by position among
    objects. An id that is a list or an object can't be looked up and goes by position.
    """
    calls = _parsed(request)
    if not calls:
        return []
    answers = _parsed(response) or []
    by_id = {a["id"]: a for a in answers if "id" in a and a["id"] is not None and _hashable(a["id"])}
    took = (end - start) * 1000.0 if start and end else None
    out = []
    for position, call in enumerate(calls):
        wanted = call.get("id")
        answer = by_id.get(wanted) if wanted is not None and _hashable(wanted) else None
        if answer is None and position < len(answers):
            answer = answers[position]
        result = code = message = data = None
        if answer is not None:
            if "result" in answer:
                result = compact(answer["result"])  # a null result is the text null
            error = answer.get("error")
            if isinstance(error, dict):
                code = _whole(error.get("code"))
                message = None if error.get("message") is None else str(error["message"])
                data = compact(error["data"]) if error.get("data") is not None else None
        out.append(
            (
                flow_id, position, len(calls), start or None, took, status, host, path,
                str(call.get("method", "?")), None if wanted is None else str(wanted),
                compact(call["params"]) if call.get("params") is not None else None,
                result, code, message, data, len(request), len(response),
            )
        )
    return out


def client_address(headers: dict[str, str], peer: str | None) -> str | None:
    """First forwarded address, else the real-IP header, else the connection's peer."""
    forwarded = headers.get("x-forwarded-for") or ""
    if forwarded:
        return forwarded.split(",")[0].strip()
    real = headers.get("x-real-ip") or ""
    return real.strip() if real else peer
