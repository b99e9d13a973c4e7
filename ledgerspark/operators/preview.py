"""Read-back of original records: verified by digest, reduced to a few fields, redacted."""

from __future__ import annotations

import hashlib
import json
import re

from ledgerspark.functions.exprs import PREVIEW_CHARACTERS, REDACTIONS

#: Fields that a preview may show; records and bytes that it looks at.
SHOWN = ("cmd", "command", "code", "path", "file_path", "offset", "limit", "start_line", "end_line", "workdir")
MOST_RECORDS, MOST_BYTES = 8, 1 << 20


def redact(text: str) -> str:
    for pattern, instead in REDACTIONS:
        text = re.sub(pattern, instead.replace("$1", r"\1"), text)
    return text[:PREVIEW_CHARACTERS] + ("\n[preview truncated]" if len(text) > PREVIEW_CHARACTERS else "")


def verify(path: str, begin: int, end: int, digest: str) -> tuple[str, bytes | None]:
    """``digest_matches`` with the bytes, ``source_changed`` or ``unavailable``."""
    try:
        with open(path, "rb") as f:
            f.seek(begin)
            raw = f.read(end - begin)
    except OSError:
        return "unavailable", None
    return ("digest_matches", raw) if hashlib.sha256(raw).hexdigest() == digest else ("source_changed", None)


def _given(body: dict):
    """What a call or completed command was asked to do; None for other records."""
    item = body.get("item") if body.get("type") == "item_completed" else None
    if isinstance(item, dict):
        if str(item.get("type", "")).lower() == "commandexecution":
            return {"command": item.get("command"), "workdir": item.get("cwd")}
        return item.get("arguments") if str(item.get("type", "")).lower() in ("mcptoolcall", "dynamictoolcall") else None
    return body.get("arguments", body.get("input")) if body.get("type") in ("function_call", "custom_tool_call") else None


def command_preview(records: list[dict]) -> dict:
    """Preview from the newest of ``(record_id, path, byte_start, byte_end, digest)`` records that works."""
    why = "No supported original call record available"
    for r in sorted(records, key=lambda r: -r["record_id"])[:MOST_RECORDS]:
        if r["byte_end"] - r["byte_start"] > MOST_BYTES:
            why = "Source record exceeds preview size limit"
            continue
        state, raw = verify(r["path"], r["byte_start"], r["byte_end"], r["digest"])
        if raw is None:
            why = "Source changed since ingestion" if state == "source_changed" else "Original call could not be read"
            continue
        try:
            given = _given(json.loads(raw)["payload"])
            if isinstance(given, str) and given[:1] in "{[":
                given = json.loads(given)
        except (ValueError, KeyError, TypeError, AttributeError):
            why = "Original call could not be read"
            continue
        if given is None:
            continue
        if isinstance(given, dict):
            given = {k: v for k, v in given.items() if k in SHOWN}
            if not given:
                return {"status": "No command/path fields in this call", "text": None}
            given = json.dumps(given, ensure_ascii=False, indent=2)
        if not isinstance(given, str):
            return {"status": "Unsupported command shape", "text": None}
        return {"status": "Digest verified; common secrets redacted; preview only", "text": redact(given)}
    return {"status": why, "text": None}
