"""Opaque cursors of ranked results: encoded state, decoded only against the same state."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from dataclasses import dataclass

from ..functions import formats
from ..functions.hashing import pipeline_fingerprint


class CursorError(ValueError):
    """code: malformed, stale_index, stale_generation, stale_scope or stale_fingerprint."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class State:
    index_id: str
    scope_revision: int
    epoch: int
    generation: int | None


def config_fingerprint(version: str) -> bytes:
    text = f"{formats.RETRIEVAL_DESCRIPTOR}binary-version={version}\npipeline-fingerprint={pipeline_fingerprint()}\n"
    return hashlib.sha256(text.encode()).digest()


def query_fingerprint(api: str, project_id: str, query: str, mode: str, explain: bool) -> bytes:
    h = hashlib.sha256()
    for part in (api.encode(), uuid.UUID(project_id).bytes, query.encode(), mode.encode(), b"1" if explain else b"0"):
        h.update(struct.pack(">Q", len(part)) + part)
    return h.digest()


def encode(offset: int, state: State, config: bytes, query: bytes) -> str:
    body = struct.pack(">BB16sQQBq", 1, offset, uuid.UUID(state.index_id).bytes, state.scope_revision, state.epoch, state.generation is not None, state.generation or 0) + config + query
    body += hashlib.sha256(formats.CURSOR_DOMAIN + body).digest()
    return "v1." + base64.urlsafe_b64encode(body).decode().rstrip("=")


def decode(cursor: str, state: State, config: bytes, query: bytes) -> int:
    """The offset, if the cursor is whole and was made for this query and state."""
    try:
        if not cursor.startswith("v1."):
            raise ValueError
        text = cursor[3:]
        raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        if len(raw) != 139 or base64.urlsafe_b64encode(raw).decode().rstrip("=") != text:
            raise ValueError
    except ValueError:
        raise CursorError("malformed") from None
    body, check = raw[:107], raw[107:]
    if hashlib.sha256(formats.CURSOR_DOMAIN + body).digest() != check:
        raise CursorError("malformed")
    version, offset, index, scope, epoch, flag, generation = struct.unpack(">BB16sQQBq", body[:43])
    if version != 1 or not 1 <= offset < formats.RESULTS_MAX or flag not in (0, 1) or (generation != 0 if not flag else generation <= 0):
        raise CursorError("malformed")
    if body[75:107] != query:
        raise CursorError("stale_fingerprint")
    if str(uuid.UUID(bytes=index)) != state.index_id or epoch != state.epoch:
        raise CursorError("stale_index")
    if (generation if flag else None) != state.generation:
        raise CursorError("stale_generation")
    if scope != state.scope_revision:
        raise CursorError("stale_scope")
    if body[43:75] != config:
        raise CursorError("stale_fingerprint")
    return offset
