"""Drift: stored documents against the live files they were made from."""

from __future__ import annotations

import hashlib
import os
import stat
import time

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import format_mtime
from .filesystem import DiscoveryError, open_below, open_root

#: metadata_unchanged, metadata_changed, missing, blocked or unknown.
SCHEMA = "document_id string, state string, content_matches boolean"


def look(top: int, key: bytes, size: int, updated: str | None, body_sha256: str, verify: bool) -> tuple[str, bool | None]:
    """(state, whether the content still has its hash: None if not asked or not readable) of a file below the open folder
    top. Names are opened relative to their folder and no link is followed."""
    *folders, name = key.split(b"/")
    try:
        folder = open_below(top, folders, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
    except FileNotFoundError:
        return "missing", None
    except OSError:
        return "blocked", None
    try:
        info = os.stat(name, dir_fd=folder, follow_symlinks=False)
        if not stat.S_ISREG(info.st_mode):
            return "blocked", None
        matches = None
        if verify:
            with os.fdopen(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=folder), "rb") as f:
                matches = hashlib.file_digest(f, "sha256").hexdigest() == body_sha256
    except FileNotFoundError:
        return "missing", None
    except OSError:
        return "blocked", None
    finally:
        os.close(folder)
    same = info.st_size == size and format_mtime(info.st_mtime_ns) == updated
    return "metadata_unchanged" if same else "metadata_changed", matches


def probe(targets: DataFrame, root: str, verify: bool = False, deadline_ms: int | None = None) -> DataFrame:
    """A row for each of targets, which need document_id, connector_key, size, source_updated_at and body_sha256. Each task
    looks for deadline_ms at most, from its first row on; what it did not come to is unknown. A root that can't be
    opened blocks every document."""

    def run(batches):
        end = None
        for pdf in batches:
            if end is None and deadline_ms is not None:
                end = time.monotonic() + deadline_ms / 1000
            try:
                top = open_root(root)
            except DiscoveryError:
                top = None
            rows = []
            for r in pdf.itertuples():
                if end is not None and time.monotonic() >= end:
                    found = "unknown", None
                else:
                    found = ("blocked", None) if top is None else look(top, bytes(r.connector_key), r.size, r.source_updated_at, r.body_sha256, verify)
                rows.append((r.document_id, *found))
            if top is not None:
                os.close(top)
            yield pd.DataFrame(rows, columns=["document_id", "state", "content_matches"]).astype({"content_matches": "boolean"})

    return targets.select("document_id", "connector_key", "size", "source_updated_at", "body_sha256").mapInPandas(run, SCHEMA)
