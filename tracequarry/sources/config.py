"""Configuration of a directory source as canonical JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from ..functions.hashing import canonical_json
from .filesystem import Options

CONFIG_BYTES, SCHEMA_VERSION = 16 * 1024, 1

# --- Fixed values: the JSON's fields, and the option that each stands for ---
FIELDS = {
    "max_file_bytes": "max_file_bytes", "max_source_files": "max_files", "max_source_bytes": "max_bytes", "includes": "includes", "excludes": "excludes", "allow_sensitive": "allow_sensitive",
    "max_visited_entries": "max_entries", "max_visited_directories": "max_directories", "max_directory_depth": "max_depth", "max_entries_per_directory": "max_entries_per_directory",
}
REQUIRED = {"schema_version", "root", "max_file_bytes", "max_source_files", "max_source_bytes"}


class ConfigError(ValueError):
    """code: too_large, invalid_json, unknown_field, missing_field, unsupported_schema, invalid_root, invalid_value or invalid_quota."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class SourceConfig:
    root: str
    options: Options = Options()
    index_quota_bytes: int | None = None

    def to_json(self) -> str:
        """The configuration with every field, keys in order; the quota only if there is one."""
        value = {"schema_version": SCHEMA_VERSION, "root": self.root} | {name: getattr(self.options, option) for name, option in FIELDS.items()}
        value |= {"includes": list(self.options.includes), "excludes": list(self.options.excludes)}
        return canonical_json(value if self.index_quota_bytes is None else value | {"index_quota_bytes": self.index_quota_bytes})

    @classmethod
    def parse(cls, text: str) -> "SourceConfig":
        if len(text.encode()) > CONFIG_BYTES:
            raise ConfigError("too_large")
        try:
            value = json.loads(text)
        except ValueError:
            raise ConfigError("invalid_json") from None
        if not isinstance(value, dict):
            raise ConfigError("invalid_json")
        if set(value) - REQUIRED - set(FIELDS) - {"index_quota_bytes"}:
            raise ConfigError("unknown_field")
        if REQUIRED - set(value):
            raise ConfigError("missing_field")
        if value["schema_version"] != SCHEMA_VERSION:
            raise ConfigError("unsupported_schema")
        root, quota = value["root"], value.get("index_quota_bytes")
        if not isinstance(root, str) or not os.path.isabs(root) or "\0" in root or ".." in root.split("/"):
            raise ConfigError("invalid_root")
        kinds = {"includes": list, "excludes": list, "allow_sensitive": bool}
        own = {}
        for name, option in FIELDS.items():
            if name in value:
                kind = kinds.get(name, int)
                if type(value[name]) is not kind or (kind is list and not all(isinstance(x, str) for x in value[name])):
                    raise ConfigError("invalid_value")
                own[option] = tuple(value[name]) if kind is list else value[name]
        if quota is not None and (type(quota) is not int or quota <= 0):
            raise ConfigError("invalid_quota")
        try:
            return cls(root, Options(**own), quota)
        except ValueError:
            raise ConfigError("invalid_value") from None
