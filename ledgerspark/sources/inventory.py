"""What there is to read: logs, databases and the session index, found on the driver."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import sqlite

#: Begins a path of logs that stands for all eligible rollouts of a configuration.
DISCOVER = "discover:"
COLUMNS = "canonical_path string, original_path string, kind string, disposition string, reason string, error string, size bigint, mtime_ns bigint, file_id string, schema_signature string"


def local_path(text: str | Path) -> Path:
    """A path of this machine, without the prefix of long paths."""
    plain = str(text)
    for start, instead in (("\\\\?\\UNC\\", "\\\\"), ("\\\\?\\", "")):
        if plain.startswith(start):
            plain = instead + plain[len(start) :]
            break
    return Path(plain).expanduser().resolve()


def database_kind(name: str) -> tuple[str, str]:
    """(kind, disposition) by a file's name."""
    for start, kind in (("state_", "state_database"), ("thread_history_", "history_database")):
        if name.startswith(start):
            return kind, "eligible"
    if name.endswith("-dev.db"):
        return "catalog_database", "eligible"
    return ("log_database", "diagnostic_only") if name.startswith("logs_") else ("unknown_database", "excluded")


@dataclass
class Config:
    """Where sources and results are: arguments before environment before defaults."""

    home: Path
    data: Path
    logs: list[Path] = field(default_factory=list)
    databases: list[Path] = field(default_factory=list)
    log_dir: Path | None = None
    otel: dict = field(default_factory=dict)

    @property
    def sources(self) -> list[Path]:
        """Folders that nothing is written to."""
        return [p.resolve() for p in (self.home, *self.logs, *self.databases, *([self.log_dir] if self.log_dir else []))]

    def writable(self, path: str | Path) -> Path:
        """An output path; raises if it lies in a source."""
        out = local_path(path)
        if any(out.is_relative_to(s) for s in self.sources):
            raise ValueError("output can't be written into a source")
        return out

    @classmethod
    def resolve(cls, home: str | None = None, data: str | None = None, more: tuple[str, ...] = ()) -> Config:
        base = local_path(home or os.environ.get("AGENT_HOME") or Path.home() / ".agent")
        out = local_path(data or os.environ.get("LEDGERSPARK_DATA") or Path.home() / ".ledgerspark")
        given = {}
        if (toml := base / "config.toml").is_file():
            given = tomllib.loads(toml.read_text())
        named = lambda key: local_path(given[key]) if isinstance(given.get(key), str) else None
        databases = named("sqlite_home") or base
        roots = [base / "sessions", base / "archived_sessions", *map(local_path, more)]
        if any(out == r or r in out.parents for r in (base, *roots)):
            raise ValueError("results can't be inside a source")
        return cls(base, out, roots, [databases], named("log_dir"), given["otel"] if isinstance(given.get("otel"), dict) else {})


def walk(root: Path, suffixes: tuple[str, ...]) -> tuple[list[Path], list[str]]:
    """Files below a folder, linked folders left out, and what couldn't be read."""
    errors: list[str] = []
    found = []
    for top, folders, names in os.walk(root, onerror=lambda e: errors.append(str(e)), followlinks=False):
        folders[:] = sorted(d for d in folders if not os.path.islink(os.path.join(top, d)))
        found += [Path(top, n) for n in sorted(names) if n.endswith(suffixes)]
    return found, errors


def discover(config: Config) -> list[dict]:
    """One row for each source; the first kind of a path counts, and no source stops the others."""
    rows: dict[str, dict] = {}

    def add(path: Path, kind: str, disposition: str, reason: str = "", error: str | None = None) -> None:
        name = os.path.realpath(path)
        row = {"canonical_path": name, "original_path": str(path), "kind": kind, "disposition": disposition, "reason": reason, "error": error, "size": None, "mtime_ns": None, "file_id": None, "schema_signature": None}
        try:
            s = os.stat(path)
            row |= {"size": s.st_size, "mtime_ns": s.st_mtime_ns, "file_id": f"{s.st_dev}:{s.st_ino}"}
            if kind in ("state_database", "history_database", "catalog_database"):
                row["schema_signature"] = sqlite.signature(str(path))
        except Exception as e:  # an unreadable source is a row, not an end
            row |= {"disposition": "unavailable", "error": str(e)}
        rows.setdefault(name, row)

    for root in config.logs:
        if not root.is_dir():
            add(root, "log_root", "unavailable", "missing")
            continue
        found, errors = walk(root, (".jsonl",))
        for p in found:
            add(p, "rollout", "eligible")
        for e in errors:
            add(root, "log_root", "failed", "walk", e)
    for root in config.databases:
        for p in walk(root, (".sqlite", ".db"))[0] if root.is_dir() else []:
            kind, disposition = database_kind(p.name)
            add(p, kind, disposition)
    if (index := config.home / "session_index.jsonl").is_file():
        add(index, "session_index", "eligible")
    for state in [r["original_path"] for r in rows.values() if r["kind"] == "state_database" and r["disposition"] == "eligible"]:
        for path in rollout_paths(state):
            remote = "://" in path
            add(Path(path), "rollout", "diagnostic_only" if remote else "eligible", "remote_reference" if remote else "catalog")
    return list(rows.values())


def eligible(config: Config) -> str:
    """A path for the log source: what is discovered whenever the source looks for files."""
    return DISCOVER + json.dumps({"home": str(config.home), "data": str(config.data), "logs": [*map(str, config.logs)], "databases": [*map(str, config.databases)]})


def rollouts(where: str) -> list[str]:
    """Canonical paths of the eligible rollouts that such a path stands for, each once."""
    c = json.loads(where.removeprefix(DISCOVER))
    config = Config(Path(c["home"]), Path(c["data"]), [*map(Path, c["logs"])], [*map(Path, c["databases"])])
    return sorted(s["canonical_path"] for s in discover(config) if s["kind"] == "rollout" and s["disposition"] == "eligible")


def rollout_paths(state: str) -> list[str]:
    has = sqlite.reflect(state).get("threads", {})
    if "rollout_path" not in has:
        return []
    c = sqlite.connect(state)
    try:
        return [r[0] for r in c.execute("SELECT rollout_path FROM threads WHERE rollout_path IS NOT NULL AND rollout_path <> ''")]
    finally:
        c.close()


def as_table(spark: SparkSession, sources: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(s[c.split(" ")[0]] for c in COLUMNS.split(", ")) for s in sources], COLUMNS)
