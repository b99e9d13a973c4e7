"""What surrounds a run on one machine: lock, heartbeat, log of imports, labels, tokenizers, displayed values."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import merge
from ledgerspark.operators.token_counts import TokenCounter


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


@contextmanager
def writer_lock(data: Path) -> Iterator[None]:
    """Only one process writes to a data folder; a second one raises."""
    data.mkdir(parents=True, exist_ok=True)
    with open(data / "writer.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"another process writes to {data}") from e
        yield


def locked(data: Path) -> bool:
    try:
        with writer_lock(data):
            return False
    except RuntimeError:
        return True


def heartbeat(data: Path, state: dict) -> None:
    """Replace the heartbeat; readers see the old one or the new one."""
    data.mkdir(parents=True, exist_ok=True)
    made = data / f"heartbeat-{uuid.uuid4().hex}"
    made.write_text(json.dumps(state | {"at": now(), "pid": os.getpid()}))
    made.replace(data / "heartbeat.json")


def status(data: Path) -> dict:
    """The last heartbeat, and whether its process is still there."""
    try:
        last = json.loads((data / "heartbeat.json").read_text())
    except (OSError, ValueError):
        last = {}
    held = locked(data)
    alive = "running" if held else "stale" if last.get("status") == "running" else "stopped"
    return last | {"status": alive, "writer_lock": held}


def log_run(data: Path, summary: dict) -> dict:
    """Append an import's summary to the log of imports."""
    data.mkdir(parents=True, exist_ok=True)
    with open(data / "runs.jsonl", "a") as f:
        f.write(json.dumps(summary | {"finished_at": now()}) + "\n")
    return summary


def put_label(data: Path, session: str, label: str | None) -> None:
    """Queue a label: a file of its own, so that any process may do it while another one writes."""
    queue = data / "labels"
    queue.mkdir(parents=True, exist_ok=True)
    made = queue / f".{uuid.uuid4().hex}"
    made.write_text(json.dumps({"session_id": session, "label": label, "updated_at": now()}))
    made.replace(queue / f"{uuid.uuid4().hex}.json")


def labels(spark: SparkSession, data: Path) -> DataFrame:
    """The last label of each session from the queue."""
    kind = "session_id string, label string, updated_at string"
    queue = data / "labels"
    rows = spark.read.schema(kind).json(str(queue)) if queue.is_dir() and any(queue.glob("*.json")) else spark.createDataFrame([], kind)
    return merge.labels_of(rows).select("session_id", "label").where("label is not null")


# --- tokenizers -----------------------------------------------------------------------------------


def tokenizer_map(data: Path) -> dict[str, dict]:
    """Models with a tokenizer that can be verified: an absolute local file of the given SHA-256."""
    try:
        models = json.loads((data / "tokenizers.json").read_text()).get("models", {})
    except (OSError, ValueError, AttributeError):
        return {}
    good = {}
    for model, spec in models.items() if isinstance(models, dict) else ():
        try:
            path = Path(spec["bpe_path"])
            if path.is_absolute() and path.is_file() and hashlib.sha256(path.read_bytes()).hexdigest() == spec["sha256"] and spec["pattern"] and spec["encoding"]:
                good[model] = spec
        except (OSError, KeyError, TypeError):
            continue
    return good


def counter(specs: dict[str, dict], kept: str | None = None) -> TokenCounter | None:
    """Counts of texts by their model's tokenizer; with ``kept``, a folder where they stay from import to import."""
    return TokenCounter(specs, kept) if specs else None


# --- displayed values -----------------------------------------------------------------------------

#: What is shown for codes and for unknown token numbers.
WORDS = {"unknown": "Not recorded", "unknown_outcome": "Outcome not recorded", "no_verified_local_tokenizer": "Model tokenizer not configured", "unavailable": "Content unavailable"}
UNKNOWN = dict.fromkeys(("argument_tokens", "result_tokens", "estimated_result_tokens"), "No model-tokenizer estimate") | dict.fromkeys(("rough_argument_tokens", "rough_result_tokens"), "Text size unavailable")


def shown(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """A dataset as text to look at: grouped digits, local times, words for codes and for what is unknown."""

    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("timestamp"):
            local = F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))
            return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("unknown"))
        if kind in ("bigint", "int", "smallint", "tinyint"):
            made = F.format_number(c, 0)
        elif kind in ("double", "float") or kind.startswith("decimal"):
            made = F.format_number(c, 2)
        else:
            made = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair]), c.cast("string")), c.cast("string"))
        return F.coalesce(made, F.lit(UNKNOWN.get(name, "Not recorded")))

    return df.select(*[text(n, k).alias(n) for n, k in df.dtypes])


def local_time(value: str | None, zone: str) -> str:
    """An ISO time as wall time of a zone; what is no time is shown as it is."""
    if not value:
        return "unknown"
    try:
        return datetime.fromisoformat(value).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S %Z")
    except ValueError:
        return value
