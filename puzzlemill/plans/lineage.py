"""Manifests: what an artifact is, what it came from, whether it still holds."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validation import count_violations
from ..sources.writers import canonical_json, publish_json

SHA = 1 << 20
#: A lock file that is empty for so many seconds was left by a crash.
EMPTY_LOCK = 10.0


def file_sha256(path: str | Path) -> str:
    """Of a file, or of the names and contents of a folder's files."""
    path, digest = Path(path), hashlib.sha256()
    for p in sorted(path.rglob("*")) if path.is_dir() else [path]:
        if p.is_file() and not p.name.startswith((".", "_")):
            if path.is_dir():
                digest.update(str(p.relative_to(path)).encode())
            with p.open("rb") as f:
                while block := f.read(SHA):
                    digest.update(block)
    return digest.hexdigest()


def byte_size(path: str | Path) -> int:
    path = Path(path)
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))) if path.is_dir() else path.stat().st_size


def table_digest(df: DataFrame) -> dict:
    """Rows and a digest of a table of any size, whatever its order and partitions; one aggregation."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.conv(F.substring(F.sha2(row, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)]
    one = df.agg(F.count("*").alias("rows"), *sums).first()
    return {"rows": one.rows, "digest": hashlib.sha256("|".join([str(one.rows), *[one[f"s{k}"].split(".")[0] for k in range(4)]]).encode()).hexdigest()}


def config_sha256(config: dict) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def safe_path(root: str | Path, relative: str) -> Path:
    """A path below ``root``; anything that leaves it is refused."""
    root = Path(root).resolve()
    out = (root / relative).resolve()
    if Path(relative).is_absolute() or root not in (out, *out.parents):
        raise ValueError(f"path leaves its folder: {relative}")
    return out


def utc_text(moment: datetime) -> str:
    if moment.tzinfo is None:
        raise ValueError("a time needs its zone")
    return moment.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def increasing_clock(now: Callable[[], datetime], after: datetime | None = None) -> Callable[[], str]:
    """A clock whose times always increase, by a microsecond at least."""
    last = after

    def tick() -> str:
        nonlocal last
        moment = now()
        utc_text(moment)
        last = moment if last is None or moment > last else last + timedelta(microseconds=1)
        return utc_text(last)

    return tick


def artifact_id(manifest: dict) -> str:
    """Identity: everything but the time and the identity itself."""
    return config_sha256({k: v for k, v in manifest.items() if k not in ("created_at", "artifact_id")})


def write_manifest(path: str | Path, stage: str, config: dict, outputs: dict[str, str | Path], parents: list[dict] = (), counts: dict[str, int] | None = None, schemas: dict[str, str] | None = None) -> dict:
    """Publish a manifest, last of all that a stage publishes; counts must meet their equations."""
    if wrong := count_violations(counts or {}):
        raise ValueError("; ".join(wrong))
    m = {
        "stage": stage,
        "completed": True,
        "config_sha256": config_sha256(config),
        "outputs": {k: {"path": str(v), "sha256": file_sha256(v), "byte_size": byte_size(v), "schema": (schemas or {}).get(k)} for k, v in outputs.items()},
        "parents": [{"stage": p["stage"], "artifact_id": p["artifact_id"]} for p in parents],
        "counts": counts or {},
        "created_at": utc_text(datetime.now(timezone.utc)),
    }
    m["artifact_id"] = artifact_id(m)
    publish_json(path, m)
    return m


def revoke_manifest(path: str | Path) -> None:
    """Before outputs change, what vouches for them goes."""
    Path(path).unlink(missing_ok=True)


def v1_manifest(path: str | Path, values: dict, now: datetime | None = None) -> dict:
    """v1: an envelope around whatever a stage reports; its own values outweigh the envelope's."""
    name = values.get("name", Path(path).parent.name)
    # Version and schema of the envelope.
    m = {"manifest_version": 1, "schema": "countdown.post_train.manifest.v1", "name": name, "stage": name, "created_at": (now or datetime.now(timezone.utc)).isoformat()} | values
    publish_json(path, m)
    return m


def manifest_violations(m: dict, stage: str | None = None, rows: dict[str, int] | None = None, schemas: dict[str, str] | None = None) -> list[str]:
    """What of a manifest does not fit its files: stage, completion, sizes, hashes, counts, schemas."""
    wrong = [] if stage in (None, m.get("stage")) else [f"stage is {m.get('stage')}, not {stage}"]
    wrong += [] if m.get("completed") is True else ["not completed"]
    for name, o in m.get("outputs", {}).items():
        if not Path(o["path"]).exists():
            wrong.append(f"{name} is missing")
        elif "byte_size" in o and o["byte_size"] != byte_size(o["path"]):
            wrong.append(f"{name} has another size")
        elif o["sha256"] != file_sha256(o["path"]):
            wrong.append(f"{name} has another hash")
        if schemas and name in schemas and o.get("schema") != schemas[name]:
            wrong.append(f"{name} has another schema")
    for name, n in (rows or {}).items():
        if m.get("counts", {}).get(name) != n:
            wrong.append(f"{name} has {n} rows, not {m.get('counts', {}).get(name)}")
    return wrong + count_violations(m.get("counts", {}))


def read_manifest(path: str | Path) -> dict:
    m = json.loads(Path(path).read_text(encoding="utf-8"))
    if m.get("artifact_id") != artifact_id(m):
        raise ValueError(f"{path}: the identity does not fit the contents")
    return m


def status(path: str | Path, config: dict, parents: list[dict] = ()) -> str:
    """missing, failed (unreadable or forged), stale (unfinished or not what it should be) or complete."""
    if not Path(path).exists():
        return "missing"
    try:
        m = read_manifest(path)
    except (ValueError, KeyError):
        return "failed"
    now = [{"stage": p["stage"], "artifact_id": p["artifact_id"]} for p in parents]
    same = m["config_sha256"] == config_sha256(config) and m["parents"] == now
    return "complete" if same and not manifest_violations(m) else "stale"


@contextmanager
def unchanged(*paths: str | Path):
    """Fail if an input changes meanwhile."""
    before = [file_sha256(p) for p in paths]
    yield
    if [file_sha256(p) for p in paths] != before:
        raise RuntimeError("an input has changed")


def _held(path: Path) -> dict:
    """Who holds a lock; nobody if its file has stayed empty."""
    began = time.monotonic()
    while True:
        try:
            text = path.read_text()
        except FileNotFoundError:
            return {}
        if text:
            return json.loads(text)
        if time.monotonic() - began > EMPTY_LOCK:
            return {"host": os.uname().nodename, "pid": 0, "token": ""}
        time.sleep(0.05)


@contextmanager
def output_lock(path: str | Path):
    """An exclusive lock file; one that a dead process of this host has left is taken over.

    The file appears with its contents by one link, so it is never half made.
    A take-over moves the dead lock away by one rename, which only one process
    can do; release removes the file only if the token in it is the own one.
    """
    path = Path(path)
    me = {"pid": os.getpid(), "host": os.uname().nodename, "token": uuid.uuid4().hex}
    mine = path.with_name(f".{path.name}.{me['token']}")
    mine.write_text(json.dumps(me))
    try:
        while True:
            try:
                os.link(mine, path)
                break
            except FileExistsError:
                held = _held(path)
                if not held:
                    continue
                if held.get("host") != me["host"]:
                    raise RuntimeError(f"locked by another host: {held.get('host')}") from None
                if held.get("pid") and Path(f"/proc/{held['pid']}").exists():
                    raise RuntimeError(f"locked by process {held['pid']}") from None
                aside = path.with_name(f".{path.name}.dead-{me['token']}")
                try:
                    os.rename(path, aside)
                except FileNotFoundError:
                    continue
                taken = json.loads(aside.read_text() or "{}")
                if taken.get("token", "") != held.get("token", ""):  # a live lock that has come between
                    os.link(aside, path)
                aside.unlink()
    finally:
        mine.unlink()
    try:
        yield
    finally:
        if path.exists() and json.loads(path.read_text() or "{}").get("token") == me["token"]:
            path.unlink()
