"""Sinks: versions behind a pointer, sets with a manifest, ledgers, logs, canonical JSON."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .store import Store

#: The file that names a table's present version.
POINTER = "_CURRENT"


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no escapes, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def publish_json(path: str | Path, value: object) -> None:
    """Write beside the target, flush to disk, then rename.  For files of the driver's machine."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with temporary.open("w", encoding="utf-8") as f:
        f.write(canonical_json(value) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def current(spark: SparkSession, path: str | Path) -> str:
    """The folder of a published table's present version."""
    return f"{path}/{Store(spark).read(f'{path}/{POINTER}').strip()}"


def publish(df: DataFrame, path: str | Path, form: str = "json") -> int:
    """Write a new version of a table, read it back, then point to it; its row count.

    Readers go by ``current``: they see the old version or the new one, whole.
    The version before the present one stays for readers that have begun.
    """
    spark, store = df.sparkSession, Store(df.sparkSession)
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{path}/{version}")
    n = spark.read.format(form).schema(df.schema).load(f"{path}/{version}").count()
    before = store.read(f"{path}/{POINTER}").strip() if store.exists(f"{path}/{POINTER}") else None
    store.write(f"{path}/{POINTER}", version + "\n")
    for name in store.names(path):
        if name.startswith("v-") and name not in (version, before):
            store.delete(f"{path}/{name}")
    return n


def publish_parquet(df: DataFrame, path: str | Path, expected: int | None = None) -> int:
    """Parquet with its schema beside it; fails if the rows read back are not as many as expected."""
    n = publish(df, path, "parquet")
    if expected is not None and n != expected:
        raise ValueError(f"{path}: {n} rows instead of {expected}")
    Store(df.sparkSession).write(f"{path}.schema.json", canonical_json(json.loads(df.schema.json())) + "\n")
    return n


def publish_set(tables: dict[str, DataFrame], folder: str | Path, manifest: dict, form: str = "json", aliases: dict[str, str] | None = None) -> dict:
    """Several tables that count only together.

    The manifest of the set before is revoked first and the new one comes last,
    so whoever finds a manifest finds all its tables.  ``aliases`` are further
    names of tables: the same version under another pointer, no second copy.
    """
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark)
    store.delete(f"{folder}/manifest.json")
    counts = {name: publish(df, f"{folder}/{name}", form) for name, df in tables.items()}
    for alias, name in (aliases or {}).items():
        version = store.read(f"{folder}/{name}/{POINTER}").strip()
        store.write(f"{folder}/{alias}/{POINTER}", f"../{name}/{version}\n")
        counts[alias] = counts[name]
    done = manifest | {"completed": True, "counts": counts}
    store.write(f"{folder}/manifest.json", canonical_json(done) + "\n")
    return done


def published_set(spark: SparkSession, folder: str | Path) -> dict:
    """The manifest of a set; fails if there is none or it is not complete."""
    store = Store(spark)
    if not store.exists(f"{folder}/manifest.json"):
        raise FileNotFoundError(f"{folder} has no manifest")
    manifest = json.loads(store.read(f"{folder}/manifest.json"))
    if manifest.get("completed") is not True:
        raise ValueError(f"{folder} is not complete")
    return manifest


def extend_ledger(spark: SparkSession, path: str | Path, rows: list[dict], key: str = "step") -> list[dict]:
    """Read a ledger of JSON lines, add rows and put the whole in place; a key that it has is refused."""
    store = Store(spark)
    old = [json.loads(x) for x in store.read(path).splitlines() if x.strip()] if store.exists(path) else []
    every = old + rows
    if len({r[key] for r in every}) < len(every):
        raise ValueError(f"the ledger has that {key} already")
    store.write(path, "".join(canonical_json(r) + "\n" for r in every))
    return every


def append_log(df: DataFrame, path: str | Path) -> None:
    """Append rows to a log of JSON lines."""
    df.write.mode("append").json(str(path))
