"""Driver-side files: checked downloads, locked updates, slots shared by processes, configuration, artifacts with digests."""

from __future__ import annotations

import csv
import fcntl
import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import atomic_json


def fetch(url: str, target: str | Path, sha256: str, timeout: float = 60.0, block: int = 1 << 20) -> Path:
    """Download a file unless it is there already; it appears whole and with the right digest, or not at all."""
    target = Path(target)
    if target.exists() and file_digest(target) == sha256:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:
            while data := source.read(block):
                out.write(data)
        if (found := file_digest(part)) != sha256:
            raise ValueError(f"{url} has digest {found}, not {sha256}")
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return target


def file_digest(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@contextmanager
def locked(path: str | Path) -> Iterator[None]:
    """An advisory lock that other processes on this machine wait for."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def update_json(path: str | Path, change: Callable[[Any], Any], default: Any = None) -> Any:
    """Read, change and write a small JSON file under its lock."""
    path = Path(path)
    with locked(path.with_name(path.name + ".lock")):
        value = change(json.loads(path.read_text()) if path.exists() else default)
        atomic_json(path, value)
    return value


@contextmanager
def slot(folder: str | Path, n: int, wait: float = 0.05, sleep: Callable[[float], None] = time.sleep) -> Iterator[int]:
    """One of ``n`` slots that processes share; waits until one is free."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    while True:
        for i in range(n):
            f = (folder / f"slot-{i}").open("a")
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                f.close()
                continue
            try:
                yield i
            finally:
                f.close()
            return
        sleep(wait)


def paced(path: str | Path, per_minute: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait for the next of evenly spaced calls that all processes with this file share."""
    due = 0.0

    def take(state: dict) -> dict:
        nonlocal due
        due = max(clock(), state["next"])
        return {"next": due + 60.0 / per_minute}

    update_json(path, take, {"next": 0.0})
    if (left := due - clock()) > 0:
        sleep(left)


def load_config(path: str | Path | None, defaults: dict[str, Any], env: Mapping[str, str] = os.environ, prefix: str = "QUILLSPAN") -> dict[str, Any]:
    """Nested settings: defaults, then a JSON or YAML file, then variables such as PREFIX__RETRIEVAL__TOP_K.

    Unknown names in the file are an error. A variable takes the type of the value that it replaces.
    """
    given: dict[str, Any] = {}
    if path is not None:
        text = Path(path).read_text()
        if str(path).endswith((".yaml", ".yml")):
            import yaml  # an optional library

            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
    return _merged(defaults, given, env, prefix)


def _merged(base: dict[str, Any], given: dict[str, Any], env: Mapping[str, str], at: str) -> dict[str, Any]:
    if unknown := set(given) - set(base):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    out = {}
    for name, default in base.items():
        key = f"{at}__{name.upper()}"
        if isinstance(default, dict):
            out[name] = _merged(default, given.get(name, {}), env, key)
            continue
        value = given.get(name, default)
        if key in env:
            raw = env[key]
            value = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw) if isinstance(default, int | float) else raw
        out[name] = value
    return out


def rows_csv(rows: list[dict[str, Any]], path: str | Path, union: bool = False) -> Path:
    """A small report: columns of the first row, or of all in order of appearance; no rows are one empty line."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if not rows:
        path.write_text("\n")
        return path
    names = list(dict.fromkeys(k for r in rows for k in r)) if union else list(rows[0])
    with path.open("w", newline="") as f:
        out = csv.DictWriter(f, names, extrasaction="raise" if union else "ignore", lineterminator="\n")
        out.writeheader()
        out.writerows(rows)
    return path


def ordered_digest(df: DataFrame, order: str, span: int = 10_000) -> str:
    """SHA-256 of the rows in order of a distinct, non-negative integer column, however they are partitioned.

    Rows are digested in ranges of ``span``, ranges in ranges of ranges; a few digests reach the driver.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    level = df.select(F.col(order).cast("long").alias("p"), row.alias("d"))
    for _ in range(2):
        parts = level.groupBy(F.floor(F.col("p") / span).alias("p"))
        level = parts.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda r: r["d"])), 256).alias("d"))
    return hashlib.sha256("".join(r.d for r in level.orderBy("p").collect()).encode()).hexdigest()


def write_passages(df: DataFrame, path: str, order: str = "pos") -> str:
    """Store passages and return the digest of what was stored."""
    df.write.mode("overwrite").parquet(path)
    return ordered_digest(df.sparkSession.read.parquet(path), order)
