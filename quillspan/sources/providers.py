"""Model services as pluggable providers, with deterministic offline stand-ins, retries and limits."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
from collections.abc import Callable
from typing import Any, TypeVar

R = TypeVar("R")


class ProviderError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}")
        self.status = status


def with_retries(call: Callable[[], R], retries: int = 3, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> R:
    """Retry on 429 and 5xx with exponential backoff."""
    for n in range(retries + 1):
        try:
            return call()
        except ProviderError as e:
            if n == retries or not (e.status == 429 or 500 <= e.status < 600):
                raise
            sleep(backoff * 2**n)
    raise AssertionError


class RateLimiter:
    """At most ``per_minute`` calls a minute in this process, evenly spaced."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 60.0 / per_minute, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            due = max(now, self.next)
            self.next = due + self.gap
        if due > now:
            self.sleep(due - now)


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in embedder: signed feature hashing of words."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """A stand-in reranker: share of the query's words that a text has."""
    q = set(re.findall(r"\w+", query.lower()))
    return [len(q & set(re.findall(r"\w+", t.lower()))) / max(1, len(q)) for t in texts]


def pattern_extractor(patterns: dict[str, str]) -> Callable[[Any, str, str], list[dict[str, str]]]:
    """A stand-in extractor: for each predicate a regular expression with one named group for each variable."""

    def extract(slot: Any, source_id: str, text: str) -> list[dict[str, str]]:
        shape = patterns.get(slot.predicate)
        return [m.groupdict() for m in re.finditer(shape, text)] if shape else []

    return extract


def redacted(value: Any) -> Any:
    """A trace value without secrets."""
    if isinstance(value, dict):
        return {k: "***" if re.search(r"(?i)key|token|secret|password|authorization", k) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


def trace_event(service: str, request: Any, response: Any, latency_ms: float) -> str:
    """One JSON line of a provider trace, with digests of what was sent and received."""
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()
    return json.dumps({"service": service, "request": redacted(request), "request_sha256": digest(request), "response_sha256": digest(response), "latency_ms": latency_ms}, sort_keys=True)
