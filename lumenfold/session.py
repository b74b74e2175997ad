"""Session state: configuration, the pluggable reasoner and embedder, and diversified search."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import search as S
from lumenfold.operators.ledger import Ledger

def _text(v: object) -> bool:
    return isinstance(v, str) and "\0" not in v


def _path(v: object) -> bool:
    return _text(v) and ".." not in re.split(r"[/\\\\]", v)


def _flag(v: object) -> bool:
    return isinstance(v, bool)


#: key -> (default, check)
CONFIG: dict[str, tuple[object, Callable[[object], bool]]] = {
    # fixed values: the names, ranges and defaults that callers of the surveyed system use
    "reasoning_plugin": ("", _path),
    "http_url": ("", _path),
    "http_token": ("", _text),
    "http_model": ("", _text),
    "http_allow_plaintext": (False, _flag),
    "http_embed_url": ("", _path),
    "http_embed_model": ("", _text),
    "http_think": ("", _text),
    "http_think_provider": ("", _text),
    "http_native_url": ("", _path),
    "http_num_ctx": (0, lambda v: isinstance(v, int) and 0 <= v <= 1048576),
    "text_to_sql_max_attempts": (2, lambda v: isinstance(v, int) and 1 <= v <= 10),
    "text_to_sql_allowed_statements": ("select", lambda v: v in ("select", "select_insert_update")),
    "text_to_sql_use_review": (False, _flag),
    "enterprise_lib": ("", _path),
    "enterprise_ledger_key": ("", _text),
    "enterprise_require_signature": (False, _flag),
    "agent_partial_reasoning_fail": (False, _flag),
    # settings of this engine
    "default_k": (10, lambda v: isinstance(v, int) and v > 0),
    "default_seed": (42, lambda v: isinstance(v, int)),
    "diffusion": (2, lambda v: isinstance(v, int) and 1 <= v <= 32),
    "embed_dim": (64, lambda v: isinstance(v, int) and 1 <= v <= 16384),
    "iterations": (30, lambda v: isinstance(v, int) and 1 <= v <= 10000),
    "ledger_redact": ("", lambda v: isinstance(v, str)),
    "loop_bits": (64, lambda v: isinstance(v, int) and 1 <= v <= 33554424),
    "max_context_rows": (64, lambda v: isinstance(v, int) and 1 <= v <= 64),
    "max_result_rows": (1024, lambda v: isinstance(v, int) and 1 <= v <= 1024),
    "mmr_lambda": (0.5, lambda v: isinstance(v, (int, float)) and 0 <= v <= 1),
    "population": (50, lambda v: isinstance(v, int) and 1 <= v <= 10000),
    "queue_batch": (85, lambda v: isinstance(v, int) and v > 0),
    "queue_stale_secs": (600, lambda v: isinstance(v, int) and v > 0),
    "reasoning_timeout_ms": (30000, lambda v: isinstance(v, int) and v > 0),
    "walk": (0.5, lambda v: isinstance(v, (int, float)) and 0 <= v <= 1),
}


def hashing_embedder(dim: int = 64) -> Callable[[str], list[float]]:
    """A deterministic stand-in for an embedding model: signed hashes of words and their parts, unit length."""
    def embed(text: str) -> list[float]:
        v = np.zeros(dim)
        for w in re.findall(r"\w+", text.lower()):
            for g in {w, *(w[i:i + 4] for i in range(max(1, len(w) - 3)))}:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return embed


def stub_reasoner(prompt: str) -> str:
    """A deterministic stand-in for a language model."""
    return f"[{hashlib.blake2b(prompt.encode(), digest_size=4).hexdigest()}] {prompt.splitlines()[0][:120]}" if prompt else ""


def _post(url: str, token: str, plain: bool, body: dict, timeout_ms: int) -> dict:
    """The JSON answer of a service to a JSON request; without encryption only where that is allowed."""
    if not url.startswith("https://") and not (plain and url.startswith("http://")):
        raise ValueError("the address must begin with https:// (or http:// where http_allow_plaintext is set)")
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout_ms / 1000) as answer:
        return json.loads(answer.read())


@dataclass
class Diversify:
    enabled: bool = False
    window: int = 5
    sigma: float = 0.3
    weight: float = 0.5
    max_shadows: int = 64
    tail: int = 256
    stall: float = 0.15


@dataclass
class Session:
    spark: SparkSession
    reasoner: Callable[[str], str] | None = stub_reasoner
    embedder: Callable[[str], list[float]] | None = None
    config: dict[str, object] = field(default_factory=dict)
    diversify: Diversify = field(default_factory=Diversify)
    queries: deque = field(default_factory=lambda: deque(maxlen=32))
    shadows: dict[int, list[float]] = field(default_factory=dict)
    shown: list[list[float]] = field(default_factory=list)
    overhead_us: deque = field(default_factory=lambda: deque(maxlen=1000))
    ledger: Ledger | None = None

    def __post_init__(self) -> None:
        self.embedder = self.embedder or hashing_embedder(int(self.config_get("embed_dim")))
        self.ledger = self.ledger or Ledger(self.spark)

    # ---- configuration
    def config_set(self, key: str, value: object) -> None:
        if key not in CONFIG:
            raise KeyError(f"unknown setting {key}")
        if not CONFIG[key][1](value):
            raise ValueError(f"{value!r} is no value of {key}")
        self.config[key] = value

    def config_get(self, key: str) -> object:
        if key not in CONFIG:
            raise KeyError(f"unknown setting {key}")
        return self.config.get(key, CONFIG[key][0])

    # ---- reasoning
    def reason(self, query: str, context: str = "") -> str:
        if self.reasoner is None:
            raise RuntimeError("no reasoner is set")
        return self.reasoner(f"{query}\n{context}" if context else query)

    def embed(self, text: str) -> list[float]:
        return self.embedder(text)

    def use_http(self) -> None:
        """Reason and embed by the services that the settings name, where they name any."""
        plain = bool(self.config_get("http_allow_plaintext"))
        if url := self.config_get("http_url"):
            extra = {"num_ctx": n} if (n := self.config_get("http_num_ctx")) else {}
            extra |= {"think": t} if (t := self.config_get("http_think")) else {}
            self.reasoner = lambda prompt: _post(url, self.config_get("http_token"), plain, {"model": self.config_get("http_model"), "messages": [{"role": "user", "content": prompt}]} | extra,
                                                 int(self.config_get("reasoning_timeout_ms")))["choices"][0]["message"]["content"]
        if embed_url := self.config_get("http_embed_url"):
            self.embedder = lambda text: _post(embed_url, self.config_get("http_token"), plain, {"model": self.config_get("http_embed_model"), "input": text}, int(self.config_get("reasoning_timeout_ms")))["data"][0]["embedding"]

    def explain(self, prompt: str, context: str = "") -> dict:
        """{text, reasoning_step_failed}: a failing reasoner is reported instead of raised where the setting says so."""
        try:
            return {"text": self.reason(prompt, context), "reasoning_step_failed": False}
        except Exception:
            if not self.config_get("agent_partial_reasoning_fail"):
                raise
            return {"text": None, "reasoning_step_failed": True}

    # ---- diversified search
    def diversify_enable(self) -> None:
        self.diversify.enabled = True

    def diversify_disable(self) -> None:
        self.diversify.enabled = False

    def diversify_set_params(self, **params: float) -> None:
        for k, v in params.items():
            if k not in ("window", "sigma", "weight", "max_shadows", "tail", "stall") or not v > 0 or (k == "window" and v > 32):
                raise ValueError(f"{k}={v}")
            setattr(self.diversify, k, v)

    def search(self, df: DataFrame, id: str, vec: str, query: list[float], k: int) -> DataFrame:
        """knn; while diversifying it keeps away from rejected vectors and from those shown before.

        Diversified searches run at once, as their k rows are remembered as shown: the newest
        max_shadows vectors, shown and rejected together, push away. What that costs over
        a plain search is the time to put up the penalty and to remember the rows.
        """
        self.queries.append(list(query))
        if not self.diversify.enabled:
            return S.knn(df, id, vec, query, k)
        began = time.perf_counter()
        away = [*self.shadows.values(), *self.shown][-int(self.diversify.max_shadows):]
        penalty = S.repulsion(vec, away, self.diversify.sigma, self.diversify.weight) if away else None
        hits = S.knn(df, id, vec, query, k, penalty=penalty, keep=[vec])
        before = time.perf_counter() - began
        found = hits.collect()
        began = time.perf_counter()
        self.shown += [[float(x) for x in r[vec]] for r in found]
        self.shown = self.shown[-int(self.diversify.max_shadows):]
        out = self.spark.createDataFrame([(r[id], r["distance"]) for r in found], f"`{id}` {df.schema[id].dataType.simpleString()}, distance double")
        self.overhead_us.append((before + time.perf_counter() - began) * 1e6)
        while len(self.overhead_us) > int(self.diversify.tail):
            self.overhead_us.popleft()
        return out

    def isolate(self, df: DataFrame, id: str, vec: str, handle) -> None:
        """Keep later searches away from one row."""
        self.shadows[handle] = S.vector_of(df, id, vec, handle)
        self.ledger.report(int(handle), "negative")

    def feedback(self, df: DataFrame, id: str, vec: str, handle, signal: str, ms: int | None = None) -> None:
        if signal == "negative":
            self.isolate(df, id, vec, handle)
        else:
            self.ledger.report(int(handle), signal, ms)

    def current_dq(self) -> float | None:
        """1 - mean cosine among the last queries: 0 when they have collapsed to one; None before two, or while off."""
        q = list(self.queries)[-int(self.diversify.window):]
        if not self.diversify.enabled or len(q) < 2:
            return None
        u = np.array(q)
        u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        s = u @ u.T
        return float(1 - s[np.triu_indices(len(q), 1)].mean())

    detect_collapse = current_dq

    def stalled(self) -> bool:
        """Whether the last queries have collapsed below the `stall` diversity."""
        dq = self.current_dq()
        return dq is not None and dq < self.diversify.stall

    def overhead_p99_us(self) -> float | None:
        return float(np.percentile(self.overhead_us, 99)) if self.overhead_us else None

    def explain_result(self) -> dict:
        return {"dq": self.current_dq(), "diversify_enabled": self.diversify.enabled, "overhead_p99_us": self.overhead_p99_us()}
