"""Where each agent keeps its logs."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

# Agents in the order in which their stores are read.
SOURCES = ("claude", "codex", "pi", "omp", "opencode", "droid", "openclaw", "hermes", "agy")
OPENCODE_NAMES = ("opencode.db", "opencode-next.db", "opencode-local.db")


@dataclass(frozen=True)
class Store:
    source: str
    kind: str  # jsonl or sqlite
    path: str


def roots(env: Mapping[str, str], home: str) -> list[Store]:
    """Every place a store can be; a variable that is set replaces its default."""

    def place(variable: str, *default: str) -> str:
        return os.path.abspath(env[variable]) if env.get(variable) else os.path.join(home, *default)

    codex = place("CODEX_HOME", ".codex")
    pi = env.get("PI_CODING_AGENT_DIR") or os.path.join(home, ".pi", "agent")
    if pi == "~" or pi.startswith("~/"):
        pi = home + pi[1:]
    data = os.path.join(place("XDG_DATA_HOME", ".local", "share"), "opencode")
    named = env.get("OPENCODE_DB")
    databases = [] if named == ":memory:" else [os.path.join(data, n) for n in ([named] if named else OPENCODE_NAMES)]
    return [
        Store("claude", "jsonl", os.path.join(place("CLAUDE_CONFIG_DIR", ".claude"), "projects")),
        Store("codex", "jsonl", os.path.join(codex, "sessions")),
        Store("codex", "jsonl", os.path.join(codex, "archived_sessions")),
        Store("pi", "jsonl", os.path.join(pi, "sessions")),
        *([] if env.get("PI_CODING_AGENT_DIR") else _profiles("pi", os.path.join(home, ".pi"), "agent-*", "sessions")),
        Store("omp", "jsonl", os.path.join(home, ".omp", "agent", "sessions")),
        *_profiles("omp", os.path.join(home, ".omp", "profiles"), "*", "agent", "sessions"),
        *(Store("opencode", "sqlite", path) for path in databases),
        Store("droid", "jsonl", os.path.join(env.get("FACTORY_HOME_OVERRIDE") or home, ".factory", "sessions")),
        *(Store("openclaw", "sqlite", s.path) for s in _profiles("openclaw", os.path.join(place("OPENCLAW_STATE_DIR", ".openclaw"), "agents"), "*", "agent", "openclaw-agent.sqlite")),
        Store("hermes", "sqlite", os.path.join(place("HERMES_HOME", ".hermes"), "state.db")),
        Store("agy", "jsonl", os.path.join(home, ".gemini", "antigravity-cli", "brain")),
    ]


def _profiles(source: str, parent: str, pattern: str, *below: str) -> list[Store]:
    """A store per folder next to the main one, in name order; links are skipped."""
    found = sorted((p for p in Path(parent).glob(pattern) if p.is_dir() and not p.is_symlink()), key=lambda p: str(p).encode("utf-16-be"))
    return [Store(source, "jsonl", os.path.join(p, *below)) for p in found]


def discover(env: Mapping[str, str], home: str, source: str = "all", exists: Callable[[str], bool] = os.path.exists) -> list[Store]:
    order = {s: k for k, s in enumerate(SOURCES)}
    kept = [s for s in roots(env, home) if source in ("all", s.source) and exists(s.path)]
    return sorted(kept, key=lambda s: order[s.source])
