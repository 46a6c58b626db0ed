"""Configuration: layers of TOML over defaults, modes and client profiles (S-15, U-03, U-04, U-06)."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

#: What a mode sets, and what a client profile sets before the mode does.
MODES = {"conservative": {"max_lines": 200, "truncate": False, "trim_decorative": False}, "balanced": {}, "aggressive": {"max_lines": 30}}
PROFILES = {
    "claude": {"max_lines": 80, "mode": "balanced", "limits": {"grep": 120, "find": 100}},
    "gpt": {"max_lines": 50, "mode": "balanced", "limits": {"grep": 80}},
    "gemini": {"max_lines": 150, "mode": "conservative", "limits": {"grep": 200, "find": 150}},
}
#: Parts of a client's name, in order, and the profile that they stand for.
CLIENTS = (("claude", "claude"), ("cursor", "gpt"), ("openai", "gpt"), ("gpt", "gpt"), ("gemini", "gemini"), ("google", "gemini"))


@dataclass(frozen=True)
class Config:
    """Settings of a chain; `limits` are per-command line limits, `mapping` assigns types to binaries."""

    mode: str = "balanced"
    profile: str = ""
    max_lines: int = 50
    truncate: bool = True
    strip_ansi: bool = True
    strip_timestamps: bool = True
    normalize_whitespace: bool = True
    dedup: bool = True
    drop_console_on_pass: bool = True
    trim_decorative: bool = True
    redact_secrets: bool = True
    escalate: str = "window"
    escalate_window: int = 10
    passthrough: bool = False
    always_keep: tuple[str, ...] = ()
    always_remove: tuple[str, ...] = ()
    mapping: Mapping[str, str] = field(default_factory=dict)
    limits: Mapping[str, int] = field(default_factory=dict)

    def with_profile(self) -> Config:
        """The profile's limit and mode; limits that are set already stay."""
        p = PROFILES.get(self.profile)
        return self if p is None else replace(self, max_lines=p["max_lines"], mode=p["mode"], limits={**p["limits"], **self.limits})

    def with_mode(self) -> Config:
        return replace(self, **MODES.get(self.mode, {}))

    def resolved(self) -> Config:
        """Profile first, then mode, which therefore has the last word on max_lines."""
        return self.with_profile().with_mode()

    def limit_for(self, command: str) -> int:
        return self.limits.get(command, self.max_lines)


def profile_of(client: str | None) -> str:
    """The profile that a client's name stands for, or none (U-07)."""
    name = (client or "").lower()
    return next((profile for part, profile in CLIENTS if part in name), "")


def load(layers: Iterable[str]) -> Config:
    """Settings from TOML texts, lowest precedence first; unknown keys and sections are ignored."""
    out = Config()
    for text in layers:
        data = tomllib.loads(text)
        flat = {**data, **data.get("general", {}), **data.get("filters", {}), **data.get("security", {}), **data.get("rules", {})}
        flat |= {new: flat[old] for old, new in (("auto_escalate", "escalate"), ("jest_drop_console_on_pass", "drop_console_on_pass")) if old in flat}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in Config.__dataclass_fields__ and not isinstance(v, dict)}
        out = replace(out, **known, mapping={**out.mapping, **data.get("commands", {})}, limits={**out.limits, **data.get("truncation", {})})
    return out


def layers(folder: Path, home: Path, name: str = "lineflow") -> list[Path]:
    """Files that settings come from, lowest precedence first: the user's, the nearest `.name.toml` from `folder` up, and
    `name.toml` in the folder itself; those that don't exist are left out (S-15)."""
    project = next((p for f in (folder, *folder.parents) if (p := f / f".{name}.toml").is_file()), None)
    return [p for p in (home / ".config" / name / "config.toml", project, folder / f"{name}.toml") if p is not None and p.is_file()]


def discover(folder: str | Path = ".", home: str | Path | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """The settings of a folder; LINEFLOW_PASSTHROUGH=1 in the environment turns every step off (F-16)."""
    found = load(p.read_text() for p in layers(Path(folder).resolve(), Path(home or Path.home())))
    env = os.environ if environment is None else environment
    return replace(found, passthrough=found.passthrough or env.get("LINEFLOW_PASSTHROUGH") == "1")
