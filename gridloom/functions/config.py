"""Configurations on the driver: YAML with $include, dotted keys and scopes, typed and flattened."""

from __future__ import annotations

from pathlib import Path

import yaml

#: How deep files may include one another.
MAX_DEPTH = 16


def load(path: str | Path, depth: int = 0) -> dict:
    """A file's settings over those of the files that it includes, in order."""
    if depth > MAX_DEPTH:
        raise ValueError(f"{path}: files include one another too deeply")
    own = yaml.safe_load(Path(path).read_text()) or {}
    out: dict = {}
    for other in own.pop("$include", []) or []:
        target = Path(other)
        out.update(load(target if target.is_absolute() or target.exists() else Path(path).parent / other, depth + 1))
    return out | own


def scoped(settings: dict, scope: str | None = None) -> dict:
    """Settings of a scope ('train/Class.key') over those without one."""
    plain = {k: v for k, v in settings.items() if "/" not in k}
    return plain | {k.split("/", 1)[1]: v for k, v in settings.items() if scope and k.startswith(scope + "/")}


def rows(settings: dict) -> list[tuple[str, str, str]]:
    """(scope, key, value as text)."""
    return [(k.split("/", 1)[0] if "/" in k else "", k.split("/", 1)[-1], str(v)) for k, v in settings.items()]


def fan_out(name: str, files: list[str], save_dir: str) -> dict[str, dict]:
    """One set of arguments as the three configurations of a fine-tuning run: coarse, fine and interface."""
    shared = {"AudioLoader.sources": list(files)}
    return {
        "coarse": shared | {"save_path": f"{save_dir}/{name}/coarse", "fine_tune": True},
        "c2f": shared | {"save_path": f"{save_dir}/{name}/c2f", "fine_tune": True},
        "interface": shared | {"Interface.coarse_lora_ckpt": f"{save_dir}/{name}/coarse/lora.pth", "Interface.coarse2fine_lora_ckpt": f"{save_dir}/{name}/c2f/lora.pth"},
    }
