"""Settings, glossaries and the checks of what a user asks for."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.protect import FIELDS
from docweave.sources.registry import Registry, default_registry

# Number, least, most and default of each setting.
RANGES: dict[str, tuple[type, float, float, Any]] = {
    "timeout": (int, 1, 600, 60),
    "connect_timeout": (int, 1, 60, 10),
    "read_timeout": (int, 1, 600, 60),
    "max_retries": (int, 0, 10, 2),
    "batch_size": (int, 1, 100, 8),
    "parallel_batches": (int, 1, 20, 2),
    "temperature": (float, 0.0, 2.0, 0.2),
    "max_tokens": (int, 1, 1_000_000, None),
    "residual_language_threshold": (int, 1, 50, 5),
    "min_batch_split_size": (int, 1, 10, 2),
}
TEXTS = {"provider": "openai_compatible", "api_format": "openai", "anthropic_version": "2023-06-01", "base_url": "", "api_key": "", "model": "", "validation_mode": "balanced"}


@dataclass(frozen=True)
class Settings:
    values: dict[str, Any]
    front_matter_fields: tuple[str, ...] = FIELDS

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def missing(self) -> list[str]:
        return [n for n in ("base_url", "api_key", "model") if not str(self.values[n]).strip()]


def number(kind: type, raw: Any, least: float, most: float, default: Any) -> Any:
    """The value, or the default if it is none or out of range."""
    try:
        value = kind(str(raw).strip())
    except ValueError:
        return default
    return value if least <= value <= most else default


def truth(raw: Any) -> bool:
    return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")


def field_list(raw: Any) -> tuple[str, ...]:
    parts = raw.split(",") if isinstance(raw, str) else raw
    if not isinstance(parts, (list, tuple)) or not all(isinstance(p, str) for p in parts):
        raise ValueError("front matter fields must be a list of strings")
    found = tuple(dict.fromkeys(p.strip().lower() for p in parts if p.strip()))
    if not found:
        raise ValueError("front matter fields must not be empty")
    return found


def read_env_file(path: Path) -> dict[str, str]:
    out = {}
    for line in path.read_text("utf-8").splitlines() if path.exists() else []:
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def edit_env_file(path: Path, changes: dict[str, str]) -> None:
    """The file with some keys set; other lines stay as they are."""
    quoted = {k: f'"{v}"' if any(c.isspace() or c in "#\"'" for c in v) else v for k, v in changes.items()}
    lines, left = [], dict(quoted)
    for line in path.read_text("utf-8").splitlines() if path.exists() else []:
        key = line.partition("=")[0].strip()
        lines.append(f"{key}={left.pop(key)}" if key in left and "=" in line else line)
    path.write_text("\n".join([*lines, *(f"{k}={v}" for k, v in left.items())]) + "\n", "utf-8")


def load_settings(root: str | Path, env: dict[str, str] | None = None, prefix: str = "DOCWEAVE_") -> Settings:
    """Environment over .env over settings.json over defaults; a number out of range
    counts as not given."""
    root = Path(root)
    given = json.loads((root / "settings.json").read_text("utf-8")) if (root / "settings.json").exists() else {}
    if not isinstance(given, dict):
        raise ValueError("settings.json must hold an object")
    layers = [given.get("llm", {}), *({k.removeprefix(prefix).lower(): v for k, v in x.items() if k.startswith(prefix)} for x in (read_env_file(root / ".env"), dict(os.environ if env is None else env)))]
    merged = {k: v for layer in layers for k, v in layer.items() if v is not None and v != ""}
    values: dict[str, Any] = {n: str(merged.get(n, d)) for n, d in TEXTS.items()}
    values |= {n: number(k, merged[n], a, b, d) if n in merged else d for n, (k, a, b, d) in RANGES.items()}
    values["allow_placeholder_reorder"] = truth(merged.get("allow_placeholder_reorder", False))
    fields = merged.get("front_matter_fields", given.get("markdown", {}).get("front_matter_translatable_fields"))
    return Settings(values, FIELDS if fields is None else field_list(fields))


def load_glossary(path: str | Path) -> list[dict[str, str]]:
    """A JSON array of objects with source and target; a missing file is empty."""
    path = Path(path)
    if not path.exists():
        return []
    items = json.loads(path.read_text("utf-8"))
    if not isinstance(items, list):
        raise ValueError("a glossary is a list")
    out = []
    for i, item in enumerate(items):
        pair = [item.get(k) if isinstance(item, dict) else None for k in ("source", "target")]
        if not all(isinstance(x, str) and x.strip() for x in pair):
            raise ValueError(f"glossary item {i}: source and target must be texts")
        out.append({"source": pair[0].strip(), "target": pair[1].strip()})
    return out


def save_glossary(path: str | Path, items: list[dict[str, str]]) -> None:
    Path(path).write_text(json.dumps([{"source": x["source"].strip(), "target": x["target"].strip()} for x in items], ensure_ascii=False, indent=2) + "\n", "utf-8")


def glossary_table(spark: SparkSession, path: str) -> DataFrame:
    """Valid glossary items as rows; others are left out."""
    rows = spark.read.schema("source string, target string").json(path, multiLine=True)
    return rows.select(F.trim("source").alias("source"), F.trim("target").alias("target")).where("source <> '' and target <> ''")


@dataclass(frozen=True)
class Checked:
    paths: tuple[str, ...] = ()
    output_dir: str = ""
    errors: tuple[str, ...] = field(default=())
    filled_output: bool = False

    @property
    def valid(self) -> bool:
        return not self.errors


def check_input(paths: list[str], output_dir: str, *, folder: bool = False, registry: Registry | None = None) -> Checked:
    """All errors of a request at once. Paths are trimmed and taken once; a blank output
    folder becomes the folder of a single file."""
    known = (registry or default_registry()).extensions()
    taken = tuple(dict.fromkeys(str(Path(p.strip()).expanduser()) for p in paths if p.strip()))
    errors = [] if taken else ["no source given"]
    for p in map(Path, taken):
        if not p.exists():
            errors.append(f"{p} does not exist")
        elif folder != p.is_dir():
            errors.append(f"{p} is {'not ' if folder else ''}a folder")
        elif not folder and p.suffix.lower() not in known:
            errors.append(f"{p} is not of a known format")
    out, filled = output_dir.strip(), False
    if not out and not folder and len(taken) == 1 and Path(taken[0]).is_file():
        out, filled = str(Path(taken[0]).parent), True
    if not out:
        errors.append("no output folder given")
    elif not Path(out).expanduser().is_dir():
        errors.append(f"{out} is not a folder")
    return replace(Checked(taken, out, filled_output=filled), errors=tuple(errors))
