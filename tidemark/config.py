"""Rules from a YAML (or JSON) file: unknown keys are an error, missing ones keep their defaults."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from tidemark.operators.backtest import Rules


def load(path: str | Path) -> Rules:
    text = Path(path).read_text()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    found = (found or {}).get("rules", found) or {}
    known = {f.name: f.type for f in fields(Rules)}
    wrong = sorted(set(found) - set(known))
    if wrong:
        raise ValueError(f"unknown rules: {', '.join(wrong)}")
    return Rules(**{k: str(v) if known[k] in ("str", str) else float(v) for k, v in found.items()})
