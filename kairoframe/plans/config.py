"""Configuration files: JSON with # comments, trailing commas and includes, stages merged over it."""

from __future__ import annotations

import json
import os
import re

from .schema import merged, without_comments


def composed(path: str, seen: tuple[str, ...] = ()) -> str:
    """A file's text with its ``#include "name"`` lines replaced by the files of that name beside it.
    An included file's outer braces go, so that its keys join the including object's."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError(f"{path} includes itself")
    with open(path, encoding="utf-8") as f:
        text = f.read()

    def include(m: re.Match) -> str:
        inner = composed(os.path.join(os.path.dirname(path), m[1]), (*seen, path)).strip()
        return (inner[1:-1] if inner.startswith("{") else inner).strip().rstrip(",") + ","

    text = re.sub(r'(?m)^\s*#include\s+"([^"]+)"\s*$', include, text)
    return re.sub(r"(?m)^\s*#.*$", "", text)


def load(path: str, stages: str = "") -> dict:
    """The configuration of a file, with the named ``stages`` (joined by commas) merged over it in
    order; a stage is an object under the key ``stages``."""
    config = json.loads(without_comments(composed(path)))
    known = config.pop("stages", {})
    for stage in filter(None, stages.split(",")):
        if stage not in known:
            raise ValueError(f"unknown stage {stage}")
        config = merged(config, known[stage])
    return config
