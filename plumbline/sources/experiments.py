"""Experiment folders: a prompt, a reply schema, options."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from plumbline.sources import schemas

#: File names by priority.
SYSTEM = ("system.md", "system.txt", "prompt.md", "prompt.txt")
USER = ("user.md", "user.txt")
RESPONSE = ("response.json", "schema.json")
META = ("meta.json", "experiment.json")


class ExperimentError(ValueError):
    pass


@dataclass(frozen=True)
class Experiment:
    name: str
    system: str
    schema: dict
    user: str | None = None
    model: str | None = None
    effort: str | None = None
    notes: str = ""
    use_text: bool = True
    use_dimensions: bool = True
    files: tuple[str, ...] = field(default=())


def _first(folder: str, names: tuple[str, ...]) -> str | None:
    return next((os.path.join(folder, n) for n in names if os.path.isfile(os.path.join(folder, n))), None)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read().strip()


def load(folder: str) -> Experiment:
    """One folder; a missing prompt or schema, an empty prompt or bad options are errors."""
    system, response = _first(folder, SYSTEM), _first(folder, RESPONSE)
    if system is None or not _read(system):
        raise ExperimentError(f"{folder}: no system prompt")
    if response is None:
        raise ExperimentError(f"{folder}: no reply schema")
    try:
        schema = schemas.load(response)
        schemas.spark_type(schema)
        path = _first(folder, META)
        meta = json.loads(_read(path)) if path else {}
    except ValueError as e:
        raise ExperimentError(f"{folder}: {e}") from e
    if not isinstance(meta, dict):
        raise ExperimentError(f"{folder}: options are an object")
    user = _first(folder, USER)
    return Experiment(
        os.path.basename(os.path.normpath(folder)), _read(system), schema, _read(user) if user else None, meta.get("model") or meta.get("llm_model"),
        meta.get("reasoning_effort") or meta.get("reasoning"), str(meta.get("description") or meta.get("notes") or ""),
        bool(meta.get("pdf_text", True)), bool(meta.get("dimensions", meta.get("dimscan", True))), tuple(sorted(os.listdir(folder))),
    )


def names(root: str) -> list[str]:
    """Folders with a prompt, by the number in their names."""
    found = [n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n)) and _first(os.path.join(root, n), SYSTEM)]
    number = lambda n: int(m[0]) if (m := re.search(r"\d+", n)) else 0
    return sorted(found, key=lambda n: (number(n), n))


def catalogue(root: str) -> list[tuple[str, Experiment | None, str | None]]:
    """(name, experiment, error) of all folders; a broken one does not stop the rest."""
    out = []
    for n in names(root):
        try:
            out.append((n, load(os.path.join(root, n)), None))
        except ExperimentError as e:
            out.append((n, None, str(e)))
    return out


def render(e: Experiment, text_block: str | None, dimensions_block: str | None) -> str:
    """The system prompt with its blocks: in place of their tokens, else at the end.

    Without a block of dimensions the section that would hold it goes.
    """
    out = e.system
    for token, block, wanted in (("{{PDF_TEXT}}", text_block, e.use_text), ("{{DIMENSIONS}}", dimensions_block, e.use_dimensions)):
        if wanted and block is not None:
            out = out.replace(token, block) if token in out else f"{out}\n\n{block}"
        elif token in out:
            head = out[: out.index(token)]
            heading = max(head.rfind("\n#"), 0 if head.startswith("#") else -1)
            out = (head[:heading] if heading >= 0 else head).rstrip()
    return out
