"""What callers pass as paths, flags and forms; plain values on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path, PurePosixPath

#: Texts that switch a flag on.
TRUE = {"1", "true", "yes", "on"}


def local_path(path: str | Path) -> str:
    """A path of the driver's machine without ``~`` and relative parts; one with a scheme stays as it is."""
    text = str(path)
    return text if "://" in text else str(Path(text).expanduser().resolve())


def output_path(source: str | None, given: str | None = None, suffix: str = ".docx") -> str:
    """Where a conversion is written: where it is told to, else beside its source; a source without a path needs to be told."""
    if given is not None:
        return str(given)
    if source is None:
        raise ValueError("a document without a path needs an output path")
    return str(PurePosixPath(source).with_suffix(suffix)) if "://" not in source else source.rsplit("/", 1)[0] + "/" + PurePosixPath(source.rsplit("/", 1)[1]).with_suffix(suffix).name


def flag(names: Iterable[str], values: Mapping[str, str]) -> bool:
    """Whether the first of the names that is set is on; false where none is."""
    for name in names:
        if (value := values.get(name)) is not None:
            return value.strip().lower() in TRUE
    return False


def form_object(text: str | None) -> dict[str, object] | None:
    """A form's JSON object without its nulls; null and empty forms give none, anything but an object is an error."""
    if not text:
        return None
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("the form is not JSON") from e
    if not isinstance(found, dict):
        raise ValueError("the form is not a JSON object")
    return {str(k): v for k, v in found.items() if v is not None}
