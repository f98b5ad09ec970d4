"""Plain Python counterparts to check against, for small inputs only."""

import hashlib


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def split(path: str) -> tuple[str, str]:
    head, _, tail = path.rpartition("/")
    return head, tail


def directories(files: dict[str, str]) -> dict[str, list[str]]:
    """Names per directory, sorted."""
    found: dict[str, list[str]] = {}
    for path in files:
        head, tail = split(path)
        found.setdefault(head, []).append(tail)
    return {directory: sorted(names) for directory, names in found.items()}


def directory_hash(files: dict[str, str], directory: str) -> str:
    names = directories(files).get(directory, [])
    prefix = f"{directory}/" if directory else ""
    return sha("|".join(sha(files[prefix + name]) for name in names))
