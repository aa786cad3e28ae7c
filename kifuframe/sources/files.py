"""Files on any file system, opened inside tasks by the paths that Spark reports."""

from __future__ import annotations

from urllib.parse import quote

# Schemes of Hadoop connectors and the names that Arrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "wasbs": "abfss", "wasb": "abfss"}


def arrow_uri(path: str) -> str:
    """A path as Spark writes it (unescaped, Hadoop scheme) as the URI that Arrow parses."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return f"file://{quote(path)}"
    if scheme == "file":
        rest = "//" + rest if not rest.startswith("//") else rest
    return f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/@:')}"


def filesystem_of(path: str):
    """Arrow file system and the name on it, for a file or folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))
