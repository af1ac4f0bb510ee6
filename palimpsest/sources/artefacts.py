"""Files that models are made of: what is missing, and fetching it whole or not at all. The registry is a parameter."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import BinaryIO

CHUNK, REPORT_EVERY = 1 << 16, 8


@dataclass(frozen=True)
class Artefact:
    category: str
    name: str
    url: str
    sha256: str | None = None


class FetchError(OSError):
    """All tries failed."""


class ArtefactNotFound(FetchError):
    """The source has no such file: trying again is no use."""


class IntegrityError(FetchError):
    """What came is not what was expected."""


def place(folder: str, a: Artefact) -> str:
    return os.path.join(folder, a.category, a.name)


def temporary(path: str) -> str:
    """A hidden name of its own beside ``path``."""
    return os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path) or 'modelo'}.{uuid.uuid4()}.tmp")


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def present(folder: str, a: Artefact) -> bool:
    path = place(folder, a)
    return os.path.exists(path) and (a.sha256 is None or digest(path) == a.sha256)


def missing(folder: str, registry: list[Artefact]) -> list[str]:
    return [f"{a.category}/{a.name}" for a in registry if not present(folder, a)]


def open_url(url: str) -> tuple[BinaryIO, int]:
    """A stream and its length (0 if it is not told)."""
    import urllib.error
    import urllib.request

    try:
        answer = urllib.request.urlopen(url, timeout=60)
    except urllib.error.HTTPError as e:
        raise ArtefactNotFound(f"{url} (HTTP {e.code})") from e
    return answer, int(answer.headers.get("Content-Length") or 0)


def stream(source: BinaryIO, total: int, path: str, on_bytes: Callable[[int, int], None] = lambda *a: None) -> str:
    """Writes ``source`` to a new file and returns its hash; tells how far it is every few chunks and at the end."""
    h, done = hashlib.sha256(), 0
    with open(path, "xb") as f:
        for k, chunk in enumerate(iter(lambda: source.read(CHUNK), b""), 1):
            h.update(chunk)
            f.write(chunk)
            done += len(chunk)
            if k % REPORT_EVERY == 0:
                on_bytes(done, total)
        f.flush()
        os.fsync(f.fileno())
    on_bytes(done, done)
    return h.hexdigest()


def fetch(a: Artefact, folder: str, opener: Callable[[str], tuple[BinaryIO, int]] = open_url, on_bytes: Callable[[int, int], None] = lambda *x: None, tries: int = 3, wait: float = 2.0) -> str:
    """Brings one artefact to its place by way of a temporary file. Other failures than a missing or wrong file are tried again."""
    path = place(folder, a)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part, last = temporary(path), None
    for k in range(tries):
        try:
            source, total = opener(a.url)
            with source:
                found = stream(source, total, part, on_bytes)
            if a.sha256 not in (None, found):
                raise IntegrityError(f"{a.name}: expected {a.sha256}, found {found}")
            os.replace(part, path)
            return path
        except (ArtefactNotFound, IntegrityError):
            raise
        except OSError as e:
            last = e
            if k + 1 < tries:
                time.sleep(wait)
        finally:
            if os.path.exists(part):
                os.unlink(part)
    raise FetchError(f"Fallaron {tries} intentos para {a.name}: {last}") from last


def ensure(folder: str, registry: list[Artefact], opener: Callable[[str], tuple[BinaryIO, int]] = open_url, on_file: Callable[[str, int, int], None] = lambda *x: None, on_bytes: Callable[[int, int], None] = lambda *x: None, **how) -> str:
    """``folder`` with all of ``registry`` in it: what is there and whole stays, what is there and broken goes first."""
    fetched = 0
    for a in registry:
        if present(folder, a):
            continue
        if os.path.exists(place(folder, a)):
            os.unlink(place(folder, a))
        fetched += 1
        on_file(a.name, fetched, len(registry))
        fetch(a, folder, opener, on_bytes, **how)
    return folder
