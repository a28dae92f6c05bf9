"""Remote files, fetched to a local cache and known there by their ETag. The opener can be replaced, as tests do."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

PROTOCOLS = ("http", "https")
CHUNK = 64 * 1024


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def open_url(url: str, method: str = "GET"):
    """A response without redirects followed; a redirect is a response too."""
    try:
        return urllib.request.build_opener(_Stay).open(urllib.request.Request(url, method=method), timeout=60)
    except urllib.error.HTTPError as e:
        if 300 <= e.code < 400:
            return e
        raise


def is_remote(source: str) -> bool:
    return str(source).startswith(tuple(f"{p}://" for p in PROTOCOLS))


def solve_redirect(url: str, opener: Callable = open_url) -> str:
    """Where one hop from url leads."""
    with opener(url, "HEAD") as r:
        return r.headers.get("Location") or url


def etag_of(headers) -> str:
    tag = headers.get("ETag")
    if not tag:
        raise ValueError("the response has no ETag")
    return tag.removeprefix("W/").strip('"')


def fetch(url: str, folder: str | Path, prefix: str | None = None, opener: Callable = open_url) -> Path:
    """The file at url as folder/[prefix-]etag.suffix; nothing is read again while that is there."""
    url = solve_redirect(url, opener)
    with opener(url, "HEAD") as r:
        tag = etag_of(r.headers)
    name = "-".join(filter(None, [prefix, tag])) + Path(urlsplit(url).path).suffix
    target = Path(folder) / name
    if target.exists():
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_name(f".{name}.{os.getpid()}.tmp")
    with opener(url, "GET") as r, temp.open("wb") as out:
        while block := r.read(CHUNK):
            out.write(block)
    temp.replace(target)
    return target
