"""Package archives from a feed: over HTTPS only, with bounds on redirects and bytes, verified by their digest."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from ..errors import QueryError
from .packages import MAX_ARCHIVE_BYTES, valid_package_id, valid_version, verify_sha512

# fixed values: how often an answer may send elsewhere, and what a feed calls the place of its archives
MAX_REDIRECTS, BASE_ADDRESS, MAX_INDEX_BYTES = 5, "PackageBaseAddress/3.0.0", 1 << 20

Get = Callable[[str, int], tuple[int, dict[str, str], bytes]]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # answers that send elsewhere are handled here, one by one
        return None


def get(url: str, most: int) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, at most ``most`` + 1 bytes) of one request."""
    try:
        with urllib.request.build_opener(_Stay).open(url, timeout=120) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most + 1)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""
    except OSError as e:
        raise QueryError("sync_failed", f"{url}: {e}") from e


def download(url: str, most: int, get: Get = get) -> bytes:
    """The bytes at a URL; every step of the way is HTTPS."""
    for _ in range(MAX_REDIRECTS + 1):
        if urlsplit(url).scheme != "https":
            raise QueryError("sync_failed", f"{url} is not HTTPS")
        status, headers, body = get(url, most)
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status != 200:
            raise QueryError("sync_failed", f"{url} answered {status}")
        if len(body) > most or int(headers.get("content-length") or 0) > most:
            raise QueryError("sync_failed", f"{url} has more than {most} bytes")
        return body
    raise QueryError("sync_failed", f"{url}: more than {MAX_REDIRECTS} redirects")


def fetch(definition: dict, get: Get = get) -> bytes:
    """The archive of a package's definition (packageId, version, sha512, feed)."""
    name, version = definition["packageId"], definition["version"]
    if not (valid_package_id(name) and valid_version(version)):
        raise QueryError("source_invalid", f"no package {name!r} {version!r}")
    try:
        resources = json.loads(download(definition["feed"], MAX_INDEX_BYTES, get))["resources"]
        bases = [r["@id"] for r in resources if r.get("@type") == BASE_ADDRESS]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise QueryError("sync_failed", f"{definition['feed']} is no index of a feed") from e
    if len(bases) != 1 or urlsplit(bases[0]).scheme != "https":
        raise QueryError("sync_failed", f"{definition['feed']} names {len(bases)} places of archives; one is expected, over HTTPS")
    low = (name.lower(), version.lower().partition("+")[0])
    content = download(f"{bases[0].rstrip('/')}/{low[0]}/{low[1]}/{low[0]}.{low[1]}.nupkg", MAX_ARCHIVE_BYTES, get)
    verify_sha512(content, definition["sha512"])
    return content
