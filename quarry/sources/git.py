"""Checkouts of Git repositories at one commit, with the paths that a source names only.

The folder must be one that the executors can read too, where the documents are then scanned by Spark.
"""

from __future__ import annotations

import os
import re
import subprocess

from ..errors import QueryError

# fixed values: seconds that a command may take, by what it does: look at what is there, work on it, or fetch from elsewhere
LOCAL, WORK, NETWORK = 10, 120, 900


def run(place: str | None, *arguments: str, seconds: int = LOCAL) -> str:
    """What a Git command prints. It never asks for anything, and runs no hooks and no configuration but its own."""
    env = {"PATH": os.environ.get("PATH", ""), "HOME": os.devnull, "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "LC_ALL": "C"}
    command = ["git", "-c", "core.hooksPath=" + os.devnull, "-c", "core.fsmonitor=false", "-c", "core.autocrlf=false", *(["-C", place] if place else []), *arguments]
    try:
        done = subprocess.run(command, env=env, stdin=subprocess.DEVNULL, capture_output=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired as e:
        raise QueryError("git_timeout", f"git {arguments[0]} took more than {seconds} seconds") from e
    except OSError as e:
        raise QueryError("sync_failed", f"git can't be run: {e}") from e
    if done.returncode:
        raise QueryError("sync_failed", f"git {arguments[0]}: {done.stderr.decode('utf-8', 'replace').strip()[-500:]}")
    return done.stdout.decode("utf-8", "replace").strip()


def checkout(url: str, place: str, sparse: list[str], commit: str | None = None, head: str | None = None) -> str:
    """Brings a folder to a commit, or to the tip of a branch, with the sparse paths only; returns the commit.

    A folder that holds another repository is refused; one that holds this one is fetched into, so a broken-off checkout goes on.
    """
    if (commit is None) == (head is None):
        raise QueryError("invalid_ref", "a commit or a branch is named, not both")
    wanted = commit or head
    if wanted.startswith("-") or (commit and not re.fullmatch("[0-9a-fA-F]{40}", commit)) or any(p.startswith("-") for p in sparse):
        raise QueryError("invalid_ref", f"{wanted!r} can't be fetched")
    if not os.path.isdir(os.path.join(place, ".git")):
        if os.path.isdir(place) and os.listdir(place):
            raise QueryError("sync_failed", f"{place} holds something else")
        os.makedirs(place, exist_ok=True)
        run(place, "init", "--quiet")
        run(place, "remote", "add", "origin", url)
    if run(place, "remote", "get-url", "origin") != url:
        raise QueryError("sync_failed", f"{place} is a checkout of another repository")
    run(place, "sparse-checkout", "set", "--no-cone", *(f"/{p.strip('/')}/" if not re.search(r"[*?]|\.[A-Za-z0-9]+$", p) else f"/{p.strip('/')}" for p in sparse), seconds=WORK)
    run(place, "fetch", "--quiet", "--depth", "1", "--filter=blob:none", "--no-tags", "origin", wanted, seconds=NETWORK)
    found = run(place, "rev-parse", "FETCH_HEAD^{commit}")
    run(place, "checkout", "--quiet", "--force", "--detach", found, seconds=NETWORK)  # fetches what the sparse paths need
    validate(place, url, found)
    return found


def validate(place: str, url: str, commit: str) -> None:
    """That a folder is a checkout of this commit with nothing changed in it."""
    if run(place, "remote", "get-url", "origin") != url or run(place, "rev-parse", "HEAD") != commit:
        raise QueryError("sync_failed", f"{place} is not at {commit}")
    if changed := run(place, "status", "--porcelain", "--untracked-files=all", seconds=WORK):
        raise QueryError("sync_failed", f"{place} was changed: {changed.splitlines()[0]}")
