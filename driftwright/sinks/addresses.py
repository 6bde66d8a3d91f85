"""Arithmetic of local paths and addresses in remote stores, and names that are safe in them."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from os import PathLike
from pathlib import PurePosixPath
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

#: Schemes of stores that aren't local files.
SCHEMES = ("abfs", "abfss", "adl", "dbfs", "gs", "hdfs", "s3", "s3a", "wasbs")
#: Fixed value: the time zone of the names of runs.
REPORT_ZONE = "America/Toronto"


def is_remote(address: str) -> bool:
    return str(address).split(":", 1)[0].lower() in SCHEMES and ":/" in str(address)


def _split(address: str) -> tuple[str, str]:
    """The root of an address (scheme and authority) and its path."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:/{1,2}[^/]*|[A-Za-z][A-Za-z0-9+.-]*:/)(.*)", str(address)) if is_remote(address) else None
    if not m:
        return "", str(address)
    root, path = (m[1], m[2]) if "://" in m[1] else (str(address).split("/", 1)[0] + "/", str(address).split("/", 1)[1])
    return root, path


def join_address(base: str, *parts: str) -> str:
    return "/".join([str(base).rstrip("/"), *[str(p).strip("/") for p in parts if str(p).strip("/")]])


def parent_address(address: str) -> str:
    """The folder of an address; a store's root is its own."""
    root, path = _split(str(address).rstrip("/"))
    own = path.strip("/")
    if root:
        above = own.rpartition("/")[0]
        return f"{root.rstrip('/')}/{above}".rstrip("/") if above else root
    return str(PurePosixPath(path).parent)


def with_suffix(address: str, suffix: str) -> str:
    head, _, name = str(address).rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{head}/{stem}{suffix}" if head else f"{stem}{suffix}"


def numbered_address(address: str, number: int) -> str:
    """``a/b.csv`` with 2 is ``a/b_2.csv``."""
    head, _, name = str(address).rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    own = f"{stem}_{number}{dot}{suffix}" if dot else f"{name}_{number}"
    return f"{head}/{own}" if head else own


def relative_label(address: str, base: str) -> str:
    a, b = str(address).rstrip("/"), str(base).rstrip("/")
    return a[len(b) + 1 :] if a.startswith(b + "/") else a


def safe_name(text: str, *, fallback: str = "unnamed", longest: int = 120) -> str:
    """Letters, digits, dot, dash and underscore; never empty, a dot file or too long."""
    own = re.sub(r"[^\w.-]+", "_", str(text), flags=re.UNICODE).strip("._")
    return own[:longest] or fallback


def unique_names(texts: list[str], *, longest: int = 31) -> list[str]:
    """Safe names that differ without regard to case, as sheets need."""
    out: list[str] = []
    for t in texts:
        own, k = safe_name(t, longest=longest), 1
        while own.lower() in (o.lower() for o in out):
            k += 1
            own = f"{safe_name(t, longest=longest - len(str(k)) - 1)}_{k}"
        out.append(own)
    return out


def report_time(zone: str = REPORT_ZONE, now: datetime | None = None) -> datetime:
    """``now`` (the clock's time by default) in ``zone``; in UTC where the machine doesn't know the zone."""
    now = now or datetime.now(timezone.utc)
    try:
        return now.astimezone(ZoneInfo(zone))
    except (ZoneInfoNotFoundError, ValueError):
        return now.astimezone(timezone.utc)


def run_stamp(prefix: str = "", zone: str = REPORT_ZONE, now: datetime | None = None) -> str:
    """A name of a run that sorts by time, such as ``drift_20240131_235959``."""
    return "_".join([*([prefix] if prefix else []), report_time(zone, now).strftime("%Y%m%d_%H%M%S")])


class OutputFolder:
    """Where results go: ``default``, or what was set last; an address that is given for one result comes first."""

    def __init__(self, default: str = "results"):
        self.default, self._chosen = default, None

    def set(self, address: str | PathLike[str] | None) -> str:
        """Choose another folder for all that follows; None returns to the default. Returns the folder in use."""
        if address is not None and not str(address).strip():
            raise ValueError("the output folder is empty")
        self._chosen = None if address is None else (str(address).rstrip("/") or "/")
        return self.resolve()

    def reset(self) -> str:
        return self.set(None)

    def resolve(self, address: str | PathLike[str] | None = None) -> str:
        return str(address) if address is not None else self._chosen or self.default


OUTPUT = OutputFolder()
