"""Does writing one dataset touch the files of another?"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from typing import NamedTuple

from millrace.sources.spec import DatasetSpec

_URI = re.compile(r"^(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*):(?://(?P<authority>[^/]*))?(?P<path>/.*|$)")
# Names of one file system.
_FAMILY = {
    "s3a": "s3", "s3n": "s3",
    "viewfs": "hdfs", "webhdfs": "hdfs", "swebhdfs": "hdfs",
    "abfss": "abfs", "wasbs": "wasb",
}


def overlap(source: DatasetSpec, target: DatasetSpec) -> bool:
    """True if the two specs may share files or a database table.

    Leans to the safe side: a path without a scheme is held to be on any file
    system, a relative one to be in any folder, a mount table to lead to any
    cluster, and a glob to match whatever it can. Ports are not compared.
    """
    if "jdbc" in (source.format.lower(), target.format.lower()):
        return source.format.lower() == target.format.lower() and _table(source) == _table(target)
    return any(_paths_overlap(_split(a), _split(b)) for a in source.paths for b in target.paths)


def _table(spec: DatasetSpec) -> tuple[str, str]:
    return str(spec.option("url")), str(spec.option("dbtable")).strip().lower()


class _Place(NamedTuple):
    system: str
    host: str
    relative: bool
    segments: list[str]


def _split(path: str) -> _Place:
    uri = _URI.match(path)
    scheme = uri["scheme"].lower() if uri else ""
    # A mount table's name says nothing about the host.
    host = "" if uri is None or scheme == "viewfs" else re.sub(r":\d*$", "", uri["authority"] or "").lower()
    rest = uri["path"] if uri else path
    segments = [part for part in posixpath.normpath(rest or "/").split("/") if part not in ("", ".", "..")]
    return _Place(_FAMILY.get(scheme, scheme), host, uri is None and not path.startswith("/"), segments)


def _paths_overlap(a: _Place, b: _Place) -> bool:
    if a.system and b.system and a.system != b.system:
        return False
    if a.host and b.host and a.host != b.host:
        return False
    if a.relative != b.relative:
        some, whole = (a.segments, b.segments) if a.relative else (b.segments, a.segments)
        # It may begin below any folder on the way.
        return any(_nested(some, whole[start:]) for start in range(len(whole) + (not whole)))
    return _nested(a.segments, b.segments)


def _nested(a: list[str], b: list[str]) -> bool:
    # zip stops at the shorter one: a folder overlaps with all that is under it.
    return all(_segments_match(x, y) for x, y in zip(a, b))


def _segments_match(x: str, y: str) -> bool:
    if "{" in x or "{" in y:
        return True
    return fnmatch.fnmatchcase(x, y) or fnmatch.fnmatchcase(y, x)
