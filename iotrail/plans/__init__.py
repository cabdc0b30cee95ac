"""Named queries over the driver tables, each with the SQL it must agree with."""

from iotrail.plans import (
    blocks,
    counters,
    documents,
    fidelity,
    objects,
    pages,
    parsing,
    projection,
    readamp,
    streams,
    syscalls,
)
from iotrail.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

_ = (blocks, counters, documents, fidelity, objects, pages, parsing, projection, readamp, streams, syscalls)
