"""All registered queries."""

from . import faces, images, live, scans, sessions, storage, streams, triage  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
