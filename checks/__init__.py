"""Registered queries over the driver's tables, each beside an independent SQL statement."""

from . import (  # noqa: F401
    audit_cases,
    detect_cases,
    example_cases,
    fleet_cases,
    learn_cases,
    shape_cases,
    source_cases,
    stream_cases,
    timetable_cases,
    trajectory_cases,
)
from .registry import ORACLES, QUERIES, assemble  # noqa: F401

assemble()
