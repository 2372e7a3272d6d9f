"""Default parameters, all of them arguments of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass

MIN_LINES = 30
SUMMARY_RATIO = 0.75
EXEC_ARCHIVE_CAP = 65_536
MAX_BUFFER_BYTES = 262_144
USD_PER_MILLION_TOKENS = 3.0


@dataclass(frozen=True)
class PipePolicy:
    """When a piped command's output is cut, in seconds and bytes.

    A chunk joins the open segment iff the gap before it is below ``silence``
    and it comes less than ``max_hold`` after the segment's first chunk; the
    chunk that brings the segment to ``max_bytes`` closes it.
    """

    silence: float = 2.0
    max_hold: float = 5.0
    max_bytes: int = MAX_BUFFER_BYTES


@dataclass(frozen=True)
class TerminalPolicy:
    """When terminal output is cut: enough lines, a prompt, or silence.

    An unfinished traceback is held back until it ends or reaches ``max_bytes``.
    """

    silence: float = 0.15
    min_lines: int = MIN_LINES
    max_bytes: int = MAX_BUFFER_BYTES
