"""User-supplied detectors, line parsers and reputation sources: plain DataFrame functions by name."""

from __future__ import annotations

from collections.abc import Callable

_detectors: dict[str, Callable] = {}
_entry_detectors: dict[str, Callable] = {}
_parsers: dict[str, Callable] = {}
_line_parsers: dict[str, Callable] = {}
_providers: dict[str, Callable] = {}


def register_detector(name: str, fn: Callable) -> None:
    """fn(entries, params) -> ip, finding_type, pattern_type, risk_score, description, ref and more."""
    _detectors[name] = fn


def register_entry_detector(name: str, fn: Callable) -> None:
    """fn(entry as a dict) -> findings as dicts with finding_type, pattern_type, risk_score, description and more. It may
    raise: the entry is then counted as an error of this detector, and the others go on."""
    _entry_detectors[name] = fn


def register_parser(name: str, fn: Callable) -> None:
    """fn(lines) -> entry columns and error: asked for lines of a format that the access-log parser does not know."""
    _parsers[name] = fn


def register_line_parser(name: str, fn: Callable) -> None:
    """fn(text column) -> struct column with entry columns and error: asked like those of register_parser, before them, but
    all in the pass that parses the access log."""
    _line_parsers[name] = fn


def register_provider(name: str, fn: Callable) -> None:
    """fn(raw payload rows of this provider) -> reputation rows."""
    _providers[name] = fn


def detectors() -> dict[str, Callable]:
    return dict(_detectors)


def entry_detectors() -> dict[str, Callable]:
    return dict(_entry_detectors)


def parsers() -> dict[str, Callable]:
    return dict(_parsers)


def line_parsers() -> dict[str, Callable]:
    return dict(_line_parsers)


def providers() -> dict[str, Callable]:
    return dict(_providers)


def unregister(name: str) -> None:
    for names in (_detectors, _entry_detectors, _parsers, _line_parsers, _providers):
        names.pop(name, None)
