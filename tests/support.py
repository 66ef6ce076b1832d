"""Helpers of the tests; not in a conftest, whose module name other folders share."""

from datetime import datetime


def rows(frame, *order):
    ordered = frame.orderBy(*order) if order else frame
    return [tuple(row) for row in ordered.collect()]


def at(text):
    return datetime.fromisoformat(text)
