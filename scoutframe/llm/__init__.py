"""Operators of a training-data pipeline; nothing else in the library imports this."""

from scoutframe.session import ships_with_tasks

ships_with_tasks(__name__)
