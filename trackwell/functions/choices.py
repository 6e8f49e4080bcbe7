"""What a caller chooses before a query is made: platforms, statuses, hidden statuses, columns, the sort.

Short lists of parameters, never data. Every function returns a new list."""

from __future__ import annotations

from trackwell.functions.text import PLATFORM_DOMAINS

# The table's columns in order, and how many of them show at first.
COLUMNS = ["company", "title", "status", "priority", "created_at", "deadline", "interview_date", "start_date", "detected_language"]
SHOWN = 6
# A status that older lists lack, and its neighbours.
PLANNED, BEFORE, AFTER = "Plan to Apply", "Interesting", "Application Sent"
# The default statuses in order.
STATUSES = [BEFORE, PLANNED, AFTER, "Feedback", "Done"]

# The views of the board (the second is the default), the week from Monday on.
BOARD_VIEWS = ["kanban", "table", "calendar"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def requested_platforms(wanted: list[str]) -> list[str]:
    """The known ones among the platforms asked for; all if none was asked for."""
    return [p for p in wanted if p in PLATFORM_DOMAINS] if wanted else list(PLATFORM_DOMAINS)


def effective_statuses(statuses: list[str]) -> list[str]:
    return list(statuses) or list(STATUSES)


def with_planned_status(statuses: list[str]) -> list[str]:
    """An older list of statuses with the planned status before its right neighbour, if both neighbours are there."""
    if PLANNED in statuses or not {BEFORE, AFTER} <= set(statuses):
        return list(statuses)
    at = statuses.index(AFTER)
    return [*statuses[:at], PLANNED, *statuses[at:]]


def renamed_status(statuses: list[str], at: int, name: str) -> list[str]:
    """The list with one status renamed; an empty name changes nothing. Rows keep the old name."""
    return [(name or s) if i == at else s for i, s in enumerate(statuses)]


def moved_status(statuses: list[str], at: int, by: int) -> list[str]:
    """The list with a status and its left (-1) or right (1) neighbour exchanged; beyond the ends nothing changes."""
    out, to = list(statuses), at + by
    if 0 <= to < len(out):
        out[at], out[to] = out[to], out[at]
    return out


def _in_order(order: list[str], picked) -> list[str]:
    return [x for x in order if x in picked]


def hidden_statuses(picked, statuses: list[str]) -> list[str]:
    """The picked ones among statuses, in their order; anything but a list hides none."""
    return _in_order(statuses, picked) if isinstance(picked, list) else []


def toggled(picked: list[str], value: str) -> list[str]:
    """The picked keywords or platforms with one more, at the end, or one less."""
    return [x for x in picked if x != value] if value in picked else [*picked, value]


def board_view(wanted) -> str:
    """A known view of the board; the default one for anything else."""
    return wanted if isinstance(wanted, str) and wanted in BOARD_VIEWS else BOARD_VIEWS[1]


def search_query(wanted) -> str:
    """The trimmed query; empty for anything but text."""
    return wanted.strip() if isinstance(wanted, str) else ""


def toggled_status(hidden: list[str], status: str, statuses: list[str]) -> list[str]:
    return _in_order(statuses, set(hidden) ^ {status})


def visible_columns(picked) -> list[str]:
    """The picked columns in the table's order; the default ones if no known column is left."""
    return (_in_order(COLUMNS, picked) if isinstance(picked, list) else []) or COLUMNS[:SHOWN]


def toggled_column(visible: list[str], column: str) -> list[str]:
    """The columns with one more or one less; the last one stays."""
    return list(visible) if visible == [column] else _in_order(COLUMNS, set(visible) ^ {column})


def clicked_sort(key: str, descending: bool, clicked: str) -> tuple[str, bool]:
    """The sort after a click on a column's head: the same key turns round, a new one starts descending."""
    return clicked, not descending if clicked == key else True
