"""String, array and map columns."""

from pyspark.sql import Column, functions as F

from workloom.schemas import DEFAULT_PRIORITY, LOG_LEVELS, PRIORITIES, SUBJECTS

# The request paths that carry an id.
ROUTES = (
    (r"^/api/v1/tasks/[^/]+\z", "/api/v1/tasks/{id}"),
    (r"^/api/v1/tasks/[^/]+/executions\z", "/api/v1/tasks/{id}/executions"),
)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_non_blank(*texts: Column | str) -> Column:
    """The first text that is more than white space, untrimmed; empty text when there is none."""
    candidates = [F.when(F.trim(_column(t), F.lit(" \t\n\r\x0b\x0c")) != "", _column(t)) for t in texts]
    return F.coalesce(*candidates, F.lit(""))


def subject_matches(subject: Column | str, pattern: str) -> Column:
    """Whether a dotted subject fits a pattern in which `*` stands for exactly one token.

    A token holds no white space, so a line end behind a subject is not passed over.
    """
    tokens = [r"[^.\s]+" if token == "*" else r"\Q" + token + r"\E" for token in pattern.split(".")]
    return _column(subject).rlike("^" + r"\.".join(tokens) + r"\z")


def subject_of(priority: Column | str) -> Column:
    """The subject a priority is published on; null for a priority outside the value set."""
    given = F.coalesce(F.nullif(_column(priority), F.lit("")), F.lit(DEFAULT_PRIORITY))
    chosen = None
    for name in PRIORITIES:
        chosen = (F if chosen is None else chosen).when(given == name, F.lit(SUBJECTS[name]))
    return chosen


def route_template(path: Column | str) -> Column:
    """The route a path belongs to; a path outside the routes stays as it is."""
    path = _column(path)
    template = None
    for pattern, name in ROUTES:
        template = (F if template is None else template).when(path.rlike(pattern), F.lit(name))
    return template.otherwise(path)


def level_rank(level: Column | str) -> Column:
    """The position of a log level; null for text that is not a level."""
    level = F.lower(_column(level))
    rank = None
    for position, name in enumerate(LOG_LEVELS):
        rank = (F if rank is None else rank).when(level == name, F.lit(position))
    return rank


def merge_arrays(existing: Column | str, wanted: Column | str) -> Column:
    """`existing` in its order without repeats, then what only `wanted` has."""
    return F.array_distinct(F.concat(_column(existing), _column(wanted)))


def merge_changes(existing: Column | str, wanted: Column | str) -> Column:
    """Whether `merge_arrays` adds anything."""
    return F.size(F.array_except(_column(wanted), _column(existing))) > 0


def header(headers: Column | str, key: str) -> Column:
    """One header's value; empty text when it is absent."""
    return F.coalesce(F.try_element_at(_column(headers), F.lit(key)), F.lit(""))


def with_header(headers: Column | str, key: str, value: Column | str) -> Column:
    """The headers with one key set, replacing an older value."""
    headers = F.coalesce(_column(headers), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(headers, lambda name, _: name != key)
    return F.map_concat(kept, F.create_map(F.lit(key), _column(value)))


def header_keys(headers: Column | str) -> Column:
    return F.array_sort(F.map_keys(_column(headers)))
