"""The collection's fields and the shapes of its tables."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_SIZE, LARGEST_SIZE = 10, 10_000


@dataclass(frozen=True)
class Field:
    """``kind``: ``text`` is analysed into words, ``keyword`` is one term as it is."""

    name: str
    kind: str
    boost: float = 1.0


#: The declared fields, with the weights that search gives them.
FIELDS = (Field("title", "text", 2.0), Field("content", "text"), Field("tags", "keyword"))

OP_LOG = "doc_id string, seq long, op string, source string"
#: The log as it is read: ``writes`` and ``since`` are of rows that stand for all of an id's writes up to a state.
LOG_ROWS = OP_LOG + ", origin string, writes long, since long"
