"""Resolving citations: windows of whole passages around a cited one, what became of their sources, and replies of bounded size."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_window(spans: list[tuple[int, int]], cited: int, most: int) -> tuple[int, int]:
    """First and last passage of the widest window: one step left, one right, and so on; a side stops for good at its first step that doesn't fit."""
    first = last = cited
    open_left = open_right = True
    while open_left or open_right:
        if open_left:
            open_left = first > 0 and spans[last][1] - spans[first - 1][0] <= most
            first -= open_left
        if open_right:
            open_right = last + 1 < len(spans) and spans[last + 1][1] - spans[first][0] <= most
            last += open_right
    return first, last


def source_state(state: Column, content_matches: Column) -> Column:
    """What a drift observation says of a passage's source; null columns: nothing was observed."""
    by_content = F.when(content_matches, "content_unchanged").when(~content_matches, "changed_since_ingest")
    by_state = by_content.when(state == "metadata_unchanged", "metadata_unchanged").when(state == "metadata_changed", "changed_since_ingest")
    return by_state.when(state == "missing", "missing_since_ingest").otherwise("unverifiable")


def hash_verification(state: Column, content_matches: Column) -> Column:
    known = F.when(content_matches, "unchanged").when(~content_matches, "changed")
    return known.when(state == "missing", "missing").when(state == "blocked", "blocked").otherwise("unverifiable")


def cited_verification(cited: Column, current: Column, state: Column, content_matches: Column) -> Column:
    """Whether a cited body is still the live one: current is the head's body hash, the observation that head's."""
    same = F.when(content_matches & current.isNotNull(), F.when(current == cited, "unchanged").otherwise("changed"))
    return same.when(~content_matches, "changed").when(content_matches.isNull() & (state == "missing"), "missing").when(content_matches.isNull() & (state == "blocked"), "blocked").otherwise("unverifiable")


def trim(reply: dict, most: int) -> dict | None:
    """reply without as many of its last results as its JSON must lose to fit; None if none would be left of some."""
    results = list(reply["results"])
    sizes = [len(json.dumps(r, ensure_ascii=False).encode()) + 2 for r in results]
    left = most - len(json.dumps({**reply, "results": []}, ensure_ascii=False).encode())
    while results and sum(sizes) > left:
        results.pop()
        sizes.pop()
    if left < 0 or (reply["results"] and not results):
        return None
    return {**reply, "results": results, "truncated": reply["truncated"] or len(results) < len(reply["results"])}
