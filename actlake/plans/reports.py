"""Report layouts, reuse of results that are there already, cache paths, and the command line.

A layout says what a report holds. A report can be cut from the data of another layout if that holds at least as much.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Sequences:
    before: int | None = 5
    after: int = 5
    whole_window: bool = True
    intervals: int = 10
    top_rows: int = 20
    interval_rows: int = 5
    hover_rows: int = 5

    def within(self, other: Sequences) -> bool:
        """Windows and intervals must be the same; rows may be fewer; colours of one token can be cut from a whole window's."""
        same = (self.before, self.after) == (other.before, other.after) and self.intervals in (0, other.intervals)
        return same and self.top_rows <= other.top_rows and self.interval_rows <= other.interval_rows and self.hover_rows <= other.hover_rows and (other.whole_window or not self.whole_window)


@dataclass(frozen=True)
class Histogram:
    bins: int = 50

    def within(self, other: Histogram) -> bool:
        return self.bins == other.bins


@dataclass(frozen=True)
class Rows:
    rows: int = 10

    def within(self, other: Rows) -> bool:
        return self.rows <= other.rows


@dataclass(frozen=True)
class Layout:
    """Each part at most once; None leaves it out."""

    sequences: Sequences | None = field(default_factory=Sequences)
    activations: Histogram | None = field(default_factory=Histogram)
    logits: Histogram | None = field(default_factory=Histogram)
    logit_rows: Rows | None = field(default_factory=Rows)
    table_rows: Rows | None = field(default_factory=lambda: Rows(3))

    def within(self, other: Layout) -> bool:
        """True if a report of this layout can be cut from data of the other."""
        for name in ("sequences", "activations", "logits", "logit_rows", "table_rows"):
            mine, theirs = getattr(self, name), getattr(other, name)
            if mine is not None and (theirs is None or not mine.within(theirs)):
                return False
        return True


#: The layout of single prompts: ten top rows, no intervals, five logit rows.
PROMPT_LAYOUT = Layout(sequences=Sequences(intervals=0, top_rows=10), logit_rows=Rows(5))


def deep_union(*trees: dict) -> dict:
    """Nested dictionaries in one: dictionaries are united, lists joined, anything else under one key twice is an error."""
    out: dict = {}
    for tree in trees:
        for k, v in tree.items():
            if k not in out:
                out[k] = v
            elif isinstance(v, dict) and isinstance(out[k], dict):
                out[k] = deep_union(out[k], v)
            elif isinstance(v, list) and isinstance(out[k], list):
                out[k] = out[k] + v
            else:
                raise ValueError(f"two values for {k!r}")
    return out


def cache_path(base: str, kind: str, settings: object) -> str:
    """A folder for a cached table, named by all settings that its content depends on: a stale one is never reused."""
    text = json.dumps(asdict(settings), sort_keys=True, default=str)
    return f"{base.rstrip('/')}/{kind}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def differences(a: object, b: object, tolerance: float = 1e-6, at: str = "") -> list[str]:
    """Where two trees of dictionaries, lists and values differ; numbers by more than the tolerance. NaN equals NaN."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted(a.keys() | b.keys(), key=str) for d in ([f"{at}/{k}"] if (k in a) != (k in b) else differences(a[k], b[k], tolerance, f"{at}/{k}"))]
    if isinstance(a, list) and isinstance(b, list):
        return [at or "/"] if len(a) != len(b) else [d for i, (x, y) in enumerate(zip(a, b)) for d in differences(x, y, tolerance, f"{at}/{i}")]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return [] if abs(a - b) <= tolerance or (a != a and b != b) or a == b else [at or "/"]
    return [] if a == b else [at or "/"]


def output_folder(base: str, model: str, source_set: str, hook: str, width: int, suffix: str | None = None) -> str:
    """The folder of a run's output; a file in its place is an error."""
    path = f"{base.rstrip('/')}/{model}_{source_set}_{hook}_{width}" + (f"_{suffix}" if suffix else "")
    if os.path.isfile(path.removeprefix("file://")):
        raise NotADirectoryError(path)
    return path


def main(argv: list[str] | None = None) -> None:
    """spark-submit -m actlake.plans.reports NAME --tables DIR --out DIR: runs a registered query and writes its rows."""
    from pyspark.sql import SparkSession

    from actlake.plans.queries import QUERIES

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("name", choices=sorted(QUERIES))
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("parquet", "json"), default="parquet")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    QUERIES[args.name](spark, args.tables).write.mode("errorifexists").format(args.format).save(args.out)


if __name__ == "__main__":
    main()
