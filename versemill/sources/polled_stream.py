"""Feeds and timelines as a streaming source (R02, R03, R06, R12): ``readStream.format("polled")``.

Each batch is one round of polls. The offset, which Spark keeps in the checkpoint, carries for each source its cursor or its
bounded set of seen entries, the failures in a row, when it is due and whether it has been given up; so a stream that stops
goes on where it was, and a source that fails waits while the others go on. A poll's answer is bounded by what a feed shows
or by ``most``, and is all that the driver holds.

Options: ``path`` (where the answers are), ``sources`` (names, joined by commas), ``kind`` (``feed`` or ``timeline``),
``tick`` (seconds from one round to the next), ``interval`` (seconds between polls of a source), ``keep`` (seen entries kept),
``most`` (entries of a timeline's poll).

Answers are read by ``fetch(source, round, cursor)``; here from the newline-delimited JSON files that lie under
``path/source=<name>/poll=<round>/`` in any file system that Arrow reaches. A reader of a service subclasses ``PolledSource``
and overrides ``fetch``. Answers of a round must stay the same for as long as the round may be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FIRST_WAIT, LONGEST_WAIT, MOST_ERRORS = 5, 300, 10
EMPTY_ROUNDS = 3  # after so many empty answers a timeline's cursor counts as stale


def entry_key(entry: dict) -> str:
    """The id of an entry, else its link, else its title."""
    return next((v.strip() for v in (entry.get("id"), entry.get("link"), entry.get("title")) if v and v.strip()), "")


def entry_text(entry: dict) -> str:
    """The title and the content, or the summary where there is none, a blank line between."""
    return "\n\n".join(p for p in (entry.get("title"), entry.get("content") or entry.get("summary")) if p)


def poll_feed(answer: list[dict], state: dict, keep: int) -> list[dict]:
    """Entries whose key was not seen; a key counts once. Of more than ``keep`` seen keys those of this answer stay first, then older ones."""
    seen, new = set(state["seen"]), []
    for entry in answer:
        if (key := entry_key(entry)) not in seen:
            seen.add(key)
            new.append(entry)
    recent = list(dict.fromkeys(map(entry_key, answer)))
    now = set(recent)
    state["seen"] = (recent + [k for k in state["seen"] if k not in now])[:keep]
    return [e for e in new if entry_text(e).strip()]


def poll_timeline(answer: list[dict], state: dict, most: int) -> list[dict]:
    """Entries after the cursor, oldest first, at most ``most``; the cursor is the last one's place. It is dropped after too many empty answers."""
    rows = sorted((e for e in answer if state["cursor"] is None or [e["at"], entry_key(e)] > state["cursor"]), key=lambda e: (e["at"], entry_key(e)))[:most]
    state["empty"] = 0 if rows else state["empty"] + 1
    if rows:
        state["cursor"] = [rows[-1]["at"], entry_key(rows[-1])]
    elif state["empty"] >= EMPTY_ROUNDS and not answer:
        state["cursor"], state["empty"] = None, 0
    return rows


class PolledReader(SimpleDataSourceStreamReader):
    def __init__(self, source: PolledSource):
        o = source.options
        self.fetch = source.fetch
        self.names = [n for n in o["sources"].split(",") if n]
        self.kind, self.tick, self.interval = o.get("kind", "feed"), float(o.get("tick", 60)), float(o.get("interval", 0))
        self.keep, self.most = int(o.get("keep", 500)), int(o.get("most", 50))

    def initialOffset(self) -> dict:
        fresh = {"seen": [], "cursor": None, "empty": 0, "errors": 0, "due": 0.0, "gone": False}
        return {"round": 0, "sources": {n: dict(fresh) for n in self.names}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """One round: the new entries of every source that is due, and the next offset."""
        number, out = start["round"] + 1, []
        now = number * self.tick
        sources = json.loads(json.dumps(start["sources"]))
        for name in self.names:
            state = sources.setdefault(name, self.initialOffset()["sources"][name])
            if state["gone"] or state["due"] > now:
                continue
            try:
                answer = self.fetch(name, number, state["cursor"])
                rows = poll_feed(answer, state, self.keep) if self.kind == "feed" else poll_timeline(answer, state, self.most)
            except Exception:  # whatever a source fails with, it waits, and the others go on
                state["errors"] += 1
                state["due"] = now + min(LONGEST_WAIT, FIRST_WAIT * 2 ** (state["errors"] - 1))
                state["gone"] = state["errors"] >= MOST_ERRORS
                continue
            state["errors"], state["due"] = 0, now + self.interval
            for e in rows:
                at = datetime.fromisoformat(e["at"]) if e.get("at") else None
                out.append((name, number, entry_key(e), at if at is None or at.tzinfo else at.replace(tzinfo=timezone.utc), entry_text(e), e.get("link")))
        return iter(out), {"round": number, "sources": sources}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rounds after ``start`` again, when a batch is repeated."""
        while start["round"] < end["round"]:
            rows, start = self.read(start)
            yield from rows


class PolledSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "source string, round long, key string, at timestamp, text string, link string"

    def simpleStreamReader(self, schema) -> PolledReader:
        return PolledReader(self)

    def fetch(self, source: str, number: int, cursor: list | None) -> list[dict]:
        """What a source answers in a round; an answer that is not there, or no JSON, is a failure."""
        files, base = fs.FileSystem.from_uri(self.options["path"])
        out: list[dict] = []
        for f in sorted(files.get_file_info(fs.FileSelector(f"{base}/source={source}/poll={number}")), key=lambda f: f.path):
            if f.base_name.endswith(".json"):
                with files.open_input_stream(f.path) as stream:
                    out += [json.loads(line) for line in stream.read().decode().splitlines() if line.strip()]
        return out


def register(spark: SparkSession, source: type[PolledSource] = PolledSource) -> None:
    spark.dataSource.register(source)
