"""The resolver over a stream of extracted chunks.

Chunks of a novel may arrive in any order and in different batches. Those that came early wait in the novel's state, and
the contiguous run from the next expected chunk on is taken, so the rows are those of the batch form. A chunk whose
extraction failed is sent with `tombstone` true and only moves the run on; `last` closes the novel, of which only that it's closed
is kept: chunks that come again later are passed over. At most `most_early` chunks of a novel may wait.

A novel's state is a value (where it stands), a map of what it knows (an entry for each name, alias, sighting and so on)
and a map of the waiting chunks. A batch reads them and writes the entries that it changed, so what is written follows the
batch and not the novel. The session needs a state store with such states: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storyloom.operators.resolution import AliasJudge, Novel, frame
from storyloom.schema import CHARACTER, RELATIONSHIP, RESOLUTION

INPUT = f"novel_id string, chunk_id int, chapter_id int, text string, section_type string, characters array<{CHARACTER}>, relationships array<{RELATIONSHIP}>, tombstone boolean, last boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Facts = dict[tuple[str, str, str], str]


def facts_of(novel: Novel) -> Facts:
    """All that a novel knows, as entries: (what, of whom, what else) -> value."""
    out: Facts = {("canonical", name, ""): c for name, c in novel.canonical.items()}
    out |= {("name", c, n): "" for c, names in novel.index.items() for n in names}
    out |= {("provisional", n, ""): "" for n in novel.provisional}
    out |= {("barred", n, ""): "" for n in novel.barred}
    out |= {("settled", m, target): "" for m, target in novel.settled}
    out |= {("sighting", m, ""): json.dumps([target, sorted(chunks)], ensure_ascii=False) for m, (target, chunks) in novel.sightings.items()}
    return out


def restored(novel: Novel, facts: Facts) -> Novel:
    """The novel with what facts_of() gave."""
    for (what, a, b), value in facts.items():
        if what == "canonical":
            novel.canonical[a] = value
        elif what == "name":
            novel.know(a, b)
        elif what == "settled":
            novel.settled.add((a, b))
        elif what == "sighting":
            target, chunks = json.loads(value)
            novel.sightings[a] = target, set(chunks)
        else:
            {"provisional": novel.provisional, "barred": novel.barred}[what].add(a)
    return novel


def plain(x: Any) -> Any:
    """Rows as JSON holds them."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "tolist"):  # numpy's scalars and arrays
        x = x.tolist()
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


class Resolver(StatefulProcessor):
    """One novel's chunks to RESOLUTION rows."""

    def __init__(self, judge: AliasJudge, lineage: bool, most_early: int):
        self.judge, self.lineage, self.most_early = judge, lineage, most_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "expected int, step int, closed boolean, counters string")
        self.known = handle.getMapState("known", "what string, who string, more string", "value string")
        self.early = handle.getMapState("early", "chunk_id int", "row string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        expected, step, closed, counters = self.place.get() if self.place.exists() else (1, 0, False, "{}")
        if closed:
            for _ in rows:
                pass
            return
        new = {int(r["chunk_id"]): plain(r) for b in rows for r in b.to_dict("records") if r["chunk_id"] >= expected}
        if expected not in new and not self.early.containsKey((expected,)):
            yield from self.wait(key, expected, new)
            return
        before: Facts = {tuple(k): v[0] for k, v in self.known.iterator()}
        novel = restored(Novel(key[0], self.lineage), before)
        novel.order = step
        novel.count |= json.loads(counters)
        while not closed and (expected in new or self.early.containsKey((expected,))):
            if (row := new.pop(expected, None)) is None:
                row = json.loads(self.early.getValue((expected,))[0])
            self.early.removeKey((expected,))
            expected += 1
            if not row["tombstone"]:
                novel.take(row, self.judge)
            if closed := bool(row["last"]):
                novel.close()
        yield frame(novel.taken())
        if closed:
            self.known.clear()
            self.early.clear()
        else:
            now = facts_of(novel)
            for k in before.keys() - now.keys():
                self.known.removeKey(k)
            for k, v in now.items():
                if before.get(k) != v:
                    self.known.updateValue(k, (v,))
            yield from self.wait(key, expected, new)
        self.place.update((expected, novel.order, closed, "{}" if closed else json.dumps(novel.count)))

    def wait(self, key: tuple, expected: int, new: dict[int, dict]) -> Iterator[pd.DataFrame]:
        for chunk_id, row in new.items():
            self.early.updateValue((chunk_id,), (json.dumps(row, ensure_ascii=False),))
        if (n := sum(1 for _ in self.early.keys())) > self.most_early:
            raise ValueError(f"novel {key[0]}: chunk {expected} is missing and {n} later ones wait")
        yield frame([])

    def close(self) -> None:
        pass


def resolve_stream(inputs: DataFrame, judge: AliasJudge, lineage: bool = False, most_early: int = 10_000) -> DataFrame:
    """RESOLUTION rows as chunks become resolvable. inputs: a streaming frame with the columns of INPUT."""
    if inputs.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    return inputs.groupBy("novel_id").transformWithStateInPandas(Resolver(judge, lineage, most_early), RESOLUTION, "append", "none")
