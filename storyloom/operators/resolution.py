"""Mentions to canonical persons, chunk by chunk in a novel's order.

Which name is first seen decides who is canonical, so what happens to a name is decided in a novel's order; Spark runs
novels side by side. Novel keeps the state of one novel, takes a chunk at a time and emits what it decides: rows of one
type, told apart by `kind`. All else is set-based: prepared() finds beforehand which names each text has, and characters(),
relations(), aliases(), canonicals(), dropped() and bridges() are joins and aggregates over the decisions.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as rules
from storyloom.operators.alike import NameIndex
from storyloom.operators.recall import TOP_K, text_mentions
from storyloom.schema import RESOLUTION, columns

#: (text, [{"mention", "candidates": [{"canonical", "matched_names"}]}]) -> [{"mention", "resolves_to"}]; None resolves to nobody.
AliasJudge = Callable[[str, list[dict]], list[dict]]

COLLECTIVE = re.compile(rules.COLLECTIVE)
INVALID = re.compile(r"(?:\s*|\d+|[!@#$%^&*()_+=\[\]{};':\"\\|,.<>/?~`-]+)")
OF = re.compile(rules.OF)
COUNTERS = (
    "collective_filtered", "invalid_filtered", "generic_filtered", "descriptive_resolved", "composite_resolved", "descriptive_unresolved", "composite_unresolved",
    "nonbody_person_provisional", "nonbody_descriptive_dropped", "nonbody_provisional_dropped",
)


def nobody(text: str, pending: list[dict]) -> list[dict]:
    """A judge that resolves nothing."""
    return [{"mention": p["mention"], "resolves_to": None} for p in pending]


def judge_from(answers: dict[str, str | None]) -> AliasJudge:
    return lambda text, pending: [{"mention": p["mention"], "resolves_to": answers[p["mention"]]} for p in pending if p["mention"] in answers]


def fingerprint(*asked: object) -> str:
    """Of a judge's version and input; lists are in a total order already."""
    return hashlib.sha256(json.dumps(asked, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def kind_of_name(name: str | None) -> str | None:
    """The class that rules alone give: invalid, collective, generic or none."""
    if name is None or len(name) > 50 or INVALID.fullmatch(name):
        return "invalid"
    return "collective" if COLLECTIVE.match(name) else "generic" if name in rules.GENERIC else None


def filtered(name: str | None) -> bool:
    return kind_of_name(name) in ("invalid", "collective")


@dataclass
class Role:
    """A mention as a role: of an anchor person, by `的` or as the anchor's name with more after it; else bare."""

    kind: str
    by_of: bool = False
    anchor: str | None = None
    head: str | None = None


@dataclass
class Chunk:
    """What holds within one chunk only."""

    id: int
    chapter: int
    text: str
    body: bool
    section: str
    category: dict[str, str]
    hits: list[str] | None = None  # names of the novel that the text has, where they were found beforehand
    seen: set[str] = field(default_factory=set)  # canonicals that the extraction has shown so far
    shown: set[str] = field(default_factory=set)  # canonicals that the text has
    pending: dict[str, list[str]] = field(default_factory=dict)
    deferred: dict[str, None] = field(default_factory=dict)
    gone: set[str] = field(default_factory=set)


@dataclass
class Novel:
    """State of one novel: canonical of each known name, aliases and index of each canonical, evidence for roles."""

    novel_id: str
    lineage: bool = False
    own_candidates_only: bool = True  # a judge may pick only from the mention's own candidates
    version: str = ""  # of the judge: its prompt, model and settings
    replays: dict[str, str] = field(default_factory=dict)  # earlier answers by the fingerprint of what was asked
    canonical: dict[str, str] = field(default_factory=dict)
    index: dict[str, set[str]] = field(default_factory=dict)
    alike: NameIndex = field(default_factory=NameIndex)  # of the same names, where no rule filters the canonical
    provisional: set[str] = field(default_factory=set)
    sightings: dict[str, tuple[str, set[int]]] = field(default_factory=dict)  # bare role: target, chunks
    settled: set[tuple[str, str]] = field(default_factory=set)
    barred: set[str] = field(default_factory=set)
    order: int = 0  # of aliases and bridges
    count: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    emitted: int = 0  # rows, those taken too: the order of events
    out: list[dict] = field(default_factory=list)

    # output

    def emit(self, kind: str, chunk: Chunk | None = None, **values: object) -> None:
        self.out.append({"novel_id": self.novel_id, "kind": kind, "chunk_id": chunk.id if chunk else None, "chapter_id": chunk.chapter if chunk else None} | values)
        self.emitted += 1

    def trace(self, chunk: Chunk, event: str, name: str, **facts: object) -> None:
        """A lineage event; it has no part in any decision."""
        if self.lineage:
            where = f"{self.novel_id}\x1f{chunk.id}\x1f{name}"
            shown = {"lineage_id": hashlib.sha256(where.encode()).hexdigest()[:32], "section_type": chunk.section} | facts
            self.emit("event", chunk, type=event, name=name, names=[f"{k}={'|'.join(v) if isinstance(v, list) else '' if v is None else v}" for k, v in shown.items()], ordinal=self.emitted)

    def step(self) -> int:
        self.order += 1
        return self.order

    def taken(self) -> list[dict]:
        rows, self.out = self.out, []
        return rows

    # names

    def category(self, chunk: Chunk, name: str) -> str | None:
        return "generic" if name in rules.GENERIC else chunk.category.get(name)

    def know(self, canonical: str, name: str) -> None:
        """From now on the name leads to the canonical in recall."""
        self.index.setdefault(canonical, set()).add(name)
        if not filtered(canonical):
            self.alike.add(canonical, name)

    def register(self, chunk: Chunk, name: str) -> None:
        """A new canonical; outside the body it's provisional and no candidate until the body has it."""
        self.canonical[name] = name
        self.emit("register", chunk, name=name, flag=chunk.body)
        if chunk.body:
            self.know(name, name)
        else:
            self.provisional.add(name)
            self.count["nonbody_person_provisional"] += 1

    def leave_out(self, chunk: Chunk, name: str) -> str:
        """What becomes of a mention that nobody could be found for: its label."""
        category = self.category(chunk, name)
        if category == "generic":
            chunk.gone.add(name)
            return "generic_dropped"
        if category in ("descriptive", "composite"):
            chunk.gone.add(name)
            self.count[f"{category}_unresolved" if chunk.body else "nonbody_descriptive_dropped"] += 1
            return "null_unresolved" if chunk.body else "nonbody_dropped"
        if name not in self.canonical:
            self.register(chunk, name)
        return "null_registered"

    def has(self, chunk: Chunk, names: Iterable[str]) -> bool:
        """Whether the chunk's text has one of the names."""
        return any(n in (chunk.text if chunk.hits is None else chunk.hits) for n in names)

    def in_text(self, chunk: Chunk) -> set[str]:
        if chunk.hits is None:
            return {c for c, names in self.index.items() if not filtered(c) and self.has(chunk, names)}
        return {c for n in chunk.hits if (c := self.canonical.get(n)) and n in self.index.get(c, ()) and not filtered(c)}

    def recall(self, chunk: Chunk, mention: str) -> list[str]:
        """Canonicals of the chunk's extraction, then of its text, by name within each; the most alike of the others up to TOP_K."""
        usable = lambda c: c != mention and c in self.index and not filtered(c)
        strong = sorted(filter(usable, chunk.seen)) + sorted(filter(usable, chunk.shown - chunk.seen))
        if len(strong) >= TOP_K:
            return strong
        return strong + [c for c, _, _ in self.alike.most_alike(mention, TOP_K - len(strong), strong)]

    def recall_source(self, chunk: Chunk, found: list[str]) -> str:
        return "none" if not found else "strong_extraction" if chunk.seen & set(found) else "strong_text" if chunk.shown & set(found) else "weak"

    def settle(self, chunk: Chunk, name: str, role: str) -> str:
        """One occurrence of a name: known, filtered, registered, dropped, deferred or pending."""
        self.trace(chunk, "mention_enter", name, role=role, extraction_category=chunk.category.get(name), hygiene_category=kind_of_name(name))
        if name in self.canonical:
            who = self.canonical[name]
            if who in self.provisional and chunk.body:
                self.provisional.discard(who)
                self.know(who, who)
                self.emit("promote", chunk, name=who)
            if who not in self.provisional:
                chunk.seen.add(who)
            self.trace(chunk, "registration", name, registered=True, alias_to=who if who != name else None, final_canonical=who, provisional=who in self.provisional)
            return "known"
        found = self.recall(chunk, name)
        self.trace(chunk, "recall", name, recall_source=self.recall_source(chunk, found), recall_candidates=found)
        if found:
            chunk.pending[name] = found
            return "pending"
        category = self.category(chunk, name)
        if category == "generic":
            self.count["generic_filtered"] += 1
            fate = "dropped"
        elif category in ("descriptive", "composite"):
            if chunk.body:
                chunk.deferred[name] = None
                return "deferred"
            self.count["nonbody_descriptive_dropped"] += 1
            chunk.gone.add(name)
            fate = "dropped"
        else:
            self.register(chunk, name)
            if chunk.body:
                chunk.seen.add(name)
            fate = "registered"
        self.trace(chunk, "admission", name, admission=f"no_candidate_{fate}")
        self.trace(chunk, "registration", name, registered=fate == "registered", alias_to=None, final_canonical=name if fate == "registered" else None, provisional=fate == "registered" and not chunk.body)
        return fate

    # roles

    def role(self, name: str) -> Role:
        if m := OF.match(name):
            return Role("qualified", True, self.canonical.get(m[1]), m[2])
        prefix = next((name[:k] for k in range(len(name), 1, -1) if name[:k] in self.canonical), None)
        return Role("qualified", False, self.canonical[prefix], name[len(prefix) :]) if prefix and prefix != name else Role("bare")

    def admits(self, chunk: Chunk, mention: str, target: str) -> tuple[bool, str]:
        """Whether a role may become an alias of the target, and the label of why."""
        if (mention, target) in self.settled:
            return True, "confirmed"
        role = self.role(mention)
        if role.kind == "qualified":
            if not role.by_of and target == role.anchor:
                return True, "accept"
            if target != role.head:
                return False, "target_mismatch" if role.by_of else "anchor_mismatch"
            here = role.anchor is None or self.has(chunk, {role.anchor} | self.index.get(role.anchor, set()))
            return here, "accept" if here else "anchor_absent"
        if self.category(chunk, mention) != "descriptive" or mention[:1] not in rules.SENIOR:
            return True, "accept"
        if mention in self.barred:
            return False, "blocked"
        who, chunks = self.sightings.setdefault(mention, (target, set()))
        if who != target:
            self.barred.add(mention)
            del self.sightings[mention]
            return False, "blocked"
        chunks.add(chunk.id)
        if len(chunks) < 2:
            return False, "observation"
        self.settled.add((mention, target))
        del self.sightings[mention]
        return True, "confirmed"

    # judging

    def apply(self, chunk: Chunk, mention: str, target: str | None, answered: bool) -> None:
        self.trace(chunk, "judge", mention, judge_called=True, judge_resolves_to=target, judge_missing=not answered, judge_input_candidates=chunk.pending[mention])
        if target is None:
            label, ok = self.leave_out(chunk, mention), False
        else:
            ok, label = self.admits(chunk, mention, target)
            if ok:
                self.canonical[mention] = target
                self.know(target, mention)
                self.emit("alias", chunk, name=target, target=mention, ordinal=self.step())
                if (category := chunk.category.get(mention)) in ("descriptive", "composite"):
                    self.count[f"{category}_resolved"] += 1
            else:
                chunk.gone.add(mention)
        who = self.canonical.get(mention)
        self.trace(chunk, "admission", mention, admission=label)
        self.trace(chunk, "registration", mention, registered=who is not None, alias_to=who if who != mention else None, final_canonical=who, provisional=who in self.provisional)

    def judged(self, chunk: Chunk, judge: AliasJudge) -> bool:
        """Asks once for all pending mentions; whether that failed. Wrong targets count as no answer."""
        asked = [{"mention": m, "candidates": [{"canonical": c, "matched_names": sorted(self.index[c])} for c in found]} for m, found in chunk.pending.items()]
        question = fingerprint(self.version, chunk.text, asked)
        try:
            answers: dict[str, str | None] = {}
            for a in json.loads(self.replays[question]) if question in self.replays else judge(chunk.text, asked):
                answers.setdefault(a["mention"], a["resolves_to"])
            failed = False
            self.emit("judgement", chunk, name=question, text=json.dumps([{"mention": m, "resolves_to": t} for m, t in answers.items()], ensure_ascii=False))
        except Exception as e:  # noqa: BLE001  a judge may fail in any way; its chunk is marked
            answers, failed = {}, True
            self.emit("judge_failure", chunk, text=f"{type(e).__name__}: {e}")
        every = {c for found in chunk.pending.values() for c in found}
        for m, found in chunk.pending.items():
            allowed = set(found) if self.own_candidates_only else every
            target = answers.get(m)
            wrong = target is not None and (target not in allowed or filtered(target) or self.canonical.get(target) != target)
            self.apply(chunk, m, None if wrong else target, m in answers and not wrong)
        return failed

    # a chunk

    def take(self, row: dict, judge: AliasJudge) -> None:
        """row: chunk_id, chapter_id, section_type, characters, relationships, and text or hits."""
        people = [(c["name"], c["category"]) for c in row["characters"]]
        links = [(i, r["source"], r["target"]) for i, r in enumerate(row["relationships"]) if r["source"] != r["target"]]
        section, hits = row["section_type"] or "body", row.get("hits")
        chunk = Chunk(row["chunk_id"], row["chapter_id"], row.get("text") or "", section == "body", section, {n: c for n, c in people if c is not None}, None if hits is None else dict.fromkeys(hits))
        names = {n for n, _ in people} | {n for _, *ends in links for n in ends}
        chunk.seen = {c for n in names if not filtered(n) and (c := self.canonical.get(n)) and not filtered(c) and c not in self.provisional}
        chunk.shown = self.in_text(chunk)
        kept: list[tuple[str, int, str]] = []  # part, place, name of each occurrence that wasn't dropped
        for i, (name, _) in enumerate(people):
            if kind := kind_of_name(name) if filtered(name) else None:
                self.count[f"{kind}_filtered"] += 1
                self.trace(chunk, "admission", name, admission="skipped_hardfilter")
            elif self.settle(chunk, name, "character") != "dropped":
                kept.append(("character", i, name))
        for i, *ends in links:
            if not any(map(filtered, ends)) and all(self.settle(chunk, e, "end") != "dropped" for e in ends):
                kept += [("source", i, ends[0]), ("target", i, ends[1])]
        if chunk.deferred:  # with what the rest of the chunk has shown meanwhile
            chunk.shown = self.in_text(chunk)
            for name in chunk.deferred:
                found = self.recall(chunk, name)
                self.trace(chunk, "recall", name, recall_source=self.recall_source(chunk, found), recall_candidates=found)
                if found:
                    chunk.pending[name] = found
                else:
                    label = self.leave_out(chunk, name)
                    self.trace(chunk, "admission", name, admission=label)
        for m, found in chunk.pending.items():
            sides = sorted(c for c in found if self.canonical.get(c) == c)
            for i, a in enumerate(sides):
                for b in sides[i + 1 :]:
                    self.emit("bridge", chunk, ordinal=self.step(), type=m, name=a, target=b)
        failed = bool(chunk.pending) and self.judged(chunk, judge)
        for name in sorted(chunk.gone):
            self.emit("gone", chunk, name=name)
        for part, i, name in kept:
            if name not in chunk.gone:
                self.emit("decision", chunk, type=part, ordinal=i, name=name, target=self.canonical.get(name, name))
        self.emit("chunk", chunk, flag=failed, type=section)

    def close(self) -> None:
        """The novel's counters; names that the body never had are no longer known."""
        for name in self.provisional:
            if self.canonical.pop(name, None):
                self.count["nonbody_provisional_dropped"] += 1
        self.provisional.clear()
        for k in COUNTERS:
            self.emit("counter", name=k, n=self.count[k])


def frame(rows: Iterable[dict]) -> pd.DataFrame:
    """Rows as RESOLUTION columns."""
    names = columns(RESOLUTION)
    out = pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)
    for c in ("chunk_id", "chapter_id", "ordinal"):
        out[c] = out[c].astype("Int32")
    out["n"], out["confidence"], out["flag"] = out["n"].astype("Int64"), out["confidence"].astype("Float64"), out["flag"].astype("boolean")
    return out


#: Chunks that a task has as Python rows at a time, and rows that it gathers before it gives them on: what it holds doesn't grow with its input.
AT_ONCE, GATHERED = 64, 2_000
ARROW = pa.schema([
    ("novel_id", pa.string()), ("kind", pa.string()), ("chunk_id", pa.int32()), ("chapter_id", pa.int32()), ("ordinal", pa.int32()), ("name", pa.string()), ("target", pa.string()), ("type", pa.string()),
    ("confidence", pa.float64()), ("n", pa.int64()), ("flag", pa.bool_()), ("text", pa.string()), ("names", pa.list_(pa.string())),
])


def resolved_in_order(batches: Iterable[pa.RecordBatch], start: Callable[[str], Novel], judge: AliasJudge) -> Iterator[pa.RecordBatch]:
    """RESOLUTION rows of chunks that come in order, a novel after the other; only the state of one novel is held."""
    novel, out = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            for row in batch.slice(at, AT_ONCE).to_pylist():
                if novel is None or novel.novel_id != row["novel_id"]:
                    if novel is not None:
                        novel.close()
                        out += novel.taken()
                    novel = start(row["novel_id"])
                novel.replays = {x["fingerprint"]: x["answers"] for x in row.get("replays") or ()}
                novel.take(row, judge)
                out += novel.taken()
                if len(out) >= GATHERED:
                    yield pa.RecordBatch.from_pylist(out, ARROW)
                    out = []
    if novel is not None:
        novel.close()
        out += novel.taken()
    yield pa.RecordBatch.from_pylist(out, ARROW)


def mention_names(inputs: DataFrame) -> DataFrame:
    """novel_id, name: the names of all extractions of a novel that aren't filtered, each once; only these can be known to it."""
    names = F.concat(F.transform("characters", lambda c: c["name"]), F.transform("relationships", lambda r: r["source"]), F.transform("relationships", lambda r: r["target"]))
    each = inputs.select("novel_id", F.explode(F.array_distinct(names)).alias("name"))
    return each.where(~rules.hard_filtered(F.col("name"))).distinct()


def prepared(inputs: DataFrame, with_text: bool) -> DataFrame:
    """inputs with `hits`, the novel's names that each text has; with the text itself only where a judge reads it."""
    names = mention_names(inputs).select("novel_id", F.col("name").alias("canonical"), "name")
    hits = text_mentions(inputs, names).groupBy("novel_id", "chunk_id").agg(F.sort_array(F.collect_set("canonical")).alias("hits"))  # at most as many as the text's places
    out = inputs.select("novel_id", "chunk_id", "chapter_id", *["text"] * with_text, "section_type", "characters", "relationships").join(hits, ["novel_id", "chunk_id"], "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def resolve(inputs: DataFrame, judge: AliasJudge, lineage: bool = False, replays: DataFrame | None = None, version: str = "", own_candidates_only: bool = True, judge_reads_text: bool = True) -> DataFrame:
    """RESOLUTION rows of every novel. inputs: (novel_id, chunk_id, chapter_id, text, section_type, characters, relationships).

    replays, as judgements() gives them, answer what an earlier run has asked of the same version of the judge.
    own_candidates_only: a judge may pick only from a mention's own candidates; else from those of all mentions of its chunk.
    judge_reads_text: without it the texts stay out of the ordered step, and the judge gets empty ones.
    Write the result before it's split by kind: each action runs the judge anew.
    """
    rows = prepared(inputs, judge_reads_text)
    if replays is not None:
        old = replays.groupBy("novel_id", "chunk_id").agg(F.collect_set(F.struct("fingerprint", "answers")).alias("replays"))  # a few for each chunk
        rows = rows.join(old, ["novel_id", "chunk_id"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return resolved_in_order(batches, lambda novel_id: Novel(novel_id, lineage, own_candidates_only, version), judge)

    return rows.repartition("novel_id").sortWithinPartitions("novel_id", "chunk_id").mapInArrow(run, RESOLUTION)


def judgements(rows: DataFrame) -> DataFrame:
    """novel_id, chunk_id, fingerprint, answers of the calls that succeeded; a failed call leaves none and is made again."""
    return rows.where("kind = 'judgement'").select("novel_id", "chunk_id", F.col("name").alias("fingerprint"), F.col("text").alias("answers"))


def decisions(rows: DataFrame, part: str) -> DataFrame:
    return rows.where((F.col("kind") == "decision") & (F.col("type") == part)).select("novel_id", "chunk_id", "chapter_id", "ordinal", "target")


def characters(rows: DataFrame) -> DataFrame:
    """Canonicals of each chunk, each once, in the order of their first mention."""
    first = decisions(rows, "character").groupBy("novel_id", "chunk_id", "chapter_id", F.col("target").alias("name")).agg(F.min("ordinal").alias("at"))
    ordinal = F.row_number().over(Window.partitionBy("novel_id", "chunk_id").orderBy("at")) - 1  # a chunk's
    return first.select("novel_id", "chunk_id", "chapter_id", ordinal.alias("ordinal"), "name")


def relations(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """The relations of `inputs` with the canonicals of their ends: those whose two ends are kept and differ."""
    raw = inputs.select("novel_id", "chunk_id", F.posexplode("relationships").alias("ordinal", "r")).select("novel_id", "chunk_id", "ordinal", "r.type", "r.confidence")
    key = ["novel_id", "chunk_id", "ordinal"]
    ends = rows.where("kind = 'decision' AND type <> 'character'").groupBy(*key).agg(
        F.first("chapter_id").alias("chapter_id"), F.max(F.when(F.col("type") == "source", F.col("target"))).alias("source"), F.max(F.when(F.col("type") == "target", F.col("target"))).alias("target")
    )
    return ends.where("source <> target").join(raw, key).select("novel_id", "chunk_id", "chapter_id", "ordinal", "source", "target", "type", "confidence")


def dropped(rows: DataFrame) -> DataFrame:
    """Names registered outside the body only: provisional ones that were never promoted."""
    promoted = rows.where("kind = 'promote'").select("novel_id", "name")
    return rows.where("kind = 'register' AND NOT flag").select("novel_id", "name").join(promoted, ["novel_id", "name"], "left_anti").distinct()


def aliases(rows: DataFrame) -> DataFrame:
    """novel_id, canonical, alias, ordinal: each alias once, in the order of its first confirmation."""
    first = rows.where("kind = 'alias' AND name <> target").groupBy("novel_id", F.col("name").alias("canonical"), F.col("target").alias("alias")).agg(F.min("ordinal").alias("at"))
    return first.select("novel_id", "canonical", "alias", (F.row_number().over(Window.partitionBy("novel_id", "canonical").orderBy("at")) - 1).alias("ordinal"))


def canonicals(rows: DataFrame) -> DataFrame:
    """novel_id, name, first_seen, mention_count (body chunks only), chapters, aliases."""
    key = ["novel_id", "name"]
    seen = rows.where("kind = 'promote' OR kind = 'register' AND flag").groupBy(*key).agg(F.min("chunk_id").alias("first_seen"))
    body = rows.where("kind = 'chunk' AND type = 'body'").select("novel_id", "chunk_id")
    counted = characters(rows).join(body, ["novel_id", "chunk_id"]).groupBy(*key).agg(F.countDistinct("chunk_id").alias("mention_count"), F.sort_array(F.collect_set("chapter_id")).alias("chapters"))
    names = aliases(rows).groupBy("novel_id", F.col("canonical").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "alias"))), lambda x: x["alias"]).alias("aliases"))
    out = seen.join(counted, key, "left").join(names, key, "left").na.fill(0, ["mention_count"])
    return out.withColumns({"chapters": F.coalesce("chapters", F.array().cast("array<int>")), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})


def bridges(rows: DataFrame) -> DataFrame:
    """Bridge evidence; a mention that is left out takes all its evidence up to that chunk with it."""
    gone = rows.where("kind = 'gone'").groupBy("novel_id", F.col("name").alias("mention")).agg(F.max("chunk_id").alias("upto"))
    out = rows.where("kind = 'bridge'").select("novel_id", F.col("type").alias("mention"), F.col("name").alias("a"), F.col("target").alias("b"), "chunk_id", "chapter_id")
    return out.join(gone, ["novel_id", "mention"], "left").where("upto IS NULL OR chunk_id > upto").select(*out.columns)


def judge_failures(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'chunk' AND flag").select("novel_id", "chunk_id")


def counters(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'counter'").select("novel_id", "name", "n")


def events(rows: DataFrame) -> DataFrame:
    """Lineage: novel_id, chunk_id, chapter_id, ordinal, event, mention, facts (a map)."""
    facts = F.map_from_entries(F.transform("names", lambda s: F.struct(F.substring_index(s, "=", 1), F.nullif(F.regexp_replace(s, "^[^=]*=", ""), F.lit("")))))
    return rows.where("kind = 'event'").select("novel_id", "chunk_id", "chapter_id", "ordinal", F.col("type").alias("event"), F.col("name").alias("mention"), facts.alias("facts"))
