"""Substring dedup: passages that recur in several documents are confirmed, then located by sharded automata.

A window is ``width`` consecutive words of one document. Words go that are covered by a window whose words also start
in a document with a smaller id; windows are judged on the input.

1. Anchors. The anchor of a window is the least hash among its runs of ``RUN`` words: equal windows have equal anchors,
   and neighbouring windows mostly share theirs. A segment is a run of windows with one anchor; a document has one for
   about 20 words. An anchor in one document only rules out its windows. Equal segments are owned by the least document,
   which covers all others that have them, so only the owners of segments go on, and only where an anchor has several.
2. Confirmation. The windows of those segments are grouped by their hash: least and greatest document. Where the two
   differ, the window recurs and the least document owns it. Counting is partial before the shuffle, so a segment or
   window in a third of all documents is a row from each task.
3. Automata. Documents that hold recurring anchors are dealt in blocks of bounded size; each block gets every passage
   that its documents have segments or windows of once, however many of them share it. A passage that all blocks need is
   a row for each block; Spark splits such a key at run time, as the other side has one row. A block compiles its own
   Aho-Corasick automaton over word numbers: a passage is cut into pieces of half a window, one of which lies whole in any
   window of the passage. Its documents are streamed through the automaton; at a hit, the words around the piece are
   compared as far as windows with it reach, and extents of at least ``width`` words are covered. Pieces with equal
   surroundings count once, under the least owner, so passages of repeated words cost no more than others. So hashes only
   propose: words decide.

Whole texts are shuffled once, to the marks of their document, and stored; what grows with the input is never broadcast.

Hashes have 64 bits: that a window is hidden by another one with its hash has odds of 1e-6 among 2e13 windows.

Null texts have no words. Keys must be integers, else TypeError. Rows without a key are never compared and keep all words. Rows that repeat a key are judged
one by one, but not against each other. Columns beside key and text are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import block_count, block_of, chunks, forget, integer_key, stored, utf8
from .words import span_hashes, window_hashes, word_hashes

#: Words of a run that anchors are made of.
RUN = 10
_NONE = np.zeros(0, np.uint64)


def _anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window: the least run hash in it."""
    run = min(RUN, width)
    low = window_hashes(words, run)
    span, have = width - run + 1, 1
    if len(low) < span:
        return low[:0]
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _segments(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchors, hashes of all their words, first windows, numbers of windows."""
    anchors = _anchors(words, width)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(anchors)), bool), anchors[1:] != anchors[:-1]]))
    after = np.concatenate([first[1:], np.full(min(1, len(first)), len(anchors), dtype=first.dtype)])
    return anchors[first], span_hashes(words, first, after + width - 1), first, after - first


def _places(words: np.ndarray, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the segments whose hashes are wanted, and the hash of the segment of each."""
    _, hashes, first, sizes = _segments(words, width)
    found = np.isin(hashes, wanted)
    hashes, first, sizes = hashes[found], first[found], sizes[found]
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), np.repeat(hashes, sizes)


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([_NONE, *parts]).view(np.int64))


def _hashes(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x or [], dtype=np.int64).view(np.uint64) for x in column.to_pylist()]


def _segment_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            anchors, segments, sizes = [], [], []
            for raw in utf8(batch, "text"):
                a, s, _, _ = _segments(word_hashes(raw), width)
                s, once = np.unique(s, return_index=True)
                anchors.append(a[once])
                segments.append(s)
                sizes.append(len(s))
            ids = np.repeat(batch.column("id").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([_signed(anchors), _signed(segments), pa.array(ids, pa.int64())], names=["anchor", "segment", "id"])

    return docs.where("id IS NOT NULL").mapInArrow(run, "anchor long, segment long, id long")


def _open_windows(words: np.ndarray, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of the wanted segments, as hashes in rising order, the first place of each and its segment."""
    at, segments = _places(words, width, wanted)
    found, first = np.unique(span_hashes(words, at, at + width), return_index=True)
    return found, at[first], segments[first]


def _window_rows(marked: DataFrame, width: int) -> DataFrame:
    """The distinct windows of each document in its open segments, with their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = [_open_windows(word_hashes(raw), width, wanted) for raw, wanted in zip(utf8(batch, "text"), _hashes(batch.column("open")), strict=True)]
            ids = np.repeat(batch.column("id").to_numpy(), [len(x[0]) for x in made])
            yield pa.RecordBatch.from_arrays([_signed([x[0] for x in made]), pa.array(ids, pa.int64()), _signed([x[2] for x in made])], names=["hash", "id", "segment"])

    return marked.where("size(open) > 0").select("id", "text", "open").mapInArrow(run, "hash long, id long, segment long")


def _passages(owners: DataFrame, width: int) -> DataFrame:
    """The owners' own words: a row for each run of recurring windows, its number and the segments that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, numbers, made, held = [], [], [], []
            columns = batch.column("id").to_pylist(), utf8(batch, "text"), *(_hashes(batch.column(c)) for c in ("open", "shared", "windows"))
            for owner, raw, wanted, shared, confirmed in zip(*columns, strict=True):
                words, hashes = raw.split(), word_hashes(raw)
                found, at, _ = _open_windows(hashes, width, wanted)
                at = np.union1d(_places(hashes, width, shared)[0], at[np.isin(found, confirmed)])
                _, segments, first, _ = _segments(hashes, width)
                for number, part in enumerate(np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []):
                    low, high = np.searchsorted(first, [part[0], part[-1]], side="right")
                    ids.append(owner)
                    numbers.append(number)
                    made.append(b" ".join(words[part[0] : part[-1] + width]))
                    held.append(np.unique(segments[low - 1 : high]).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(made, pa.binary()), pa.array(held, pa.list_(pa.int64()))], names=["owner", "number", "passage", "segments"])

    return owners.select("id", "text", "open", "shared", "windows").mapInArrow(run, "owner long, number long, passage binary, segments array<long>")


class Automaton:
    """An Aho-Corasick automaton over word numbers for a set of owned passages."""

    def __init__(self, owned: list[tuple[int, bytes]], width: int) -> None:
        self.width, self.piece = width, max(1, width // 2)
        self.numbers: dict[bytes, int] = {}
        beside = width - self.piece
        # piece to its surroundings, each once: (words, place of the piece in them) to the least owner
        places: dict[tuple[int, ...], dict[tuple[bytes, int], int]] = {}
        for owner, passage in owned:
            words = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in passage.split()], dtype=np.int32)
            for at in range(0, len(words) - self.piece + 1, self.piece):
                low = max(0, at - beside)
                around = words[low : at + width].tobytes(), at - low
                found = places.setdefault(tuple(words[at : at + self.piece].tolist()), {})
                found[around] = min(owner, found.get(around, owner))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in places.items():
            self.machine.add_word(key, [(owner, np.frombuffer(words, dtype=np.int32), at) for (words, at), owner in found.items()])
        self.machine.make_automaton()

    def covered(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words of a document lie in a window that starts in a passage of a smaller one."""
        out = np.zeros(len(words) + 1, dtype=np.int64)
        if not len(self.machine) or len(words) < self.width:
            return out[:-1].astype(bool)
        number = self.numbers.get
        text = [number(w, 0) for w in words]
        line = np.array(text, dtype=np.int32)
        for last, found in self.machine.iter(tuple(text)):
            for owner, around, at in found:
                if owner >= doc:
                    continue
                shift = last - self.piece + 1 - at
                begin, end = max(0, shift), min(len(line), shift + len(around))
                differ = np.flatnonzero(line[begin:end] != around[begin - shift : end - shift]) + begin
                cut = np.searchsorted(differ, last)
                start = differ[cut - 1] + 1 if cut else begin
                stop = differ[cut] if cut < len(differ) else end
                if stop - start >= self.width:
                    out[start] += 1
                    out[stop] -= 1
        return np.cumsum(out[:-1]) > 0


def dedup(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): for each row its count of words, of removed ones, and the rest joined by a blank as UTF-8."""
    docs = docs.select(integer_key(docs, key).alias("id"), F.col(text).alias("text"))
    schema = "id long, n_words long, n_removed long, kept binary"
    rows = stored(_segment_rows(docs, width), "segments")
    recurring = rows.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), (F.min("segment") < F.max("segment")).alias("several")).where("a < b").select("anchor", "several")
    owned = rows.join(recurring.hint("merge"), "anchor").groupBy("segment").agg(F.max("several").alias("several"), F.min("id").alias("owner"), F.max("id").alias("last"))
    owned = stored(owned, "owned")
    copies = rows.join(owned.where("owner < last").select("segment", "owner").hint("merge"), "segment").where("owner < id").select("id", "owner", "segment").distinct()
    copies = stored(copies, "copies")

    lists = owned.where("several OR owner < last").groupBy(F.col("owner").alias("id")).agg(F.collect_set(F.when(F.col("several"), F.col("segment"))).alias("open"), F.collect_set(F.when(F.col("owner") < F.col("last"), F.col("segment"))).alias("shared"))
    marks = lists.join(copies.select("id").distinct().hint("merge"), "id", "full").select("id", F.lit(True).alias("marked"), F.coalesce("open", F.array().cast("array<long>")).alias("open"), F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))
    every = stored(docs.join(marks.hint("merge"), "id", "left"), "marked")
    forget(rows, owned)
    marked = every.where("marked")

    windows = _window_rows(marked, width)
    confirmed = windows.groupBy("hash").agg(F.min(F.struct("id", "segment")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    confirmed = stored(confirmed.select("hash", F.col("first.id").alias("owner"), F.col("first.segment").alias("segment")), "confirmed")
    others = windows.select("hash", "id").join(confirmed.hint("merge"), "hash").where("owner < id").select("id", "owner", "segment")

    own = confirmed.groupBy(F.col("owner").alias("id")).agg(F.collect_list("hash").alias("windows"))
    passages = stored(_passages(marked.join(own.hint("merge"), "id", "left").where("size(shared) > 0 OR windows IS NOT NULL"), width), "passages")

    blocks = block_count(marked.count())
    wanted = copies.union(others).select(block_of(F.col("id"), blocks).alias("block"), "owner", "segment").distinct()
    holding = passages.select("owner", "number", F.explode("segments").alias("segment"))
    named = wanted.join(holding.hint("merge"), ["owner", "segment"]).select("block", "owner", "number").distinct()
    needed = named.join(passages.select("owner", "number", "passage").hint("merge"), ["owner", "number"]).select("block", "owner", "passage")
    bodies = marked.select(block_of(F.col("id"), blocks).alias("block"), "id", "text")

    def locate(rows: pa.Table, held: pa.Table) -> pa.Table:
        machine = Automaton(list(zip(held["owner"].to_pylist(), held["passage"].to_pylist(), strict=True)), width)
        out: dict[str, list] = {"id": rows["id"].to_pylist(), "n_words": [], "n_removed": [], "kept": []}
        for doc, body in zip(out["id"], rows["text"].cast(pa.binary()).to_pylist(), strict=True):
            words = body.split()
            gone = machine.covered(doc, words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    located = bodies.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(locate, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = [x.split() for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(x) for x in words], pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    rest = every.where("marked IS NULL").select("id", "text").mapInArrow(whole, schema)
    return located.unionByName(rest).withColumnRenamed("id", key)
