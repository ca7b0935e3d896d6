"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Words are lower-cased and freed of punctuation at their ends. A word with a digit first is a number; a unit is a word of
``UNITS`` after a number, or the end of one such as ``5kg``'s (then the word is both); a name is a run of words that begin
with a capital, without punctuation between them, and are not of ``STARTERS``. Each name is one token, however many words
it has, so a question with other numbers, names or units keeps its template.

Both the words themselves and the tokens of the template are looked for. Windows of ``WINDOW`` are hashed; of
``SPAN - WINDOW + 1`` neighbours the least hash stands for all, so any ``SPAN`` equal words of document and item share a
hash, whatever they are. So do ``SPAN`` equal tokens, but for stretches where every window has fewer than ``LITERAL`` plain
words, which are found by their words only. Items that are shorter than ``SPAN`` are hashed whole: by their words, and by
their template if it has ``LITERAL`` plain words. Hashes are joined; the documents and items that meet are aligned. A run
of equal words counts. A run of equal tokens counts if its slots agree: one value of the item always stands against the
same value of the document, and the other way round; where two slots disagree, the runs that hold only one of them are
taken. Runs of ``SPAN``, or of the whole item if it is shorter, make a document contaminated.

Items of under ``SHORTEST`` words are not looked for: a parameter, as single words are no passages. Null texts have no
words. Keys must be integers, else TypeError. Rows without a key are never reported. Rows that repeat a key are examined one
by one and reported once for an item. Columns beside key and text are not read. An empty table on either side gives an
empty result. The items of a document are dealt in ``SHARES`` lists, so its text is copied so many times at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chunks, integer_key, stored, utf8
from .words import byte_hashes, mix, spans, window_hashes, word_hashes

WINDOW, SPAN, LITERAL, SHORTEST = 8, 13, 5, 3
SHARES = 64
NUMBER, NAME, UNIT, PLAIN = 1, 2, 3, 0
#: Words that are units after a number.
UNITS = frozenset("% $ € £ mm cm m km in ft mi mg g kg t oz lb lbs ml l ms s sec min h hr d w mph kmh w kw v a hz khz mhz ghz kb mb gb tb usd eur gbp dollar dollars euro euros cent cents pound pounds meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees".split())
#: Words that begin sentences and are no names.
STARTERS = frozenset("a about after all although an and any are as at because before both but by can could did do does during each either every few find for from given had has have he her here his how however i if in into is it its let many may more most much my neither no not now of on one only or our over she should since so some such suppose than that the their then there these they this those through to two under until was we were what when where whether which while who whose why will with would you your".split())
_EDGES = b"""!"'()*+,-./:;<=>?[\\]^_`{|}~"""
_NUMBER = re.compile(rb"[0-9][0-9.,:/]*([a-z%]*)$")


def _plain(word: bytes) -> bytes:
    return (word.strip(_EDGES) or word).decode().lower().encode()


_IS_EDGE = np.zeros(256, dtype=bool)
_IS_EDGE[list(_EDGES)] = True
_UNITS, _STARTERS = (np.sort(np.concatenate([word_hashes(w.encode()) for w in words])) for words in (UNITS, STARTERS))
#: What stands for each kind.
_HOLDERS = mix(np.arange(1, 5, dtype=np.uint64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _split(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text in lower case, the starts and ends of its words there, and whether each begins with a capital."""
    said = raw.decode()
    low = said.lower().encode()
    if len(low) == len(raw):
        starts, ends = _bare(low, *spans(low))
        one, two = np.frombuffer(raw + b" ", dtype=np.uint8), np.frombuffer(low + b" ", dtype=np.uint8)
        # the first character differs: its only byte, or the one after the first, as capitals share that with small letters
        capital = np.where(one[starts] < 128, one[starts] != two[starts], (one[starts] != two[starts]) | (one[starts + 1] != two[starts + 1]))
        return low, starts, ends, capital
    # some letters change their size with their case, so words are turned one by one
    words = [w.decode() for w in raw.split()]
    low = " ".join(w.lower() for w in words).encode()
    return low, *_bare(low, *spans(low)), np.array([w.strip(_EDGES.decode())[:1].isupper() for w in words], dtype=bool)


def _bare(low: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the punctuation at their ends; words of nothing else stay whole."""
    inner = np.flatnonzero(~_IS_EDGE[np.frombuffer(low, dtype=np.uint8)])
    first, last = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
    whole = last < first
    at = np.append(inner, 0)
    return np.where(whole, starts, at[first]), np.where(whole, ends, at[last] + 1)


def streams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text; and of its template's tokens their hashes, kinds and first words."""
    low, starts, ends, name = _split(raw)
    if not len(starts):
        return *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int8), np.zeros(0, np.int64)
    literal = byte_hashes(low, starts, ends)
    signs = np.frombuffer(low + b" ", dtype=np.uint8)
    kind = np.where(name & ~_among(literal, _STARTERS), NAME, PLAIN).astype(np.int8)
    kind[_among(literal, _UNITS)] = UNIT
    for k in np.flatnonzero((signs[starts] >= 48) & (signs[starts] <= 57)).tolist():
        number = _NUMBER.match(low, int(starts[k]), int(ends[k]))
        if number and (not number[1] or number[1].decode() in UNITS):
            kind[k] = NUMBER
    number = np.zeros(len(kind), dtype=bool)
    number[1:] = kind[:-1] == NUMBER
    kind[(kind == UNIT) & ~number] = PLAIN
    name = kind == NAME
    first = np.ones(len(kind), dtype=bool)
    # a name goes on where nothing but a blank stands between its words
    first[1:] = ~(name[1:] & name[:-1] & ~_IS_EDGE[signs[ends[:-1]]])
    at = np.flatnonzero(first)
    kinds = kind[at]
    return literal, np.where(kinds == PLAIN, literal[at], _HOLDERS[kinds]), kinds, at


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are known, of a few in rising order."""
    at = np.searchsorted(known, hashes)
    return known[np.minimum(at, len(known) - 1)] == hashes


def _rich(kinds: np.ndarray, width: int) -> np.ndarray:
    """Which windows of tokens have enough plain words."""
    plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    return plain[width:] - plain[: len(plain) - width] >= LITERAL if len(kinds) >= width else np.zeros(0, bool)


def _least(low: np.ndarray) -> np.ndarray:
    """The least of each ``SPAN - WINDOW + 1`` neighbours, where it changes."""
    turn, have = SPAN - WINDOW + 1, 1
    if len(low) < turn:
        return low[:0]
    while have < turn:
        step = min(have, turn - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low[np.concatenate([[True], low[1:] != low[:-1]])]


def _marks(raw: bytes, short: list[int], short_tokens: list[int]) -> np.ndarray:
    """The hashes that stand for a text: of neighbours the least, and every window of the short items' lengths."""
    literal, tokens, kinds, _ = streams(raw)
    template = lambda n: np.where(_rich(kinds, n), window_hashes(tokens, n), _NONE)
    out = [_least(window_hashes(literal, WINDOW)), _least(template(WINDOW)), *(window_hashes(literal, n) for n in short), *(template(n) for n in short_tokens)]
    out = np.unique(np.concatenate(out))
    return out[out != _NONE]


def _mark_rows(df: DataFrame, short: list[int], short_tokens: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [_marks(x, short, short_tokens) for x in utf8(batch, "text")]
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(ids, pa.int64())], names=["mark", "id"])

    return df.mapInArrow(run, "mark long, id long")


def _short(items: DataFrame) -> tuple[list[int], list[int]]:
    """The lengths below ``SPAN`` that items have: in words, and in tokens. They are a few numbers, however many items there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [(len(s[0]), len(s[1])) for s in (streams(x) for x in utf8(batch, "text")) if len(s[0]) >= SHORTEST]
            yield pa.RecordBatch.from_arrays([pa.array([min(x[k], SPAN) for x in found], pa.int64()) for k in (0, 1)], names=["words", "tokens"])

    rows = items.mapInArrow(run, "words long, tokens long").distinct().collect()
    return sorted({r.words for r in rows if r.words < SPAN}), sorted({r.tokens for r in rows if LITERAL <= r.tokens < SPAN})


def _consistent(item: list[bytes], doc: list[bytes], slots: np.ndarray) -> list[tuple[int, int]]:
    """The longest parts of an aligned run within which the values in the slots stand one for one; they may overlap."""
    parts, start = [], 0
    there: dict[bytes, tuple[bytes, int]] = {}
    back: dict[bytes, tuple[bytes, int]] = {}
    for k in np.flatnonzero(slots).tolist():
        a, b = item[k], doc[k]
        (other, i), (former, j) = there.get(a, (b, -1)), back.get(b, (a, -1))
        last = max(i if other != b else -1, j if former != a else -1)
        if last >= start:
            parts.append((start, k))
            start = last + 1
        there[a], back[b] = (b, k), (a, k)
    return [*parts, (start, len(item))]


class Read:
    """A document, read once for all the items that it meets: its words, its template and the places of their windows."""

    def __init__(self, raw: bytes) -> None:
        self.words = raw.split()
        self.literal, self.tokens, _, self.starts = streams(raw)
        self._windows: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def plain(self) -> list[bytes]:
        return list(map(_plain, self.words))

    def windows(self, literal: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of its windows, and their places in the order of hash, then place."""
        if (literal, width) not in self._windows:
            own = window_hashes(self.literal if literal else self.tokens, width)
            self._windows[literal, width] = own, np.argsort(own, kind="stable")
        return self._windows[literal, width]


def _runs(doc: Read, literal: bool, item: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start in the item, stop, shift) of the stretches of at least so many equal hashes."""
    at: dict[int, list[int]] = {}
    for k, h in enumerate(window_hashes(item, least).tolist()):
        at.setdefault(h, []).append(k)
    said, (own, order) = doc.literal if literal else doc.tokens, doc.windows(literal, least)
    wanted = np.fromiter(at, dtype=np.uint64, count=len(at))
    low, high = (np.searchsorted(own, wanted, side, sorter=order).tolist() for side in ("left", "right"))
    reached: dict[int, int] = {}
    for d in np.sort(np.concatenate([order[:0], *(order[a:b] for a, b in zip(low, high, strict=True))])).tolist():
        for k in at[int(own[d])]:
            shift = d - k
            if reached.get(shift, -1) < d:
                end = min(len(said), shift + len(item))
                differ = np.flatnonzero(said[d:end] != item[k : end - shift])
                stop = d + int(differ[0]) if len(differ) else end
                reached[shift] = stop - least
                yield k, stop - shift, shift


def aligned(doc: bytes | Read, item: bytes) -> tuple[int, int, bool]:
    """(words of the item that runs of the document cover, words of the item, whether some are covered with other values only)."""
    iw = item.split()
    n = len(iw)
    if n < SHORTEST:
        return 0, n, False
    doc, (il, it, kinds, starts) = doc if isinstance(doc, Read) else Read(doc), streams(item)
    same, covered = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for a, b, _ in _runs(doc, True, il, min(SPAN, n)):
        same[a:b] = True
    least, plain = min(SPAN, len(it)), np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    if not same.all() and plain[-1] >= LITERAL:
        dp, ip, ds = doc.plain, list(map(_plain, iw)), doc.starts
        ends, doc_ends = np.append(starts[1:], n), np.append(ds[1:], len(dp))
        value = lambda words, first, last, k: b" ".join(words[first[k] : last[k]])
        for a, b, shift in _runs(doc, False, it, least):
            item_values = [value(ip, starts, ends, k) for k in range(a, b)]
            doc_values = [value(dp, ds, doc_ends, k + shift) for k in range(a, b)]
            for p, q in _consistent(item_values, doc_values, kinds[a:b] != PLAIN):
                if q - p >= least and plain[a + q] - plain[a + p] >= LITERAL:
                    covered[starts[a + p] : ends[a + q - 1]] = True
    return int((same | covered).sum()), n, bool((covered & ~same).any())


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, matched_words, item_words, changed_slots) for each document and item that it holds at least ``SPAN`` words of."""
    docs = docs.select(integer_key(docs, key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    items = benchmark.select(integer_key(benchmark, item).alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL")
    short = _short(items)
    sought = stored(_mark_rows(items, *short).distinct().select("mark", F.col("id").alias("item")), "marks")
    met = stored(_mark_rows(docs, *short).join(sought, "mark").select("id", "item").distinct(), "met")
    said = met.join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    lists = said.groupBy("id", F.pmod(F.xxhash64("item"), F.lit(SHARES)).alias("share")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    # the ids alone choose the documents, so only those that met an item are shuffled to their lists
    pairs = docs.join(met.select("id").distinct(), "id").join(lists, "id").select("id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(i, s["item"], *aligned(doc, (s["item_text"] or "").encode())) for i, doc, own in zip(batch.column("id").to_pylist(), map(Read, utf8(batch, "text")), batch.column("items").to_pylist(), strict=True) for s in own]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "item", "matched_words", "item_words", "changed_slots"])

    found = pairs.mapInArrow(run, "id long, item long, matched_words long, item_words long, changed_slots boolean").where("matched_words > 0")
    best = found.groupBy("id", "item").agg(F.max(F.struct("matched_words", "item_words", ~F.col("changed_slots"))).alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item), "b.matched_words", "b.item_words", (~F.col("b.col3")).alias("changed_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """The documents that hold nothing of the benchmark, with all their columns; rows without a key stay."""
    return docs.join(contaminated(docs, benchmark, key, **names).select(key).distinct(), key, "left_anti").select(docs.columns)
