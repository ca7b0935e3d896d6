"""PII: base patterns, and boosted trees over high-recall candidates that add to them.

Base spans (email, ip, card, phone) come from fixed expressions and always stay. Beyond them, generators propose spans
that may overlap: runs of letters, digits and a few signs as secrets, and whatever stands after a cue such as ``password:``,
both of any length; groups of digits as phones; addresses spelled out with "at" and "dot". Features of their format (lengths,
shares of signs, changes between them, entropy, groups) and context (cues before them, quotes, an equals sign) go through
gradient-boosted trees, grown in numpy; a threshold for each kind is the least one that is ``PRECISION`` precise on rows that
the trees were not grown on. Accepted candidates that meet no base span and no better candidate are added.

The trees are fitted on candidates of the documents themselves, and on seeded templates for what documents lack. One view
of a candidate labels it for the other: base spans say what an email or a phone is and that other kinds are not; a cue before
a candidate says what it is (``token =``) or isn't (``commit``, ``isbn``). Each such candidate is also shown without its
cues, so that its format has to decide; candidates that nothing labels aren't used. ``fit`` reads at most ``SAMPLE``
candidates of about ``SAMPLE_DOCS`` documents, the least by a hash of their text, and this is the one bounded sample here.

Spans are in code points, ends exclusive. Null texts count as empty. Rows are independent: keys may be null or repeat.
``find`` reads key and text only; ``redact`` keeps all columns. Empty tables give empty results.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import chunks

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin within a run of digits, as one at the run's begin would have held it
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Each @ with the name to its left, which no earlier match holds, and the domain to its right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled and its own digits added, ends in 0."""
    return sum(n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9) for k, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind, then start."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{14,}+")
_LED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|(?:api|access|private)[_ -]?key|credential)s?[\"']? ?[=:]+ ?[\"']?([^\s\"',;]{4,}+)", re.IGNORECASE)
_DIALLED = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){0,3}(?![0-9A-Za-z-])")
_AT = re.compile(r"\(at\)|\[at\]|\bat\b")
_HOST = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z]{2,}+|\.[A-Za-z]{2,}+)+")
_SECRET_CUE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)[\"']? ?[=:]? ?[\"']?$", re.IGNORECASE)
_PHONE_CUE = re.compile(r"(?:tel|phone|call|mobile|cell|fax|telefon|whatsapp|contact)\.?:? ?(?:\w+ )?$", re.IGNORECASE)
_MAIL_CUE = re.compile(r"(?:mail|contact|write|reach|email)\S{0,3} (?:\w+ )?$", re.IGNORECASE)
_OTHER_CUE = re.compile(r"(?:commit|sha-?1?|sha-?256|md5|hash|checksum|isbn|issn|order|invoice|version|ref|no|nr|id|item|page|pages|date|from|between|digest|revision|build|part|model)[.:#]? ?$", re.IGNORECASE)
_PREFIX = re.compile(r"AKIA[A-Z0-9]{16}$|sk-|ghp_|xox[abp]-|AIza")
_HEX = re.compile(r"[0-9a-fA-F]+$")
FEATURES = 18
#: The places of features that tell of cues.
CUES = slice(10, 14)


def _spelled(text: str) -> Iterator[Span]:
    """Each "at" with the name to its left, which no earlier match holds, and a host to its right."""
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        end = start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if end - start >= 2 and (host := _HOST.match(text, m.end())):
            done = host.end()
            yield "email", start, done


def candidates(text: str) -> list[Span]:
    """What the generators propose, in no order; no span twice."""
    found = {("secret", *m.span()) for m in _SECRET.finditer(text)} | {("secret", *m.span(1)) for m in _LED.finditer(text)}
    if _DIGIT.search(text):
        found |= {("phone", *m.span()) for m in _DIALLED.finditer(text)}
    return sorted(found | set(_spelled(text)))


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 28) : start], text[end : end + 1]
    n = len(s)
    digits, upper, lower = sum(map(str.isdigit, s)), sum(map(str.isupper, s)), sum(map(str.islower, s))
    group = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    runs = [len(x) for x in re.findall(r"[0-9]+", s)] or [0]
    cues = (_SECRET_CUE, _PHONE_CUE, _MAIL_CUE, _OTHER_CUE)
    return [
        KINDS.index(kind), n, digits, digits / n, upper / n, lower / n, sum(a != b for a, b in zip(group, group[1:], strict=False)) / n, entropy, len(runs), max(runs),
        *(float(bool(c.search(before))) for c in cues), float(bool(_PREFIX.match(s))), float(bool(_HEX.match(s))), float(before[-1:] in "\"'=" and bool(before)), float("(at)" in s or "[at]" in s or " dot " in s),
    ]


# Templated rows: text, the span that is meant, and whether it is personal or secret.

_FILL = "the of and was here with some other people going near water house green again morning paper river often little".split()


def _row(rng: random.Random) -> tuple[str, Span, int]:
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    num, hexa, caps, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda n: " ".join(rng.choice(_FILL) for _ in range(n))
    cue = rng.choice(["password=", "token = \"", "api_key: ", "secret=", "auth: ", "access key ", "passwd: "])
    plain = rng.choice(["commit ", "sha1 ", "md5 ", "checksum: ", "hash ", "build ", "revision ", "digest "])
    phone = rng.choice([f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", f"0{pick(num, 2)} {pick(num, 4)} {pick(num, 4)}"])
    spelled = f"{rng.choice(_FILL)}.{pick(num, 2)} {rng.choice(['(at)', '[at]', 'at'])} {rng.choice(_FILL)} {rng.choice(['(dot)', '[dot]', 'dot'])} com"
    kind, lead, body, good = rng.choice(
        [
            ("secret", cue, pick(hexa, rng.choice([18, 24, 32, 40])), 1), ("secret", "", "AKIA" + pick(caps, 16), 1), ("secret", cue, pick(mixed, rng.randint(16, 44)), 1), ("secret", "", rng.choice(["sk-", "ghp_"]) + pick(mixed, 30), 1),
            ("secret", plain, pick(hexa, rng.choice([32, 40, 64])), 0), ("secret", "", pick(num, rng.randint(14, 22)), 0), ("secret", "", "-".join(rng.choice(_FILL) for _ in range(3)) + pick(num, 2), 0), ("secret", "", f"{rng.choice(_FILL)}{rng.choice(_FILL)}{rng.choice(_FILL)}{pick(num, 1)}", 0), ("secret", "model ", f"{pick(caps, 4)}-{pick(num, 6)}-{pick(caps, 4)}", 0), ("secret", "", pick(hexa, rng.choice([18, 32, 40])), 0),
            ("phone", rng.choice(["tel: ", "call ", "phone ", "mobile: ", "fax "]), phone, 1), ("phone", rng.choice(["isbn ", "order ", "ref: ", "invoice "]), f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", 0), ("phone", "", f"{pick(num, 4)} {pick(num, 3)} {pick(num, 3)}", 0), ("phone", "from ", f"19{pick(num, 2)}-20{pick(num, 2)}", 0), ("phone", "", phone, 0), ("phone", rng.choice(["date ", "", "page "]), f"20{pick(num, 2)} 120 300", 0),
            ("email", rng.choice(["mail ", "contact ", ""]), spelled, 1), ("email", "", f"{rng.choice(_FILL)} at {rng.choice(_FILL)}. {rng.choice(_FILL).title()}", 0), ("email", "", f"{rng.choice(_FILL)} at {rng.choice(_FILL)} dot {rng.choice(_FILL)}", 0),
        ]
    )
    text = f"{words(rng.randint(0, 9))} {lead}{body}"
    start = len(text) - len(body)
    if lead.endswith('"'):
        text += '"'
    return f"{text} {words(4)}", (kind, start, start + len(body)), good


@dataclass
class Trees:
    """Gradient-boosted trees of two levels: each is (feature, bound) at the root and on both sides, and four values."""

    bias: float
    splits: np.ndarray
    bounds: np.ndarray
    values: np.ndarray
    least: dict[str, float]

    def odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for split, bound, value in zip(self.splits, self.bounds, self.values, strict=True):
            side = (x[:, split[0]] > bound[0]).astype(int)
            leaf = 2 * side + (x[rows, split[1 + side]] > bound[1 + side])
            total += value[leaf]
        return total


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The split with the largest gain: all bounds between values, one feature at a time."""
    best, where = -1.0, (0, np.inf)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, a, b = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = a[cut] ** 2 / (b[cut] + 1) + (a[-1] - a[cut]) ** 2 / (b[-1] - b[cut] + 1)
            k = int(gain.argmax())
            if gain[k] > best + 1e-12:
                best, where = float(gain[k]), (f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    return where


PRECISION, TREES, SHRINK, ROWS = 0.99, 60, 0.3, 3000
SAMPLE, SAMPLE_DOCS = 20_000, 8_000


def weak_label(text: str, span: Span, x: list[float], base: list[Span]) -> int | None:
    """1 or 0 where a base span or a cue tells what a candidate is, else None."""
    kind, start, end = span
    met = {k for k, s, e in base if s < end and start < e}
    if met:
        return int(kind in met)
    secret, phone, mail, other = (bool(v) for v in x[CUES])
    own = {"secret": secret, "phone": phone, "email": mail and bool(x[17])}[kind]
    return None if own == other else int(own)


def labelled(text: str) -> list[tuple[list[float], int]]:
    """(features, label) of the labelled candidates of a text, each also without its cues."""
    base, out = base_spans(text), []
    for span in candidates(text):
        x = features(text, span)
        if (label := weak_label(text, span, x, base)) is not None:
            bare = [*x]
            bare[CUES] = [0.0] * 4
            out += [(x, label)] if bare == x else [(x, label), (bare, label)]
    return out


def _grown(x: np.ndarray, y: np.ndarray, held: np.ndarray, held_y: np.ndarray) -> Trees:
    """Trees from (x, y), and the thresholds that the held-out rows give."""
    odds = np.full(len(y), bias := math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    splits, bounds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        root = _best(x, g, h)
        side = x[:, root[0]] > root[1]
        pair = [_best(x[m], g[m], h[m]) if m.any() else (0, np.inf) for m in (~side, side)]
        inner = np.where(side, x[:, pair[1][0]] > pair[1][1], x[:, pair[0][0]] > pair[0][1])
        leaf = 2 * side + inner
        value = SHRINK * np.bincount(leaf, g, 4) / (np.bincount(leaf, h, 4) + 1)
        odds += value[leaf]
        splits.append([root[0], pair[0][0], pair[1][0]])
        bounds.append([root[1], pair[0][1], pair[1][1]])
        values.append(value)
    made = Trees(bias, np.array(splits), np.array(bounds), np.array(values), {})
    scores = made.odds(held)
    for k, kind in enumerate(KINDS):
        own = np.flatnonzero(held[:, 0] == k)
        if len(own):
            order = own[np.argsort(-scores[own], kind="stable")]
            precise = np.cumsum(held_y[order]) / np.arange(1, len(order) + 1) >= PRECISION
            made.least[kind] = max(0.0, float(scores[order[np.flatnonzero(precise)[-1]]])) if precise.any() else np.inf
    return made


@lru_cache(maxsize=1)
def _templated(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    rows = [_row(rng) for _ in range(2 * ROWS)]
    return np.array([features(t, s) for t, s, _ in rows]), np.array([g for *_, g in rows], dtype=float)


def trained(x: np.ndarray | None = None, y: np.ndarray | None = None) -> Trees:
    """Trees from half of the labelled rows (features, 0 or 1) and of the templated ones, thresholds from the other halves."""
    tx, ty = _templated()
    x, y = (np.zeros((0, FEATURES)), np.zeros(0)) if x is None else (x, y)
    half = len(y) // 2  # rows are in the order of their texts' hashes, so the halves are of different texts
    return _grown(np.concatenate([tx[:ROWS], x[:half]]), np.concatenate([ty[:ROWS], y[:half]]), np.concatenate([tx[ROWS:], x[half:]]), np.concatenate([ty[ROWS:], y[half:]]))


def sampled(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates of a bounded sample of the documents, in an order that a hash gives."""
    known = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # the share is one of distinct texts, so copies take no place of others; twice as many as wanted outweigh the estimate's error
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, known.agg(F.approx_count_distinct("h")).first()[0]))
    few = known.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # hashes alone choose, so no task gathers the texts
    last = few.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(h, x, y) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x, y in labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())], names=["h", "x", "y"])

    # one text for each hash, so that copies weigh as one; the rows of one text stay together
    rows = few.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")).mapInArrow(run, "h long, x array<double>, y long").orderBy("h", "x", "y").limit(SAMPLE).collect()
    return np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.y for r in rows], dtype=float)


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Trees for these documents."""
    return trained(*sampled(docs, text))


def all_spans(text: str, trees: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by kind, then start."""
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, []
    taken: list[tuple[int, int]] = []  # disjoint and in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            s, e = taken[-1][0], max(e, taken.pop()[1])
        taken.append((s, e))
    odds = trees.odds(np.array([features(text, c) for c in proposed]))
    added: list[Span] = []
    for k in np.argsort(-odds, kind="stable").tolist():
        kind, start, end = proposed[k]
        if odds[k] < trees.least.get(kind, np.inf):
            continue
        at = bisect_left(taken, (start, start))
        if (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start):
            added.append(proposed[k])
            taken.insert(at, (start, end))
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", trees: Trees | None = None) -> DataFrame:
    """(key, base, added): spans (kind, start, end), each list by kind, then start. Without trees, they are fitted first."""
    trees, kind = trees or fit(docs, text), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [all_spans(x, trees) for x in batch.column(1).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found], pa.list_(_SPAN)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "base", "added"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return docs.fillna("", [text]).select(key, text).mapInArrow(run, f"`{key}` {kind}, base {spans}, added {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of touching spans replaced by the kind of its first one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """The documents with personal data and secrets replaced in their text; null texts stay null."""
    trees, at = trees or fit(docs, text), docs.columns.index(text)
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = [None if x is None else redacted(x, sum(all_spans(x, trees), [])) for x in batch.column(at).to_pylist()]
            columns = [pa.array(made, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
