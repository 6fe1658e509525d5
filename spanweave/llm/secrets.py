"""Secret scans with inferred grammars (operator 8).

Three base patterns find assignments, access keys and long hexadecimal runs; their spans stay as they
are. Their values are also the labelled credentials from which formats are learned: a prefix tree of
character classes is built per kind of label and its states are merged while their continuation
frequencies are compatible (the Hoeffding test of ALERGIA), which leaves a small probabilistic
automaton. What the base spans leave of the runs of the labels' alphabet is scored by its likelihood per
character under the best automaton that accepts it, against that of ordinary tokens; what is above the
threshold becomes a span of kind ``format``. As a run may hold a key, a path or a full stop beside the
value, everything in it that begins at its start or after a symbol and ends at its end or before one is
scored, from the labels' least length on and without a longest: a walk ends where no format has a step, and
walks in the same states go on as one. Of overlapping ones the longest stays.

Training reads a bounded sample: the ``MAX_LABELLED`` values of each kind, and as many ordinary
tokens, that come first by hash; ordinary is what base spans leave of the same runs, digits and symbols
included, one a document (that with the least hash) entering the choice, but not what a format accepts
unless it is all letters. Everything else covers whole
texts of all rows.

Defined results: a null text is an empty one and has no spans; spans are half-open in code points; an
added span that overlaps a base span is dropped, base spans never are; without labelled credentials
nothing is added; repeated rows each return their row; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint, map_texts

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_ASSIGN},}}")
SYMBOL = re.compile("[+/_.=-]")
MAX_LABELLED, MERGE_ERROR, THRESHOLD = 2000, 0.05, 0.5
#: Log likelihood of a step that ordinary tokens never took.
UNSEEN = math.log(1e-4)
SPANS = "array<struct<kind:int,start:int,stop:int,value:string>>"
END = "$"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, secret) of the three base patterns, leftmost and non-overlapping per kind."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return sorted(found + [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)], key=lambda s: (s[1], s[0]))


def free_runs(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """What base spans leave of the runs of the labels' alphabet, where it is as long as a label."""
    found, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        at = max(m.start(), reach)
        while k < len(taken) and taken[k][1] < m.end():
            if taken[k][1] - at >= MIN_ASSIGN:
                found.append((at, taken[k][1]))
            reach = max(reach, taken[k][2])
            at = max(at, reach)
            k += 1
        if m.end() - at >= MIN_ASSIGN:
            found.append((at, m.end()))
    return found


def credentials(text: str, taken: list[tuple[int, int, int, str]], formats: Formats, threshold: float) -> list[tuple[int, int, int, str]]:
    """Spans beside those of the base patterns that read like a learned format."""
    if not formats.formats or not formats.may.search(text):
        return []
    chosen: list[tuple[int, int]] = []
    for a, b in free_runs(text, taken):
        if formats.may.search(text, a, b):
            chosen += [(a + x, a + y) for x, y in formats.above(text[a:b], threshold)]
    return [(3, a, b, text[a:b]) for a, b in chosen]


def classes(value: str) -> str:
    """Character classes: digits and lower-case hex letters x, other lower case l, upper case u; symbols are themselves."""
    return "".join("x" if c.isdigit() or c in "abcdef" else "l" if c.islower() else "u" if c.isupper() else c for c in value)


class Automaton:
    """A probabilistic automaton: per state the counts and targets of each class, ends under END."""

    def __init__(self, values: list[str], error: float = MERGE_ERROR):
        self.count: list[Counter] = [Counter()]
        self.next: list[dict[str, int]] = [{}]
        for v in values:
            at = 0
            for c in classes(v):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][c]
            self.count[at][END] += 1
        self.slack = math.sqrt(0.5 * math.log(2 / error))
        self.same = list(range(len(self.next)))
        self._merge()

    def _state(self, s: int) -> int:
        while self.same[s] != s:
            self.same[s] = self.same[self.same[s]]
            s = self.same[s]
        return s

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = map(self._state, todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            x, y = self.count[a], self.count[b]
            m, n = sum(x.values()), sum(y.values())
            if m and n:
                most = self.slack * (m**-0.5 + n**-0.5)
                if any(abs(x[c] / m - y[c] / n) > most for c in x.keys() | y.keys()):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _join(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self._state, todo.pop())
            if a == b:
                continue
            self.same[b] = a
            self.count[a] += self.count[b]
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        """Red states are final; each blue one, breadth first, joins the first compatible red or turns red."""
        red, blue = [0], deque(self.next[0].values())
        while blue:
            b = self._state(blue.popleft())
            if b in {self._state(r) for r in red}:
                continue
            into = next((r for r in red if self._state(r) == r and self._compatible(r, b)), None)
            if into is None:
                red.append(b)
            else:
                self._join(into, b)
            known = {self._state(r) for r in red}
            blue = deque(sorted({t for r in known for t in map(self._state, self.next[r].values())} - known))
        self.same = [self._state(s) for s in range(len(self.same))]
        self.steps = [{c: math.log(n / counts.total()) for c, n in counts.items() if n} for counts in self.count]

    def states(self) -> int:
        return len({0} | {self.same[t] for s in set(self.same) for t in self.next[s].values()})

    def log_likelihoods(self, seen: str, lengths: list[int], floor: float = -math.inf) -> list[float]:
        """Natural log per symbol, the end included, of the beginnings of classes; a step that was never seen costs ``floor``."""
        at, total, done, out = 0, 0.0, 0, []
        for n in lengths:
            for c in seen[done:n]:
                steps = self.steps[at] if at is not None else {}
                total += steps.get(c, floor)
                if total == -math.inf:
                    return out + [total] * (len(lengths) - len(out))
                at = self.same[self.next[at][c]] if c in steps else None
            done = n
            out.append((total + (self.steps[at] if at is not None else {}).get(END, floor)) / (n + 1))
        return out

    def log_likelihood(self, value: str, floor: float = -math.inf) -> float:
        return self.log_likelihoods(classes(value), [len(value)], floor)[0]


class Formats:
    """Learned formats by kind of label, and that of ordinary tokens."""

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str]):
        self.formats = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        # what reads like a credential may be one without its key, so it is no ordinary token; words of letters always are
        self.ordinary = Automaton([v for v in ordinary if v.isalpha() or not self.accepts(v)])
        known = {c for f in self.formats.values() for steps in f.steps for c in steps}
        # no format accepts a value with other symbols, so text without such a run needs no scoring
        self.may = re.compile("[" + re.escape("".join(c for c in ALPHABET if classes(c) in known) or "-") + f"]{{{MIN_ASSIGN},}}")

    def accepts(self, value: str) -> bool:
        """Whether some format has a path for the value."""
        seen = classes(value)
        return any(f.log_likelihoods(seen, [len(value)])[0] > -math.inf for f in self.formats.values())

    def scores(self, value: str, lengths: list[int]) -> list[float]:
        """Of the beginnings of ``value``: best log likelihood per symbol under a credential format, over that of ordinary tokens; minus infinity if no format accepts it."""
        seen = classes(value)
        best = [max(x) for x in zip(*(f.log_likelihoods(seen, lengths) for f in self.formats.values()), strict=True)] or [-math.inf] * len(lengths)
        if max(best) == -math.inf:
            return best
        return [b - o if b > -math.inf else b for b, o in zip(best, self.ordinary.log_likelihoods(seen, lengths, UNSEEN), strict=True)]

    def score(self, value: str) -> float:
        return self.scores(value, [len(value)])[0]

    def above(self, run: str, threshold: float) -> list[tuple[int, int]]:
        """Of all that begins at the start of ``run`` or after a symbol, ends at its end or before one and scores above the threshold: the longest, then the longest beside it, and so on."""
        symbols = [m.start() for m in SYMBOL.finditer(run)]
        starts, ends, seen = [0, *(x + 1 for x in symbols)], [*symbols, len(run)], classes(run)
        walks = [w for f in self.formats.values() for w in _walks(f, self.ordinary, seen, starts, set(ends), threshold)]
        heap = [(-n, w.start, k) for k, w in enumerate(walks) if (n := w.longest(len(run)))]
        heapify(heap)
        chosen: list[tuple[int, int]] = []
        while heap:
            n, start, k = heappop(heap)
            at = bisect_right(chosen, (start, len(run)))
            if at and chosen[at - 1][1] > start:
                continue
            limit = chosen[at][0] if at < len(chosen) else len(run)
            if start - n <= limit:
                chosen.insert(at, (start, start - n))
            elif n := walks[k].longest(limit):
                heappush(heap, (-n, start, k))
        return chosen


class _Track:
    """What walks that are in the same states share from where they met: the ends passed and the gain at each."""

    def __init__(self, gain: float):
        self.gain, self.ends, self.gains = gain, [], []
        self.into: tuple[_Track, float, int] | None = None

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(self.ends, list):
            self.ends, self.gains = np.array(self.ends, np.int64), np.array(self.gains, np.float64)
        return self.ends, self.gains


class _Walk:
    """The values that begin at ``start``; on ``track`` their gain is the track's plus ``more``."""

    def __init__(self, start: int, track: _Track, more: float):
        self.start, self.track, self.more = start, track, more

    def longest(self, limit: int) -> int:
        """Length of the longest value with a gain that ends at ``limit`` or before; 0 if there is none of the least length."""
        parts, track, more, since = [], self.track, self.more, self.start + MIN_ASSIGN
        while True:
            parts.append((track, more, since))
            if track.into is None:
                break
            track, added, met = track.into
            more, since = more + added, max(since, met)
        for track, more, since in reversed(parts):
            ends, gains = track.arrays()
            low, high = np.searchsorted(ends, since), np.searchsorted(ends, limit, "right")
            hit = np.flatnonzero(gains[low:high] > -more)
            if len(hit):
                return int(ends[low + hit[-1]]) - self.start
        return 0


def _walks(form: Automaton, ordinary: Automaton, seen: str, starts: list[int], ends: set[int], threshold: float) -> list[_Walk]:
    """Walks through both automata from every start, all at once. A walk ends where the format has no step. Walks that come
    into the same two states go on as one, so a run of any length takes a step a character and pair of states."""
    live: dict[tuple[int, int | None], _Track] = {}
    walks, begins = [], set(starts)
    for at in range(len(seen) + 1):
        if at in ends:
            for (f, o), track in live.items():
                stop = form.steps[f].get(END)
                if stop is not None:
                    track.ends.append(at)
                    track.gains.append(track.gain + stop - (UNSEEN if o is None else ordinary.steps[o].get(END, UNSEEN)) - threshold)
        if at == len(seen):
            break
        if at in begins:
            track = live.setdefault((0, 0), _Track(0.0))
            walks.append(_Walk(at, track, -track.gain))
        c, onward = seen[at], {}
        for (f, o), track in live.items():
            step = form.steps[f].get(c)
            if step is None:
                continue
            plain = None if o is None else ordinary.steps[o].get(c)
            track.gain += step - (UNSEEN if plain is None else plain) - threshold
            state = form.same[form.next[f][c]], None if plain is None else ordinary.same[ordinary.next[o][c]]
            first = onward.setdefault(state, track)
            if first is not track:
                track.into = first, track.gain - first.gain, at + 1
        live = onward
    return walks


def spans_of(docs: DataFrame, id_col: str, text_col: str, find: Callable[[str], list[tuple[int, int, int, str]]]) -> DataFrame:
    """doc_id and the spans that ``find`` has of every row."""

    def batch(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "spans": [[dict(zip(("kind", "start", "stop", "value"), s, strict=True)) for s in find(text or "")] for text in texts]}

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col)), batch, f"doc_id long, spans {SPANS}")


def plainest(text: str, taken: list[tuple[int, int, int, str]]) -> str | None:
    """Of what base spans leave of the runs of the labels' alphabet, the one with the least hash."""
    return min((text[a:b] for a, b in free_runs(text, taken)), key=lambda v: (xxh64_intdigest(v), v), default=None)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base spans of every row, and an ordinary token of it (null: none)."""

    def batch(ids: list, texts: list) -> dict:
        base = [base_spans(text or "") for text in texts]
        spans = [[dict(zip(("kind", "start", "stop", "value"), s, strict=True)) for s in found] for found in base]
        return {"doc_id": ids, "spans": spans, "plain": [plainest(text or "", found) for text, found in zip(texts, base, strict=True)]}

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col)), batch, f"doc_id long, spans {SPANS}, plain string")


def first_by_hash(values: DataFrame, most: int) -> list[str]:
    """At most ``most`` distinct values of column value."""
    return [r.value for r in values.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(most).collect()]


def learn(scanned: DataFrame, most: int = MAX_LABELLED) -> Formats:
    """Fit the automata on at most ``most`` distinct values a kind and ``most`` ordinary tokens."""
    values = scanned.select(F.explode("spans").alias("s")).where("s.kind < 3").select("s.kind", F.col("s.value").alias("value"))
    labelled = {k: first_by_hash(values.where(F.col("kind") == k), most) for k in range(3)}
    if not any(labelled.values()):
        return Formats({}, [])
    return Formats(labelled, first_by_hash(scanned.where("plain is not null").select(F.col("plain").alias("value")), most))


def all_spans(text: str, formats: Formats, threshold: float = THRESHOLD) -> list[tuple[int, int, int, str]]:
    """Base spans and what else reads like a learned format."""
    base = base_spans(text)
    return sorted(base + credentials(text, base, formats, threshold), key=lambda s: (s[1], s[0]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (kind as an index of KINDS, start, stop, value), one row per row of ``docs``."""
    formats = learn(checkpoint(scan(docs, id_col, text_col)))
    return spans_of(docs, id_col, text_col, lambda text: all_spans(text, formats, threshold))


def spelled(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in spans)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text."""

    def batch(ids: list, spans: list) -> dict:
        base = [[s for s in found if s["kind"] < 3] for found in spans]
        counts = {f"n_{kind}": [sum(s["kind"] == k for s in b) for b in base] for k, kind in enumerate(KINDS[:3])}
        return {"doc_id": ids, **counts, "base_sha256": [hashlib.sha256(spelled(b).encode()).hexdigest() for b in base], "spans": [spelled(s) for s in spans]}

    return map_texts(found.select("doc_id", "spans"), batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, formats: Formats, text_col: str = "text", threshold: float = THRESHOLD, mark: Callable[[str], str] = lambda kind: f"[{kind}]") -> DataFrame:
    """``docs`` with each secret replaced by its kind; the words around it, of an assignment also its key, stay."""
    names = docs.columns
    at = names.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for kind, _, stop, value in all_spans(text, formats, threshold):
            start = max(done, stop - len(value))
            if start < stop:
                out += [text[done:start], mark(KINDS[kind])]
                done = stop
        return "".join([*out, text[done:]])

    def batch(*columns: list) -> dict:
        return dict(zip(names, [*columns[:at], [clean(t) for t in columns[at]], *columns[at + 1 :]], strict=True))

    return map_texts(docs, batch, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
