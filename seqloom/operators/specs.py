"""Specifications: what a sequence should be like, as a score and the places that break it.

Each has two forms of one definition. `score` and `locations` are Column expressions over a column of sequences, so that
any number of specifications is evaluated in one projection, without a shuffle. `measure` scores one Python string, for the
search in `solver`. A score of 0 or more passes; `best` is the highest one.

For the search, `localized` gives a specification on less, or with what lies outside counted once: over changes within
an interval, its score differs from the whole one's by a constant.

Limits of whole locations follow the usual rules of such checks where they aren't obvious: the k-mer and hairpin scans stop
one start before the last possible one.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dna, kernels, parsing
from ..functions.dna import GENETIC_CODE, IUPAC, revcomp, synonyms
from .intervals import extended, grouped_spans, location, no_locations
from .patterns import Pattern, Pssm, pattern

Place = tuple[int, int, int]
#: An interval and what may stand there.
Choice = tuple[int, int, tuple[str, ...]]


def runs(positions: list[int], gap: int, spread: int | None = None) -> list[list[int]]:
    """As intervals.grouped, of a Python list."""
    out: list[list[int]] = []
    for p in positions:
        if out and p - out[-1][-1] < gap and (spread is None or p - out[-1][0] < spread):
            out[-1].append(p)
        else:
            out.append([p])
    return out


@dataclass(frozen=True)
class Spec:
    place: Place | None = field(default=None, kw_only=True)
    boost: float = field(default=1.0, kw_only=True)

    #: An objective that others' changes mustn't lower, but that isn't worked at.
    passive: bool = field(default=False, kw_only=True)

    best = 0.0
    priority = 0
    #: How far from a change the score can change; None where that isn't bounded.
    reach = None

    # the region that is looked at
    def region(self, q: Column) -> Column:
        return q if self.place is None else dna.part(q, *self.place)

    def text(self, s: str) -> str:
        if self.place is None:
            return s
        start, end, strand = self.place
        return revcomp(s[start:end]) if strand == -1 else s[start:end]

    def span(self, s: str) -> tuple[int, int]:
        return (0, len(s)) if self.place is None else self.place[:2]

    def span_column(self, q: Column) -> tuple:
        return (0, F.length(q)) if self.place is None else self.place[:2]

    @property
    def offset(self) -> int:
        return self.place[0] if self.place else 0

    def upright(self, places: list[Place], s: str) -> list[Place]:
        """Places in the region's text as places in the sequence."""
        if self.place and self.place[2] == -1:
            return [(self.place[1] - e, self.place[1] - b, -t if t else -1) for b, e, t in places]
        return [(b + self.offset, e + self.offset, t) for b, e, t in places]

    def upright_column(self, places: Column) -> Column:
        if self.place and self.place[2] == -1:
            return F.transform(places, lambda x: location(self.place[1] - x["end"], self.place[1] - x["start"], -1))
        return F.transform(places, lambda x: location(x["start"] + self.offset, x["end"] + self.offset, x["strand"]))

    # the interface
    def score(self, q: Column) -> Column:
        raise NotImplementedError

    def locations(self, q: Column) -> Column:
        return no_locations()

    def measure(self, s: str) -> tuple[float, list[Place] | None]:
        raise NotImplementedError

    def passes(self, q: Column) -> Column:
        return self.score(q) >= 0

    def restrict(self, s: str) -> list[Choice]:
        """What the specification leaves to choose, where that says all of it."""
        return []

    def enforced(self) -> bool:
        """Whether restrict() makes it pass."""
        return False

    def bound(self, s: str) -> Spec:
        """The specification with what it takes from the first sequence."""
        return self

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        """The specification for a change of s within [start, end): itself, on less, or None where the change doesn't matter."""
        low, high = self.place[:2] if self.place else (0, 1 << 60)
        if self.reach is None:
            return self if low < end and start < high else None
        a, b = max(low, start - self.reach), min(high, end + self.reach)
        return replace(self, place=(a, b, self.place[2] if self.place else 0)) if a < b else None

    def shifted(self, by: int) -> Spec:
        return self if self.place is None else replace(self, place=(self.place[0] + by, self.place[1] + by, self.place[2]))

    def as_passive(self) -> Spec:
        return replace(self, passive=True)

    # hooks of the search: whether they did the work
    def resolve_in(self, problem) -> bool:
        return False

    def optimize_in(self, problem) -> bool:
        return False

    @property
    def kind(self) -> str:
        return type(self).__name__

    def parameters(self) -> str:
        return ""

    def short_label(self) -> str:
        """A few words, for features and columns."""
        return f"{self.kind} {p}" if (p := self.parameters()) else self.kind

    def breach_label(self) -> str:
        """What a breach is."""
        return self.short_label()

    def label(self) -> str:
        where = "" if self.place is None else "[{}-{}{}]".format(*self.place[:2], {1: "(+)", -1: "(-)"}.get(self.place[2], ""))
        return f"{self.kind}{where}" + (f"({p})" if (p := self.parameters()) else "")


@dataclass(frozen=True)
class AvoidPattern(Spec):
    pattern: str | Pattern | Pssm
    strand: int | None = None
    best = 0.0
    priority = 1

    @property
    def p(self) -> Pattern | Pssm:
        return pattern(self.pattern)

    @property
    def reach(self):
        return self.p.size - 1 if self.p.size else None

    @property
    def on(self) -> int:
        """The strand: that given, or the location's; 0 for both."""
        return self.strand if self.strand is not None else self.place[2] if self.place else 0

    def whole(self, q: Column) -> Column:
        return q if self.place is None else dna.part(q, self.place[0], self.place[1])

    def count(self, q: Column) -> Column:
        return self.p.count(self.whole(q), self.on)

    def score(self, q: Column) -> Column:
        return (-self.count(q)).cast("double")

    def locations(self, q: Column) -> Column:
        return self.p.locations(self.whole(q), self.on, self.offset)

    def found(self, s: str) -> list[Place]:
        start, end = self.span(s)
        return [(a + start, b + start, t) for a, b, t in self.p.find(s[start:end], self.on)]

    def measure(self, s: str):
        found = self.found(s)
        return float(-len(found)), found

    def parameters(self) -> str:
        return self.p.name

    def short_label(self) -> str:
        return f"No {self.p.name}"

    def breach_label(self) -> str:
        return self.p.name


@dataclass(frozen=True)
class EnforcePatternOccurence(AvoidPattern):
    occurences: int = 1
    centre: bool = True
    priority = -1
    reach = None

    def score(self, q: Column) -> Column:
        return (-F.abs(self.count(q) - self.occurences)).cast("double")

    def locations(self, q: Column) -> Column:
        return F.array(location(*self.span_column(q), self.on))

    def measure(self, s: str):
        return float(-abs(len(self.found(s)) - self.occurences)), [(*self.span(s), self.on)]

    def insertions(self, s: str) -> list[str]:
        """The sequence with the pattern put at each place, from the centre out, then on the other strand."""
        start, end = self.span(s)
        words = [self.pattern if isinstance(self.pattern, str) and set(self.pattern) <= set("ACGT") else None]
        if words[0] is None and isinstance(self.p, Pattern) and self.p.size:
            name = self.p.name
            words = [dna_word(name)] if dna_word(name) else []
        n = len(words[0]) if words and words[0] else 0
        if not n:
            return []
        middle = (start + end - n) / 2
        order = sorted(range(start, end - n + 1), key=lambda i: (abs(i - middle), i) if self.centre else i)
        strands = [revcomp(words[0])] if self.on == -1 else [words[0]] if self.on == 1 else [words[0], revcomp(words[0])]
        return [s[:i] + w + s[i + n :] for w in strands for i in order]

    def resolve_in(self, problem) -> bool:
        """Puts the pattern where the others allow it, until there are enough."""
        while len(self.found(problem.sequence)) < self.occurences:
            now, held = self.measure(problem.sequence)[0], [c for c in problem.constraints if c.measure(problem.sequence)[0] >= 0]
            for s in self.insertions(problem.sequence):
                if self.measure(s)[0] > now and problem.allowed(s) and all(c.measure(s)[0] >= 0 for c in held):
                    problem.sequence = s
                    break
            else:
                return False
        return self.measure(problem.sequence)[0] >= 0

    def short_label(self) -> str:
        return f"{self.occurences} {self.p.name}"


def dna_word(name: str) -> str | None:
    """A plain word that the named pattern matches."""
    from .patterns import enzyme_table

    word = enzyme_table().get(name.removesuffix("_site"), name)
    return "".join(IUPAC[x][0] for x in word) if set(word) <= set(IUPAC) else None


@dataclass(frozen=True)
class EnforceGCContent(Spec):
    mini: float = 0.0
    maxi: float = 1.0
    target: float | None = None
    window: int | None = None

    @classmethod
    def parsed(cls, text: str, **more) -> EnforceGCContent:
        p = parsing.gc_parameters(text)
        return cls(p["mini"] if p["mini"] is not None else 0.0, p["maxi"] if p["maxi"] is not None else 1.0, p["target"], p["window"], **more)

    @property
    def limits(self) -> tuple[float, float]:
        return (self.mini, self.maxi) if self.target is None else (self.target, self.target)

    @property
    def reach(self):
        return self.window - 1 if self.window else None

    def _breach(self, gc: Column) -> Column:
        low, high = self.limits
        return F.greatest(F.lit(0.0), low - gc) + F.greatest(F.lit(0.0), gc - high)

    def score(self, q: Column) -> Column:
        r = self.region(q)
        if self.window is None:
            return -self._breach(dna.gc_fraction(r))
        return kernels.gc_window_score(r, self.window, *self.limits)

    def locations(self, q: Column) -> Column:
        r = self.region(q)
        if self.window is None:
            return F.when(self.score(q) < 0, F.array(location(self.offset, self.offset + F.length(r)))).otherwise(no_locations())
        return self.upright_column(kernels.gc_window_places(r, self.window, *self.limits))

    def measure(self, s: str):
        t, (low, high) = self.text(s), self.limits
        bad = lambda gc: max(0.0, low - gc) + max(0.0, gc - high)
        if self.window is None:
            score = -bad(sum(c in "GC" for c in t) / len(t)) if t else 0.0
            return score, [(*self.span(s), 0)] if score < 0 else []
        w, n, total, at = self.window, 0, 0.0, []
        for i, c in enumerate(t):
            n += (c in "GC") - (t[i - w] in "GC" if i >= w else 0)
            if i >= w - 1 and (b := bad(n / w)) > 0:
                total += b
                at.append(i - w + 1)
        return -total, self.upright([(g[0], g[-1] + w, 0) for g in runs(at, 1 << 30, 50)], s)

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        low, high = self.span(s) if s is not None else (0, 0)
        if self.window is not None or s is None or low >= end or start >= high:
            return super().localized(start, end, s)
        a, b = max(low, start), min(high, end)
        outside = sum(c in "GC" for c in s[low:a]) + sum(c in "GC" for c in s[b:high])
        return PartOfGCContent(*self.limits, outside, high - low, place=(a, b, 0), boost=self.boost)

    def parameters(self) -> str:
        low, high = self.limits
        return f"mini:{low:g}, maxi:{high:g}" + (f", window:{self.window}" if self.window else "")

    def short_label(self) -> str:
        low, high = self.limits
        return (f"{100 * low:g}% GC" if low == high else f"{100 * low:g}-{100 * high:g}% GC") + (f"/{self.window}bp" if self.window else "")

    def breach_label(self) -> str:
        low, high = self.limits
        said = f"GC != {100 * low:g}%" if low == high else " or ".join([f"GC < {100 * low:g}%"] * (low > 0) + [f"GC > {100 * high:g}%"] * (high < 1))
        return said + (f"/{self.window}bp" if self.window else "")


@dataclass(frozen=True)
class PartOfGCContent(Spec):
    """The global share of G and C, as far as a part changes it."""

    low: float
    high: float
    outside: int
    length: int

    def measure(self, s: str):
        gc = (self.outside + sum(c in "GC" for c in self.text(s))) / self.length
        score = -(max(0.0, self.low - gc) + max(0.0, gc - self.high))
        return score, [(*self.place[:2], 0)] if score < 0 else []


@dataclass(frozen=True)
class EnforceTerminalGCContent(Spec):
    window: int
    mini: float = 0.0
    maxi: float = 1.0

    def _ends(self, q: Column) -> list[tuple[Column, Column]]:
        n, w = F.length(q), self.window
        return [(F.substring(q, 1, w), location(0, F.least(F.lit(w), n))), (F.substring(q, -w, w), location(F.greatest(F.lit(0), n - w), n))]

    def _bad(self, q: Column) -> Column:
        gc = dna.gc_fraction(q)
        return F.greatest(F.lit(0.0), self.mini - gc) + F.greatest(F.lit(0.0), gc - self.maxi)

    def score(self, q: Column) -> Column:
        (a, _), (b, _) = self._ends(q)
        return -(self._bad(a) + self._bad(b))

    def locations(self, q: Column) -> Column:
        return F.filter(F.array(*[F.when(self._bad(e) > 0, at) for e, at in self._ends(q)]), lambda x: x.isNotNull())

    def measure(self, s: str):
        bad, at = 0.0, []
        for t, p in ((s[: self.window], (0, min(self.window, len(s)), 0)), (s[-self.window :], (max(0, len(s) - self.window), len(s), 0))):
            gc = sum(c in "GC" for c in t) / len(t) if t else 0.0
            b = max(0.0, self.mini - gc) + max(0.0, gc - self.maxi)
            bad, at = bad + b, at + [p] * (b > 0)
        return -bad, at


@lru_cache(maxsize=8)
def canonical_words(s: str, k: int, both_strands: bool) -> tuple[str, ...]:
    words = [s[i : i + k] for i in range(max(0, len(s) - k + 1))]
    if not both_strands:
        return tuple(words)
    back = revcomp(s)
    return tuple(min(w, back[len(s) - i - k : len(s) - i]) for i, w in enumerate(words))


@dataclass(frozen=True)
class UniquifyAllKmers(Spec):
    """K-mers of the place that occur more than once, or their reverse complements do, in the reference: the sequence, a
    place, or ("here") the place itself."""

    k: int
    both_strands: bool = True
    last: bool = False  # whether the last k-mer counts
    reference: Place | str | None = None

    @property
    def within(self) -> bool:
        """Whether the place is its own reference."""
        return self.reference in ("here", "same") or (self.reference is None and self.place is None)

    def wide(self, n: int) -> Place | None:
        return None if self.within else self.reference or (0, n, 0)

    def score(self, q: Column) -> Column:
        if self.within:
            return kernels.repeated_words_score(self.region(q), self.k, self.both_strands, self.last)
        return (-F.size(self.locations(q))).cast("double")

    def locations(self, q: Column) -> Column:
        if self.within:
            return self.upright_column(kernels.repeated_words_places(self.region(q), self.k, self.both_strands, self.last))
        start, end = (F.lit(0), F.length(q)) if self.reference is None else map(F.lit, self.reference[:2])
        found = kernels.repeated_words_places(dna.part(q, start, end), self.k, self.both_strands, self.last)
        low, high = self.span_column(q)
        found = F.transform(found, lambda x: location(x["start"] + start, x["end"] + start, x["strand"]))
        return F.filter(found, lambda x: (x["start"] >= low) & (x["end"] < high))

    def starts(self, s: str) -> tuple[range, Callable[[int], bool]]:
        """Where words are counted, and which of them count."""
        wide = self.wide(len(s))
        low, high = wide[:2] if wide else self.span(s)
        counted = range(low, max(low, min(high, len(s)) - self.k + self.last))
        if wide is None:
            return counted, lambda i: True
        a, b = self.span(s)
        return counted, lambda i: a <= i and i + self.k < b

    def measure(self, s: str):
        words = canonical_words(s, self.k, self.both_strands)
        counted, counts = self.starts(s)
        n = Counter(words[i] for i in counted)
        at = [i for i in counted if n[words[i]] > 1 and counts(i)]
        back = -1 if self.place and self.place[2] == -1 and self.wide(len(s)) is None else 0
        return float(-len(at)), [(i, i + self.k, back) for i in at]

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        """Of the words that the change touches, and those outside that are equal to one of them."""
        if s is None:
            return super().localized(start, end)
        counted, counts = self.starts(s)
        touched = range(max(counted.start, start - self.k + 1), min(counted.stop, end))
        if not touched:
            return None
        words = canonical_words(s, self.k, self.both_strands)
        now = [words[i] for i in touched]
        return PartOfKmers(self.k, self.both_strands, touched, tuple(map(counts, touched)), (_word_counts(s, self.k, self.both_strands, counted), Counter(now)), (Counter() if self.wide(len(s)) is None else Counter(words[i] for i in counted if counts(i)), Counter(w for w, i in zip(now, touched, strict=True) if counts(i))), self.wide(len(s)) is None, place=(touched.start, touched.stop + self.k - 1, 0), boost=self.boost)

    def shifted(self, by: int) -> Spec:
        out = super().shifted(by)
        return replace(out, reference=(self.reference[0] + by, self.reference[1] + by, self.reference[2])) if isinstance(self.reference, tuple) else out

    def parameters(self) -> str:
        return f"k:{self.k}"

    def short_label(self) -> str:
        return f"All {self.k}-mers unique"

    def breach_label(self) -> str:
        return f"{self.k}-mers that repeat"


@lru_cache(maxsize=8)
def _word_counts(s: str, k: int, both_strands: bool, counted: range) -> Counter:
    words = canonical_words(s, k, both_strands)
    return Counter(words[i] for i in counted)


@dataclass(frozen=True)
class PartOfKmers(Spec):
    """Repeated words, as far as a part changes them. all, mine: the counts of all words and of those that count, with what
    of them the part had at first."""

    k: int
    both_strands: bool
    touched: range
    count: tuple[bool, ...]
    all: tuple[Counter, Counter]
    mine: tuple[Counter, Counter]
    same: bool

    def measure(self, s: str):
        a, b = self.place[:2]
        words = canonical_words(s[a:b], self.k, self.both_strands)
        now, (total, had), (own, own_had) = Counter(words), self.all, self.all if self.same else self.mine
        score, at = 0, []
        for i, w, counts in zip(self.touched, words, self.count, strict=True):
            if counts and total[w] - had[w] + now[w] > 1:
                at.append((i, i + self.k, 0))
        for w, n in now.items():
            fixed = total[w] - had[w]
            if fixed == 1 and fixed + n > 1:  # a word outside that is no longer the only one
                score += own[w] - own_had[w]
        return float(-len(at) - score), at


@dataclass(frozen=True)
class AvoidHairpins(Spec):
    """Words whose reverse complement follows within the window."""

    stem: int = 20
    window: int = 200

    @property
    def reach(self):
        return self.window

    def score(self, q: Column) -> Column:
        return kernels.hairpin_score(self.region(q), self.stem, self.window)

    def locations(self, q: Column) -> Column:
        return self.upright_column(kernels.hairpin_places(self.region(q), self.stem, self.window))

    def measure(self, s: str):
        t, k = self.text(s), self.stem
        back, n = revcomp(t), len(t)
        at = [i for i in range(max(0, n - k)) if back[n - i - k : n - i] in t[i + k : i + self.window]]
        return float(-len(at)), self.upright([(g[0], min(g[-1] + self.window, n), 0) for g in runs(at, 1 << 30, 10)], s)

    def parameters(self) -> str:
        return f"stem:{self.stem}, window:{self.window}"

    def short_label(self) -> str:
        return f"No hairpins of {self.stem}/{self.window}bp"

    def breach_label(self) -> str:
        return f"hairpins of {self.stem}/{self.window}bp"


@dataclass(frozen=True)
class AvoidChanges(Spec):
    """At most so many bases differ from the target: a column of the batch, or the sequence that the search begins with."""

    max_edits: int = 0
    max_edits_percent: float | None = None
    target: str | Column | None = None
    indices: tuple[int, ...] | None = None
    priority = -1000

    def limit(self, n):
        if self.max_edits_percent is None:
            return self.max_edits
        return F.floor(n * self.max_edits_percent / 100) if isinstance(n, Column) else math.floor(n * self.max_edits_percent / 100)

    def pair(self, q: Column) -> tuple[Column, Column]:
        target = self.target if isinstance(self.target, Column) else F.lit(self.target)
        if self.indices is not None:
            pick = lambda x: F.concat(*[F.substring(x, i + 1, 1) for i in self.indices])
            return pick(q), pick(target)
        return self.region(q), self.region(target) if isinstance(self.target, Column) else target

    def score(self, q: Column) -> Column:
        a, b = self.pair(q)
        return (self.limit(F.length(a)) - dna.n_differences(a, b)).cast("double")

    def locations(self, q: Column) -> Column:
        flags = dna.differences(*self.pair(q))
        if self.indices is not None:
            at = F.filter(F.transform(flags, lambda x, i: F.when(x, F.get(F.array(*map(F.lit, self.indices)), i))), lambda x: x.isNotNull())
            return F.transform(grouped_spans(F.array_sort(at), 1 << 30, 6), lambda g: location(g["first"], g["last"] + 1))
        at = F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
        return self.upright_column(F.transform(grouped_spans(at, 1 << 30, 6), lambda g: location(g["first"], g["last"] + 1)))

    def at(self, s: str) -> list[int]:
        return list(self.indices) if self.indices is not None else list(range(*self.span(s)))

    def differing(self, s: str) -> list[int]:
        want = self.target if self.indices is None or len(self.target) == len(self.indices) else "".join(self.target[i] for i in self.indices)
        if self.place and self.place[2] == -1:
            want = revcomp(want)
        return [i for i, b in zip(self.at(s), want, strict=True) if s[i] != b]

    def measure(self, s: str):
        at = self.differing(s)
        return float(self.limit(len(self.at(s))) - len(at)), [(g[0], g[-1] + 1, 0) for g in runs(at, 1 << 30, 6)]

    def bound(self, s: str) -> Spec:
        if self.target is not None:
            return self
        return replace(self, target="".join(s[i] for i in self.indices) if self.indices is not None else self.text(s))

    def enforced(self) -> bool:
        return self.max_edits == 0 and not self.max_edits_percent

    def restrict(self, s: str) -> list[Choice]:
        if not self.enforced():
            return []
        want = revcomp(self.target) if self.place and self.place[2] == -1 else self.target
        return [(i, i + 1, (b,)) for i, b in zip(self.at(s), want, strict=True)]

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        """On the part, with what may still change there."""
        if s is None or self.target is None or isinstance(self.target, Column) or (self.place and self.place[2] == -1) or type(self) is not AvoidChanges:
            return self
        want = self.target if self.indices is None or len(self.target) == len(self.indices) else "".join(self.target[i] for i in self.indices)
        inside = [(i, b) for i, b in zip(self.at(s), want, strict=True) if start <= i < end]
        if not inside:
            return None
        n = len(self.at(s))
        outside = sum(s[i] != b for i, b in zip(self.at(s), want, strict=True) if not start <= i < end)
        return replace(self, place=None, indices=tuple(i for i, _ in inside), target="".join(b for _, b in inside), max_edits=self.limit(n) - outside, max_edits_percent=None)

    def short_label(self) -> str:
        return "Keep" if self.enforced() else f"At most {self.max_edits if self.max_edits_percent is None else f'{self.max_edits_percent:g}%'} edits"

    def breach_label(self) -> str:
        return "edits"


@dataclass(frozen=True)
class EnforceChanges(AvoidChanges):
    """At least `minimum` bases differ (as a constraint), or as near to `amount` as can be (as an objective)."""

    minimum: int | None = None
    minimum_percent: float | None = None
    amount: int | None = None
    amount_percent: float | None = None
    priority = 0

    def wanted(self, n):
        ceil, floor = (F.ceil, F.floor) if isinstance(n, Column) else (math.ceil, math.floor)
        if self.amount is not None:
            return self.amount
        if self.amount_percent is not None:
            return floor(n * self.amount_percent / 100)
        if self.minimum is not None:
            return self.minimum
        return ceil(n * (100 if self.minimum_percent is None else self.minimum_percent) / 100)

    @property
    def exact(self) -> bool:
        return self.amount is not None or self.amount_percent is not None

    def score(self, q: Column) -> Column:
        a, b = self.pair(q)
        more = dna.n_differences(a, b) - self.wanted(F.length(a))
        return (-F.abs(more) if self.exact else more).cast("double")

    def locations(self, q: Column) -> Column:
        return F.array(location(*self.place)) if self.place else F.array(location(0, F.length(q)))

    def measure(self, s: str):
        more = len(self.differing(s)) - self.wanted(len(self.at(s)))
        return float(-abs(more) if self.exact else more), [(*self.span(s), 0)]

    def enforced(self) -> bool:
        return not self.exact and self.minimum is None and (self.minimum_percent is None or self.minimum_percent == 100)

    def restrict(self, s: str) -> list[Choice]:
        want = revcomp(self.target) if self.place and self.place[2] == -1 else self.target
        return [(i, i + 1, tuple(x for x in "ACGT" if x != b)) for i, b in zip(self.at(s), want, strict=True)] if self.enforced() else []


@dataclass(frozen=True)
class EnforceSequence(Spec):
    """The region matches an IUPAC word of its length."""

    sequence: str
    reach = 0

    def wrong(self, q: Column) -> Column:
        sets = F.array(*[F.lit(IUPAC[x]) for x in self.sequence])
        return F.filter(F.transform(dna.letters(self.region(q)), lambda c, i: F.when(~F.contains(F.get(sets, i), c), i)), lambda x: x.isNotNull())

    def score(self, q: Column) -> Column:
        return (-F.size(self.wrong(q))).cast("double")

    def locations(self, q: Column) -> Column:
        return self.upright_column(F.transform(grouped_spans(self.wrong(q), 1 << 30, 6), lambda g: location(g["first"], g["last"] + 1)))

    def measure(self, s: str):
        at = [i for i, (c, x) in enumerate(zip(self.text(s), self.sequence, strict=True)) if c not in IUPAC[x]]
        return float(-len(at)), self.upright([(g[0], g[-1] + 1, 0) for g in runs(at, 1 << 30, 6)], s)

    def enforced(self) -> bool:
        return True

    def restrict(self, s: str) -> list[Choice]:
        word = revcomp(self.sequence) if self.place and self.place[2] == -1 else self.sequence
        start = self.span(s)[0]
        return [(start + i, start + i + 1, tuple(IUPAC[x])) for i, x in enumerate(word)]

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        low, high = self.place[:2] if self.place else (0, len(self.sequence))
        return self if low < end and start < high else None

    def parameters(self) -> str:
        return self.sequence


@dataclass(frozen=True)
class EnforceChoice(Spec):
    choices: tuple[str, ...]

    def variants(self) -> list[str]:
        from .patterns import enzyme_table, iupac_variants

        words = [enzyme_table().get(c.removesuffix("_site"), c) for c in self.choices]
        return sorted({v for w in words for v in iupac_variants(w)})

    def score(self, q: Column) -> Column:
        return F.when(self.region(q).isin(self.variants()), 0.0).otherwise(-1.0)

    def locations(self, q: Column) -> Column:
        whole = location(*self.place) if self.place else location(0, F.length(q))
        return F.when(self.score(q) < 0, F.array(whole)).otherwise(no_locations())

    def measure(self, s: str):
        ok = self.text(s) in self.variants()
        return (0.0, []) if ok else (-1.0, [(*self.span(s), 0)])

    def enforced(self) -> bool:
        return True

    def restrict(self, s: str) -> list[Choice]:
        back = bool(self.place and self.place[2] == -1)
        return [(*self.span(s), tuple(sorted(revcomp(v) if back else v for v in self.variants())))]

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        return self if self.place is None or (self.place[0] < end and start < self.place[1]) else None


class CodonSpec(Spec):
    """Of specifications that read a region codon by codon."""

    def codons(self, q: Column) -> Column:
        return dna.codons(self.region(q))

    def codon_list(self, s: str) -> list[str]:
        t = self.text(s)
        if len(t) % 3:
            raise ValueError(f"length {len(t)} isn't a multiple of 3")
        return [t[i : i + 3] for i in range(0, len(t), 3)]

    def codon_places(self, at: Column) -> Column:
        return self.upright_column(F.transform(at, lambda i: location(3 * i, 3 * i + 3, 1)))

    def places(self, at: list[int], s: str) -> list[Place]:
        return self.upright([(3 * i, 3 * i + 3, 1) for i in at], s)

    def localized(self, start: int, end: int, s: str | None = None) -> Spec | None:
        """On the whole codons that the change touches."""
        low, high, strand = self.place or (0, len(s) if s is not None else 1 << 60, 1)
        if low >= end or start >= high:
            return None
        if s is None:
            return self
        a, b = max(low, start), min(high, end)
        first, last = ((a - low) // 3, -(-(b - low) // 3)) if strand != -1 else ((high - b) // 3, -(-(high - a) // 3))
        last = min(last, (high - low) // 3)
        place = (low + 3 * first, low + 3 * last, strand) if strand != -1 else (high - 3 * last, high - 3 * first, strand)
        return self.on_codons(place, first, last, s)

    def on_codons(self, place: Place, first: int, last: int, s: str) -> Spec | None:
        """The specification on the codons from first to last of its own, which lie at place."""
        return replace(self, place=place)

    def where(self, q: Column, test: Callable[[Column, Column], Column]) -> Column:
        """The indices of codons for which the test holds."""
        return F.filter(F.transform(self.codons(q), lambda c, i: F.when(test(c, i), i)), lambda x: x.isNotNull())


@dataclass(frozen=True)
class EnforceTranslation(CodonSpec):
    """The region keeps its protein: one given, a column, or that of the sequence the search begins with. code: the name of a
    genetic code, or codons and amino acids in pairs."""

    protein: str | Column | None = None
    start_codon: str | None = None
    code: str | tuple[tuple[str, str], ...] = "Standard"

    @property
    def table(self) -> dict[str, str]:
        return dna.code_table(self.code)

    def amino(self, c: Column) -> Column:
        return F.coalesce(F.element_at(dna.mapping(self.table), c), F.lit("X"))

    def wrong(self, q: Column) -> Column:
        want = dna.letters(self.protein if isinstance(self.protein, Column) else F.lit(self.protein))
        bad = F.zip_with(F.transform(self.codons(q), self.amino), want, lambda a, b: ~(a.eqNullSafe(b)))
        first = F.substring(self.region(q), 1, 3)
        if self.start_codon:
            allowed = first.isin(*(dna.STARTS.get(self.start_codon) or (self.start_codon,)))
            bad = F.transform(bad, lambda x, i: F.when(i == 0, ~allowed).otherwise(x))
        return F.filter(F.transform(bad, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())

    def score(self, q: Column) -> Column:
        return (-F.size(self.wrong(q))).cast("double")

    def locations(self, q: Column) -> Column:
        return self.codon_places(self.wrong(q))

    def measure(self, s: str):
        words = self.codon_list(s)
        at = [i for i, (c, a) in enumerate(zip(words, self.protein, strict=True)) if c not in self.allowed(i, a)]
        return float(-len(at)), self.places(at, s)

    def allowed(self, i: int, aa: str) -> tuple[str, ...]:
        if i == 0 and self.start_codon:
            return tuple(dna.STARTS.get(self.start_codon) or (self.start_codon,))
        return _synonyms(aa, self.code)

    def bound(self, s: str) -> Spec:
        return self if self.protein is not None else replace(self, protein="".join(self.table[c] for c in self.codon_list(s)))

    def enforced(self) -> bool:
        return True

    def restrict(self, s: str) -> list[Choice]:
        back = bool(self.place and self.place[2] == -1)
        return [(a, b, tuple(sorted(revcomp(c) if back else c for c in self.allowed(i, aa)))) for i, aa in enumerate(self.protein) for a, b, _ in self.places([i], s)]

    def on_codons(self, place: Place, first: int, last: int, s: str) -> Spec | None:
        if isinstance(self.protein, Column) or self.protein is None:
            return self
        return replace(self, place=place, protein=self.protein[first:last], start_codon=self.start_codon if first == 0 else None)

    def parameters(self) -> str:
        return "" if self.code == "Standard" else str(self.code) if isinstance(self.code, str) else "own code"

    def breach_label(self) -> str:
        return "protein sequence changed"


@lru_cache(maxsize=4096)
def _synonyms(aa: str, code) -> tuple[str, ...]:
    return tuple(synonyms(aa, code))


@dataclass(frozen=True)
class AvoidStopCodons(CodonSpec):
    code: str | tuple[tuple[str, str], ...] = "Standard"

    def score(self, q: Column) -> Column:
        return (-F.size(self._stops(q))).cast("double")

    def _stops(self, q: Column) -> Column:
        return self.where(q, lambda c, i: c.isin(*synonyms("*", self.code)))

    def locations(self, q: Column) -> Column:
        return self.codon_places(self._stops(q))

    def measure(self, s: str):
        stops = _synonyms("*", self.code)
        at = [i for i, c in enumerate(self.codon_list(s)) if c in stops]
        return float(-len(at)), self.places(at, s)


Usage = dict[str, float]


def _one(fn: Callable) -> Callable[[Column], Column]:
    """fn with one argument only, as array functions tell their arguments by number."""
    return lambda x: fn(x)


@lru_cache(maxsize=64)
def _usage_table(usage: tuple[tuple[str, float], ...]) -> Usage:
    return dict(usage)


@lru_cache(maxsize=64)
def _adaptiveness(usage: tuple[tuple[str, float], ...]) -> Usage:
    return relative_adaptiveness(dict(usage))


@lru_cache(maxsize=64)
def _excess(usage: tuple[tuple[str, float], ...], least: float) -> Usage:
    table = dict(usage)
    return {c: min(0.0, table.get(c, 0.0) - least) for c in GENETIC_CODE}


@lru_cache(maxsize=64)
def _log_adaptiveness(usage: tuple[tuple[str, float], ...]) -> Usage:
    table = dict(usage)
    floor = {c: table.get(c, 0.0) or 0.001 for c in GENETIC_CODE}
    return {c: math.log(floor[c]) - math.log(max(floor[x] for x in synonyms(a))) for c, a in GENETIC_CODE.items()}


def by_amino_acid(usage: Usage) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for c, a in GENETIC_CODE.items():
        out[a][c] = usage.get(c, 0.0)
    return out


def relative_adaptiveness(usage: Usage) -> Usage:
    """A codon's frequency over that of its amino acid's most frequent one."""
    return {c: (f / top if (top := max(group.values())) else 0.0) for group in by_amino_acid(usage).values() for c, f in group.items()}


@dataclass(frozen=True)
class CodonUsageSpec(CodonSpec):
    """usage: codon to its share within its amino acid."""

    usage: tuple[tuple[str, float], ...] = ()

    @property
    def table(self) -> Usage:
        return _usage_table(self.usage)

    def lookup(self, values: Usage) -> Callable[[Column], Column]:
        table = dna.mapping({c: float(v) for c, v in values.items()})
        return lambda c: F.coalesce(F.element_at(table, c), F.lit(0.0))

    def summed(self, q: Column, values: Usage) -> Column:
        get = self.lookup(values)
        return F.aggregate(self.codons(q), F.lit(0.0), lambda a, c: a + get(c))


@dataclass(frozen=True)
class AvoidRareCodons(CodonUsageSpec):
    min_frequency: float = 0.1

    def excess(self) -> Usage:
        return _excess(self.usage, self.min_frequency)

    def score(self, q: Column) -> Column:
        return self.summed(q, self.excess())

    def locations(self, q: Column) -> Column:
        rare = [c for c, v in self.excess().items() if v < 0]
        return self.codon_places(self.where(q, lambda c, i: c.isin(rare)))

    def measure(self, s: str):
        excess, words = self.excess(), self.codon_list(s)
        at = [i for i, c in enumerate(words) if excess[c] < 0]
        return float(sum(excess[words[i]] for i in at)), self.places(at, s)

    def enforced(self) -> bool:
        return True

    def restrict(self, s: str) -> list[Choice]:
        back = bool(self.place and self.place[2] == -1)
        common = tuple(sorted(revcomp(c) if back else c for c, v in self.excess().items() if v >= 0))
        return [(a, b, common) for i in range(len(self.codon_list(s))) for a, b, _ in self.places([i], s)]


@dataclass(frozen=True)
class MaximizeCAI(CodonUsageSpec):
    """Sum of the logarithms of the codons' relative adaptiveness; a frequency of 0 counts as 0.001."""

    def logs(self) -> Usage:
        return _log_adaptiveness(self.usage)

    def score(self, q: Column) -> Column:
        return self.summed(q, self.logs())

    def locations(self, q: Column) -> Column:
        lower = [c for c, v in self.logs().items() if v < 0]
        return self.codon_places(self.where(q, lambda c, i: c.isin(lower)))

    def measure(self, s: str):
        logs, words = self.logs(), self.codon_list(s)
        return float(sum(logs[c] for c in words)), self.places([i for i, c in enumerate(words) if logs[c] < 0], s)


def _apart(counts: Column, shares: list[float]) -> Column:
    """How far an amino acid's codon counts, an array, are from the shares of their sum."""
    of = [F.get(counts, F.lit(i)) for i in range(len(shares))]
    all_ = sum(of[1:], of[0])
    return F.when(all_ > 0, sum((F.abs(n - all_ * f) for n, f in zip(of, shares, strict=True)), F.lit(0.0))).otherwise(0.0)


@dataclass(frozen=True)
class MatchTargetCodonUsage(CodonUsageSpec):
    """Minus the difference between the codons' shares in the sequence and in the table, weighted by amino acid counts."""

    def score(self, q: Column) -> Column:
        """Each codon becomes one letter; a letter's count is what a string loses without it, in the JVM's own string code."""
        letter = {c: chr(48 + i) for i, c in enumerate(sorted(GENETIC_CODE))}
        coded = F.array_join(F.transform(self.codons(q), lambda c: F.element_at(dna.mapping(letter), c)), "")

        def distance(text: Column) -> Column:
            total = F.lit(0.0)
            for group in by_amino_acid(self.table).values():
                counts = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(letter[c]), F.lit("")))).cast("double") for c in group])
                total = total + dna.let(counts, _one(lambda n, group=group: _apart(n, list(group.values()))))
            return total

        return -dna.let(coded, distance)

    def over(self, words: list[str]) -> set[str]:
        n = Counter(words)
        of = Counter(GENETIC_CODE[c] for c in words)
        return {c for c in n if n[c] > of[GENETIC_CODE[c]] * self.table.get(c, 0.0)}

    def locations(self, q: Column) -> Column:
        table, code = dna.mapping({c: self.table.get(c, 0.0) for c in GENETIC_CODE}), dna.mapping(GENETIC_CODE)
        n = lambda words, same: F.size(F.filter(words, same))
        over = lambda words, c: n(words, lambda w: w == c) > n(words, lambda w: F.element_at(code, w) == F.element_at(code, c)) * F.element_at(table, c)
        at = dna.let(self.codons(q), lambda words: F.transform(words, lambda c, i: F.when(over(words, c), i)))
        return self.codon_places(F.filter(at, lambda x: x.isNotNull()))

    def measure(self, s: str):
        words = self.codon_list(s)
        n, of = Counter(words), Counter(GENETIC_CODE[c] for c in words)
        total = sum(abs(n[c] - of[a] * f) for a, group in by_amino_acid(self.table).items() if of[a] for c, f in group.items())
        over = self.over(words)
        return -float(total), self.places([i for i, c in enumerate(words) if c in over], s)

    def on_codons(self, place: Place, first: int, last: int, s: str) -> Spec | None:
        words = self.codon_list(s)
        return PartOfCodonUsage(self.usage, Counter(words[:first] + words[last:]), place=place, boost=self.boost)


@dataclass(frozen=True)
class PartOfCodonUsage(CodonUsageSpec):
    """The whole region's codon usage, as far as a part changes it."""

    outside: Counter = field(default_factory=Counter)

    def measure(self, s: str):
        n = self.outside + Counter(self.codon_list(s))
        of: Counter = Counter()
        for c, k in n.items():
            of[GENETIC_CODE[c]] += k
        return -float(sum(abs(n[c] - of[a] * f) for a, group in _groups(self.usage).items() if of[a] for c, f in group.items())), []


@lru_cache(maxsize=64)
def _groups(usage: tuple[tuple[str, float], ...]) -> dict[str, dict[str, float]]:
    return by_amino_acid(dict(usage))


@dataclass(frozen=True)
class HarmonizeRCA(CodonUsageSpec):
    """Minus the difference between each codon's relative adaptiveness here and that of the original codon in its host."""

    original_usage: tuple[tuple[str, float], ...] = ()
    original: str | Column | None = None

    def score(self, q: Column) -> Column:
        here, there = self.lookup(relative_adaptiveness(self.table)), self.lookup(relative_adaptiveness(dict(self.original_usage)))
        before = self.codons(self.original if isinstance(self.original, Column) else F.lit(self.original))
        apart = F.zip_with(self.codons(q), before, lambda a, b: F.abs(there(b) - here(a)))
        return -F.aggregate(apart, F.lit(0.0), lambda t, x: t + x)

    def nearest(self) -> Usage:
        return _nearest(self.usage, self.original_usage)

    def locations(self, q: Column) -> Column:
        here, there, least = self.lookup(relative_adaptiveness(self.table)), self.lookup(relative_adaptiveness(dict(self.original_usage))), self.lookup(self.nearest())
        before = self.codons(self.original if isinstance(self.original, Column) else F.lit(self.original))
        far = F.zip_with(self.codons(q), before, lambda a, b: F.abs(there(b) - here(a)) > least(b))
        return self.codon_places(F.filter(F.transform(far, lambda x, i: F.when(x, i)), lambda x: x.isNotNull()))

    def bound(self, s: str) -> Spec:
        return self if self.original is not None else replace(self, original=s)

    def measure(self, s: str):
        here, there = _adaptiveness(self.usage), _adaptiveness(self.original_usage)
        apart = [(abs(there[b] - here[a]), b) for a, b in zip(self.codon_list(s), self.codon_list(self.original), strict=True)]
        nearest = _nearest(self.usage, self.original_usage)
        return -float(sum(x for x, _ in apart)), self.places([i for i, (x, b) in enumerate(apart) if x > nearest[b]], s)


@lru_cache(maxsize=64)
def _nearest(usage: tuple[tuple[str, float], ...], original_usage: tuple[tuple[str, float], ...]) -> Usage:
    """For each original codon, the least difference that some synonym of it has here."""
    here, there = _adaptiveness(usage), _adaptiveness(original_usage)
    return {c: min(abs(there[c] - here[x]) for x in synonyms(a)) for c, a in GENETIC_CODE.items()}


def CodonOptimize(usage: Usage, method: str = "use_best_codon", original_usage: Usage | None = None, **more) -> Spec:
    """The objective that a method name stands for."""
    table = tuple(sorted(usage.items()))
    if method == "use_best_codon":
        return MaximizeCAI(table, **more)
    if method == "match_codon_usage":
        return MatchTargetCodonUsage(table, **more)
    if method == "harmonize_rca":
        return HarmonizeRCA(table, tuple(sorted((original_usage or {}).items())), **more)
    raise ValueError(f"no such method: {method}")


# Unified nearest-neighbour parameters (SantaLucia 1998), enthalpy in kcal/mol and entropy in cal/(mol K).
STACKS = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
TERMINAL = {"G": (0.1, -2.8), "C": (0.1, -2.8), "A": (2.3, 4.1), "T": (2.3, 4.1)}
ALL_STACKS = STACKS | {revcomp(k): v for k, v in STACKS.items()}
DNA_MOLAR, SALT_MOLAR = 50e-9, 50e-3


def melting_temperature(q: Column) -> Column:
    """In degrees Celsius, of a sequence with its complement; null below two bases."""
    heat, entropy = (dna.mapping({k: v[i] for k, v in ALL_STACKS.items()}) for i in (0, 1))
    ends = lambda i: sum((F.coalesce(F.element_at(dna.mapping({b: v[i] for b, v in TERMINAL.items()}), e), F.lit(0.0)) for e in (F.substring(q, 1, 1), F.substring(q, -1, 1))), F.lit(0.0))
    total = lambda table: F.aggregate(dna.kmers(q, 2), F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(table, w), F.lit(0.0)))
    ds = total(entropy) + ends(1) + 0.368 * (F.length(q) - 1) * math.log(SALT_MOLAR)
    return F.when(F.length(q) >= 2, 1000 * (total(heat) + ends(0)) / (ds + 1.987 * math.log(DNA_MOLAR / 4)) - 273.15)


def melting(s: str) -> float:
    if len(s) < 2:
        return -273.15
    pairs = [ALL_STACKS.get(s[i : i + 2], (0.0, 0.0)) for i in range(len(s) - 1)] + [TERMINAL[s[0]], TERMINAL[s[-1]]]
    ds = sum(p[1] for p in pairs) + 0.368 * (len(s) - 1) * math.log(SALT_MOLAR)
    return 1000 * sum(p[0] for p in pairs) / (ds + 1.987 * math.log(DNA_MOLAR / 4)) - 273.15


@dataclass(frozen=True)
class EnforceMeltingTemperature(Spec):
    mini: float = 50.0
    maxi: float = 70.0
    target: float | None = None

    @property
    def best(self):
        return 0.5 * (self.maxi - self.mini)

    @property
    def aim(self) -> float:
        return self.target if self.target is not None else 0.5 * (self.mini + self.maxi)

    def score(self, q: Column) -> Column:
        return self.best - F.abs(melting_temperature(self.region(q)) - self.aim)

    def locations(self, q: Column) -> Column:
        return F.array(location(*self.place) if self.place else location(0, F.length(q)))

    def measure(self, s: str):
        return self.best - abs(melting(self.text(s)) - self.aim), [(*self.span(s), 0)]


def _measured(spec: Spec):
    """A specification's measure as an Arrow function."""
    measure = spec.measure

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else measure(x)[0] for x in column.to_pylist()], pa.float64())

    return run


def longest_duplex(a: str, b: str) -> float:
    """The highest melting temperature of a run in which a pairs with b, over all shifts without gaps."""
    c, best = revcomp(b), 0.0
    for shift in range(1 - len(c), len(a)):
        run = ""
        for i in range(max(0, shift), min(len(a), shift + len(c)) + 1):
            if i < len(a) and 0 <= i - shift < len(c) and a[i] == c[i - shift]:
                run += a[i]
            else:
                best = max(best, melting(run) if len(run) > 1 else 0.0)
                run = ""
    return best


@dataclass(frozen=True)
class AvoidHeterodimerization(Spec):
    """A primer binds to none of the others above a temperature. An ungapped model: the strongest run of paired bases."""

    others: tuple[str, ...] = ()
    tmax: float = 5.0

    def measure(self, s: str):
        if not self.others:
            return 0.0, []
        t = [longest_duplex(self.text(s), o) for o in self.others]
        return self.tmax - max(t) - 0.001 * sum(t) / len(t), [(*self.span(s), 0)]

    def score(self, q: Column) -> Column:
        """The strongest run of each has no built-in form; batches go through Arrow."""
        return _measured(self)(q)


@dataclass(frozen=True)
class SequenceLengthBounds(Spec):
    min_length: int = 0
    max_length: int | None = None

    def score(self, q: Column) -> Column:
        ok = F.length(q) >= self.min_length
        return F.when(ok if self.max_length is None else ok & (F.length(q) <= self.max_length), 0.0).otherwise(-1.0)

    def measure(self, s: str):
        return (0.0 if self.min_length <= len(s) <= (self.max_length if self.max_length is not None else len(s)) else -1.0), None

    def locations(self, q: Column) -> Column:
        return F.lit(None).cast("array<struct<start:int,end:int,strand:int>>")


@dataclass(frozen=True)
class AvoidMatches(Spec):
    """No word of so many bases is within `mismatches` of one of the subjects', on either strand. For tables of subjects
    see homology; here they are a few strings."""

    match_length: int = 20
    subjects: tuple[str, ...] = ()
    mismatches: int = 0
    priority = -2

    @property
    def reach(self):
        return self.match_length - 1

    def subject_words(self) -> frozenset[str]:
        return _both_strand_words(self.subjects, self.match_length)

    def measure(self, s: str):
        t, k, known = self.text(s), self.match_length, self.subject_words()
        total, at = 0.0, []
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            best = 0 if w in known else min((sum(a != b for a, b in zip(w, x, strict=True)) for x in known), default=k) if self.mismatches else k
            if best <= self.mismatches:
                total += 1 / (1 + best)
                at.append((i, i + k, 0))
        return -total, self.upright(at, s)

    def score(self, q: Column) -> Column:
        """The subjects' words go with the function, not into the plan."""
        if self.mismatches:
            return _measured(self)(q)
        return kernels.match_score(self.region(q), self.match_length, frozenset(w.encode() for w in self.subject_words()))

    def locations(self, q: Column) -> Column:
        if self.mismatches:
            return super().locations(q)
        return self.upright_column(kernels.match_places(self.region(q), self.match_length, frozenset(w.encode() for w in self.subject_words())))


@lru_cache(maxsize=64)
def _both_strand_words(subjects: tuple[str, ...], k: int) -> frozenset[str]:
    return frozenset(w for s in subjects for t in (s, revcomp(s)) for w in (t[i : i + k] for i in range(len(t) - k + 1)))


@dataclass(frozen=True)
class AvoidBlastMatches(Spec):
    """No ungapped segment of min_align_length bases or more is equal to one of the subjects', on either strand. The score is
    minus the bases in such segments, or 1 without any. The model is that of an ungapped search for identical segments,
    without statistics: word_size below min_align_length finds the same ones. For tables of subjects see homology."""

    subjects: tuple[str, ...] = ()
    min_align_length: int = 20
    word_size: int = 4
    perc_identity: float = 100
    best = 1.0
    priority = -2

    def segments(self, t: str) -> list[tuple[int, int]]:
        if self.perc_identity != 100:
            raise ValueError("only identical segments are searched")
        k, open_, out = self.min_align_length, {}, []
        known = _placed_words(self.subjects, k)
        for i in range(len(t) - k + 1):
            now = {}
            for which, j in known.get(t[i : i + k], ()):
                now[which, i - j] = open_.pop((which, i - j), i)
            out += [(first, i + k - 1) for first in open_.values()]
            open_ = now
        return sorted(out + [(first, len(t)) for first in open_.values()])

    def measure(self, s: str):
        found = self.segments(self.text(s))
        return float(-sum(b - a for a, b in found)) if found else 1.0, self.upright([(a, b, 0) for a, b in found], s)

    def score(self, q: Column) -> Column:
        return _measured(self)(q)

    def breach_label(self) -> str:
        return f"matches of {self.min_align_length}bp or more"


@lru_cache(maxsize=16)
def _placed_words(subjects: tuple[str, ...], k: int) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, t in enumerate(x for s in subjects for x in (s, revcomp(s))):
        for j in range(len(t) - k + 1):
            out[t[j : j + k]].append((n, j))
    return dict(out)


@dataclass(frozen=True)
class EnforceRegionsCompatibility(Spec):
    """Each two of the regions fulfil a condition: a function of two strings, and for columns one of two columns."""

    regions: tuple[Place, ...] = ()
    condition: Callable[[str, str], bool] | None = None
    column_condition: Callable[[Column, Column], Column] | None = None

    def pairs(self):
        return [(a, b) for i, a in enumerate(self.regions) for b in self.regions[i + 1 :]]

    def score(self, q: Column) -> Column:
        bad = [(~self.column_condition(dna.part(q, *a), dna.part(q, *b))).cast("int") for a, b in self.pairs()]
        return -sum(bad, F.lit(0)).cast("double")

    def incompatibilities(self, q: Column) -> Column:
        """The regions by how many others they don't fit, as an array of region and n, the most first."""
        bad = [F.when(~self.column_condition(dna.part(q, *a), dna.part(q, *b)), 1).otherwise(0) for a, b in self.pairs()]
        counts = [sum((x for x, pair in zip(bad, self.pairs(), strict=True) if r in pair), F.lit(0)) for r in self.regions]
        rows = F.array(*[F.struct((-n).alias("less"), F.lit(k).alias("region"), n.alias("n")) for k, n in enumerate(counts)])
        return F.transform(F.filter(F.array_sort(rows), lambda x: x["n"] > 0), lambda x: F.struct(x["region"], x["n"]))

    def locations(self, q: Column) -> Column:
        places = F.array(*[location(*r) for r in self.regions])
        return F.transform(self.incompatibilities(q), lambda x: F.get(places, x["region"]))

    def measure(self, s: str):
        take = lambda p: revcomp(s[p[0] : p[1]]) if p[2] == -1 else s[p[0] : p[1]]
        n: Counter = Counter()
        bad = [(a, b) for a, b in self.pairs() if not self.condition(take(a), take(b))]
        for pair in bad:
            n.update(pair)
        return float(-len(bad)), [p for p, _ in n.most_common()]


def AllowPrimer(place: Place, tmin: float = 50, tmax: float = 70, max_homology: int = 6, others: tuple[str, ...] = (), max_heterodimer: float = 5, repeats: tuple[tuple[int, int], ...] = ((2, 5), (3, 4), (4, 3))) -> list[Spec]:
    """The specifications of a primer's place."""
    out: list[Spec] = [UniquifyAllKmers(max_homology, place=place), EnforceMeltingTemperature(tmin, tmax, place=place)]
    out += [AvoidPattern(f"{n}x{k}mer", place=place) for k, n in repeats]
    return out + ([AvoidHeterodimerization(others, max_heterodimer, place=place)] if others else [])


@dataclass(frozen=True)
class CustomSpec(Spec):
    """A specification by a function of a string that gives a score, or a score and places."""

    evaluate: Callable[[str], object] = lambda s: 0.0
    name: str = "Custom"
    #: Own ways to work at it: functions of the specification and the problem, whose sequence they may set; whether they did.
    resolver: Callable[[Spec, object], bool] | None = None
    optimizer: Callable[[Spec, object], bool] | None = None

    def measure(self, s: str):
        out = self.evaluate(self.text(s))
        score, at = out if isinstance(out, tuple) else (out, [])
        return float(score), self.upright(list(at), s)

    def score(self, q: Column) -> Column:
        return _measured(self)(q)

    def resolve_in(self, problem) -> bool:
        return bool(self.resolver and self.resolver(self, problem))

    def optimize_in(self, problem) -> bool:
        return bool(self.optimizer and self.optimizer(self, problem))

    @property
    def kind(self) -> str:
        return self.name


#: Names in labels.
REGISTRY: dict[str, Callable] = {
    "AvoidPattern": AvoidPattern, "no": AvoidPattern, "EnforcePatternOccurence": EnforcePatternOccurence, "insert": EnforcePatternOccurence,
    "EnforceGCContent": EnforceGCContent, "gc": EnforceGCContent, "EnforceTerminalGCContent": EnforceTerminalGCContent,
    "UniquifyAllKmers": UniquifyAllKmers, "all_unique_kmers": UniquifyAllKmers, "AvoidHairpins": AvoidHairpins, "no_hairpin": AvoidHairpins,
    "AvoidChanges": AvoidChanges, "keep": AvoidChanges, "EnforceChanges": EnforceChanges, "change": EnforceChanges,
    "EnforceSequence": EnforceSequence, "sequence": EnforceSequence, "EnforceChoice": EnforceChoice, "choice": EnforceChoice,
    "EnforceTranslation": EnforceTranslation, "cds": EnforceTranslation, "AvoidStopCodons": AvoidStopCodons, "no_stop": AvoidStopCodons,
    "AvoidRareCodons": AvoidRareCodons, "no_rare_codons": AvoidRareCodons, "MaximizeCAI": MaximizeCAI, "use_best_codon": MaximizeCAI,
    "MatchTargetCodonUsage": MatchTargetCodonUsage, "match_codon_usage": MatchTargetCodonUsage, "HarmonizeRCA": HarmonizeRCA, "harmonize_rca": HarmonizeRCA,
    "CodonOptimize": CodonOptimize, "optimize": CodonOptimize, "EnforceMeltingTemperature": EnforceMeltingTemperature, "tm": EnforceMeltingTemperature,
    "AvoidHeterodimerization": AvoidHeterodimerization, "AvoidMatches": AvoidMatches, "no_match": AvoidMatches, "AvoidBlastMatches": AvoidBlastMatches, "no_blast": AvoidBlastMatches, "SequenceLengthBounds": SequenceLengthBounds, "length": SequenceLengthBounds,
    "AllowPrimer": AllowPrimer, "primer": AllowPrimer,
}

__all__ = ["REGISTRY", "extended", *[n for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, Spec)], "CodonOptimize", "AllowPrimer", "melting_temperature"]
