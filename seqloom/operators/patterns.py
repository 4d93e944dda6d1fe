"""Patterns: regular expressions, IUPAC words, enzyme sites, homopolymers, repeated k-mers and position-specific scores.

A match may start at any position, whatever overlaps it. One pass of a regular expression with a look-ahead gives the match
at each position, so a scan is linear in the sequence and stays in the JVM.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import IUPAC, kmers, reverse_complement, revcomp
from .intervals import location, no_locations

# Recognition sites of common restriction enzymes.
ENZYME_SITES = {
    "AarI": "CACCTGC", "AscI": "GGCGCGCC", "AvrII": "CCTAGG", "BamHI": "GGATCC", "BbsI": "GAAGAC", "BclI": "TGATCA", "BglII": "AGATCT",
    "BsaI": "GGTCTC", "BsmBI": "CGTCTC", "BspEI": "TCCGGA", "ClaI": "ATCGAT", "DpnI": "GATC", "EcoRI": "GAATTC", "EcoRV": "GATATC",
    "HindIII": "AAGCTT", "HpaI": "GTTAAC", "KpnI": "GGTACC", "MluI": "ACGCGT", "NcoI": "CCATGG", "NdeI": "CATATG", "NheI": "GCTAGC",
    "NotI": "GCGGCCGC", "NsiI": "ATGCAT", "PacI": "TTAATTAA", "PmeI": "GTTTAAAC", "PstI": "CTGCAG", "SacI": "GAGCTC", "SalI": "GTCGAC",
    "SapI": "GCTCTTC", "SmaI": "CCCGGG", "SpeI": "ACTAGT", "SphI": "GCATGC", "StuI": "AGGCCT", "XbaI": "TCTAGA", "XhoI": "CTCGAG",
}
_own_sites: dict[str, str] = {}


def enzyme_table() -> dict[str, str]:
    """Name to site: the common ones and those that were added, which come first."""
    return ENZYME_SITES | _own_sites


def add_enzymes(sites: dict[str, str] | DataFrame, most: int = 100_000) -> None:
    """Makes sites known to patterns: a dict, or a table (name, site) of `most` rows at most."""
    if isinstance(sites, DataFrame):
        rows = sites.select("name", "site").where("name IS NOT NULL AND site IS NOT NULL").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} enzymes")
        sites = {r["name"]: r["site"] for r in rows}
    for name, site in sites.items():
        if not site or not set(site) <= set(IUPAC):
            raise ValueError(f"the site of {name} is no word of bases: {site!r}")
    _own_sites.update(sites)
    _parsed.cache_clear()


def iupac_regex(word: str) -> str:
    """Each letter as itself, or as a class of its bases and itself."""
    return "".join(x if len(IUPAC[x]) == 1 else f"[{IUPAC[x]}{x}]" for x in word)


def iupac_variants(word: str) -> list[str]:
    """All plain words that an IUPAC word stands for."""
    return ["".join(v) for v in itertools.product(*(IUPAC[x] for x in word))]


@dataclass(frozen=True)
class Pattern:
    """expression: without groups of its own but those numbered `\\1`; size: of each match, None where it varies."""

    expression: str
    size: int | None = None
    palindromic: bool = False
    name: str = ""

    def _wrapped(self) -> str:
        """The expression as group 1 of a look-ahead; its own groups move up by one."""
        inner = re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + 1}", self.expression)
        return f"(?=({inner}))"

    def at_each(self, q: Column) -> Column:
        """The match that starts at each position, or an empty string."""
        return F.regexp_extract_all(q, F.lit(f"(?:{self._wrapped()}|)[A-Z]"), F.lit(1))

    def count(self, q: Column, strand: int = 0) -> Column:
        forward = lambda s: F.regexp_count(s, F.lit(self._wrapped())).cast("long")
        return self._by_strand(forward(q), lambda: forward(reverse_complement(q)), strand, lambda a, b: a + b)

    def locations(self, q: Column, strand: int = 0, offset: int = 0) -> Column:
        n = F.length(q)
        found = lambda s, place: F.filter(F.transform(self.at_each(s), lambda m, i: F.when(F.length(m) > 0, place(m, i))), lambda x: x.isNotNull())
        plus = found(q, lambda m, i: location(i + offset, i + F.length(m) + offset, 1))
        minus = lambda: found(reverse_complement(q), lambda m, i: location(n - i - F.length(m) + offset, n - i + offset, -1))
        return self._by_strand(plus, minus, strand, F.concat)

    def _by_strand(self, plus, minus, strand, both):
        if strand == 1 or (strand == 0 and self.palindromic):
            return plus
        return minus() if strand == -1 else both(plus, minus())

    def find(self, s: str, strand: int = 0) -> list[tuple[int, int, int]]:
        """The matches in a Python string."""
        rx = re.compile(self._wrapped())
        plus = [(m.start(), m.end(1), 1) for m in rx.finditer(s)]
        if strand == 1 or (strand == 0 and self.palindromic):
            return plus
        minus = [(len(s) - m.end(1), len(s) - m.start(), -1) for m in rx.finditer(revcomp(s))]
        return minus if strand == -1 else plus + minus


def iupac(word: str, name: str = "") -> Pattern:
    return Pattern(iupac_regex(word), len(word), revcomp(word) == word, name or word)


def enzyme_site(name: str) -> Pattern:
    if name not in enzyme_table():
        raise ValueError(f"no enzyme is known by the name {name!r}; add_enzymes takes a table of names and sites")
    return iupac(enzyme_table()[name], f"{name}_site")


def homopolymer(base: str, n: int) -> Pattern:
    return Pattern(base * n, n, False, f"{n}x{base}")


def repeated_kmer(n: int, k: int) -> Pattern:
    """A word of k bases n times in a row. Both strands have it at the same places, so one is searched."""
    return Pattern(f"([ATGC]{{{k}}})\\1{{{n - 1}}}", n * k, True, f"{n}x{k}mer")


def pattern(text: str | Pattern) -> Pattern:
    """9xA, 3x4mer, BsmBI_site, an IUPAC word, or else a regular expression. A site of an unknown enzyme is an error."""
    return _parsed(text) if isinstance(text, str) else text


@lru_cache(maxsize=4096)
def _parsed(text: str) -> Pattern:
    if m := re.fullmatch(r"(\d+)x([ATGC])", text):
        return homopolymer(m[2], int(m[1]))
    if m := re.fullmatch(r"(\d+)x(\d+)mer", text):
        return repeated_kmer(int(m[1]), int(m[2]))
    if text.endswith("_site"):
        return enzyme_site(text[:-5])
    if text and set(text) <= set(IUPAC):
        return iupac(text)
    return Pattern(text, None, False, text)


@dataclass(frozen=True)
class Pssm:
    """Scores of bases by position; a window matches from `threshold` on."""

    scores: tuple[dict, ...]
    threshold: float
    name: str = "motif"
    palindromic: bool = field(default=False, init=False)

    @property
    def size(self) -> int:
        return len(self.scores)

    @classmethod
    def relative(cls, scores, share: float, name: str = "motif") -> Pssm:
        """The threshold lies at a share of the way from the lowest to the highest score."""
        low, high = (sum(f(p.values()) for p in scores) for f in (min, max))
        return cls(tuple(scores), low + share * (high - low), name)

    @classmethod
    def from_counts(cls, counts: list[dict[str, float]], pseudocount: float | dict | str | None = None, **limit) -> Pssm:
        """Log odds against equal shares. pseudocount: a number, one a base, "jaspar" (a fourth of the root of the number
        of sites), or None for none, where a missing base scores minus infinity."""
        rows = []
        for column in counts:
            n = sum(column.values())
            add = {b: math.sqrt(n) / 4 for b in "ACGT"} if pseudocount == "jaspar" else {b: pseudocount[b] if isinstance(pseudocount, dict) else pseudocount or 0.0 for b in "ACGT"}
            total = n + sum(add.values())
            rows.append({b: math.log2((column.get(b, 0) + add[b]) / total * 4) if column.get(b, 0) + add[b] else -math.inf for b in "ACGT"})
        return cls.relative(rows, limit["relative_threshold"], limit.get("name", "motif")) if "relative_threshold" in limit else cls(tuple(rows), limit["threshold"], limit.get("name", "motif"))

    @classmethod
    def from_sequences(cls, sequences: list[str], pseudocount: float | dict | str | None = None, **limit) -> Pssm:
        return cls.from_counts([{b: sum(s[i] == b for s in sequences) for b in "ACGT"} for i in range(len(sequences[0]))], pseudocount, **limit)

    def _score(self, word: Column) -> Column:
        total = F.lit(0.0)
        for j, column in enumerate(self.scores):
            base = F.substring(word, j + 1, 1)
            value = F.lit(float("-inf"))
            for b, v in column.items():
                value = F.when(base == b, float(v)).otherwise(value)
            total = total + value
        return total

    def window_scores(self, q: Column) -> Column:
        return F.transform(kmers(q, self.size), self._score)

    def count(self, q: Column, strand: int = 0) -> Column:
        one = lambda s: F.size(F.filter(kmers(s, self.size), lambda w: self._score(w) >= self.threshold)).cast("long")
        return one(q) if strand == 1 else one(reverse_complement(q)) if strand == -1 else one(q) + one(reverse_complement(q))

    def locations(self, q: Column, strand: int = 0, offset: int = 0) -> Column:
        n, k = F.length(q), self.size
        found = lambda s, place: F.filter(F.transform(self.window_scores(s), lambda x, i: F.when(x >= self.threshold, place(i))), lambda x: x.isNotNull())
        plus = found(q, lambda i: location(i + offset, i + k + offset, 1))
        minus = found(reverse_complement(q), lambda i: location(n - i - k + offset, n - i + offset, -1))
        return plus if strand == 1 else minus if strand == -1 else F.concat(plus, minus)

    def find(self, s: str, strand: int = 0) -> list[tuple[int, int, int]]:
        k = self.size
        hits = lambda x: [i for i in range(len(x) - k + 1) if sum(self.scores[j].get(x[i + j], -math.inf) for j in range(k)) >= self.threshold]
        plus, minus = [(i, i + k, 1) for i in hits(s)], [(len(s) - i - k, len(s) - i, -1) for i in hits(revcomp(s))]
        return plus if strand == 1 else minus if strand == -1 else plus + minus


__all__ = ["ENZYME_SITES", "Pattern", "Pssm", "add_enzymes", "enzyme_table", "enzyme_site", "homopolymer", "iupac", "iupac_regex", "iupac_variants", "no_locations", "pattern", "repeated_kmer"]
