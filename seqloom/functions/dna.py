"""Scalar functions on DNA columns. Sequences are upper-case strings; locations are half-open and 0-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters and their bases, complements, and the standard genetic code in the order T, C, A, G.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
LETTERS, COMPLEMENTS = "ACGTUWSMKRYBDHVN", "TGCAAWSKMYRVHDBN"
CODE_BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: What the bacterial table (11) differs in: more codons that start a protein.
STARTS = {"Standard": ("TTG", "CTG", "ATG"), "Bacterial": ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")}

GENETIC_CODE = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(CODE_BASES) for j, b in enumerate(CODE_BASES) for k, c in enumerate(CODE_BASES)}
_SWAP = str.maketrans(LETTERS, COMPLEMENTS)


# Genetic codes by what they differ in from the standard one.
CODES: dict[str, dict[str, str]] = {
    "Standard": {},
    "Bacterial": {},
    "Vertebrate Mitochondrial": {"TGA": "W", "ATA": "M", "AGA": "*", "AGG": "*"},
    "Yeast Mitochondrial": {"TGA": "W", "ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T"},
    "Mold Mitochondrial": {"TGA": "W"},
    "Mycoplasma": {"TGA": "W"},
    "Invertebrate Mitochondrial": {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S"},
    "Ciliate Nuclear": {"TAA": "Q", "TAG": "Q"},
    "Alternative Yeast Nuclear": {"CTG": "S"},
}


def code_table(code: str | dict[str, str] | tuple[tuple[str, str], ...] = "Standard") -> dict[str, str]:
    """Codon to amino acid, by the name of a code, or as given in whole."""
    if not isinstance(code, str):
        return dict(code)
    if code not in CODES:
        raise ValueError(f"no such genetic code: {code!r}; known are {', '.join(CODES)}")
    return GENETIC_CODE | CODES[code]


def synonyms(aa: str, code: str | dict[str, str] | tuple[tuple[str, str], ...] = "Standard") -> list[str]:
    """The codons of an amino acid, in alphabetical order; X stands for any but a stop, B, J and Z for pairs."""
    table = code_table(code)
    wide = {"X": [a for a in set(table.values()) if a != "*"], "B": ["D", "N"], "J": ["I", "L"], "Z": ["E", "Q"]}
    return sorted(c for c, a in table.items() if a in wide.get(aa, [aa]))


def revcomp(s: str) -> str:
    return s.translate(_SWAP)[::-1]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: as the only element of a transformed array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def complement(q: Column) -> Column:
    return F.translate(q, LETTERS, COMPLEMENTS)


def reverse_complement(q: Column) -> Column:
    return F.reverse(complement(q))


def size(q: Column) -> Column:
    return F.length(q)


def part(q: Column, start: int | Column, end: int | Column, strand: int = 0) -> Column:
    """The sequence at a location, reverse-complemented on strand -1."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    s = F.substring(q, start + 1, end - start)
    return reverse_complement(s) if strand == -1 else s


def gc_count(q: Column) -> Column:
    return F.length(q) - F.length(F.translate(q, "GC", ""))


def gc_fraction(q: Column) -> Column:
    """The share of G and C; null for an empty sequence."""
    return F.when(F.length(q) > 0, gc_count(q) / F.length(q))


def kmers(q: Column, k: int) -> Column:
    """All overlapping k-mers in order, found in one linear pass; none in a shorter sequence."""
    return F.regexp_extract_all(q, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def codons(q: Column) -> Column:
    """The whole codons in frame; a rest of one or two bases is left out."""
    return F.regexp_extract_all(q, F.lit("(.{3})"), F.lit(1))


def checked_codons(q: Column) -> Column:
    """The codons; a length that is no multiple of 3 is an error."""
    return F.when(F.length(q) % 3 == 0, codons(q)).otherwise(F.raise_error(F.concat(F.lit("length isn't a multiple of 3: "), F.length(q).cast("string"))))


def letters(q: Column) -> Column:
    """The sequence's letters; an empty array of an empty sequence."""
    return F.when(F.length(q) > 0, F.split(q, "")).otherwise(F.array().cast("array<string>"))


def mapping(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def translate(q: Column, start: str | None = None, code: str | dict[str, str] | tuple[tuple[str, str], ...] = "Standard") -> Column:
    """The protein, `*` for stops. With the name of a table of start codons, a first codon in it gives M."""
    table = mapping(code_table(code))
    protein = F.array_join(F.transform(codons(q), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")
    if start is None:
        return protein
    first = F.substring(q, 1, 3).isin(*STARTS[start])
    return F.when(first, F.concat(F.lit("M"), F.substring(protein, 2, 1 << 30))).otherwise(protein)


def back_translate(protein: Column, seed: int | None = None, code: str | dict[str, str] | tuple[tuple[str, str], ...] = "Standard") -> Column:
    """A sequence of the protein: each amino acid's first codon, or with a seed one chosen by a hash of seed and place."""
    table = mapping({a: ",".join(synonyms(a, code)) for a in sorted(set(code_table(code).values()) | set("XBJZ"))})
    pick = lambda a, i: F.split(F.element_at(table, a), ",")
    if seed is None:
        chosen = F.transform(letters(protein), lambda a: F.get(pick(a, None), F.lit(0)))
    else:
        chosen = F.transform(letters(protein), lambda a, i: F.get(pick(a, i), F.pmod(F.xxhash64(F.lit(seed), i), F.size(pick(a, i))).cast("int")))
    return F.array_join(chosen, "")


def random_dna(key: Column, length: int, seed: int = 0, gc_share: float = 0.5) -> Column:
    """A sequence drawn by a hash of seed, key and place, so that reruns agree."""
    at = int(1000 * (1 - gc_share) / 2)
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1000))
    base = lambda i: F.when(draw(i) < at, "A").when(draw(i) < 2 * at, "T").when(draw(i) < 1000 - (1000 - 2 * at) // 2, "G").otherwise("C")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "") if length else F.lit("")


def random_protein(key: Column, length: int, seed: int = 0) -> Column:
    """M, then letters other than M and stops, then a stop."""
    middle = sorted(set(CODE) - set("M*"))
    pick = lambda i: F.get(F.array(*map(F.lit, middle)), F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(len(middle))).cast("int"))
    inner = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length - 2)), pick), "") if length > 2 else F.lit("")
    return F.concat(F.lit("M"), inner, F.lit("*"))


def differences(a: Column, b: Column) -> Column:
    """Where two sequences of one length differ, as an array of booleans; other lengths are an error."""
    same = F.zip_with(letters(a), letters(b), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), same).otherwise(F.raise_error(F.lit("sequences of different lengths")))


def count_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x)).cast("long")


def n_differences(a: Column, b: Column) -> Column:
    return count_true(differences(a, b))


def location_text(start: Column, end: Column, strand: Column) -> Column:
    """5-10(+), 5-10(-), or 5-10 without a strand."""
    sign = F.when(strand == 1, "(+)").when(strand == -1, "(-)").otherwise("")
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"), sign)


def parse_location(text: Column) -> Column:
    """The location that a text gives; without a sign the strand is +1; null if it gives none."""
    m = lambda g: F.regexp_extract(text, r"^(-?\d+)-(\d+)(\([+-]\))?$", g)
    return F.when(m(1) != "", F.struct(m(1).cast("int").alias("start"), m(2).cast("int").alias("end"), F.when(m(3) == "(-)", -1).otherwise(1).alias("strand")))


def score_text(score: Column, width: int = 9) -> Column:
    """The shortest of the plain number, two decimals and an exponent form, right-justified."""
    plain = F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))
    forms = F.array(plain, F.format_string("%.2f", score.cast("double")), F.format_string("%.2E.", score.cast("double")))
    best = F.element_at(F.array_sort(F.transform(forms, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))), 1)["x"]
    return F.when(F.length(best) >= width, best).otherwise(F.lpad(best, width, " "))
