"""Pieces of SQL that the oracles share."""

from __future__ import annotations

from ..functions.dna import GENETIC_CODE
from ..sources.sequences import HEX, HEX_BASES, LETTER_BASES, LETTERS


def seqs(salts: str = "ab", name: str = "seqs", table: str = "orders", key: str = "o_orderkey") -> str:
    parts = ", ".join(f"md5(concat('{s}', CAST({key} AS VARCHAR)))" for s in salts)
    return f"{name} AS (SELECT {key} AS seq_id, translate(concat({parts}), '{HEX}', '{HEX_BASES}') AS q FROM {table})"


def docs(name: str = "docs", table: str = "documents", key: str = "doc_id") -> str:
    return f"{name} AS (SELECT {key} AS seq_id, regexp_replace(translate(text, '{LETTERS}', '{LETTER_BASES}'), '[^ACGT]', '', 'g') AS q FROM {table})"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def gc(x: str) -> str:
    return f"(length(regexp_replace({x}, '[^GC]', '', 'g'))::DOUBLE / length({x}))"


def kmers(k: int, source: str = "seqs", name: str = "words") -> str:
    return f"{name} AS (SELECT seq_id, q, i, substr(q, i::INT + 1, {k}) AS w FROM (SELECT seq_id, q, unnest(generate_series(0, length(q) - {k})) AS i FROM {source}))"


def codons(source: str = "seqs", name: str = "codons") -> str:
    return f"{name} AS (SELECT seq_id, q, i, substr(q, 3 * i::INT + 1, 3) AS c FROM (SELECT seq_id, q, unnest(generate_series(0, length(q) // 3 - 1)) AS i FROM {source}))"


CODE = "code(c, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in GENETIC_CODE.items()) + ")"

#: Each codon's share within its amino acid, over all sequences; every codon is there.
USAGE = f"""{CODE}, n AS (SELECT code.aa, code.c, count(codons.c) AS n FROM code LEFT JOIN codons USING (c) GROUP BY code.aa, code.c),
usage AS (SELECT aa, c, n, coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY aa), 0), 0) AS f FROM n)"""


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0::DOUBLE)"
