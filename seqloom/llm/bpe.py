"""BPE by a token automaton (operator 1).

The automaton reads tokens and accepts exactly the token sequences that BPE gives. It starts as one state with a loop for
each byte. Each merge (u, v), in order of rank, is one gadget: with p the state that u leads to, if p has an arc v, then a
copy of p without v takes over as the target of u, and each state with an arc u gets an arc uv to where v leads. A copy
is kept as its parent and the arc it lacks, and a new token's arcs as "where u is", so a gadget takes constant memory and
whether a state has an arc is found by walking back over the gadgets; found transitions go to a table.

Two tables are compiled: an Aho-Corasick automaton of the labels, which gives the tokens that end at each place of a word in
one pass, the longest first; and the states' arcs as default transitions, a state's row being its parent's less one arc.
Transitions that were asked for are kept.

A word is encoded in one pass from left to right. The token sequence of each of its beginnings is unique, so it is enough
to know its last token: the first of the tokens that end there whose arc the state before it has. No step is taken back.
Decoding emits the labels of the arcs.

Defined results: a null text is encoded as an empty one, with no tokens; strings of added tokens in a text become their
token; repeated rows give repeated results; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed value: the pre-split of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words (twice as many, see Coder) and transitions that a worker keeps, some 250 MB; beyond that they are found anew.
KEPT_WORDS, KEPT_ARCS = 400_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    def __init__(self, tokens: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        """tokens: label to id; merges in order of rank. Tokens that no gadget makes have no arc."""
        self.ids = {x: i for x, i in tokens.items() if len(x) == 1}
        self.labels = {i: x for x, i in tokens.items()}
        self.left: dict[int, int] = {}
        self.made = dict.fromkeys(self.ids.values(), -1)
        self.target = dict.fromkeys(self.ids.values(), 0)
        self.parent, self.lacks, self.born = [-1], [-1], [0]
        self.table: dict[int, bool] = {}
        for step, (u, v) in enumerate(merges, 1):
            self._gadget(step, u, v, tokens)
        self.ending = self._ending()

    def _ending(self) -> ahocorasick.Automaton:
        """Token and length of each label, by where they end."""
        out = ahocorasick.Automaton()
        for label, token in self.ids.items():
            out.add_word(label.decode("latin-1"), (token, len(label)))
        out.make_automaton()
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ending", "table")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.table, self.ending = {}, self._ending()

    def _gadget(self, step: int, u: bytes, v: bytes, tokens: dict[bytes, int]) -> None:
        a, b, whole = self.ids.get(u), self.ids.get(v), u + v
        if a is None or b is None or not self._walk(p := self.target[a], b):
            return
        if whole in self.ids:
            raise ValueError(f"two merges make {whole!r}")
        token = self.ids[whole] = tokens[whole]
        self.target[token], self.made[token], self.left[token] = self.target[b], step, a
        self.parent.append(p)
        self.lacks.append(b)
        self.born.append(step)
        self.target[a] = len(self.parent) - 1

    def _walk(self, state: int, token: int) -> bool:
        """Whether the state has the arc. Of a token made after the state was, the arc is there if its first part's is;
        an older one's is there if the parent has it and the copy doesn't lack it."""
        made, left, born, lacks, parent = self.made, self.left, self.born, self.lacks, self.parent
        at = made[token]
        while state:
            if at >= born[state]:
                token = left[token]
                at = made[token]
            elif lacks[state] == token:
                return False
            else:
                state = parent[state]
        return True

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The labels' ids on the one path for the word."""
        target, table = self.target, self.table
        #: for each end, the token that ends there and its size
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)
        found = -1
        for at, hit in self.ending.iter(word.decode("latin-1")):
            if at == found:
                continue
            if start := at + 1 - hit[1]:
                if (before := last[start]) is None:
                    continue
                key = target[before[0]] << 20 | hit[0]
                if (known := table.get(key)) is None:
                    if len(table) >= KEPT_ARCS:
                        table.clear()
                    known = table[key] = self._walk(key >> 20, hit[0])
                if not known:
                    continue
            found = at
            last[at + 1] = hit
        path, end = [], len(word)
        while end:
            if (hit := last[end]) is None:
                raise ValueError(f"no path for {word!r}")
            path.append(hit[0])
            end -= hit[1]
        path.reverse()
        return tuple(path)


class Coder:
    """Texts to ids and back. Added tokens are found in the text first, the longest at a place."""

    def __init__(self, automaton: TokenAutomaton, added: dict[str, int], pattern: str = PATTERN):
        self.automaton, self.added = automaton, added
        self.find: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.labels = automaton.labels | {i: x.encode() for x, i in added.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.automaton, self.added, self.find.__self__.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def _word(self, word: str) -> tuple[int, ...]:
        """Words found lately are kept: when the newer half is full, the older one goes."""
        if (ids := self.older.get(word)) is None:
            ids = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self.known) >= KEPT_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(self.added[part])
                continue
            known = self.known
            for word in self.find(part):
                out += known.get(word) or self._word(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> Coder:
    """The coder of a byte-level BPE vocabulary in a tokenizers JSON file. Its size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    raw = lambda s: bytes(letter[c] for c in s)
    tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letter for c in t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Coder(TokenAutomaton(tokens, [(raw(a), raw(b)) for a, b in pairs]), {t["content"]: t["id"] for t in spec["added_tokens"]})


def _digest(s: bytes) -> str:
    return hashlib.sha256(s).hexdigest()


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded text for each row; with_ids adds the ids and the decoded text.
    The coder is compiled once, on the driver, and broadcast: its size is that of the vocabulary, whatever the input."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(vocabulary))

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, digits = shared.value, names
        columns: list[list] = [[], [], [], [], []]
        if not digits:
            digits.update((i, str(i)) for i in coder.labels)
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text)
            decoded = coder.decode(ids)
            row = (len(ids), _digest(",".join(map(digits.__getitem__, ids)).encode()), _digest(decoded.encode("utf-8", "surrogatepass")))
            for column, x in zip(columns, (*row, ids, decoded) if with_ids else row, strict=False):
                column.append(x)
        kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]
        fields = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], fields[: 1 + len(kinds)])

    names: dict[int, str] = {}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_batches(rows, coded, schema).withColumnRenamed("_id", id_col)
