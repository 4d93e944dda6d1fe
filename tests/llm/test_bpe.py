import hashlib
import random

import cases
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.load(PATH)


def test_like_the_library(coder):
    rng, pieces = random.Random(7), ["a", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "12", "'s", "!", "<|endoftext|>", "<|endof", "日", "\x1c", "\x85", "🙂", "Ⅷ", "zzzz"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    library = Tokenizer.from_file(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert ids == want.ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_automaton_by_merging():
    merges = [(b"a", b"b"), (b"ab", b"a"), (b"b", b"a"), (b"aba", b"b"), (b"a", b"a"), (b"aa", b"aa"), (b"c", b"ab")]
    tokens = {x: i for i, x in enumerate([b"a", b"b", b"c", *(u + v for u, v in merges)])}
    automaton = bpe.TokenAutomaton(tokens, merges)
    rank = {m: i for i, m in enumerate(merges)}

    def merged(word):
        parts = [bytes([b]) for b in word]
        while found := [rank[p] for p in zip(parts, parts[1:], strict=False) if p in rank]:
            best, out, i = merges[min(found)], [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(tokens[p] for p in parts)

    rng = random.Random(1)
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert automaton.encode(word) == merged(word), word


def test_table(spark, coder):
    rows = bpe.encode_decode(cases.docs(spark), PATH, with_ids=True).collect()
    assert len(rows) == len(cases.TEXTS)
    for r, (key, text, _) in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0, r["decoded"])), sorted(cases.TEXTS, key=lambda x: (x[0] or 0, x[1] or "")), strict=True):
        assert r["doc_id"] == key and r["decoded"] == (text or "") and list(r["ids"]) == coder.encode(text) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(cases.empty(spark), PATH).count() == 0
