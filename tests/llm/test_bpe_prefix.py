import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import bpe_prefix
from noticelake.llm.queries import BYTE_TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))


def awkward_texts():
    rng = random.Random(1)
    signs = " aeti'snx\n\t é中1²½ ,.#<|>\x1c\x85​"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    wide = [*range(32, 127), *range(0xA0, 0x3000), *range(0x10000, 0x11000)]
    out += ["".join(map(chr, rng.choices(wide, k=40))) for _ in range(500)]
    out += ["x" + chr(c) + " " + chr(c) + "1 " + chr(c) * 2 + " a" for c in range(0, 0x3100)]
    out += ["a" * 9_000, "ab" * 3_000, " " * 3_000, "a  b   c \n d\n\n e ", "-" * 999, "the the the" * 2_000]
    out += ["<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "it's we'll I'd'v 's", ""]
    return out


def test_ids_and_texts_equal_the_library(library):
    docs = awkward_texts()
    known = bpe_prefix.PrefixEncoder(tokenizer_path(BYTE_TOKENIZER))
    found = known.encode(docs)
    for text, ids, want in zip(docs, found, library.encode_batch(docs, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert known.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_forgetting_words_changes_nothing():
    docs = awkward_texts()[:600]
    path = tokenizer_path(BYTE_TOKENIZER)
    small, large = bpe_prefix.PrefixEncoder(path, limit=10), bpe_prefix.PrefixEncoder(path)
    assert [i for at in range(0, 600, 7) for i in small.encode(docs[at : at + 7])] == large.encode(docs)


def test_rows(spark, docs, rows, library):
    path = tokenizer_path(BYTE_TOKENIZER)
    clashing = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("decoded", F.lit("x"))
    found = sorted(bpe_prefix.encode_texts(clashing, path, decode=True).collect(), key=str)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), bytearray(np.array(ids, "<u4").tobytes()), r[1] or ""))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    back = bpe_prefix.decode_ids(bpe_prefix.encode_texts(docs, path), path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)


def test_empty_table_and_unreadable_ids(spark, no_docs):
    path = tokenizer_path(BYTE_TOKENIZER)
    assert bpe_prefix.encode_texts(no_docs, path, decode=True).count() == 0
    given = spark.createDataFrame([(1, None), (2, np.array([999_999, 64], "<u4").tobytes())], "doc_id long, ids binary")
    assert sorted(map(tuple, bpe_prefix.decode_ids(given, path).collect())) == [(1, ""), (2, "a")]


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_prefix.PrefixEncoder(tokenizer_path("word_bpe_49k.json"))
    with open(tokenizer_path(BYTE_TOKENIZER), encoding="utf-8") as file:
        plan = json.load(file)
    plan["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(plan), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe_prefix.PrefixEncoder(str(tmp_path / "v.json"))


def test_automaton_knows_all_substrings():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    automaton = bpe_prefix.SuffixAutomaton()
    for s in strings:
        automaton.add(s)

    def known(s):
        state = 0
        for b in s:
            if (state := automaton.go.get(state << 8 | b)) is None:
                return False
        return True

    inner = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert all(map(known, inner))
    others = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(500)} - inner
    assert not any(map(known, others))
