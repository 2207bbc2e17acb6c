import zlib
from array import array

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noticelake.llm import token_orc
from noticelake.llm.queries import tokenizer_path

TRICKY = [
    "",
    " ",
    "don't they'll SAY 's 't ...",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>",
    "Ünïcode ÀÉß ẞ İstanbul K ﬁne ét́ ́x",
    "12,345.67 x1y2 (a) a.b a., word!?! ΑΣ ΑΣ. 東京  nb sp \x1c\x85",
    "a" * 3000,
    "....,,,;;;::::!!!! " + "x" + "." * 20,
]


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_words_apart_equal_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts = TRICKY + [t or "" for t in given]
    words = token_orc.WordIds(tokenizer_path(), limit=500)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for text, ids in zip(part, words.documents([t.encode() for t in part])):
            assert list(array("i", ids)) == whole(tokenizer, text), text[:80]


def test_files_hold_all_rows_in_order(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = f"file://{tmp_path}/tokens"
    clashing = docs.withColumns({"ids": F.lit("x"), "part": F.lit(1), "start": F.lit(None).cast("string")})
    token_orc.write_tokens(clashing, path, tokenizer_path(), stripe_bytes=1 << 20)
    tokens = token_orc.read_tokens(spark, path)
    found = sorted(token_orc.token_digests(tokens).collect(), key=lambda r: r["start"])
    assert len(found) == len(rows)
    start, ids = 0, [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(array("i", [*whole(tokenizer, r[1] or ""), 1]))
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(a), zlib.crc32(a.tobytes())) for a in by_id[r["doc_id"]]}
    one = token_orc.read_tokens(spark, path, F.col("doc_id") == 900).collect()
    assert [r["ids"] for r in one] == [list(by_id[900][0])]


def test_no_documents(spark, no_docs, tmp_path):
    path = f"file://{tmp_path}/none"
    token_orc.write_tokens(no_docs, path, tokenizer_path())
    assert token_orc.token_digests(token_orc.read_tokens(spark, path)).count() == 0


def test_plain_words_skip_the_steps_before_the_model(monkeypatch):
    words = token_orc.WordIds(tokenizer_path())
    whole = token_orc.WordIds._encode
    asked = []
    monkeypatch.setattr(token_orc.WordIds, "_encode", lambda self, text: asked.append(text) or whole(self, text))
    plain = "well-known 3.14 (foo) a@b.org x86_64, ÄRGER-straße! café-2go ... \"end.\" 12,5% ~`|{}[]^\\ ÅK".split()
    odd = "it's o'clock ärger na×ve 日本 x\x01y x y İd ½ ŀa".split(" ")
    for text in plain + odd:
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert array("i", words.documents([text.encode()])[0]).tolist() == expected, text
    assert not {w.encode().lower() for w in plain} & set(asked)
    # Forgotten words come out the same.
    few = token_orc.WordIds(tokenizer_path(), limit=3)
    texts = [" ".join(plain), " ".join(odd), " ".join(plain)]
    assert few.documents([t.encode() for t in texts]) == words.documents([t.encode() for t in texts])
    assert len(few) < len(plain) + len(odd)
