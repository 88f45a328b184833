import zlib
from collections import Counter

import numpy as np
import pytest

from scriptoria.llm import token_shards as T
from scriptoria.llm.common import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_whole_encoding(tokenizer, odd_texts):
    own = T.Encoder(PATH)
    odd = ["", "a  b", " a", "a ", "a\tb", "x y", "don't stop 's\nit's", "<|endoftext|> a", "a <|endoftext|>", "naïve café, été.", "1,2 3.\n4", "日本 語。 x", "a\r\nb", "é x́.", "ǅ ʰ a, ²,", "a.\n\nb", "\n", "x.,y ... a,, ,.", "a\x1cb c", "a\x85b", "🙂 🙂, a"]
    for text in [*odd, *[t for _, t, _ in odd_texts if t]]:
        assert own(text) == ids(tokenizer, text)[:-1].tobytes(), text[:50]


def test_table(spark, odd_docs, odd_texts, tokenizer):
    rows = [tuple(r) for r in T.token_table(spark, odd_docs, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted([d for d, *_ in odd_texts], key=lambda d: (d is not None, d))
    start, seen = 0, Counter()
    for doc, at, n, crc in rows:
        assert at == start
        start += n
        seen[doc, n, crc] += 1
    assert seen == Counter((d, len(x := ids(tokenizer, t)), zlib.crc32(x.tobytes())) for d, t, _ in odd_texts)


def test_empty(spark, no_docs):
    assert T.token_table(spark, no_docs, PATH).count() == 0


def test_keyed_reads_over_small_segments(spark, tokenizer):
    docs = spark.createDataFrame([(i * 3, f"text number {i}\nof some words") for i in range(300)] + [(30, "again"), (None, "no id")], "doc_id long, text string")
    path = new_path(spark, "shards")
    T.write_token_shards(docs, path, PATH, segment_tokens=100)
    assert spark.read.parquet(path).count() > 20
    got = T.read_ids(spark, path, [0, 30, 31, 897, None])
    assert got[0] == [ids(tokenizer, "text number 0\nof some words").tolist()]
    assert sorted(got[30]) == sorted([ids(tokenizer, "again").tolist(), ids(tokenizer, "text number 10\nof some words").tolist()])
    assert got[31] == [] and len(got[897]) == 1 and len(got[None]) == 1


def test_minimal_perfect():
    keys = [f"key {i}" for i in range(20_000)]
    lengths = np.arange(20_000) % 7
    index = T.HashIndex.from_bytes(T.HashIndex.build(keys, lengths).to_bytes())
    h, _ = T.key_hash(keys)
    assert sorted(index.slots(h).tolist()) == list(range(20_000))
    at, n = index.find(keys)
    assert (n == lengths).all() and (at == np.cumsum(lengths) - lengths).all()
    at, _ = index.find([f"other {i}" for i in range(10_000)])
    assert (at == -1).all()
    with pytest.raises(ValueError):
        T.HashIndex.build(["a", "a"], np.array([1, 1]))
