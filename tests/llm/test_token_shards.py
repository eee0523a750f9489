import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scorewell.llm import token_shards, word_ids
from scorewell.llm.queries import token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, docs, rows):
    made = Tokenizer.from_file(PATH)
    got = sorted(token_digests(spark, docs).collect(), key=lambda r: r.start)
    ids = lambda t: made.encode(t or "", add_special_tokens=False).ids + [2]
    digest = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted(((i, len(x), digest(x)) for i, x in ((r[0], ids(r[1])) for r in rows)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("text", ["a  b", "a   b\n\n c", "x<|endoftext|> y  <|endoftext|>", " \t lead", "it's 'll\r\n\r\n end  ", "é😀 q"])
def test_pieces_equal_whole_text(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_ids.encoder(PATH).encode(pa.array([text]))[0], "<u4").tolist() == whole


def test_unknown_keys_give_no_row(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_shards.write_shards(docs, folder, PATH, 2)
    keys = spark.createDataFrame([(10**9 + i,) for i in range(2000)] + [(1,), (1,)], "doc_id long")
    assert [r.key for r in token_shards.read_documents(spark, folder, keys).collect()] == [1]


def test_empty_table(spark, empty):
    assert token_digests(spark, empty).collect() == []


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 5000))
    taken, starts, slots = token_shards.build_hash(h1, h2)
    assert sorted(slots.tolist()) == list(range(5000))
    found = token_shards.find_slots(taken, starts, np.cumsum(taken) - taken, h1, h2)
    assert (found == slots).all()
