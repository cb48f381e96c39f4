import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framewise.llm import queries, token_file

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_can_be_addressed():
    ids = np.random.default_rng(0).choice([0, 1, 255, 256, 50256, 70000, 2**31], 3000).astype(np.uint32)
    f = token_file.TokenFile(token_file.encode(ids, np.array([0, 10, 3000]), [7, None]))
    assert [f[i] for i in range(3000)] == ids.tolist()
    assert f.ids(1234, 2345).tolist() == ids[1234:2345].tolist() and f.document(0).tolist() == ids[:10].tolist()
    assert token_file.TokenFile(token_file.encode(np.zeros(0, np.uint32), np.array([0]), [])).ids(0, 0).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab.'s1 \n\t\x1c<|>", *"\xe9\x85\xa0\u2003\u2028\u3000\u1680\xdf\u0436\u6f22\ud55c\u3093\u2019\U0001f389\u0915", "<|endoftext|>"]), max_size=40).map("".join))
def test_pieces_give_the_ids_of_whole_texts(text):
    global ENCODER
    ENCODER = globals().get("ENCODER") or token_file.Encoder(PATH)
    ids, at = ENCODER(pa.array(["", text, None, "a b", text]))
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in ("", text, "", "a b", text)]
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(5)] == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    t, at, want = Tokenizer.from_file(PATH), 0, []
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op10_token_file(spark, SF).collect())) == want


def test_odd_rows_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_IDS", 5)
    rows = [(3, "x", 1), (None, None, 1), (1, "", 1), (1, "b c", 1), (1, "b c", 1), (2, "long text " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    written = token_file.write_tokens(docs, PATH)
    got = token_file.read_documents(written).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2, 3] and [r.n_tokens for r in got][:4] == [1, 1, 3, 3]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    nothing = token_file.write_tokens(docs.where("false"), PATH)
    assert nothing.count() == 0 and token_file.read_documents(nothing).count() == 0
