import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import lodestone.llm.token_files as token_files_module
from lodestone.llm.token_files import Encoder, TokenFile, token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def brute(rows, plain):
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_round_trip(docs, plain, tmp_path):
    got = sorted(map(tuple, token_files(docs, f"file://{tmp_path}/t", PATH).collect()), key=str)
    assert got == brute(docs.collect(), plain)


def test_files_have_fixed_size_lists(docs, tmp_path):
    shards = write_token_files(docs.limit(50), f"file://{tmp_path}/t", PATH, length=64).collect()
    files = sorted(glob.glob(f"{tmp_path}/t/shard-*.arrow"))
    assert len(files) == len(shards) > 0
    total = 0
    for f in files:
        with pa.memory_map(f) as source:
            table = pa.ipc.open_file(source).read_all()
        assert table.schema == pa.schema([("ids", pa.list_(pa.uint16(), 64)), ("mask", pa.list_(pa.bool_(), 64))])
        total += sum(map(sum, table.column("mask").to_pylist()))
    assert total == sum(s["n_tokens"] for s in shards)


def test_odd_rows(odd, empty, plain, tmp_path):
    got = sorted(map(tuple, token_files(odd, f"file://{tmp_path}/o", PATH, length=7).collect()), key=str)
    assert got == brute(odd.collect(), plain)
    assert token_files(empty, f"file://{tmp_path}/e", PATH).count() == 0


def test_encoder_equals_the_library(plain):
    texts = [
        "a<|endoftext|>b", "it's  we'LL\n\n x\t\ty  ", "\x1c\x1d a\x85b\xa0c", "日本語 テキスト 😀", "Ünïcödé 'S 're", "", None,
        " ", " a", "a ", "a\n\nb c", "a\n b", "a \nb", "a\n \nb", "a\t\tb c\n", "a's 's b's x_y __ z", "1a2 b3c", "\n",
        "   ", "a\r\n\r\nb", "½ ² x² ª", "١٢٣ abc123def", "don't'll  's", "é ​ zero",
    ]
    encoder = Encoder(PATH)
    for text, got in zip(texts * 2, encoder(texts * 2)):
        assert got.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_on_random_texts(plain, monkeypatch):
    monkeypatch.setattr(token_files_module, "CACHE_PIECES", 40)
    rng = random.Random(5)
    encoder = Encoder(PATH)
    for _ in range(40):
        texts = ["".join(rng.choices("ab'sté1²_. \n\t", k=rng.randint(0, 60))) for _ in range(20)]
        for text, got in zip(texts, encoder(texts)):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_have_a_limit_and_random_access(docs, plain, tmp_path):
    rows = docs.limit(120).collect()
    frame = docs.sparkSession.createDataFrame(rows, docs.schema).select("doc_id", "text")
    got = sorted(map(tuple, token_files(frame, f"file://{tmp_path}/r", PATH, length=16, file_tokens=3000).collect()), key=str)
    want = brute(rows, plain)
    assert got == want
    files = sorted(glob.glob(f"{tmp_path}/r/shard-*.arrow"))
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in rows}
    assert len(files) > 8
    allocated = pa.total_allocated_bytes()
    for f in files:
        tokens = TokenFile(f"file://{f}")
        with pa.memory_map(f.replace("shard-", "docs-")) as source:
            listed = pa.ipc.open_file(source).read_all().to_pylist()
        assert sum(d["n"] for d in listed[:-1]) < 3000
        for d in listed:
            assert np.concatenate(list(tokens.pieces(d["start"], d["n"]))).tolist() == ids[d["doc_id"]]
        flat = [x for d in listed for x in ids[d["doc_id"]]]
        for k in range(-(-len(flat) // 16)):
            own, mask = tokens.sequence(k)
            assert own[mask].tolist() == flat[16 * k : 16 * k + 16]
    first = TokenFile(f"file://{files[0]}")
    view, _ = first.sequence(0)
    # A view on the mapped file owns no memory.
    assert not view.flags.owndata and pa.total_allocated_bytes() - allocated < 1 << 20
