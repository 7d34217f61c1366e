import io
import struct
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import idfiles
from quillspark.llm.memo import Memo
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.tokens import MEMO_BYTES, _Bytes, _Words
from tests.llm.fixtures import hard_docs, hard_rows, no_docs

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoders():
    return {kind: kind(open(tokenizer_path(file), encoding="utf-8").read(), MEMO_BYTES)
            for kind, file in ((_Bytes, "byte_bpe_50k.json"), (_Words, "word_bpe_49k.json"))}


def library(encoder, text):
    return b"".join(i.to_bytes(4, "little") for i in encoder.tokenizer.encode(text or "", add_special_tokens=False).ids)


PARTS = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x85", "\x1c", "word", "Wörd", "it's", "'ll", "123", "1²", "!?", "日本語", "é", "é",
         "<|endoftext|>", "<|endoftext", "\U0001f600", "­", "ª", "_", "a", "İ", "ſ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_encoders_give_the_ids_of_the_library(encoders, text):
    for encoder in encoders.values():
        assert encoder.encode(text) == library(encoder, text)


def test_memo_keeps_what_comes_often():
    made = []
    memo = Memo(lambda k: made.append(k) or k.encode(), 100 * 240)
    for i in range(5000):
        assert memo["often"] == b"often" and memo[f"rare{i}"] == f"rare{i}".encode()
        assert (len(memo) + len(memo.old)) * memo.ENTRY <= 100 * 240
    assert made.count("often") == 1 and len(made) == 5001
    memo["x" * 1000]
    assert "x" * 1000 not in memo


def expected(rows, encoder):
    docs = [(doc, text, library(encoder, text) + b"\0\0\0\0") for doc, text in rows]
    out = []
    for doc, _, ids in docs:
        out.append((doc, len(ids) // 4, zlib.crc32(ids)))
    return out


def test_hard_rows_round_trip(spark, encoders):
    rows = [(r[0], r[1]) for r in hard_rows()]
    want = expected(rows, encoders[_Bytes])
    for small in (dict(), dict(frame_bytes=400, file_bytes=40_000, file_docs=4)):
        manifest = idfiles.write_files(hard_docs(spark), PATH, **small)
        got = sorted(idfiles.read_all(manifest).collect(), key=lambda r: r["start"])
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in got]
        assert order == sorted(order)


def test_only_the_frames_of_wanted_documents_are_read(spark, encoders):
    rows = [(i, f"text {i} " * 60) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = idfiles.write_files(docs, PATH, frame_bytes=2000)
    index = idfiles.document_index(manifest)
    wanted = spark.createDataFrame([(7,), (251,), (499,), (10_000,), (None,)], "doc_id long, file string".replace(", file string", ""))
    got = idfiles.read_documents(index, wanted).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library(encoders[_Bytes], rows[i][1]) + b"\0" * 4 for i in (7, 251, 499)}
    assert max(r["frames_read"] for r in got) <= 6 and manifest.agg({"tokens": "sum"}).first()[0] * 4 > 100_000


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def close(self):
        pass


def written(docs, frame_bytes):
    out = _File()
    w = idfiles.FrameWriter(out, frame_bytes)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    return out.getvalue()


def test_format_is_plain_zstandard_with_checksums():
    docs = [(i, struct.pack("<I", i) * (i % 50 + 1)) for i in range(200)] + [(None, b"\1\0\0\0" * 3000)]
    data = written(docs, 1000)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(ids for _, ids in docs)
    reader = idfiles.FrameReader(_File(data))
    null, ids, n = reader.index()
    assert null.sum() == 1 and list(n) == [len(x) // 4 for _, x in docs] and reader.frames_read == 0
    damaged = bytearray(data)
    damaged[-9 - 4] ^= 1  # the last checksum of the seek table
    with pytest.raises(ValueError, match="checksum"):
        list(idfiles.FrameReader(_File(bytes(damaged))).pieces(int(n.sum()) - 1, 1))
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(idfiles.FrameReader(_File(bytes(damaged))).pieces(0, 1))
    with pytest.raises(ValueError, match="seek table"):
        idfiles.FrameReader(_File(data[:-1]))


def test_no_documents(spark):
    assert idfiles.token_files(no_docs(spark), PATH).collect() == []
