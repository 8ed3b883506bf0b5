import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from riskloom.llm import common, packing, rans, token_store, tokens

ODD = [
    "Hello World's don't DON'T it's ''s <|endoftext|> <|ENDOFTEXT|> abc<|endoftext|>",
    "x1y22z 3.14 éÉßÿ×÷œŒ Ñandú,. “quoted” — naïve naïve",
    "",
    None,
    " \t\n ",
    "aaaa" * 30,
    "\x1c a\x1cb a b a b \x85x",
    "日本語 テキスト Привет МИР İstanbul ΣΑΣ",
    "a.b c,d !!! ***word*** word*** (x) [y] {z}~`^_-+=|\\/@#$%&",
    "ABC!! THE%%% Ünïcödé ÀÉÎ ð Ð þ Þ café, élan!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def texts(n=400):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéèüßñABCDEF"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", "", ".", ",", "!!", "'s", "9"])
    return ODD + [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 500)  # the table is emptied on the way
    coder, all_ = tokens.Encoder(tokens.vocabulary_path()), texts()
    for at in range(0, len(all_), 50):
        part = all_[at : at + 50]
        flat, counts = coder.encode(pa.array(part, pa.string()))
        ends = np.cumsum(counts)
        for t, end, n in zip(part, ends, counts, strict=True):
            assert flat[end - n : end].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_vocabulary_that_keeps_space():
    coder = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"), drops_space=False)
    flat, counts = coder.encode(pa.array(["a b  c", None, ""]))
    assert counts.tolist()[1:] == [0, 0]
    assert flat.tolist() == Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json")).encode("a b  c", add_special_tokens=False).ids


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    data = np.minimum(rng.geometric(0.01, 300_000), 4999).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(data, minlength=5000))
    assert table.freq.sum() == 1 << rans.SCALE_BITS
    for part in (data, data[:1], data[:63], data[:1000], data[:0]):
        assert np.array_equal(rans.decode_block(rans.encode_block(part, table), table), part)
    p = np.bincount(data) / len(data)
    bits = -np.sum(p[p > 0] * np.log2(p[p > 0]))
    assert 8 * len(rans.encode_block(data, table)) / len(data) < bits * 1.05
    broken = bytearray(rans.encode_block(data[:5000], table))
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bytes(broken), table)
    one = rans.Table.of_counts(np.array([0, 7]))
    assert np.array_equal(rans.decode_block(rans.encode_block(np.ones(500, int), one), one), np.ones(500))
    assert np.array_equal(rans.Table.from_bytes(table.to_bytes()).freq, table.freq)
    skewed = rans.Table.of_counts(np.concatenate(([10**9], np.ones(40_000, int))))
    assert skewed.freq.min() == 1 and skewed.freq.sum() == 1 << rans.SCALE_BITS


def test_store(spark, messy, pairs, empty, library, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    files = token_store.write_store(messy, folder)
    rows = token_store.read_store(spark, folder, files).orderBy("start").collect()
    assert len(rows) == len(pairs)
    ids = [r.id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and ids[:2] == [None, None]
    start, by = 0, {}
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
        by.setdefault(r.id, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for i, t in pairs:
        assert [*library.encode(t or "", add_special_tokens=False).ids, 1] in by[i]
    listed = files.collect()
    table = rans.Table.from_bytes(token_store.get(f"{folder}/table.rtb"))
    source = token_store.TokenFile(token_store.get(listed[0].path), table)
    assert source.tokens == sum(len(source.block(i)) for i in reversed(range(len(source.checkpoints))))
    none = token_store.write_store(empty, f"{tmp_path}/none")
    assert none.count() == 0 == token_store.read_store(spark, f"{tmp_path}/none", none).count()


def test_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 300)
    df = spark.createDataFrame([(i * 3 % 101, f"text number {i} " * (i % 9)) for i in range(101)], "doc_id long, text string").repartition(4)
    files = token_store.write_store(df, f"{tmp_path}/s")
    assert files.count() > 3
    rows = token_store.read_store(spark, f"{tmp_path}/s", files).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(101))
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])[:-1])).tolist()


def test_packing(spark, messy, pairs, empty, library):
    rows = packing.pack(messy, longest=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == 2**r.bucket <= 64 and len(r.ids) == 4 * r.length for r in rows)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs)
    assert sum(r.length for r in rows) == total
    for i, t in pairs:
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i and r.doc_tokens == len(want)), key=lambda r: r.start)
        starts = {r.start: r for r in own}
        assert sum(r.length for r in starts.values()) == len(want)
        assert np.frombuffer(b"".join(r.ids for r in starts.values()), "<u4").tolist() == want
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(1) == [1]
    first = packing.digest(packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))).first()
    assert first.ids_crc32 == zlib.crc32(np.array([*library.encode("a b", add_special_tokens=False).ids, 2][:2], "<u4").tobytes())
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(empty, longest=100)


def test_workers_get_small_batches_unless_the_session_names_a_size(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(64, numPartitions=1).selectExpr("id", "repeat('long text ', 1000) AS text")

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    def sizes():
        return [r.n for r in rows.mapInArrow(largest, "n bigint").collect()]

    try:
        spark.conf.unset(key)
        monkeypatch.setattr(common, "ARROW_BYTES", 100_000)
        common.workers_ready(spark)
        small = sizes()
        assert sum(small) == 64 and max(small) <= 12
        spark.conf.set(key, "64m")
        common.workers_ready(spark)
        assert sizes() == [64]
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
