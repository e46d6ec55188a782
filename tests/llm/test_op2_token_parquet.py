import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import xxhash

from seqspark.llm import token_parquet as tp

TEXTS = [None, "", "  \n", "It's the END, isn't it?!", "don't 're x'small !!'s É É naïve—well ΑΣ. İx", "<|endoftext|> a<|startoftext|>.", "tab\tand\x1cother spaces", "word " * 3000, "x" * 5000, "a.b,c;d 123,456.78 #tag&&& ...", "It's the END, isn't it?!"]


def brute(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tp.default_tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, tp.END_ID] for t in texts]


def test_encoder_equals_the_library(monkeypatch):
    encoder = tp.TextEncoder(tp.default_tokenizer())
    for text, ids in zip(TEXTS, brute(TEXTS), strict=True):
        assert encoder.encode((text or "").encode()).tolist() == ids[:-1]
    monkeypatch.setattr(tp, "PIECE_BYTES", 10)
    assert b" ".join(tp.pieces(b"aa bb cc dd ee ff gg", 5)) == b"aa bb cc dd ee ff gg"


def test_files_and_checksums(spark, tmp_path):
    rows = [(None if i == 4 else 100 - 7 * i, t, i) for i, t in enumerate(TEXTS)] + [(2, "tie b", 0), (2, "tie a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [tuple(r) for r in tp.round_trip(docs, str(tmp_path / "t")).orderBy("start").collect()]
    tie = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))  # noqa: E731  Spark's hash
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    start, want = 0, []
    for (doc_id, _, _), ids in zip(order, brute([t for _, t, _ in order]), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    meta = pq.ParquetFile(glob.glob(str(tmp_path / "t/*.parquet"))[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and columns["ids.list.element"].has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and columns["doc_id"].has_column_index


def test_one_unbroken_text_of_many_tokens():
    text = "".join(chr(0x4E00 + k * 7 % 20_000) for k in range(1_700_000))
    (ids,) = brute([text])
    assert len(ids) > 1 << 22
    assert np.array_equal(tp.TextEncoder(tp.default_tokenizer()).encode(text.encode()), ids[:-1])


def test_rows_that_are_equal_fall_into_several_files(spark, tmp_path):
    docs = spark.range(4000).selectExpr("CAST(NULL AS long) doc_id", "'one text for all rows' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tp.write_tokens(tp.encode_documents(docs), str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tp.TextEncoder(path)
    assert not own.known and tp.TextEncoder(tp.default_tokenizer()).known
    for text in ("Two  blanks, Capitals\n\nand lines", "naïve Σ", ""):
        assert own.encode(text.encode()).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_rows_of_one_id_fall_into_several_files(spark, tmp_path):
    docs = spark.range(4000).selectExpr("CAST(NULL AS long) doc_id", "concat(id * 7919 % 4000, ' words') text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tp.write_tokens(tp.encode_documents(docs), str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 1
    got = tp.read_tokens(spark, str(tmp_path / "t")).orderBy("start").select("start", "n_tokens").collect()
    assert len(got) == 4000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_empty_table(spark):
    assert tp.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
