"""Token ids as Parquet list columns that can be read selectively.

Documents are dealt out by ranges of doc_id and sorted inside each range; every range becomes one
file. Token ids are dictionary-encoded (16 bits an id for vocabularies below 65,536), the integer
columns beside them delta-encoded (Parquet format 2), row groups and pages have fixed sizes and
carry column and offset indexes, so that a reader takes single columns, row groups or pages.

Defined results for odd rows: a null or empty text is one end id; a null doc_id comes first;
repeated doc_ids are ordered by a hash of the text; other columns are ignored; an empty table gives no rows.
Texts of any length are encoded whole: they are taken in pieces cut at ASCII white space, where
this tokenizer never joins characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.common import new_path

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2000
#: Bytes of text that are split at once; distinct pieces remembered by one Python worker.
PIECE_BYTES, WORDS_KEPT = 1 << 19, 500_000
#: Bits for the number of token ids of one piece of text; a text has fewer than 2**31 bytes, and so has each piece.
SIZE_BITS = 31
TOKENIZER = "word_bpe_49k.json"
FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"

_SPACE = re.compile(rb"[ \t-\r]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(data: bytes, size: int = PIECE_BYTES):
    """data cut at ASCII white space into pieces of about size bytes."""
    at = 0
    while len(data) - at > size:
        found = _SPACE.search(data, at + size)
        if not found:
            break
        yield data[at : found.start()]
        at = found.end()
    yield data[at:]


#: Lower case within Latin-1, and what the tokenizer splits lower-case Latin-1 text into.
_LOWER = bytes(ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in map(chr, range(256)))
_LETTERS = "".join(re.escape(c) for c in map(chr, range(256)) if c.isalpha()).encode("latin-1")
_NUMBERS = "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "N").encode("latin-1")
_TOKENS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTERS + rb"]+|[" + _NUMBERS + rb"]|[^ \t-\r\x85\xa0" + _LETTERS + _NUMBERS + rb"]+")
#: How byte-level tokenizers write a byte: visible Latin-1 characters stand for themselves, the others follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([*_VISIBLE, *sorted(set(range(256)) - set(_VISIBLE))], map(chr, [*_VISIBLE, *range(256, 512 - len(_VISIBLE))]), strict=True))


#: How the tokenizers that this splitting is for normalize and split.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Places(dict):
    """key -> where its token ids are in the pool, start and size in one number; ids_of finds those of a new key."""

    def __init__(self, ids_of) -> None:
        self.ids_of = ids_of
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pool = array("i")

    def __missing__(self, key: bytes) -> int:
        ids = self.ids_of(key)
        place = len(self.pool) << SIZE_BITS | len(ids)
        self.pool.extend(ids)
        if len(key) < 64:
            self[key] = place
        return place

    def ids(self, keys: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT or len(self.pool) > 8 * WORDS_KEPT:
            self.forget()
        if not keys:
            return np.empty(0, np.int32)
        places = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        for i in np.nonzero(places < 0)[0].tolist():
            places[i] = self[keys[i]]
        sizes = places & ((1 << SIZE_BITS) - 1)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat((places >> SIZE_BITS) - ends + sizes, sizes)
        return np.frombuffer(self.pool, np.int32)[at]


class TextEncoder:
    """Token ids of texts, the same as the tokenizer's own, with remembered pieces.

    Latin-1 text is split by the tokenizer's pattern, and its model encodes each distinct piece
    once. Text with other characters, or with what may be a special token, is split at ASCII white
    space only, and the tokenizer encodes each distinct word. Both hold for tokenizers that
    normalize and split as KNOWN says; any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        stated = json.loads(self.tokenizer.to_str())
        self.known = all(stated[k] == v for k, v in KNOWN.items())
        self.tokens, self.words = _Places(self._token_ids), _Places(self._word_ids)

    def _token_ids(self, token: bytes) -> list[int]:
        text = token.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = "".join(map(_BYTE_CHARS.__getitem__, text.encode()))
        return [x.id for x in self.model.tokenize(text)]

    def _word_ids(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, data: bytes) -> np.ndarray:
        """Token ids (int32) of UTF-8 text."""
        if not self.known:
            return np.array(self._word_ids(data), np.int32)
        out = [self._encode_piece(x) for x in pieces(data)]
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _encode_piece(self, data: bytes) -> np.ndarray:
        if b"<|" not in data:
            try:
                plain = data if data.isascii() else data.decode().encode("latin-1")
                return self.tokens.ids(_TOKENS.findall(plain.translate(_LOWER)))
            except UnicodeError:
                pass
        return self.words.ids(data.split())


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) as FILE_SCHEMA, in ascending order of doc_id over the partitions."""
    path = tokenizer or default_tokenizer()

    def encode(batches):
        words, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                size, rows, till = 0, [], at
                while till < len(texts) and size < 8 * PIECE_BYTES:
                    text = texts[till].as_py() or b""
                    rows += [words.encode(text), [end_id]]
                    size, till = size + len(text), till + 1
                counts = np.array([len(x) + 1 for x in rows[::2]], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                values = np.concatenate(rows).astype(np.int32)
                n = till - at
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n).cast(pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start, at = start + int(offsets[-1]), till

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Ranges by id, hash of the text and row: many equal or null ids are split, even with equal texts.
    rows = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA)


def write_tokens(encoded: DataFrame, path: str) -> None:
    """Write FILE_SCHEMA rows with the encodings, row groups and pages that the module states."""
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    encoded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with start counted over all files in place of start_in_part.

    Only the part and n_tokens columns are read for the starts of the parts; that table has one
    row per file, which bounds what is broadcast.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """Per row of read_tokens(): doc_id, start, n_tokens (counted again) and ids_crc32."""

    def check(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            values = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Encode, write and read again; checksums() of what the files hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(encode_documents(docs, tokenizer), path)
    return checksums(read_tokens(spark, path))
