"""Sequences as numpy arrays inside tasks: what other operators work out base by base.

Rows come and go as Arrow batches; Spark partitions them and adds up what tasks return. Symbols other than A, C, G and T are
one code of their own, so words that hold them are told apart from all others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqspark.functions import seq as S

WORD = 6
#: Code of a symbol that is no base, and of a word that holds one.
NONE, OTHER = 4, 4**WORD
#: Starts of words that are worked on at once; sums of counts that a task keeps for combinations of columns.
PIECE, HELD, ODD = 1 << 20, 256, 100_000

_CODE = np.full(256, NONE, np.uint8)
_CODE[np.frombuffer(S.BASES.encode(), np.uint8)] = range(4)
WORDS = np.array(["".join(S.BASES[k >> 2 * j & 3] for j in range(WORD - 1, -1, -1)) for k in range(OTHER)])


def points(seq: bytes) -> np.ndarray:
    """One number a character of UTF-8 text, 255 for all that are no ASCII."""
    if seq.isascii():
        return np.frombuffer(seq, np.uint8)
    return np.minimum(np.frombuffer(seq.decode().encode("utf-32-le"), "<u4"), 255).astype(np.uint8)


def letters(seq: bytes) -> np.ndarray:
    """Codes of the bases, NONE for any other character."""
    return _CODE[points(seq)]


def words(code: np.ndarray, size: int = WORD) -> np.ndarray:
    """Codes of all words of `size` bases, 4**size for those that hold another symbol."""
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, np.int16)
    out = code[:n].astype(np.int16)
    for k in range(1, size):
        out <<= 2
        out += code[k : k + n]
    bad = np.concatenate(([0], np.cumsum(code == NONE)))
    if bad[-1]:
        out[bad[size:] > bad[:-size]] = 4**size
    return out


def extend(rows: DataFrame, keep: list[str], more: str, body: Callable, *texts: str) -> DataFrame:
    """rows(keep, seq) as (keep, more): body takes a batch, whose columns of texts (seq by default) are UTF-8 bytes, and
    returns the numbers of the rows that its results belong to, and the columns of more."""
    texts = texts or ("seq",)
    fields = StructType.fromDDL(more).fields
    schema = StructType([rows.schema[c] for c in keep] + fields)
    names = schema.fieldNames()
    given = rows.select(*(c for c in keep if c not in texts), *(F.col(c).cast("binary").alias(c) for c in texts))

    def run(batches):
        for batch in batches:
            index, columns = body(batch)
            if len(index):
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(index, pa.int64())) for c in keep]
                kept = [x.cast(pa.string()) if c in texts else x for c, x in zip(keep, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=names)

    return given.mapInArrow(run, schema)


def column(batch, name: str = "seq") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def count_words(rows: DataFrame, use: list[str], period: int, find: Callable | None = None, more: str = "") -> DataFrame:
    """(use, [more], i, hexamer, n): how often every word of WORD letters starts at the places of each remainder by period, in
    rows(use, seq). Partial sums, a few from each task, which the caller adds up.

    find(code) gives, for each start of a word, a small number to count by as well (column `more`), negative where the word is not counted."""
    schema = StructType([rows.schema[c] for c in use] + StructType.fromDDL(f"{more}{', ' if more else ''}i int, hexamer string, n long").fields)
    names = schema.fieldNames()
    given = rows.where(F.col("seq").isNotNull()).select(*use, F.col("seq").cast("binary").alias("seq"))

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        wait: dict[tuple, list] = {}
        held, odd, types = 0, Counter(), None

        def settle():
            nonlocal wait, held
            for key, parts in wait.items():
                own = np.bincount(np.concatenate(parts), minlength=period * (OTHER + 1))
                sums[key] = sums[key] + own if key in sums else own
            wait, held = {}, 0

        def out():
            settle()
            for key, own in sums.items():
                at = np.flatnonzero(own)
                at = at[at % (OTHER + 1) < OTHER]
                if len(at):
                    yield batch_of([key] * len(at), at // (OTHER + 1), WORDS[at % (OTHER + 1)], own[at])
            if odd:
                yield batch_of([k for k, _, _ in odd], [i for _, i, _ in odd], [w for _, _, w in odd], list(odd.values()))
            sums.clear(), odd.clear()

        def batch_of(keys, i, word, n):
            own = [pa.array([k[j] for k in keys], t) for j, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*own, pa.array(i, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in use] + ([pa.int32()] if find else [])
            keys = zip(*(column(batch, c) for c in use), strict=True) if use else ((),) * batch.num_rows
            for key, seq in zip(keys, column(batch), strict=True):
                code = letters(seq)
                if len(code) < WORD:
                    continue
                bins = find(code) if find else None
                text = None
                for at in range(0, len(code) - WORD + 1, PIECE):
                    word = words(code[at : at + PIECE + WORD - 1]).astype(np.int32)
                    turn = (np.arange(len(word), dtype=np.int32) + at % period) % period if period > 1 else 0
                    other = np.flatnonzero(word == OTHER)
                    word += turn * (OTHER + 1)
                    if bins is None:
                        wait.setdefault(key, []).append(word)
                    else:
                        own = bins[at : at + len(word)]
                        for q in np.unique(own).tolist():
                            if q >= 0:
                                wait.setdefault((*key, q), []).append(word[own == q])
                    if len(other):
                        text = text or seq.decode()
                        for j in other.tolist():
                            if bins is None or own[j] >= 0:
                                odd[key if bins is None else (*key, int(own[j])), (at + j) % period, text[at + j : at + j + WORD]] += 1
                    held += len(word)
                    if held > PIECE or len(wait) > HELD:
                        settle()
                if len(sums) > HELD or len(odd) > ODD:
                    yield from out()
        yield from out()

    return given.mapInArrow(run, schema)


def phase_sums(rows: DataFrame, keep: list[str], known: np.ndarray, logs: np.ndarray, turns: list[list[int]]) -> DataFrame:
    """(keep, s0, s1, ...): for each of turns the sum, over all words of a row's sequence, of logs[word, turn[i mod 3]], i the
    zero-based start. Words that are not known add nothing; rows without a known one are left out.

    known and logs have OTHER + 1 rows: a table of fixed size, which travels with the code."""
    table = np.where(known[:, None], logs, 0.0)

    def body(batch):
        index, sums = [], []
        for k, seq in enumerate(column(batch)):
            if seq is None or len(seq) < WORD:
                continue
            code, total, any_known = letters(seq), np.zeros((3, table.shape[1])), False
            for at in range(0, len(code) - WORD + 1, PIECE):
                word = words(code[at : at + PIECE + WORD - 1])
                any_known = any_known or bool(known[word].any())
                for r in range(3):
                    total[(at + r) % 3] += table[word[r::3]].sum(axis=0)
            if any_known:
                index.append(k)
                sums.append([sum(total[r, turn[r]] for r in range(3)) for turn in turns])
        values = np.array(sums, dtype=float).reshape(-1, len(turns))
        return index, [pa.array(values[:, m]) for m in range(len(turns))]

    return extend(rows, keep, ", ".join(f"s{m} double" for m in range(len(turns))), body)
