"""Exon structures: splicing, introns, phases, trimming, and features for gene finders.

exons(gene, contig_id, strand, exon_no, start, stop, ...): one-based, in transcript order; on the minus
strand start is larger than stop."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqspark.functions import seq as S
from seqspark.sources.fasta import contig_store

MIN_INTRON, MAX_INTRON, SHRINK = 41, 350_000, 15
GRAMMAR = "^exonpart,start,(intronpart,dss,ass,exonpart,)*stop$"


def exon_length() -> Column:
    return F.abs(F.col("stop") - F.col("start")) + 1


def ordered(exons: DataFrame) -> DataFrame:
    """exons with exon_no by place: ascending on the plus strand, descending on the minus strand."""
    place = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    return exons.withColumn("exon_no", F.row_number().over(Window.partitionBy("gene").orderBy(place, "stop")))


def structure_ordered(exons: DataFrame) -> DataFrame:
    """(gene, ok): whether coordinates strictly advance in the strand's direction."""
    own = Window.partitionBy("gene").orderBy("exon_no")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    gap = (F.col("start") - F.lag("stop").over(own)) * sign
    fine = ((F.col("stop") - F.col("start")) * sign >= 0) & (F.coalesce(gap, F.lit(1)) > 0)
    return exons.withColumn("fine", fine).groupBy("gene").agg(F.bool_and("fine").alias("ok"))


def cds_length(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene").agg(F.sum(exon_length()).alias("cds_length"))


def introns(exons: DataFrame) -> DataFrame:
    """(gene, contig_id, strand, intron_no, start, stop): gaps between consecutive exons, by strand."""
    own = Window.partitionBy("gene").orderBy("exon_no")
    step = F.when(F.col("strand") == "-", -1).otherwise(1)
    rows = exons.withColumn("next", F.lead("start").over(own)).where("next IS NOT NULL")
    return rows.select("gene", "contig_id", "strand", F.col("exon_no").alias("intron_no"), (F.col("stop") + step).alias("start"), (F.col("next") - step).alias("stop"))


def exon_phase(exons: DataFrame) -> DataFrame:
    """exons with phase (bases before it, mod 3) and after, the phase that labels the next intron."""
    before = Window.partitionBy("gene").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(exon_length()).over(before), F.lit(0))
    return exons.withColumn("phase", F.pmod(done, F.lit(3)).cast("int")).withColumn("after", F.pmod(done + exon_length(), F.lit(3)).cast("int"))


#: Bases of a chunk of a contig, and how far it reaches into the next one.
CHUNK, OVERLAP = 12_288, 4_096


def with_slices(features: DataFrame, contigs: DataFrame, margin: int = 0) -> DataFrame:
    """features with piece, their bases on their strand, from contigs(contig_id, seq) or a contig_store() of them; null where
    start or stop lie outside the contig or there is no such contig.

    With margin the piece has up to so many bases more on either side, as far as the contig goes, and lead is the
    number of those before the feature on its strand. Slices meet the chunks of a contig, not the contig: its
    key is (contig_id, chunk_no), so a contig with very many features is many keys. A slice that is longer than
    a chunk's overlap is put together from several chunks."""
    store = contigs if "chunk_no" in contigs.columns else contig_store(contigs, CHUNK, OVERLAP)
    store = store.select("contig_id", "chunk_no", F.col("n").alias("__n"), F.col("seq").alias("__seq"))
    lo, hi = F.greatest(F.least("start", "stop") - margin, F.lit(1)), F.greatest("start", "stop") + margin
    rows = features.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
    long = F.col("__hi") - F.col("__lo") >= OVERLAP
    first = F.floor((F.col("__lo") - 1) / CHUNK).cast("int")
    extra = ["lead"] if margin else []

    def out(joined: DataFrame, piece: Column) -> DataFrame:
        end = F.least("__hi", "__n") if margin else F.col("__hi")
        inside = (F.least("start", "stop") >= 1) & (F.greatest("start", "stop") <= F.col("__n"))
        turned = F.when(F.col("strand") == "-", S.revcomp(piece)).otherwise(piece)
        lead = F.when(F.col("strand") == "-", end - F.greatest("start", "stop")).otherwise(F.least("start", "stop") - F.col("__lo"))
        named = {"piece": F.when(inside, turned), "lead": F.when(inside, lead.cast("int"))}
        return joined.select(*features.columns, *(named[c].alias(c) for c in ["piece", *extra]))

    at = (F.col("__lo") - F.col("chunk_no") * F.lit(CHUNK)).cast("int")
    size = (F.col("__hi") - F.col("__lo") + 1).cast("int")
    short = rows.where(~long).withColumn("chunk_no", first).join(store, ["contig_id", "chunk_no"], "left")
    short = out(short, F.substring("__seq", at, size))
    # Long slices: one row for each chunk, the chunks' own bases joined in order; equal rows count as often as they occur.
    some = rows.where(long).groupBy(*rows.columns).agg(F.count("*").alias("__copies"))
    keys = some.withColumn("chunk_no", F.explode(F.sequence(first, F.floor((F.col("__hi") - 1) / CHUNK).cast("int"))))
    begin = F.greatest(at, F.lit(1))
    till = F.least(F.col("__hi") - F.col("chunk_no") * F.lit(CHUNK), F.lit(CHUNK)).cast("int")
    part = F.struct("chunk_no", F.substring("__seq", begin, till - begin + 1).alias("s"))
    parts = keys.join(store, ["contig_id", "chunk_no"], "left").groupBy(*some.columns).agg(F.max("__n").alias("__n"), F.array_sort(F.collect_list(part)).alias("__parts"))
    parts = parts.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    whole = out(parts, F.array_join(F.transform("__parts", lambda p: p["s"]), ""))
    return short.union(whole)


def splice(exons: DataFrame, contigs: DataFrame) -> DataFrame:
    """(gene, seq): exon slices in transcript order; genes with a slice out of range are left out."""
    rows = with_slices(exons, contigs)
    parts = F.array_sort(F.collect_list(F.struct("exon_no", "piece")))
    grouped = rows.groupBy("gene").agg(parts.alias("parts"), F.count("piece").alias("found"), F.count("*").alias("n"))
    return grouped.where("found = n").select("gene", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("seq"))


def with_flanks(exons: DataFrame, up: int = S.FLANK + S.UPSTREAM, down: int = S.DOWNSTREAM + S.FLANK) -> DataFrame:
    """exons with the first one extended by up and the last one by down, in the strand's direction."""
    own = Window.partitionBy("gene")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    first, last = F.col("exon_no") == F.min("exon_no").over(own), F.col("exon_no") == F.max("exon_no").over(own)
    rows = exons.withColumn("__first", first).withColumn("__last", last)
    start = F.when(F.col("__first"), F.col("start") - sign * up).otherwise(F.col("start"))
    stop = F.when(F.col("__last"), F.col("stop") + sign * down).otherwise(F.col("stop"))
    return rows.select(*(c for c in exons.columns if c not in ("start", "stop")), start.alias("start"), stop.alias("stop"))


def trim_structure(exons: DataFrame, offset: Column | int, keep: Column | int) -> DataFrame:
    """exons cut to `keep` bases of the transcript after dropping `offset` from its 5' end."""
    offset, keep = (c if isinstance(c, Column) else F.lit(c) for c in (offset, keep))
    before = Window.partitionBy("gene").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = exons.withColumn("__t", F.coalesce(F.sum(exon_length()).over(before), F.lit(0)))
    lo = F.greatest(offset - F.col("__t"), F.lit(0))
    hi = F.least(offset + keep - F.col("__t"), exon_length()) - 1
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    rows = rows.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi")
    return rows.select(*(c for c in exons.columns if c not in ("start", "stop")), (F.col("start") + sign * F.col("__lo")).alias("start"), (F.col("start") + sign * F.col("__hi")).alias("stop"))


def genomic_position(exons: DataFrame, place: DataFrame) -> DataFrame:
    """place(gene, at), one-based in the transcript, as (gene, at, contig_id, position)."""
    before = Window.partitionBy("gene").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = exons.withColumn("__t", F.coalesce(F.sum(exon_length()).over(before), F.lit(0))).join(place, "gene")
    rows = rows.where((F.col("at") > F.col("__t")) & (F.col("at") <= F.col("__t") + exon_length()))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    return rows.select("gene", "at", "contig_id", (F.col("start") + sign * (F.col("at") - F.col("__t") - 1)).alias("position"))


def longest_orf(peptides: DataFrame, key: str) -> DataFrame:
    """(key, piece, begin_at): the longest stretch of peptide without a stop, the first on ties; begin_at is zero-based."""
    mark = F.split(F.translate("peptide", "-", "*"), r"\*")
    pieces = peptides.select(key, F.posexplode(mark).alias("k", "piece"), mark.alias("all"))
    at = F.aggregate(F.slice("all", F.lit(1), F.col("k")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    best = F.max_by(F.struct("piece", "begin_at"), F.struct(F.length("piece"), -F.col("k"))).alias("b")
    return pieces.withColumn("begin_at", at).groupBy(key).agg(best).select(key, "b.*")


def dedupe_sequences(seqs: DataFrame) -> DataFrame:
    """(seq, descr): one row per distinct sequence, descriptions joined in falling order."""
    joined = F.array_join(F.sort_array(F.collect_list("descr"), False), " AND ")
    return seqs.groupBy("seq").agg(joined.alias("descr"))


def sequence_classes(seqs: DataFrame) -> DataFrame:
    """seqs(descr, seq, ...) without seq, with first, the least description of an equal sequence, and copies, how many rows have it.

    Membership instead of one row a group: nothing is gathered, so a sequence may have any number of copies. Rows
    travel with the SHA-256 of their sequence, not with the sequence; null sequences are no copies of each other."""
    rest = [c for c in seqs.columns if c != "seq"]
    rows = seqs.select(*rest, F.sha2(F.col("seq").cast("binary"), 256).alias("__digest"))
    named = rows.where("__digest IS NOT NULL").groupBy("__digest").agg(F.min("descr").alias("__first"), F.count("*").alias("__copies"))
    # Only sequences with copies are joined: the others are their own first.
    again = named.where("__copies > 1")
    out = rows.join(again, "__digest", "left")
    return out.select(*rest, F.coalesce("__first", "descr").alias("first"), F.coalesce("__copies", F.lit(1)).alias("copies"))


def shrink_cds_part() -> tuple[Column, Column]:
    """Ends moved inwards by SHRINK; ends that would cross become the middle."""
    lo, hi = F.least("start", "stop"), F.greatest("start", "stop")
    cross, middle = lo + SHRINK > hi - SHRINK, F.expr("(start + stop) div 2")
    return F.when(cross, middle).otherwise(lo + SHRINK).cast("long"), F.when(cross, middle).otherwise(hi - SHRINK).cast("long")


def hints(exons: DataFrame) -> DataFrame:
    """(gene, feature, start, stop) in ascending coordinates: shrunk CDSpart per exon, introns of fit length."""
    lo, hi = shrink_cds_part()
    gaps = introns(exons).where((F.abs(F.col("stop") - F.col("start")) + 1).between(MIN_INTRON, MAX_INTRON))
    return exons.select("gene", F.lit("CDSpart").alias("feature"), lo.alias("start"), hi.alias("stop")).union(
        gaps.select("gene", F.lit("intronpart"), F.least("start", "stop"), F.greatest("start", "stop"))
    )


def _feature(place: Column, name: str, start: Column, stop: Column) -> Column:
    return F.struct(place.cast("int").alias("ord"), F.lit(name).alias("feature"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def anchors(exons: DataFrame, contigs: DataFrame) -> DataFrame:
    """(gene, ord, feature, start, stop): exonpart, start and stop where the codons are there, intronpart,
    dss and ass only at GT and AG; ord is the order along the gene."""
    own = Window.partitionBy("gene")
    rows = with_slices(exons, contigs).withColumn("last", F.max("exon_no").over(own)).where("piece IS NOT NULL")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    k = F.col("exon_no") * 10
    part = _feature(k, "exonpart", F.col("start"), F.col("stop"))
    begin = F.when((F.col("exon_no") == 1) & S.is_met(F.substring("piece", 1, 3)), _feature(k + 1, "start", F.col("start"), F.col("start") + 2 * sign))
    end = F.when((F.col("exon_no") == F.col("last")) & S.is_stop(F.expr("right(piece, 3)")), _feature(k + 2, "stop", F.col("stop") - 2 * sign, F.col("stop")))
    of_exons = rows.select("gene", F.explode(F.filter(F.array(part, begin, end), lambda x: x.isNotNull())).alias("x")).select("gene", "x.*")
    gaps = with_slices(introns(exons).where(F.abs(F.col("stop") - F.col("start")) >= 3), contigs).where("piece IS NOT NULL")
    k = F.col("intron_no") * 10
    part = _feature(k + 3, "intronpart", F.col("start"), F.col("stop"))
    donor = F.when(F.expr("left(piece, 2)") == "GT", _feature(k + 4, "dss", F.col("start"), F.col("start") + sign))
    acceptor = F.when(F.expr("right(piece, 2)") == "AG", _feature(k + 5, "ass", F.col("stop") - sign, F.col("stop")))
    of_gaps = gaps.select("gene", F.explode(F.filter(F.array(part, donor, acceptor), lambda x: x.isNotNull())).alias("x")).select("gene", "x.*")
    return of_exons.union(of_gaps)


def gene_grammar_ok(features: DataFrame) -> DataFrame:
    """(gene, ok): whether the features in order read as a whole gene; the grammar wants start after the first part."""
    states = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "feature"))), lambda x: x["feature"]), ",")
    return features.groupBy("gene").agg(states.alias("states")).select("gene", F.col("states").rlike(GRAMMAR).alias("ok"))


def sift(anchor_rows: DataFrame, hint_rows: DataFrame) -> DataFrame:
    """All anchors of genes whose anchors read as a whole gene, hints of the others."""
    good = gene_grammar_ok(anchor_rows).where("ok").select("gene")
    return anchor_rows.join(good, "gene", "left_semi").select("gene", "feature", "start", "stop").union(hint_rows.join(good, "gene", "left_anti").select("gene", "feature", "start", "stop"))


def splice_sites(exons: DataFrame, contigs: DataFrame, donor: str = "GT", acceptor: str = "AG", side: int = 50) -> DataFrame:
    """(gene, intron_no, terminal, site) of introns with the right ends: side + 2 + side bases around each."""
    gaps = introns(exons).where(F.abs(F.col("stop") - F.col("start")) >= 3)
    good = with_slices(gaps, contigs).where((F.expr("left(piece, 2)") == donor) & (F.expr("right(piece, 2)") == acceptor)).drop("piece")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    ends = F.array(
        F.struct(F.lit("donor").alias("terminal"), (F.col("start") - sign * side).alias("a"), (F.col("start") + sign * (side + 1)).alias("b")),
        F.struct(F.lit("acceptor").alias("terminal"), (F.col("stop") - sign * (side + 1)).alias("a"), (F.col("stop") + sign * side).alias("b")),
    )
    rows = good.withColumn("e", F.explode(ends)).select("gene", "contig_id", "strand", "intron_no", "e.terminal", F.col("e.a").alias("start"), F.col("e.b").alias("stop"))
    return with_slices(rows, contigs).where("piece IS NOT NULL").select("gene", "intron_no", "terminal", F.col("piece").alias("site"))


def phase_relabel(phase: Column) -> Column:
    """Phases 0, 1, 2 as 1, 2, 0."""
    return F.pmod(phase + 1, F.lit(3)).cast("int")


def _false_parts(exons: DataFrame, contigs: DataFrame, side: int) -> DataFrame:
    """(gene, kind, part, n, lead, piece) of exons and introns: n bases, in a slice with up to side more on either side."""
    parts = exon_phase(exons).select("gene", "contig_id", "strand", F.concat(F.lit("F"), F.col("phase").cast("string")).alias("kind"), F.col("exon_no").alias("part"), "start", "stop")
    gaps = introns(exons).where(F.abs(F.col("stop") - F.col("start")) >= 3)
    parts = parts.union(gaps.select("gene", "contig_id", "strand", F.lit("Fi"), "intron_no", "start", "stop"))
    rows = with_slices(parts, contigs, side).where("lead IS NOT NULL")  # null where the piece is, and cheaper to tell
    return rows.select("gene", "kind", "part", (F.abs(F.col("stop") - F.col("start")) + 1).cast("int").alias("n"), "lead", F.col("piece").cast("binary").alias("piece"))


def _false_hits(of_intron, n, lead, pieces, motifs: tuple[str, str], side: int):
    """(row, 0 donor or 1 acceptor, place, sites) of the false sites in pieces, a column of UTF-8 bytes; sites is a matrix of bytes,
    or a list of texts where symbols are not ASCII."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    plain = not len(data) or data.max() < 128
    texts = None if plain else [x.decode() for x in pieces.to_pylist()]
    if plain:
        begin, size = ends[:-1].astype(np.int64) - ends[0], np.diff(ends)
    else:
        data, size = np.concatenate([np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]), np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
    rows, kinds, places = [], [], []
    for kind, motif in enumerate(motifs):
        at = np.flatnonzero((data[:-1] == ord(motif[0])) & (data[1:] == ord(motif[1])))
        row = np.searchsorted(begin + size, at, side="right")
        local = at - begin[row]
        place = local - lead[row]
        fine = (place >= 0) & (place <= n[row] - 2) & (local - side >= 0) & (local + side + 2 <= size[row])
        fine &= ~(of_intron[row] & (place == (n[row] - 2 if kind else 0)))
        rows.append(row[fine]), kinds.append(np.full(int(fine.sum()), kind)), places.append(place[fine])
    row, kind, place = np.concatenate(rows), np.concatenate(kinds), np.concatenate(places)
    first = lead[row] + place - side
    if plain:
        return row, kind, place, data[(begin[row] + first)[:, None] + np.arange(2 * side + 2)] if len(row) else np.empty((0, 2 * side + 2), np.uint8)
    return row, kind, place, [texts[r][f : f + 2 * side + 2] for r, f in zip(row.tolist(), first.tolist(), strict=True)]


#: Bytes of slices whose sites are worked out at once; sites take a dozen times as many.
SLICE_BYTES = 1 << 21


def _ints(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _some(sizes):
    """Ranges of rows of about SLICE_BYTES in all."""
    step = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def false_splice_sites(exons: DataFrame, contigs: DataFrame, donor: str = "GT", acceptor: str = "AG", side: int = 50) -> DataFrame:
    """(gene, terminal, kind, part, at, site): every donor and acceptor dinucleotide inside an intron (kind Fi)
    or an exon (F0 to F2 by its phase) that is no true one, with side bases of the contig on either side.

    part is the number of the intron or exon, at the zero-based place in it on its strand. Motifs are found in
    a slice with its surroundings, so only hits become rows."""
    rows = _false_parts(exons, contigs, side)
    schema = StructType([rows.schema["gene"], *StructType.fromDDL("terminal string, kind string").fields, rows.schema["part"], *StructType.fromDDL("at int, site string").fields])
    terminals = np.array(["donor", "acceptor"])

    def run(batches):
        for whole in batches:
            for a, b in _some(np.array([len(x) for x in whole.column(5).to_pylist()])):
                batch = whole.slice(a, b - a)
                row, kind, place, sites = _false_hits(np.array(batch.column(1).to_pylist()) == "Fi", _ints(batch.column(3)), _ints(batch.column(4)), batch.column(5), (donor, acceptor), side)
                if not len(row):
                    continue
                if isinstance(sites, list):
                    texts = pa.array(sites, pa.string())
                else:
                    texts = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32) * (2 * side + 2)), pa.py_buffer(np.ascontiguousarray(sites)))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(terminals[kind], pa.string()), batch.column(1).take(at), batch.column(2).take(at), pa.array(place, pa.int32()), texts], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def false_site_digests(exons: DataFrame, contigs: DataFrame, donor: str = "GT", acceptor: str = "AG", side: int = 50) -> DataFrame:
    """(gene, terminal, kind, n, digest): number of false_splice_sites() and the MD5 of their texts, comma-joined by part and place.

    The slices of a gene come together, not its sites, which hold each base a dozen times."""
    rows = _false_parts(exons, contigs, side)
    genes = rows.groupBy("gene").agg(F.collect_list(F.struct("kind", "part", "n", "lead", "piece")).alias("parts"))
    schema = StructType([rows.schema["gene"], *StructType.fromDDL("terminal string, kind string, n long, digest string").fields])
    terminals = ("donor", "acceptor")

    def run(batches):
        for whole in batches:
            pieces = whole.column(1)
            ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            bytes_of = np.concatenate(([0], np.cumsum([len(x) for x in pieces.flatten().field(4).to_pylist()])))
            for a, b in _some(np.diff(bytes_of[ends])):
                batch = whole.slice(a, b - a)
                parts = batch.column(1).flatten()
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                names, of_kind = np.unique(np.array(parts.field(0).to_pylist(), dtype=str), return_inverse=True)
                row, terminal, place, sites = _false_hits(names[of_kind] == "Fi", _ints(parts.field(2)), _ints(parts.field(3)), parts.field(4), (donor, acceptor), side)
                if not len(row):
                    continue
                part = _ints(parts.field(1))[row]
                group = (owner[row] * 2 + terminal) * len(names) + of_kind[row]
                order = np.lexsort((place, part, group))
                group, part, place = group[order], part[order], place[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
                same = np.flatnonzero((np.diff(group) == 0) & (np.diff(part) == 0) & (np.diff(place) == 0))
                twice = set(np.searchsorted(cuts, same, side="right").tolist())  # groups in which a place comes twice: then by text
                if isinstance(sites, list):
                    listed = [sites[k].encode() for k in order.tolist()]
                    text = lambda x, y: b",".join(listed[x:y])  # noqa: E731, B023
                    each = lambda x, y: listed[x:y]  # noqa: E731, B023
                else:
                    width = 2 * side + 3
                    joined = np.full((len(order), width), ord(","), np.uint8)
                    joined[:, :-1] = sites[order]
                    flat = memoryview(joined).cast("B")
                    text = lambda x, y: flat[x * width : y * width - 1]  # noqa: E731, B023
                    each = lambda x, y: [bytes(flat[k * width : k * width + width - 1]) for k in range(x, y)]  # noqa: E731, B023
                out = []
                for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
                    if k in twice:
                        told = b",".join(t for *_, t in sorted(zip(part[x:y].tolist(), place[x:y].tolist(), each(x, y), strict=True)))
                    else:
                        told = text(x, y)
                    out.append(hashlib.md5(told).hexdigest())
                kept = group[cuts[:-1]]
                at = pa.array(kept // (2 * len(names)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([terminals[x] for x in (kept // len(names) % 2).tolist()], pa.string()), pa.array(names[kept % len(names)], pa.string()), pa.array(np.diff(cuts)), pa.array(out, pa.string())],
                    names=schema.fieldNames(),
                )

    return genes.mapInArrow(run, schema)


def locus_join(isoforms: DataFrame, loci: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(isoforms with their locus's sequence, isoforms whose locus is missing), on locus_id."""
    own = loci.select("locus_id", "seq")
    return isoforms.join(own, "locus_id"), isoforms.join(own, "locus_id", "left_anti")


def remap_ids(features: DataFrame, idmap: DataFrame) -> DataFrame:
    """features with contig_id replaced by idmap(contig_id, new_id); ids without an entry stay."""
    rows = features.join(idmap.select("contig_id", "new_id"), "contig_id", "left")
    return rows.withColumn("contig_id", F.coalesce("new_id", "contig_id")).drop("new_id")


def annotate(structures: DataFrame, predictions: DataFrame, method: str | None = None) -> DataFrame:
    """structures(gene, ..., [annots]) with the annotations of predictions(gene, [orf_amino_bound], start_codon,
    stop_codon, score, met_seen) behind those they have; sources.xml writes and reads them.

    Without method, predictions name it in a column of their own, and one gene may have several, which are
    added by method in one join."""
    bound = F.col("orf_amino_bound") if "orf_amino_bound" in predictions.columns else F.lit(None)
    item = F.struct(
        (F.col("method") if method is None else F.lit(method)).alias("method"), bound.cast("bigint").alias("orf_amino_bound"), *(F.col(c).cast("bigint").alias(c) for c in ("start_codon", "stop_codon")),
        F.col("score").cast("double").alias("best_tis_score"), F.col("met_seen").cast("boolean").alias("met_seen"),
    )
    new = predictions.select("gene", item.alias("a")).groupBy("gene").agg(F.array_sort(F.collect_list("a")).alias("__new"))
    rows = structures.join(new, "gene", "left").withColumn("__new", F.coalesce("__new", F.array()))
    kept = F.concat("annots", "__new") if "annots" in structures.columns else F.col("__new")
    return rows.withColumn("annots", kept).drop("__new")


def splice_report(exons: DataFrame, contigs: DataFrame, up: int = S.FLANK + S.UPSTREAM, down: int = S.DOWNSTREAM + S.FLANK, require_start: bool = False) -> DataFrame:
    """(gene, seq, reason) of every gene, spliced with its flanks; reason is null where that went well.

    'contig': an exon or flank leaves the contig, or there is none (seq is null). 'start': with require_start, as for
    curated models, the first codon is no start codon (seq stays)."""
    rows = with_slices(with_flanks(exons, up, down), contigs)
    grouped = rows.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("exon_no", "piece"))).alias("parts"), (F.count("piece") == F.count("*")).alias("whole"))
    seq = F.when(F.col("whole"), F.array_join(F.transform("parts", lambda p: p["piece"]), ""))
    reason = F.when(F.col("seq").isNull(), "contig")
    if require_start:
        reason = reason.when(~S.is_met(F.substring("seq", up + 1, S.CODON)), "start")
    return grouped.select("gene", seq.alias("seq")).withColumn("reason", reason)
