"""Content scores of flanks, cluster-specific models, dynamic models, and maximal reading frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.functions import seq as S
from seqspark.operators import arrays, kmers, sites, structure
from seqspark.sources import shared
from seqspark.sources.fasta import contig_store

#: Priors of each coding phase and of noncoding.
CODING_PRIOR, NONCODING_PRIOR = 1 / 6, 1 / 2


def flanked_sites(seqs: DataFrame, key: str = "seq_id") -> DataFrame:
    """Scorable start sites with whole flanks: (key, pos, site, len, up, down), flanks of FLANK bases; a row for each site of each row of seqs."""
    return sites.met_sites(seqs, key, flank=S.FLANK)


def flank_posteriors(flanked: DataFrame, chain: DataFrame, compat: bool = True) -> DataFrame:
    """flanked with post_up and post_down, the posterior of coding of either flank, and mcratio; rows with a flank that holds no
    known hexamer are left out.

    compat keeps a known habit: the noncoding likelihood is read from the table of phase 0. Both flanks are scored
    in the task that holds the row, with a table of 4,096 rows."""
    known, logs = kmers.word_logs(chain)
    table = np.where(known[:, None], logs, 0.0)

    def posterior(texts):
        """(posterior, whether the flank holds a known word) of flanks; the place of a word is counted from 0."""
        post, fine = np.zeros(len(texts)), np.zeros(len(texts), bool)
        sizes = np.array([len(t or b"") for t in texts])
        for size in np.unique(sizes[sizes > kmers.ORDER]).tolist():
            rows = np.flatnonzero(sizes == size)
            plain = np.array([texts[k].isascii() for k in rows])
            for own in (rows[plain], *rows[~plain, None]):  # texts of one length are one matrix
                if not len(own):
                    continue
                code = arrays.letters(b"".join(texts[k] for k in own)).reshape(len(own), -1)[:, : S.FLANK]
                n = code.shape[1] - kmers.ORDER
                if n < 1:
                    continue
                word = np.zeros((len(own), n), np.int16)
                bad = np.zeros((len(own), n), bool)
                for k in range(kmers.ORDER + 1):
                    word = word * 4 + code[:, k : k + n]
                    bad |= code[:, k : k + n] == arrays.NONE
                word[bad] = arrays.OTHER
                fine[own] = known[word].any(axis=1)
                by = [table[word[:, r::3]].sum(axis=1) for r in range(3)]
                s = [sum(by[r][:, (r + m) % 3] for r in range(3)) for m in range(3)]
                non = s[0] if compat else sum(by[r][:, kmers.NONCODING] for r in range(3))
                top = np.maximum.reduce([*s, non])
                with np.errstate(invalid="ignore"):
                    coding = sum(CODING_PRIOR * np.exp(x - top) for x in s)
                    post[own] = coding / (coding + NONCODING_PRIOR * np.exp(non - top))
        return post, fine

    def body(batch):
        up, down = (posterior(arrays.column(batch, side)) for side in ("up", "down"))
        index = np.flatnonzero(up[1] & down[1])
        return index, [pa.array(up[0][index]), pa.array(down[0][index])]

    rows = arrays.extend(flanked, flanked.columns, "post_up double, post_down double", body, "up", "down")
    return rows.withColumn("mcratio", F.round(F.log(F.col("post_down") / F.col("post_up")), 6))


def predict_content(scored: DataFrame, neuron: DataFrame | None = None, key: str = "seq_id", sigmoid: bool = False) -> DataFrame:
    """scored(key, pos, len, llkr, mcratio) as (key, tis, score): weighted ratio plus mcratio, accepted
    from zero on; or a neuron's activation of both, accepted above 0 (linear) or 0.5 (sigmoid)."""
    rows = sites.candidates(scored).withColumn("wllkr", F.col("llkr") + 3 * F.log(sites.position_weight())).where("wllkr IS NOT NULL")
    if neuron is None:
        score, accepted = F.col("wllkr") + F.col("mcratio"), F.col("value") >= 0
    else:
        rows = rows.crossJoin(F.broadcast(neuron.select("w0", "w1", "w2")))  # one row
        score = sites.activation(F.col("wllkr"), F.col("mcratio"), F.col("w0"), F.col("w1"), F.col("w2"), sigmoid)
        accepted = F.col("value") > (0.5 if sigmoid else 0)
    best = sites.best_site(rows.withColumn("value", F.round(score, 6)), "value", key)
    return best.select(key, F.when(accepted, F.col("pos")).otherwise(-1).alias("tis"), F.col("value").alias("score"))


def with_cluster_llkr(clustered: DataFrame, true_wam: DataFrame, false_wam: DataFrame, key: str = "seq_id", static: bool = False) -> DataFrame:
    """clustered(key, pos, site, len, cluster) with llkr from the true model of its cluster and one false
    model. static takes the cluster of a sequence's first candidate for all its sites. Models have one
    row a cluster once packed, which bounds what is broadcast."""
    rows = sites.candidates(clustered)
    if static:
        rows = rows.withColumn("cluster", F.first("cluster").over(Window.partitionBy(key).orderBy("pos")))
    true = sites.packed_model(true_wam, ["cluster"]).withColumnRenamed("ln", "ln_t")
    false = sites.packed_model(false_wam.withColumn("one", F.lit(1)), ["one"]).select(F.col("ln").alias("ln_f"))
    rows = rows.join(F.broadcast(true), "cluster").crossJoin(F.broadcast(false))
    llkr = F.round(sites.matrix_score(F.col("site"), F.col("ln_t")) - sites.matrix_score(F.col("site"), F.col("ln_f")), 6)
    return rows.withColumn("llkr", llkr).drop("ln_t", "ln_f")


def best_cluster(found: DataFrame, models: DataFrame) -> DataFrame:
    """found(site, ...) with cluster, the one whose matrix (packed, (cluster, ln)) scores the site best; the
    lowest cluster on ties. All matrices travel as one array row."""
    table = models.agg(F.array_sort(F.collect_list(F.struct("cluster", "ln"))).alias("__models"))
    scores = F.transform("__models", lambda m: F.struct(F.round(sites.matrix_score(F.col("site"), m["ln"]), 9).alias("score"), (-m["cluster"]).alias("cluster")))
    rows = found.crossJoin(F.broadcast(table)).withColumn("cluster", -F.array_max(scores)["cluster"])
    return rows.drop("__models")


def imm_loglik(seqs: DataFrame, chain: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, model, loglik) under each phase of an interpolated chain: all hexamers, plus orders 0 to 4 of
    the first five bases from the phase's own table."""
    body = kmers.fo_loglik(seqs, chain.where(F.col("k") == kmers.ORDER + 1), key)
    words = F.transform(F.sequence(F.lit(1), F.lit(kmers.ORDER)), lambda k: F.substring("seq", F.lit(1), k))
    head = seqs.where(F.length("seq") > kmers.ORDER).select(key, F.explode(words).alias("w"))
    table = chain.where(F.col("k") <= kmers.ORDER).select("model", F.concat("hist", "base").alias("w"), S.log_or_inf(F.col("p")).alias("ln"))
    head = head.join(F.broadcast(table), "w").groupBy(key, "model").agg(F.sum("ln").alias("loglik"))  # 1,364 rows a model
    return body.unionByName(head).groupBy(key, "model").agg(F.sum("loglik").alias("loglik"))


def dynamic_model(kmers_by_part: DataFrame) -> DataFrame:
    """(model, hist, base, mean, sd, ranges): a fixed-order chain per training split, then its spread.

    kmers_by_part(part, model, k, hist, base, n); tables are model-sized."""
    six = kmers_by_part.where(F.col("k") == kmers.ORDER + 1).withColumn("model", F.col("part") * 100 + F.col("model"))
    chain = kmers.train_fixed_order(six)
    chain = chain.withColumn("part", F.floor(F.col("model") / 100)).withColumn("model", (F.col("model") % 100).cast("int"))
    return kmers.partition_stats(chain, ["model", "hist", "base"])


def dynamic_loglik(seqs: DataFrame, cloud: DataFrame, phase: int = 0, key: str = "seq_id", band: str = "rng") -> DataFrame:
    """(key, loglik): the best likelihood that probabilities within the cloud can give.

    For each history, bases in falling order of their counts (then by letter) are raised from the low
    to the high end of their range until the row sums to one. A row is worked out where it is; sequences that share
    their key, whose counts belong together, go through a shuffle of their counts. The cloud has 4,096 rows for
    each of three phases."""
    lo_hi = cloud_table(cloud, band)

    def body(batch):
        index, sums = [], []
        for k, seq in enumerate(arrays.column(batch)):
            if seq is None:
                continue
            code = arrays.letters(seq)
            found = _best_in_cloud(*_word_counts(code, phase), *lo_hi)
            if found is None and not _in_cloud(code, phase, lo_hi[2]):
                continue
            index.append(k)
            sums.append(found or 0.0)
        return index, [pa.array(sums, pa.float64())]

    rows = arrays.extend(seqs, [key], "loglik double", body)
    each = rows.groupBy(key).agg(F.sum("loglik").alias("loglik"), F.count("*").alias("__rows")).persist()  # a number a key
    again = each.where("__rows > 1").select(F.col(key).alias("__key"))
    out = each.where("__rows = 1").select(key, "loglik")
    if again.isEmpty():
        return out
    mine = seqs.join(again, F.col(key).eqNullSafe(F.col("__key")), "left_semi").select(key, "seq")
    return out.union(_dynamic_loglik_of_counts(mine, cloud, phase, key, band))


def _dynamic_loglik_of_counts(seqs: DataFrame, cloud: DataFrame, phase: int, key: str, band: str) -> DataFrame:
    """dynamic_loglik() with the counts of all sequences of a key as rows."""
    lo, hi = F.col(f"lo_{band}"), F.col(f"hi_{band}")
    found = arrays.count_words(seqs, [key], 3).groupBy(key, F.pmod(F.col("i") + phase, F.lit(3)).cast("int").alias("model"), "hexamer").agg(F.sum("n").alias("n"))
    hists = found.select(key, "model", F.substring("hexamer", 1, kmers.ORDER).alias("hist")).distinct()
    rows = hists.join(F.broadcast(cloud), ["model", "hist"])  # 4,096 rows for each of at most 7 models
    found = found.select(F.col(key).alias("__key"), "model", F.substring("hexamer", 1, kmers.ORDER).alias("hist"), F.substring("hexamer", kmers.ORDER + 1, 1).alias("base"), "n")
    same = F.col(key).eqNullSafe(F.col("__key"))
    rows = rows.alias("r").join(found.alias("f"), same & (F.col("r.model") == F.col("f.model")) & (F.col("r.hist") == F.col("f.hist")) & (F.col("r.base") == F.col("f.base")), "left").select("r.*", "f.n").fillna(0, ["n"])
    own = Window.partitionBy(key, "model", "hist")
    spent = F.coalesce(F.sum(hi - lo).over(own.orderBy(F.desc("n"), "base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = 1 - F.sum(lo).over(own) - spent
    p = lo + F.greatest(F.lit(0.0), F.least(hi - lo, left))
    return rows.withColumn("p", p).groupBy(key).agg(F.sum(F.when(F.col("n") > 0, F.col("n") * S.log_or_inf(F.col("p"))).otherwise(0.0)).alias("loglik"))


def cloud_table(cloud: DataFrame, band: str):
    """(lo, hi, has) of a cloud by phase, history and base, zero and false where it has no row."""
    lo, hi, has = (np.zeros((3, 4**kmers.ORDER, 4), t) for t in (float, float, bool))
    for r in cloud.select("model", "hist", "base", f"lo_{band}", f"hi_{band}").where(F.col("model").isin(0, 1, 2)).collect():
        at = int(arrays.words(arrays.letters((r["hist"] + r["base"]).encode()))[0])
        if at < arrays.OTHER:
            place = r["model"], at // 4, at % 4
            lo[place], hi[place], has[place] = r[3], r[4], True
    return lo, hi, has


def _word_counts(code, phase: int):
    """(models, histories, counts of the four bases) of the words of code."""
    codes = []
    for at in range(0, len(code) - kmers.ORDER, arrays.PIECE):
        word = arrays.words(code[at : at + arrays.PIECE + kmers.ORDER]).astype(np.int32)
        model = (np.arange(len(word), dtype=np.int32) + (at + phase) % 3) % 3
        codes.append((word + model * arrays.OTHER)[word < arrays.OTHER])
    both = np.concatenate(codes) if codes else np.empty(0, np.int32)
    value, n = np.unique(both, return_counts=True) if len(both) < 3 * arrays.OTHER else _counted(both)
    hist, row = np.unique(value // 4, return_inverse=True)
    counts = np.zeros((len(hist), 4), np.int64)
    counts[row, value % 4] = n
    return hist // 4**kmers.ORDER, hist % 4**kmers.ORDER, counts


def _counted(codes):
    n = np.bincount(codes)
    value = np.flatnonzero(n)
    return value, n[value]


def _best_in_cloud(model, hist, counts, lo, hi, has) -> float | None:
    """The best likelihood of counts; None where the cloud has none of the histories."""
    low, high, there = lo[model, hist], hi[model, hist], has[model, hist]
    if not there.any():
        return None
    order = np.argsort(np.where(there, -counts, 1), axis=1, kind="stable")  # falling counts, then by letter
    low, high, there, n = (np.take_along_axis(x, order, 1) for x in (low, high, there, counts))
    room = high - low
    spent = np.cumsum(room, axis=1) - room
    p = low + np.maximum(0.0, np.minimum(room, 1 - low.sum(axis=1, keepdims=True) - spent))
    use = there & (n > 0)
    with np.errstate(divide="ignore"):
        return float((n[use] * np.where(p[use] > 0, np.log(np.maximum(p[use], 5e-324)), -np.inf)).sum())


def _in_cloud(code, phase: int, has) -> bool:
    """Whether the cloud has a history of code, whatever symbol follows it."""
    known = has.any(axis=2)
    word = arrays.words(code, kmers.ORDER)[: max(0, len(code) - kmers.ORDER)]
    model, fine = (np.arange(len(word)) + phase) % 3, word < 4**kmers.ORDER
    return bool(known[model[fine], word[fine]].any())


#: Bases of a block of the stop index.
BLOCK = 4_096


def stop_index(contigs: DataFrame) -> DataFrame:
    """(contig_id, strand, frame, block, n, stops, before, after): the stop codons of each reading frame by blocks of BLOCK bases.

    stops are the sorted one-based first places, on the plus strand, of the frame's stop codons that begin in the block
    (on the minus strand those of their reverse complements), frame their remainder by three; before and after are
    the nearest ones in other blocks, n is the length of the contig. Every block has a row."""
    rows = contig_store(contigs.select("contig_id", "seq"), BLOCK, S.CODON - 1).select("contig_id", F.col("chunk_no").alias("block"), "n", "seq")

    def body(batch):
        index, strands, frames, stops = [], [], [], []
        for k, (seq, block) in enumerate(zip(arrays.column(batch), arrays.column(batch, "block"), strict=True)):
            word = arrays.words(arrays.letters(seq or b""), S.CODON)
            for strand, known in codes.items():
                place = np.flatnonzero(np.isin(word, known)) + block * BLOCK + 1
                for frame in range(3):
                    index.append(k), strands.append(strand), frames.append(frame), stops.append(place[place % 3 == frame])
        return index, [pa.array(strands, pa.string()), pa.array(frames, pa.int32()), pa.array(stops, pa.list_(pa.int64()))]

    codes = {strand: [int(arrays.words(arrays.letters(w.encode()), S.CODON)[0]) for w in words] for strand, words in STOPS.items()}
    rows = arrays.extend(rows, ["contig_id", "block", "n"], "strand string, frame int, stops array<bigint>", body)
    own = Window.partitionBy("contig_id", "strand", "frame").orderBy("block")
    before = F.max(F.array_max("stops")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.array_min("stops")).over(own.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("after", after)


#: Stop codons, and their reverse complements as they stand on the plus strand.
STOPS = {"+": ("TAA", "TAG", "TGA"), "-": ("TTA", "CTA", "TCA")}


def maximal_orf(genes: DataFrame, contigs: DataFrame, up: int = S.UPSTREAM, down: int = S.DOWNSTREAM) -> DataFrame:
    """genes(gene, contig_id, strand, start, stop) with the ends moved to the widest frame: start to just
    after the nearest stop codon upstream, stop to the first one from the last codon on; both scans run on
    the contig. Without a stop an end stays. Genes whose flanks leave the contig are dropped.

    Both ends look their block of the stop index up, so no gene meets a contig's bases, and the work is that of one
    scan for stops whatever the number of genes."""
    index = stop_index(contigs)
    minus = F.col("strand") == "-"
    a, b = F.col("start").cast("long"), F.col("stop").cast("long")
    rows = genes.where(F.when(minus, a - b).otherwise(b - a) >= 2)

    def nearest(rows: DataFrame, place: Column, own: int, frame: Column, rising: Column, name: str) -> DataFrame:
        """rows with n and name: the frame's first stop from place on (rising) or last one up to it; own 1: place itself is none."""
        keyed = rows.withColumn("block", F.floor((place - 1) / BLOCK).cast("int")).withColumn("frame", F.pmod(frame, F.lit(3)).cast("int"))
        joined = keyed.join(index.withColumnRenamed("n", "__n"), ["contig_id", "strand", "frame", "block"])
        on = F.coalesce(F.array_min(F.filter("stops", lambda p: p >= place + own)), F.col("after"))
        back = F.coalesce(F.array_max(F.filter("stops", lambda p: p <= place - own)), F.col("before"))
        return joined.select(*rows.columns, F.col("__n").alias(f"n_{name}"), F.when(rising, on).otherwise(back).alias(name))

    # A stop before the first codon: on the plus strand it begins at start - 3 or before, in start's frame; on the minus strand
    # it ends above start. From the last codon on: it begins at stop - 2 or after; on the minus strand at stop or before.
    rows = nearest(rows, a, 1, F.when(minus, a + 1).otherwise(a), minus, "k")
    rows = nearest(rows, F.when(minus, b).otherwise(b - 2), 0, F.when(minus, b).otherwise(b - 2), ~minus, "j")
    n = F.col("n_k")
    x = F.coalesce(F.when(minus, F.col("k") - 1).otherwise(F.col("k") + 3), a)
    y = F.coalesce(F.when(minus, F.col("j")).otherwise(F.col("j") + 2), b)
    rows = rows.where((F.least("start", "stop") >= 1) & (F.greatest("start", "stop") <= n)).withColumn("x", x).withColumn("y", y)
    rows = rows.where(F.when(minus, (F.col("x") + up <= n) & (F.col("y") - down >= 1)).otherwise((F.col("x") - up >= 1) & (F.col("y") + down <= n)))
    rest = [c for c in genes.columns if c not in ("start", "stop")]
    return rows.select(*rest, F.col("x").cast("long").alias("start"), F.col("y").cast("long").alias("stop"))


#: Bases before a gene that its chunk of the contig holds at least.
MARGIN = 1_024


def predict_structures(exons: DataFrame, contigs: DataFrame, wam: DataFrame, predict=sites.predict_llkr, whole_codons: bool = True) -> DataFrame:
    """(gene, orf_amino_bound, start_codon, stop_codon, score, met_seen) of gene structures: ends moved to the widest frame,
    exons spliced with flanks, start sites predicted and mapped back to the contig.

    orf_amino_bound is the first base of the widest frame. Without a predicted site the start is that too and met_seen is
    false; the stop codon is given by its first base. whole_codons false takes frames that are no multiple of three as well (isoforms of
    alternative splicing). Genes whose widest frame leaves the contig are dropped.

    exons are rows, or genes with their exons as parts. A gene is one row that meets one chunk of its contig, where frame,
    splicing and sites are worked out; what it gives is written. Genes that reach beyond their chunk go through
    maximal_orf() and structure.splice()."""
    spark = exons.sparkSession
    genes = exons
    if "parts" not in exons.columns:
        genes = exons.groupBy("gene", "contig_id", "strand").agg(F.array_sort(F.collect_list(F.struct("exon_no", "start", "stop"))).alias("parts"))
    path = shared.new_path(spark, "genes")
    _in_chunks(genes, contigs, whole_codons).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    frames = found.where("resolved")
    best = predict(sites.with_llkr(frames.select("gene", F.explode("sites").alias("s"), "len").select("gene", "s.pos", "s.site", "len"), wam), "gene")
    rows = frames.select("gene", "strand", "orf_start", "orf_stop", F.transform("sites", lambda s: F.struct(s["pos"], s["position"])).alias("sites")).join(best.select("gene", "tis", "score"), "gene", "left")
    position = F.get(F.filter("sites", lambda s: s["pos"] == F.col("tis")), F.lit(0))["position"]
    rows = rows.select("gene", "strand", "orf_start", "orf_stop", "score", position.alias("position"))
    rest = found.where("NOT resolved").select("gene", "contig_id", "strand", F.posexplode(F.arrays_zip("starts", "stops")).alias("k", "e"))
    rest = rest.select("gene", "contig_id", "strand", (F.col("k") + 1).alias("exon_no"), F.col("e.starts").alias("start"), F.col("e.stops").alias("stop"))
    if not rest.isEmpty():
        rows = rows.union(_predict_long(rest, contigs.join(rest.select("contig_id").distinct(), "contig_id", "left_semi"), wam, predict, whole_codons))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    return rows.select("gene", F.col("orf_start").alias("orf_amino_bound"), F.coalesce("position", "orf_start").alias("start_codon"), (F.col("orf_stop") - 2 * sign).alias("stop_codon"), "score", F.col("position").isNotNull().alias("met_seen"))


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def _in_chunks(genes: DataFrame, contigs: DataFrame, whole_codons: bool) -> DataFrame:
    """genes(gene, contig_id, strand, parts) as (gene, strand, resolved, orf_start, orf_stop, len, sites): widest frame, length of the spliced
    and flanked sequence (null where it leaves the contig) and its start sites (pos, site, position on the contig).

    Those that their chunk does not settle are not resolved; only these have contig_id, starts and stops. Genes
    whose widest frame leaves the contig give no row."""
    place = lambda c: F.transform("parts", lambda p: p[c].cast("long")).alias(f"{c}s")
    rows = genes.select("gene", "contig_id", "strand", place("start"), place("stop"))
    least = F.least(F.array_min("starts"), F.array_min("stops")) - MARGIN
    rows = rows.withColumn("chunk_no", F.coalesce(F.floor((F.greatest(least, F.lit(1)) - 1) / structure.CHUNK), F.lit(0)).cast("int"))
    store = contig_store(contigs.select("contig_id", "seq"), structure.CHUNK, structure.OVERLAP)
    rows = rows.join(store, ["contig_id", "chunk_no"])
    up, down, size = S.FLANK + S.UPSTREAM, S.DOWNSTREAM + S.FLANK, structure.CHUNK

    def settle(strand, starts, stops, base, n, text):
        """(orf_start, orf_stop, len, sites) of a gene; False where text, the contig's bases from base + 1 on, does not tell, None where there is no row."""
        if not starts or None in starts or None in stops:
            return False
        turn = (lambda p: n - p + 1) if strand == "-" else (lambda p: p)
        if strand == "-":
            text, base = text.translate(_COMPLEMENT)[::-1], n - base - len(text)
        starts, stops, end = [turn(p) for p in starts], [turn(p) for p in stops], base + len(text)
        a, b = starts[0], stops[-1]
        if b - a < 2 or a < 1 or b > n:
            return None
        if a <= base or b > end:
            return False
        x, y = a - S.CODON, b - 2
        while x > base and text[x - base - 1 : x - base + 2] not in S.STOPS:
            x -= S.CODON
        while y + 2 <= end and text[y - base - 1 : y - base + 2] not in S.STOPS:
            y += S.CODON
        if base >= x >= 1 or end < y + 2 <= n:
            return False
        x, y = x + S.CODON if x > base else a, y + 2 if y + 2 <= end else b
        if x - S.UPSTREAM < 1 or y + S.DOWNSTREAM > n:
            return None
        starts[0], stops[-1] = x, y
        wide = list(zip(starts, stops, strict=True))
        starts[0], stops[-1] = x - up, y + down
        pieces = [(min(p), max(p)) for p in zip(starts, stops, strict=True)]
        if any(lo < 1 or hi > n for lo, hi in pieces):
            return turn(x), turn(y), None, []
        if any(lo <= base or hi > end for lo, hi in pieces):
            return False
        seq = "".join(text[lo - base - 1 : hi - base] for lo, hi in pieces)
        coding, sites = len(seq) - up - down, []
        at = seq.find("ATG", up) if coding > 0 and not (whole_codons and coding % S.CODON) else -1
        while at != -1:
            k = at - up
            if k % S.CODON == 0 and k + S.CODON <= coding and at + S.CODON + S.DOWNSTREAM <= len(seq):
                place = None
                for start, stop in wide:
                    if k < abs(stop - start) + 1:
                        place = turn(start + k)
                        break
                    k -= abs(stop - start) + 1
                sites.append({"pos": at + 1, "site": seq[at - S.UPSTREAM : at - S.UPSTREAM + S.SITE], "position": place})
            at = seq.find("ATG", at + 1)
        return turn(x), turn(y), len(seq), sites

    def body(batch):
        index, out = [], []
        for k, row in enumerate(zip(*(arrays.column(batch, c) for c in ("strand", "starts", "stops", "chunk_no", "n", "seq")), strict=True)):
            strand, starts, stops, chunk, n, text = row
            got = settle(strand, starts, stops, chunk * size, n, (text or b"").decode())
            if got is not None:
                index.append(k)
                out.append((True, *got) if got else (False, None, None, None, []))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("pos", pa.int32()), ("site", pa.string()), ("position", pa.int64())]))
        return index, [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]

    more = "resolved boolean, orf_start long, orf_stop long, len int, sites array<struct<pos: int, site: string, position: long>>"
    rows = arrays.extend(rows, ["gene", "contig_id", "strand", "starts", "stops", "chunk_no", "n"], more, body)
    once = lambda c: F.when(~F.col("resolved"), F.col(c)).alias(c)
    return rows.select("gene", "strand", "resolved", "orf_start", "orf_stop", "len", "sites", *(once(c) for c in ("contig_id", "starts", "stops")))


def _predict_long(exons: DataFrame, contigs: DataFrame, wam: DataFrame, predict, whole_codons: bool) -> DataFrame:
    """(gene, strand, orf_start, orf_stop, score, position) as predict_structures() has them, of genes of any length."""
    ends = exons.groupBy("gene", "contig_id", "strand").agg(F.min_by("start", "exon_no").alias("start"), F.max_by("stop", "exon_no").alias("stop"))
    frames = maximal_orf(ends, contigs).select("gene", "strand", F.col("start").alias("orf_start"), F.col("stop").alias("orf_stop"))
    own = Window.partitionBy("gene")
    wide = exons.withColumn("__first", F.col("exon_no") == F.min("exon_no").over(own)).withColumn("__last", F.col("exon_no") == F.max("exon_no").over(own)).join(frames.drop("strand"), "gene")
    wide = wide.select(
        "gene", "contig_id", "strand", "exon_no", F.when(F.col("__first"), F.col("orf_start")).otherwise(F.col("start")).alias("start"), F.when(F.col("__last"), F.col("orf_stop")).otherwise(F.col("stop")).alias("stop")
    )
    seqs = structure.splice(structure.with_flanks(wide), contigs)
    best = predict(sites.with_llkr(sites.met_sites(seqs, "gene", whole_codons), wam), "gene")
    place = best.where("tis > 0").select("gene", (F.col("tis") - S.FLANK - S.UPSTREAM).alias("at"))
    found = structure.genomic_position(wide, place).select("gene", "position")
    rows = frames.join(best.select("gene", "score"), "gene", "left").join(found, "gene", "left")
    return rows.select("gene", "strand", "orf_start", "orf_stop", "score", "position")


def save_model(model: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A model is an ordinary table; by names its partition columns, one folder a cluster or hypothesis."""
    writer = model.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shadow_phase(length: Column) -> Column:
    """First model of the reverse strand: 3, 4, 5 for lengths of remainder 0, 2, 1."""
    return F.lit(3) + F.pmod(-length, F.lit(3))


def count_kmers_shadow(cds: DataFrame) -> DataFrame:
    """Counts of models 3 to 5 on the reverse complement, in phase with the forward strand."""
    rows = cds.select(S.revcomp(F.col("seq")).alias("seq"))
    first = shadow_phase(F.length("seq"))
    return kmers.count_kmers(rows.select("seq", (first - 3).alias("f")), F.pmod(F.col("i") + F.col("f"), F.lit(3)) + 3, "f", period=3)


def supported_structures(structures: DataFrame, members: DataFrame, min_exons: int = 3, min_score: float = 1.0) -> DataFrame:
    """structures(ref, exons, scores) with enough well-scored exons that are also in members(pgl, ref, exons);
    the first match of each group, with an intron at least."""
    good = structures.where(F.size(F.filter("scores", lambda s: s >= min_score)) >= min_exons).select("ref", "exons").distinct()
    rows = members.join(good, ["ref", "exons"], "left_semi").where(F.size("exons") > 1)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("pgl").orderBy("ref", F.col("exons").cast("string")))).where("r = 1").drop("r")
