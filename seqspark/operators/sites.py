"""Start-codon sites: which ones train, the matrices they give, and scores with them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqspark.functions import seq as S
from seqspark.operators import arrays

#: Sites of one piece of a sequence that is searched on all frames.
CHUNK = 4096


def met_sites(seqs: DataFrame, key: str = "seq_id", whole_codons: bool = True, flank: int = 0) -> DataFrame:
    """Every in-frame, scorable ATG of flanked sequences (key, seq): (key, pos, site, len). Coding parts that
    are no multiple of three give none if whole_codons, else those of their whole codons. With flank only sites that have so many
    bases more around them, and up and down, the bases next to what scores a site.

    Codons are compared inside the task, so only real sites become rows."""
    n, around = F.length("seq"), 2 * S.FLANK + S.UPSTREAM + S.DOWNSTREAM
    rows = seqs.where(S.cds_eligible(n) if whole_codons else n > around).select(key, "seq")
    atg = np.frombuffer(b"ATG", np.uint8)

    def body(batch):
        index, places, lengths, found = [], [], [], []
        for k, seq in enumerate(arrays.column(batch)):
            points = arrays.points(seq)
            n = len(points)
            coding = points[S.FIRST_CODON - 1 : S.FIRST_CODON - 1 + (n - around) // 3 * 3].reshape(-1, S.CODON)
            pos = np.flatnonzero((coding == atg).all(axis=1)) * S.CODON + S.FIRST_CODON
            pos = pos[(pos - S.UPSTREAM - flank >= 1) & (pos + S.CODON - 1 + S.DOWNSTREAM + flank <= n)].tolist()
            text = seq if seq.isascii() else seq.decode()
            index += [k] * len(pos)
            places += pos
            lengths += [n] * len(pos)
            found += [(text, p) for p in pos]
        first = S.UPSTREAM + 1
        cuts = [[t[p - first : p - first + S.SITE] for t, p in found]]
        if flank:
            cuts += [[t[p - first - flank : p - first] for t, p in found], [t[p - first + S.SITE : p - first + S.SITE + flank] for t, p in found]]
        texts = [pa.array([x if isinstance(x, str) else x.decode() for x in c], pa.string()) for c in cuts]
        return index, [pa.array(places, pa.int32()), texts[0], pa.array(lengths, pa.int32()), *texts[1:]]

    return arrays.extend(rows, [key], "pos int, site string, len int" + (", up string, down string" if flank else ""), body)


def labelled_sites(sites: DataFrame, key: str = "seq_id") -> DataFrame:
    """sites with hypothesis T (the first of its sequence) or F (at least FALSE_GAP after it)."""
    first = F.min("pos").over(Window.partitionBy(key))
    rows = sites.withColumn("first", first)
    kind = F.when(F.col("pos") == F.col("first"), "T").when(F.col("pos") >= F.col("first") + S.FALSE_GAP, "F")
    return rows.withColumn("hyp", kind).where("hyp IS NOT NULL").drop("first")


def count_mono(sites: DataFrame, *by: str) -> DataFrame:
    """(by, pos, base, n): counts by place in the site, zero-based."""
    places = sites.select(*by, "site", F.explode(F.sequence(F.lit(0), F.length("site") - 1)).alias("k"))
    return places.groupBy(*by, F.col("k").alias("pos"), F.substring("site", F.col("k") + 1, F.lit(1)).alias("base")).agg(F.count("*").alias("n"))


def count_di(sites: DataFrame, *by: str) -> DataFrame:
    """(by, pos, prev, base, n): counts of base pairs, pos the place of the second base."""
    places = sites.select(*by, "site", F.explode(F.sequence(F.lit(1), F.length("site") - 1)).alias("k"))
    pair = [F.col("k").alias("pos"), F.substring("site", F.col("k"), F.lit(1)).alias("prev"), F.substring("site", F.col("k") + 1, F.lit(1)).alias("base")]
    return places.groupBy(*by, *pair).agg(F.count("*").alias("n"))


def smoothed(p: Column, rows: Window) -> Column:
    """p of one probability row: even if all are tiny, else tiny ones are raised and the rest shrunk."""
    least, most = F.min(p).over(rows), F.max(p).over(rows)
    raised = F.when(p < S.MAX_FAULT, S.PROB_MIN).otherwise(p * (1 - 4 * S.PROB_MIN) + S.PROB_MIN)
    return F.when(most < S.MAX_FAULT, 0.25).when(least < S.MAX_FAULT, raised).otherwise(p)


def _counts(sites: DataFrame, by: list[str], length: int, pairs: bool) -> DataFrame:
    """(by, pos, prev, base, n) with every place, base and, for pairs, base before it (a hyphen at place 0 and without pairs)
    of a model of each group, n its count, also 0.

    Tasks count the bases of their sites as numbers; what is shuffled is a model's size from each."""
    width = 25 if pairs else 5
    schema = StructType([sites.schema[c] for c in by] + StructType.fromDDL("pos int, prev string, base string, n long").fields)
    names = schema.fieldNames()
    cells = [(k, S.BASES[c // 5] if k and pairs else "-", S.BASES[c % 5], k * width + c) for k in range(length) for c in range(width) if c % 5 < 4 and (c // 5 < 4 if k else c < 5)]
    column = lambda j: [c[j] for c in cells]
    pos, prev, base, cell = column(0), column(1), column(2), np.array(column(3))

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        types = None

        def out():
            for key, own in sums.items():
                kept = [pa.array([v] * len(cells), t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int32()), pa.array(prev), pa.array(base), pa.array(own[cell])], names=names)
            sums.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys, group = _groups(batch, by)
            for rows, code in _matrices(batch.column(batch.schema.get_field_index("site"))):
                code = code[:, :length].astype(np.int32)
                size = code.shape[1]
                shift = np.arange(size, dtype=np.int32) * width
                step = max(1, (1 << 18) // max(size, 1))
                for at in range(0, len(rows), step):
                    part = code[at : at + step]
                    at_place = part + shift
                    if pairs:
                        at_place[:, 1:] += part[:, :-1] * 5
                    at_place += group[rows[at : at + step], None] * (length * width)
                    found = np.bincount(at_place.ravel(), minlength=len(keys) * length * width).reshape(len(keys), -1)
                    for key, own in zip(keys, found, strict=True):
                        sums[key] = sums[key] + own if key in sums else own.copy()
            for key in keys:  # a group whose sites have no base that counts is a group
                sums.setdefault(key, np.zeros(length * width, np.int64))
            if len(sums) > arrays.HELD:
                yield from out()
        yield from out()

    given = sites.select(*by, F.col("site").cast("binary").alias("site"))
    return given.mapInArrow(run, schema).groupBy(*by, "pos", "prev", "base").agg(F.sum("n").alias("n"))


def _groups(batch, by: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct values of the columns by, and the number of each row's."""
    codes, values = np.zeros(batch.num_rows, np.int64), []
    for c in by:
        coded = batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        values.append(coded.dictionary.to_pylist())
    kinds, group = np.unique(codes, return_inverse=True)
    keys = []
    for kind in kinds.tolist():
        key = []
        for v in reversed(values):
            kind, k = divmod(kind, max(1, len(v)))
            key.append(v[k])
        keys.append(tuple(reversed(key)))
    return keys, group.reshape(-1).astype(np.int32)


def _matrices(texts):
    """(numbers of rows, codes of their bases) of a column of UTF-8 bytes, one matrix for each length; null rows and empty ones have none."""
    if not texts.null_count and len(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        sizes = np.diff(ends)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        if sizes[0] and (sizes == sizes[0]).all() and data.max() < 128:
            yield np.arange(len(texts)), arrays._CODE[data].reshape(len(texts), -1)
            return
    by_size: dict[int, tuple[list, list]] = {}
    for k, text in enumerate(texts.to_pylist()):
        if text:
            code = arrays.letters(text)
            rows, codes = by_size.setdefault(len(code), ([], []))
            rows.append(k), codes.append(code)
    for rows, codes in by_size.values():
        yield np.array(rows), np.array(codes)


def train_pwm(sites: DataFrame, by: list[str], length: int = S.SITE, fixed: range = range(5, 8)) -> DataFrame:
    """(by, pos, base, p): position weight matrix; places in fixed are not smoothed."""
    rows = _counts(sites, by, length, False)
    own = Window.partitionBy(*by, "pos")
    rows = rows.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(own)), F.lit(0.25)))
    p = F.when(F.col("pos").isin(*fixed), F.col("p")).otherwise(smoothed(F.col("p"), own))
    return rows.select(*by, "pos", "base", p.alias("p"))


def train_wam(sites: DataFrame, by: list[str], length: int = S.SITE, motif_at: int = S.UPSTREAM, motif: str | Column = "ATG", smooth_first: bool = True, motif_size: int | None = None) -> DataFrame:
    """(by, pos, prev, base, p): first-order weight array matrix around a fixed motif.

    At pos 0 prev is a hyphen and p the base's share. Rows inside the motif are its own transitions;
    right after it only the row of its last base counts, the others are zero. motif may be a column over by of motif_size bases."""
    rows = _counts(sites, by, length, True)
    own = Window.partitionBy(*by, "pos", "prev")
    rows = rows.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(own)), F.lit(0.0)))
    even = smoothed(F.col("p"), own)
    size = motif_size or len(motif)
    letter = lambda i: F.substring(motif, i + 1, 1) if isinstance(motif, Column) else F.lit(motif[i])
    k, after = F.col("pos"), motif_at + size
    p = F.when(k == 0, even if smooth_first else F.col("p"))
    p = p.when(k == motif_at, (F.col("base") == letter(0)).cast("double"))
    for i in range(1, size):
        p = p.when(k == motif_at + i, ((F.col("prev") == letter(i - 1)) & (F.col("base") == letter(i))).cast("double"))
    p = p.when((k == after) & (F.col("prev") != letter(size - 1)), 0.0)
    return rows.select(*by, "pos", "prev", "base", p.otherwise(even).alias("p"))


def verify_pmf(model: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a model whose probabilities do not sum to 1; rows of equal ones are skipped."""
    sums = model.groupBy(*keys).agg(F.sum("p").alias("total"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return sums.where((F.abs(F.col("total") - 1) > S.MAX_FAULT) & (F.col("lo") != F.col("hi"))).drop("lo", "hi")


def model_report(model: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys) with a column for each base, rounded to 4 decimals."""
    return model.groupBy(*keys).pivot("base", list(S.BASES)).agg(F.round(F.first("p"), 4))


def packed_model(model: DataFrame, by: list[str], length: int = S.SITE) -> DataFrame:
    """A matrix as one row per group: (by, ln array), ln[16 k + 4 prev + base] the log probability.

    A model-sized table: 16 * length numbers a group."""
    code = lambda c: F.instr(F.lit(S.BASES), c) - 1
    at = F.col("pos") * 16 + F.greatest(code(F.col("prev")), F.lit(0)) * 4 + code(F.col("base"))
    pairs = model.select(*by, at.cast("int").alias("at"), S.log_or_inf(F.col("p")).alias("ln")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "ln"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(16 * length - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return pairs.select(*by, full.alias("ln"))


def matrix_score(site: Column, ln: Column, length: int = S.SITE) -> Column:
    """Sum of a packed matrix's log probabilities along a site; row-local, without a join."""
    code = lambda i: F.instr(F.lit(S.BASES), F.substring(site, i, F.lit(1))) - 1
    at = lambda k: (k * 16 + F.when(k == 0, 0).otherwise(F.greatest(code(k), F.lit(0))) * 4 + code(k + 1) + 1).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0.0).cast("double"), lambda acc, k: acc + F.element_at(ln, at(k)))


def packed_pwm(model: DataFrame, by: list[str], length: int = S.SITE) -> DataFrame:
    """A position weight matrix in the layout of packed_model, the same for every base before: (by, ln array)."""
    every = model.withColumn("prev", F.explode(F.when(F.col("pos") == 0, F.array(F.lit("-"))).otherwise(F.array(*map(F.lit, S.BASES)))))
    return packed_model(every, by, length)


def pwm_score(sites: DataFrame, model: DataFrame, by: str) -> DataFrame:
    """sites with one row per group of the matrices and score, the sum of log probabilities along the site.

    One row a group is broadcast."""
    rows = sites.crossJoin(F.broadcast(packed_pwm(model, [by]).withColumnRenamed("ln", "__ln")))
    return rows.withColumn("score", matrix_score(F.col("site"), F.col("__ln"))).drop("__ln")


def with_llkr(sites: DataFrame, wam: DataFrame) -> DataFrame:
    """sites with llk_true, llk_false and llkr from a matrix trained by hypothesis T and F.

    Two model rows are broadcast."""
    packed = packed_model(wam, ["hyp"])
    true, false = (packed.where(F.col("hyp") == h).select(F.col("ln").alias(f"ln_{h}")) for h in "TF")
    rows = sites.crossJoin(F.broadcast(true)).crossJoin(F.broadcast(false))
    rows = rows.select(*sites.columns, matrix_score(F.col("site"), F.col("ln_T")).alias("llk_true"), matrix_score(F.col("site"), F.col("ln_F")).alias("llk_false"))
    return rows.withColumn("llkr", F.round(F.col("llk_true") - F.col("llk_false"), 6))


def position_weight() -> Column:
    """Share of the coding part that follows a site: 1 at its first codon."""
    cds = F.col("len") - (2 * S.FLANK + S.UPSTREAM + S.DOWNSTREAM)
    return (cds - (F.col("pos") - S.FIRST_CODON)) / cds


def candidates(scored: DataFrame) -> DataFrame:
    return scored.where(S.peptide_long_enough(F.col("pos"), F.col("len")))


def best_site(scored: DataFrame, score: str, key: str = "seq_id", *more: str) -> DataFrame:
    """Per sequence the site of the best score, the first one on ties."""
    best = F.max_by(F.struct("pos", score, *more), F.struct(F.col(score), -F.col("pos")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def predict_llkr(scored: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, tis, score): tis is -1 where the best log-likelihood ratio is negative."""
    best = best_site(candidates(scored), "llkr", key)
    return best.select(key, F.when(F.col("llkr") >= 0, F.col("pos")).otherwise(-1).alias("tis"), F.col("llkr").alias("score"))


def tis_report(seqs: DataFrame, best: DataFrame, unfit: Column | None = None, key: str = "seq_id") -> DataFrame:
    """(key, tis, reason) of every one of seqs: the predicted start or -1, and why there is none.

    best is what a predict function returns. reason is what unfit, a column over seqs, says (a text where the sequence was not
    fit for prediction), else 'no site' without a scorable start codon, 'score' where none was good enough, null with a start."""
    rows = seqs.select(key, (F.lit(None) if unfit is None else unfit).cast("string").alias("__unfit")).join(best.select(key, "tis"), key, "left")
    reason = F.when(F.col("tis") > 0, F.lit(None)).when(F.col("__unfit").isNotNull(), F.col("__unfit")).when(F.col("tis").isNull(), "no site").otherwise("score")
    return rows.select(key, F.coalesce("tis", F.lit(-1)).alias("tis"), reason.alias("reason"))


def predict_wllkr(scored: DataFrame, key: str = "seq_id") -> DataFrame:
    """As predict_llkr, ranked with the weight of the position; the plain ratio decides."""
    rows = candidates(scored).withColumn("weighted", F.round(F.col("llkr") + 3 * F.log(position_weight()), 6)).where("weighted IS NOT NULL")
    best = best_site(rows, "weighted", key, "llkr")
    return best.select(key, F.when(F.col("llkr") >= 0, F.col("pos")).otherwise(-1).alias("tis"), F.col("weighted").alias("score"))


def predict_bayes(scored: DataFrame, key: str = "seq_id") -> DataFrame:
    """Most probable of two hypotheses per site, with priors by position; true ones come first on ties.

    Priors of a site and its opposite sum to 1, so those of a sequence sum to its number of sites."""
    rows = candidates(scored).withColumn("t", position_weight())
    n = F.count("*").over(Window.partitionBy(key))
    both = F.array(F.struct(F.lit(1).alias("true"), F.col("t").alias("prior"), F.col("llk_true").alias("llk")), F.struct(F.lit(0).alias("true"), (1 - F.col("t")).alias("prior"), F.col("llk_false").alias("llk")))
    rows = rows.withColumn("n", n).withColumn("h", F.explode(both)).select(key, "pos", "n", "h.*")
    rows = rows.withColumn("score", F.round(S.log_or_inf(F.col("prior") / F.col("n")) + F.col("llk"), 6))
    best = rows.groupBy(key).agg(F.max_by(F.struct("pos", "true", "score"), F.struct("score", "true", -F.col("pos"))).alias("b")).select(key, "b.*")
    return best.select(key, F.when(F.col("true") == 1, F.col("pos")).otherwise(-1).alias("tis"), "score")


def all_frame_sites(seqs: DataFrame, key: str = "seq_id") -> DataFrame:
    """Every scorable ATG of both strands: (key, strand, pos, site), pos on the forward strand."""
    # Pieces of CHUNK sites with what surrounds them, cut from bytes: long sequences stay linear.
    rows = seqs.where(F.length("seq") >= S.SITE).select(key, F.length("seq").alias("n"), F.col("seq").cast("binary").alias("b"))
    rows = rows.select(key, "n", "b", F.explode(F.sequence(F.lit(0), ((F.col("n") - S.SITE) / CHUNK).cast("int"))).alias("chunk"))
    piece = F.substring("b", F.col("chunk") * CHUNK + 1, F.lit(CHUNK + S.SITE - 1)).cast("string")
    rows = rows.select(key, "n", (F.col("chunk") * CHUNK).alias("before"), piece.alias("seq")).withColumn("size", F.length("seq"))
    both = rows.select(key, "n", "before", "size", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), S.revcomp(F.col("seq")).alias("s")))).alias("x"))
    both = both.select(key, "n", "before", "size", "x.*")
    # ATG cannot overlap itself: its places follow from the lengths of what lies between.
    between = F.split("s", "ATG", -1)
    places = F.aggregate(
        F.slice(between, 1, F.size(between) - 1), F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + 3, F.lit(1)) + F.length(x))),
    )
    both = both.select(key, "strand", "s", "before", "size", F.explode(places).alias("p")).where("p >= 6 AND p <= size - 5")
    pos = F.col("before") + F.when(F.col("strand") == "+", F.col("p")).otherwise(F.col("size") - F.col("p") + 1)
    return both.select(key, "strand", pos.alias("pos"), S.site_at(F.col("s"), F.col("p")).alias("site"))


def nearest_medoid(sites: DataFrame, medoids: DataFrame) -> DataFrame:
    """sites with cluster and dist of the medoid at least Hamming distance, the lowest cluster on ties.

    The medoids' k rows travel as one array row; no pair becomes a row."""
    packed = medoids.agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("site").alias("m")))).alias("medoids"))
    rows = sites.crossJoin(F.broadcast(packed))
    near = F.array_min(F.transform("medoids", lambda m: F.struct(S.hamming(F.col("site"), m["m"]).alias("dist"), m["cluster"].alias("cluster"))))
    return rows.withColumn("near", near).select(*sites.columns, F.col("near.cluster").alias("cluster"), F.col("near.dist").alias("dist"))


def kmedoids(sites: DataFrame, k: int, restarts: int = 30, rounds: int = 100, seed: int = 1) -> DataFrame:
    """(cluster, site, k, error): medoids of sites under Hamming distance, weighted by how often a site occurs.

    Work is on distinct sites. All restarts run side by side: a round is one assignment and, per restart
    and cluster, one minimum of summed distances, until no restart's error falls any more. Starts are
    picked by a hash, so runs agree."""
    weighted = sites.groupBy("site").agg(F.count("*").alias("w")).persist()
    spark = sites.sparkSession
    try:
        # The first k sites of each restart's order; restarts * k rows.
        starts = weighted.select("site", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("run"))
        order = F.struct(F.md5(F.concat("site", F.lit(f":{seed}:"), F.col("run").cast("string"))).alias("h"), "site")
        chosen: dict[int, list[str]] = {}
        ranked = starts.select("run", "site", order.alias("o")).withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("o")))
        for r in ranked.where(F.col("r") <= k).collect():
            chosen.setdefault(r["run"], []).append(r["site"])
        if any(len(x) < k for x in chosen.values()) or not chosen:
            raise ValueError("k exceeds the number of distinct sites")
        best: dict[int, tuple[float, list[str]]] = {}
        for _ in range(rounds):
            rows = [(run, c, s) for run, own in chosen.items() for c, s in enumerate(sorted(own), 1)]
            medoids = spark.createDataFrame(rows, "run int, cluster int, m string").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("cluster", "m"))).alias("medoids"))
            near = F.array_min(F.transform("medoids", lambda m: F.struct(S.hamming(F.col("site"), m["m"]).alias("dist"), m["cluster"].alias("cluster"))))
            placed = weighted.crossJoin(F.broadcast(medoids)).select("run", "site", "w", near.alias("near")).select("run", "site", "w", "near.*")  # a row a restart
            # A medoid minimises the sum of distances, place by place a sum over base counts.
            counts = placed.select("run", "cluster", "w", F.posexplode(F.split("site", "")).alias("k", "b")).groupBy("run", "cluster", "k", "b").agg(F.sum("w").alias("c"))
            table = counts.groupBy("run", "cluster").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("k").cast("string"), "b"), "c"))).alias("m"))
            agree = lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("m", F.concat((i - 1).cast("string"), F.substring(s, i, F.lit(1)))), F.lit(0)))
            costs = placed.join(F.broadcast(table), ["run", "cluster"]).withColumn("agree", agree(F.col("site")))
            found = costs.groupBy("run", "cluster").agg(F.min_by("site", F.struct(-F.col("agree"), "site")).alias("s"), F.sum(F.col("w") * F.col("dist")).alias("error")).collect()
            new: dict[int, list[str]] = {}
            for run, own in list(chosen.items()):
                error = float(sum(r["error"] for r in found if r["run"] == run))
                if run not in best or error < best[run][0]:
                    best[run] = (error, sorted(own))
                    moved = sorted({r["s"] for r in found if r["run"] == run})
                    if len(moved) == k and moved != sorted(own):
                        new[run] = moved
            chosen = new
            if not chosen:
                break
    finally:
        weighted.unpersist()
    error, kept = min(best.values())
    return spark.createDataFrame([(i, s, k, error) for i, s in enumerate(kept, 1)], "cluster int, site string, k int, error double")


def linear_unit(features: DataFrame) -> DataFrame:
    """(w0, w1, w2) of the linear unit with least squared error on features(x, y, target).

    The batch delta rule converges to the least-squares solution; its nine moments are summed in one
    pass and the three equations solved on the driver."""
    import numpy as np

    cols = [F.lit(1.0), F.col("x"), F.col("y")]
    sums = features.agg(*(F.sum(a * b) for a in cols for b in cols), *(F.sum(a * F.col("target")) for a in cols)).first()
    values = [0.0 if v is None else float(v) for v in sums]
    w = np.linalg.lstsq(np.array(values[:9]).reshape(3, 3), np.array(values[9:]), rcond=None)[0]
    return features.sparkSession.createDataFrame([tuple(map(float, w))], "w0 double, w1 double, w2 double")


def sigmoid_unit(features: DataFrame, rate: float = 2.0, epochs: int = 500, least: float = 1e-5) -> DataFrame:
    """(w0, w1, w2, epochs, converged) of a sigmoid unit by batch gradient descent on mean squared error.

    An epoch is one aggregation; epochs end once the error falls by less than `least` of itself. A step
    that would raise it is halved. The order-dependent updates of single rows are replaced by batches on purpose."""
    rows, w, step, before, n = features.persist(), [0.0, 0.0, 0.0], rate, None, 0
    converged = False
    try:
        kept, slope = w, [0.0, 0.0, 0.0]
        for n in range(1, epochs + 1):
            out = 1 / (1 + F.exp(-(w[0] + w[1] * F.col("x") + w[2] * F.col("y"))))
            off = F.col("target") - out
            delta = off * out * (1 - out)
            *g, error = rows.agg(*(F.avg(delta * c) for c in (F.lit(1.0), F.col("x"), F.col("y"))), F.avg(off * off)).first()
            error = float(error or 0)
            if before is not None and error > before:
                step /= 2
            else:
                converged = before is not None and before - error <= least * before
                before, kept, slope = error, w, [float(x or 0) for x in g]
                if converged or not any(slope):
                    converged = True
                    break
                step *= 1.1
            w = [a + step * b for a, b in zip(kept, slope, strict=True)]
    finally:
        rows.unpersist()
    return features.sparkSession.createDataFrame([(*map(float, kept), n, converged)], "w0 double, w1 double, w2 double, epochs int, converged boolean")


def activation(x: Column, y: Column, w0: Column, w1: Column, w2: Column, sigmoid: bool = False) -> Column:
    z = w0 + w1 * x + w2 * y
    return 1 / (1 + F.exp(-z)) if sigmoid else z
