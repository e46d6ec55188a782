"""k-mer counts, Markov tables, and likelihoods with them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import seq as S
from seqspark.operators import arrays

#: Order of the models, pseudocount, reliable histogram count, least confidence, null bounds.
ORDER, PSEUDO, RELIABLE, CONFIDENCE, NULL_BOUND, NULL_FIX = 5, 5, 400, 0.5, 1e-5, 5e-5
NONCODING = 3
#: Fixed value: number of the noncoding model where models 3 to 5 are those of the reverse strand.
BOTH_NONCODING = 6
#: Fixed value: bases of a GC window.
GC_WIDTH = 100
#: Ratio of a bucket's counts, held-out counts that it needs, share of equal probabilities at the start.
BUCKET_RATIO, HELD_OUT, EVEN_SHARE = 1.2, 50, 1e-5


def hexamers(seqs: DataFrame, model: Column, *keep: str) -> DataFrame:
    """One row per base from the sixth-last on excluded: (keep, model, i zero-based, hexamer)."""
    return _windows(seqs, *keep).select(*keep, model.cast("int").alias("model"), "i", "hexamer")


def _cut(rows: DataFrame, keep: list[str], size: int, overlap: int, lead: int) -> DataFrame:
    """rows(keep, at, first, n, seq) in parts of `size` starts: at is the zero-based place of the part's first start,
    first the place in it of that start, seq the part with up to lead letters before and overlap after."""
    n = F.length("seq")
    starts = n - F.col("first") - overlap  # in this row
    count = F.greatest(F.lit(1), F.ceil(starts / size)).cast("int")

    def part(k: Column) -> Column:
        begin = F.col("first") + k * size
        before = F.least(begin, F.lit(lead))
        return F.struct((F.col("at") + k * size).alias("at"), before.cast("int").alias("first"), F.substring("seq", (begin - before + 1).cast("int"), F.lit(size + overlap) + before.cast("int")).alias("seq"))

    return rows.select(*keep, "n", F.explode(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("x")).select(*keep, "n", "x.*")


def chunks(seqs: DataFrame, *keep: str, size: int = 1 << 11, overlap: int = ORDER, lead: int = 0) -> DataFrame:
    """(keep, n, at, first, seq): sequences of more than overlap letters in parts of `size` starts of windows, n the whole
    length; see _cut(). Two steps of cutting keep the work linear in the sequence: each slice is counted
    off from the beginning of what it is cut from."""
    rows = seqs.where(F.length("seq") > overlap).select(*keep, F.length("seq").alias("n"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("first"), "seq")
    return _cut(_cut(rows, [*keep], 1 << 18, overlap, lead), [*keep], size, overlap, lead)


def _windows(seqs: DataFrame, *keep: str) -> DataFrame:
    """(keep, i, hexamer); the words are cut inside the array, from short parts of the sequence, so rows do not carry it."""
    rows = chunks(seqs, *keep)
    rows = rows.select(*keep, "at", F.length("seq").alias("m"), F.col("seq").cast("binary").alias("b"))  # a slice of bytes is not counted off
    words = F.transform(F.sequence(F.lit(1), F.col("m") - ORDER), lambda i: F.substring("b", i, F.lit(ORDER + 1)).cast("string"))
    rows = rows.select(*keep, "at", F.posexplode(words).alias("j", "hexamer"))
    return rows.select(*keep, (F.col("at") + F.col("j")).cast("int").alias("i"), "hexamer")


def count_hexamers(seqs: DataFrame, model: Column, *use: str, period: int | None = None) -> DataFrame:
    """(model, hexamer, n); model may use i and the columns use of seqs.

    With period, model depends on i only by its remainder by period: tasks then count words as numbers, and a few sums
    of each task are what is shuffled. Without it every place is a row."""
    if period is None:
        return hexamers(seqs, model, *use).groupBy("model", "hexamer").agg(F.count("*").alias("n"))
    rows = arrays.count_words(seqs, list(use), period)
    return rows.groupBy(model.cast("int").alias("model"), "hexamer").agg(F.sum("n").alias("n"))


def count_kmers(seqs: DataFrame, model: Column, *use: str, period: int | None = None) -> DataFrame:
    """(model, k, hist, base, n) for k = 1..6; hexamers are counted once, shorter words from their prefixes.

    model may use i and the columns use of seqs, so pmod(i, 3) counts by codon phase (with period 3, see count_hexamers()). All
    orders see the same start places."""
    six = count_hexamers(seqs, model, *use, period=period)
    rows = six.select("model", "hexamer", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"))
    word = F.substring("hexamer", F.lit(1), F.col("k"))
    rows = rows.groupBy("model", "k", word.alias("w")).agg(F.sum("n").alias("n"))
    return rows.select("model", "k", F.substring("w", F.lit(1), F.col("k") - 1).alias("hist"), F.substring("w", F.col("k"), F.lit(1)).alias("base"), "n")


def relative_freq(kmers: DataFrame) -> DataFrame:
    """kmers with ml, the share of a base after its history."""
    return kmers.withColumn("ml", F.col("n") / F.sum("n").over(Window.partitionBy("model", "k", "hist")))


def histories(spark, k: int) -> DataFrame:
    """All histories of k bases: (hist); 4^k rows."""
    out = spark.createDataFrame([("",)], "hist string")
    for _ in range(k):
        out = out.select(F.explode(F.array(*(F.concat("hist", F.lit(b)) for b in S.BASES))).alias("hist"))
    return out


def full_grid(models: DataFrame, k: int) -> DataFrame:
    """(model, hist, base) of order k for every model; a model-sized table."""
    grid = models.select("model").distinct().crossJoin(F.broadcast(histories(models.sparkSession, k)))
    return grid.withColumn("base", F.explode(F.array(*map(F.lit, S.BASES))))


def _absent_words(k: int) -> Column:
    """Array of (w, n) with every word of k bases and the count 0."""
    letter = lambda i, j: F.substring(F.lit(S.BASES), F.shiftright(i, 2 * j).bitwiseAND(F.lit(3)) + 1, F.lit(1))
    word = lambda i: F.struct(F.concat(*(letter(i, j) for j in range(k))).alias("w"), F.lit(0).cast("long").alias("n"))
    return F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), word)


def train_fixed_order(kmers: DataFrame) -> DataFrame:
    """(model, hist, base, p): order-5 chain with PSEUDO added to every count."""
    word = F.concat("hist", "base")
    six = kmers.where((F.col("k") == ORDER + 1) & word.rlike(f"^[{S.BASES}]+$"))
    # Words that do not occur join as zeros in the model's own row, so the counts behind it are worked out once, not
    # once more for the list of models; a model has at most 4,096 words.
    seen = six.groupBy("model").agg(F.collect_list(F.struct(word.alias("w"), F.col("n").cast("long").alias("n"))).alias("seen"))
    rows = seen.select("model", F.explode(F.concat("seen", _absent_words(ORDER + 1))).alias("x")).groupBy("model", "x.w").agg((F.sum("x.n") + PSEUDO).alias("c"))
    rows = rows.select("model", F.substring("w", 1, ORDER).alias("hist"), F.substring("w", ORDER + 1, 1).alias("base"), "c")
    return rows.select("model", "hist", "base", (F.col("c") / F.sum("c").over(Window.partitionBy("model", "hist"))).alias("p"))


def chi2_confidence(x: Column) -> Column:
    """Probability below x of chi-square with three degrees of freedom, by its power series."""
    half = x / 2
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * half / (i + 1.5)).alias("t"), (a["s"] + a["t"] * half / (i + 1.5)).alias("s")),
        lambda a: a["s"],
    )
    # half^1.5 e^-half / Gamma(2.5), Gamma(2.5) = 0.75 sqrt(pi)
    # From 100 on the series would need more terms and the probability is 1 in double precision.
    return F.when(x <= 0, 0.0).when(x >= 100, 1.0).otherwise(F.least(F.lit(1.0), F.pow(half, F.lit(1.5)) * F.exp(-half) / (0.75 * F.sqrt(F.pi())) * terms))


def adjust_nulls(rows: DataFrame, own: Window) -> DataFrame:
    """Raise probabilities below NULL_BOUND in rows(p, total) of one history and shrink the others."""
    fix = F.greatest(F.lit(NULL_FIX), F.try_divide(F.lit(1.0), F.col("total")))
    fixed = F.when(F.col("p") < NULL_BOUND, fix).otherwise(F.col("p") * (1 - 4 * fix) + fix)
    return rows.withColumn("p", F.when((F.min("p").over(own) < NULL_BOUND) & (F.col("total") > 0), fixed).otherwise(F.col("p")))


def train_chi2_imm(kmers: DataFrame) -> DataFrame:
    """(model, k, hist, base, p): interpolated chain; each order leans on the next shorter one by a
    chi-square test of its counts against it. Tables are model-sized; order k joins order k - 1."""
    kmers = kmers.persist()  # every order reads it; at most 5,460 rows a model
    base = relative_freq(kmers.where("k = 1"))
    level = base.select("model", F.lit(1).alias("k"), F.lit("").alias("hist"), "base", F.col("ml").alias("p")).persist()
    out = level
    for k in range(2, ORDER + 2):
        own = Window.partitionBy("model", "hist")
        seen = kmers.where(F.col("k") == k).select("model", "hist", "base", "n")
        rows = full_grid(kmers, k - 1).join(seen, ["model", "hist", "base"], "left").fillna(0, ["n"])
        shorter = level.select("model", F.col("hist").alias("tail"), "base", F.col("p").alias("q"))
        rows = rows.withColumn("tail", F.expr("substring(hist, 2)")).join(shorter, ["model", "tail", "base"])
        rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("expected", F.col("total") * F.col("q"))
        # A 2 x 4 table of the counts and their expectation under the shorter history.
        mean = (F.col("n") + F.col("expected")) / 2
        part = F.when(mean > 0, (F.pow(F.col("n") - mean, F.lit(2)) + F.pow(F.col("expected") - mean, F.lit(2))) / mean).otherwise(0.0)
        rows = rows.withColumn("chi2", F.sum(part).over(own)).withColumn("least", F.min(F.least(mean, "expected")).over(own))
        confidence = chi2_confidence(F.col("chi2"))
        weight = F.when(F.col("total") >= RELIABLE, 1.0).when((F.col("least") < 5) | (confidence < CONFIDENCE), 0.0).otherwise(confidence * F.col("total") / RELIABLE)
        rows = rows.withColumn("l", weight)
        p = F.when(F.col("total") > 0, F.col("l") * F.col("n") / F.col("total") + (1 - F.col("l")) * F.col("q")).otherwise(F.col("q"))
        rows = adjust_nulls(rows.withColumn("p", p), own)
        level = rows.select("model", F.lit(k).alias("k"), "hist", "base", "p").persist()
        out = out.union(level)
    return out


def induce_pseudocounts(kmers: DataFrame) -> DataFrame:
    """kmers in which every hexamer that does not occur counts once, and so do its prefixes: an absent word of
    k bases gets 4^(6-k). Tables are model-sized."""
    six = kmers.where(F.col("k") == ORDER + 1).select("model", "hist", "base", "n")
    rows = full_grid(six, ORDER).join(six, ["model", "hist", "base"], "left")
    rows = rows.select("model", F.concat("hist", "base").alias("w"), F.coalesce("n", F.lit(1)).alias("n"), F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"))
    rows = rows.groupBy("model", "k", F.substring("w", F.lit(1), F.col("k")).alias("w")).agg(F.sum("n").alias("n"))
    return rows.select("model", "k", F.substring("w", F.lit(1), F.col("k") - 1).alias("hist"), F.substring("w", F.col("k"), F.lit(1)).alias("base"), "n")


def with_gc_bin(seqs: DataFrame, bounds: DataFrame) -> DataFrame:
    """seqs with q, the first of bounds(q, bound) that the integer GC percent of the sequence does not exceed,
    the last one if it exceeds all; a handful of bounds travels as one array row."""
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("q", "bound"))).alias("__bounds"))
    n = F.length("seq")
    gc = F.floor(100 * (n - F.length(F.translate("seq", "GC", ""))) / n)
    fits = F.filter("__bounds", lambda b: b["bound"] >= gc)
    q = F.when(F.size(fits) > 0, fits[0]["q"]).otherwise(F.element_at("__bounds", -1)["q"])
    return seqs.crossJoin(F.broadcast(table)).withColumn("q", q).drop("__bounds")


def train_gc_fixed_order(binned: DataFrame) -> DataFrame:
    """(q, model, hist, base, p): one 3-periodic order-5 chain for each GC bin of binned(q, seq)."""
    six = count_hexamers(binned, F.col("q") * 10 + F.pmod(F.col("i"), F.lit(3)), "q", period=3)
    six = six.select("model", F.lit(ORDER + 1).alias("k"), F.substring("hexamer", 1, ORDER).alias("hist"), F.substring("hexamer", ORDER + 1, 1).alias("base"), "n")
    rows = train_fixed_order(six)
    return rows.select(F.floor(F.col("model") / 10).cast("int").alias("q"), (F.col("model") % 10).cast("int").alias("model"), "hist", "base", "p")


def gc_loglik(binned: DataFrame, chains: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, q, loglik) of phase 0 under the chain of the sequence's own GC bin; bins without a chain give none.

    Chains have 4,096 rows a bin and model, which bounds what tasks are given."""
    tables = bin_logs(chains)

    def body(batch):
        index, sums = [], []
        for k, (seq, q) in enumerate(zip(arrays.column(batch), arrays.column(batch, "q"), strict=True)):
            if seq is None or q not in tables:
                continue
            total, found = _phased(arrays.letters(seq), tables[q])
            if found:
                index.append(k)
                sums.append(total)
        return index, [pa.array(sums, pa.float64())]

    rows = arrays.extend(binned, [key, "q"], "loglik double", body)
    return rows.groupBy(key, "q").agg(F.sum("loglik").alias("loglik"))


def bin_logs(chains: DataFrame) -> dict:
    """{q: (known, logs)} of chains(q, model, hist, base, p) by phase and word, 0 where a chain lacks a word."""
    out: dict = {}
    for r in chains.select("q", "model", F.concat("hist", "base").alias("w"), S.log_or_inf(F.col("p")).alias("ln")).where(F.col("model").isin(0, 1, 2)).collect():
        known, logs = out.setdefault(r["q"], (np.zeros((3, arrays.OTHER + 1), bool), np.zeros((3, arrays.OTHER + 1))))
        at = int(arrays.words(arrays.letters(r["w"].encode()))[0])
        if at < arrays.OTHER:
            known[r["model"], at], logs[r["model"], at] = True, r["ln"]
    return out


def _phased(code, table, use=None) -> tuple[float, bool]:
    """(sum, whether there is a word) of all words of code (those of use, if given) under the table of their place's remainder by three."""
    known, logs = table
    total, found = 0.0, False
    for at in range(0, len(code) - ORDER, arrays.PIECE):
        word = arrays.words(code[at : at + arrays.PIECE + ORDER])
        for r in range(3):
            own = word[r::3] if use is None else word[r::3][use[at : at + len(word)][r::3]]
            phase = (at + r) % 3
            total += float(logs[phase, own].sum())
            found = found or bool(known[phase, own].any())
    return total, found


def history_buckets(counts: list[int], held: list[int]) -> list[list[int]]:
    """Histories that occur, by rising training count, in buckets that share one weight: a bucket takes counts
    up to BUCKET_RATIO times its first one and at least HELD_OUT held-out counts; a last one that would be
    narrower than that ratio is pooled with the one before. Lists indexes of counts."""
    order = sorted((i for i, n in enumerate(counts) if n > 0), key=lambda i: (counts[i], i))
    out: list[list[int]] = []
    at = 0
    while at < len(order):
        stop, till, seen = math.ceil(BUCKET_RATIO * counts[order[at]]), at, 0
        if math.ceil(BUCKET_RATIO * stop) > counts[order[-1]]:
            till = len(order)
        while till < len(order) and (counts[order[till]] <= stop or seen < HELD_OUT):
            seen += held[order[till]]
            till += 1
        out.append(order[at:till])
        at = till
    return out


def best_weight(held, longer, shorter) -> float:
    """The weight l in 0 to 1 that gives held-out counts the highest likelihood under l * longer + (1 - l) * shorter.

    The likelihood has one maximum, so its slope is bisected."""
    import numpy as np

    use = (held > 0) & (longer + shorter > 0)
    c, d, s = held[use].astype(float), (longer - shorter)[use], shorter[use]
    slope = lambda x: float((c * d / np.maximum(x * d + s, 1e-300)).sum())
    if not len(c) or slope(1.0) >= 0:
        return 1.0
    if slope(0.0) <= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if slope(middle) > 0 else (lo, middle)
    return (lo + hi) / 2


def _interpolated(top_down: bool):
    def train(pdf):
        import numpy as np
        import pandas as pd

        own = {k: np.zeros((2, 4 ** (k - 1), 4), dtype=np.int64) for k in range(1, ORDER + 2)}
        digits = {b: i for i, b in enumerate(S.BASES)}
        for k, hist, base, n, held in zip(pdf["k"], pdf["hist"], pdf["base"], pdf["n"], pdf["held"], strict=True):
            at = 0
            for b in hist:
                at = at * 4 + digits[b]
            own[k][:, at, digits[base]] += (n, held)
        ml = {k: x[0] / np.maximum(x[0].sum(axis=1, keepdims=True), 1) for k, x in own.items()}
        before, rows = np.full((1, 4), 0.25), []
        for k in range(1, ORDER + 2):
            seen, held = own[k]
            size = len(seen)
            short = before[np.arange(size) % len(before)]  # a history without its first base
            p = short.copy()  # histories that do not occur take the shorter one's
            for bucket in history_buckets(seen.sum(axis=1).tolist(), held.sum(axis=1).tolist()):
                if top_down:
                    weight = best_weight(held[bucket], short[bucket], ml[k][bucket])
                    p[bucket] = weight * short[bucket] + (1 - weight) * ml[k][bucket]
                    continue
                mixed = (1 - EVEN_SHARE) * ml[k][bucket] + EVEN_SHARE * 0.25
                for j in range(k - 1, -1, -1):
                    other = ml[j][np.array(bucket) % 4 ** max(0, j - 1)] if j else np.full((len(bucket), 4), 0.25)
                    weight = best_weight(held[bucket], mixed, other)
                    mixed = weight * mixed + (1 - weight) * other
                p[bucket] = mixed
            before = p
            names = ["".join(S.BASES[i // 4**j % 4] for j in range(k - 2, -1, -1)) for i in range(size)]
            rows.append(pd.DataFrame({"model": pdf["model"].iloc[0], "k": k, "hist": np.repeat(names, 4), "base": list(S.BASES) * size, "p": p.ravel()}))
        return pd.concat(rows).astype({"model": "int32", "k": "int32"})

    return train


def train_deleted_interpolation(kmers: DataFrame, held_out: DataFrame, top_down: bool = True) -> DataFrame:
    """(model, k, hist, base, p): each order mixed with shorter ones by weights that held-out counts choose,
    one for each bucket of histories.

    Top-down, an order leans on the finished next shorter one. Bottom-up, its own shares, slightly evened, are
    mixed with those of every shorter order in turn, down to equal ones. A group is one model: at most 5,460
    rows, whatever the input."""
    names = ["model", "k", "hist", "base"]
    both = kmers.select(*names, "n", F.lit(0).cast("long").alias("held")).union(held_out.select(*names, F.lit(0).cast("long"), "n"))
    sums = both.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return sums.groupBy("model").applyInPandas(_interpolated(top_down), "model int, k int, hist string, base string, p double")


def wide_model(chain: DataFrame, models: int = NONCODING + 1) -> DataFrame:
    """(hexamer, l0, l1, ...): log probabilities of a fixed-order chain by model; 4,096 rows."""
    logs = [S.log_or_inf(F.max(F.when(F.col("model") == m, F.col("p")))).alias(f"l{m}") for m in range(models)]
    return chain.groupBy(F.concat("hist", "base").alias("hexamer")).agg(*logs)


def fo_loglik(seqs: DataFrame, model: DataFrame, key: str = "seq_id", periodic: bool = True) -> DataFrame:
    """(key, model, loglik) under each phase table of a fixed-order chain; table (i - 5 + model) mod 3.

    A task sums the logarithms of a sequence's words for all phases at once; the table has 4,096 rows."""
    known, logs = word_logs(model)
    if not periodic:
        rows = arrays.phase_sums(seqs, [key], known, logs, [[NONCODING] * 3])
        return rows.groupBy(key).agg(F.sum("s0").alias("loglik")).select(key, F.lit(0).alias("model"), "loglik")
    return _by_model(arrays.phase_sums(seqs, [key], known, logs, [[(r + m) % 3 for r in range(3)] for m in range(3)]), key, 3)


def word_logs(chain: DataFrame, models: int = NONCODING + 1):
    """(known, logs) of wide_model() by word, the last row for words with other symbols: 4,097 rows."""
    known, logs = np.zeros(arrays.OTHER + 1, bool), np.zeros((arrays.OTHER + 1, models))
    for r in wide_model(chain, models).collect():
        at = int(arrays.words(arrays.letters(r["hexamer"].encode()))[0])
        if at < arrays.OTHER:
            known[at], logs[at] = True, r[1:]
    return known, logs


def _by_model(rows: DataFrame, key: str, models: int) -> DataFrame:
    """rows(key, s0, s1, ...) as (key, model, loglik); rows of one key add up."""
    sums = rows.groupBy(key).agg(*(F.sum(f"s{m}").alias(f"s{m}") for m in range(models)))
    return sums.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"s{m}").alias("loglik")) for m in range(models)))).alias("x")).select(key, "x.*")


def both_strand_loglik(seqs: DataFrame, chain: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, model, loglik) under the seven models of a fixed-order chain: the phases of the forward strand (0 to 2), of the
    reverse strand (3 to 5, from content.count_kmers_shadow()) and noncoding (6).

    Models m and m + 3 take table (i - 5 + m) mod 3 of their strand at base i. As in fo_loglik(), a word adds to all seven
    sums at once."""
    known, logs = word_logs(chain, BOTH_NONCODING + 1)
    turns = [[m - m % 3 + (r + m) % 3 for r in range(3)] for m in range(BOTH_NONCODING)] + [[BOTH_NONCODING] * 3]
    return _by_model(arrays.phase_sums(seqs, [key], known, logs, turns), key, BOTH_NONCODING + 1)


def posteriors(logs: DataFrame, noncoding: int = NONCODING, key: str = "seq_id") -> DataFrame:
    """(key, model, posterior) of logs(key, model, loglik): noncoding has prior one half, the coding models share the other half.

    A model whose likelihood is zero has posterior 0; sequences for which all have are left out."""
    prior = F.when(F.col("model") == noncoding, 0.5).otherwise(0.5 / noncoding)
    own = Window.partitionBy(key)
    rows = logs.withColumn("w", F.col("loglik") + F.log(prior)).withColumn("top", F.max("w").over(own)).where(F.col("top") > float("-inf"))
    rows = rows.withColumn("e", F.exp(F.col("w") - F.col("top")))
    return rows.select(key, "model", (F.col("e") / F.sum("e").over(own)).alias("posterior"))


def classify_coding(seqs: DataFrame, coding: DataFrame, noncoding: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, best, posterior): posterior of each phase and of noncoding with priors 1/6 and 1/2."""
    logs = fo_loglik(seqs, coding, key).union(fo_loglik(seqs, noncoding, key, False).withColumn("model", F.lit(NONCODING)))
    logs = logs.withColumn("w", F.col("loglik") + F.log(F.when(F.col("model") == NONCODING, 0.5).otherwise(1 / 6)))
    own = Window.partitionBy(key)
    logs = logs.withColumn("e", F.exp(F.col("w") - F.max("w").over(own)))
    logs = logs.withColumn("posterior", F.round(F.col("e") / F.sum("e").over(own), 6))
    best = F.max_by(F.struct("model", "posterior"), F.struct("posterior", -F.col("model"))).alias("b")
    return logs.groupBy(key).agg(best).select(key, F.col("b.model").alias("best"), F.col("b.posterior").alias("posterior"))


def best_tallies(classified: DataFrame) -> DataFrame:
    """(best, n, share) over all classified sequences."""
    counts = classified.groupBy("best").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def _gc(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _gc_counts(seq: Column, width: int, body) -> Column:
    """body(counts), counts the array of G and C in each window of width letters: sums of tens of letters, then of tens."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    ones = F.transform(F.split(seq, ""), lambda c: c.isin("G", "C").cast("int"))
    tens = lambda o: F.transform(F.sequence(F.lit(1), F.size(o) - 9), lambda i: total(F.slice(o, i, F.lit(10))))
    places = F.array(*(F.lit(k) for k in range(0, width - 9, 10)))

    def windows(o: Column, t: Column) -> Column:
        count = lambda i: F.aggregate(places, F.lit(0), lambda s, k: s + F.get(t, i + k))
        rest = (lambda i: total(F.slice(o, i + width - width % 10 + 1, F.lit(width % 10)))) if width % 10 else None
        return F.transform(F.sequence(F.lit(0), F.size(o) - width), lambda i: count(i) + rest(i) if rest else count(i))

    return _let(ones, lambda o: _let(tens(o), lambda t: _let(windows(o, t), body)))


def gc_windows(seqs: DataFrame, width: int = GC_WIDTH) -> DataFrame:
    """(gc, n): integer GC percent of every window of `width` bases; shorter sequences count once, whole.

    Tasks count windows from running sums; at most 101 rows of each are shuffled."""

    def count(batches):
        counts = np.zeros(101, np.int64)
        for batch in batches:
            for seq in arrays.column(batch):
                if seq:
                    counts += np.bincount(_window_gc(arrays.letters(seq), width), minlength=101)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["gc", "n"])

    rows = seqs.select(F.col("seq").cast("binary").alias("seq")).mapInArrow(count, "gc int, n long")
    return rows.groupBy("gc").agg(F.sum("n").alias("n"))


def _window_gc(code, width: int):
    """Integer GC percent of every window of `width` codes, of all codes where they are fewer."""
    till = np.concatenate(([0], np.cumsum((code == 1) | (code == 2), dtype=np.int64)))
    size = min(width, len(code))
    return 100 * (till[size:] - till[:-size]) // size


def _gc_bins(bounds: DataFrame, width: int, edges: bool):
    """A function of a sequence's codes that gives every hexamer the GC bin of gc_hexamers(), -1 where that leaves it out, and the
    names of the bins. bounds has a handful of rows."""
    listed = sorted((r["q"], r["bound"]) for r in bounds.select("q", "bound").collect())
    names = [q for q, _ in listed]
    of_percent = np.array([next((k for k, (_, b) in enumerate(listed) if b >= g), len(listed) - 1) for g in range(101)])
    side = (width - ORDER - 1) // 2

    def find(code):
        n = len(code) - ORDER
        bins = of_percent[_window_gc(code, width)]
        if len(bins) == 1 and len(code) < width:
            return np.full(n, bins[0])
        out = bins[np.clip(np.arange(n) - side, 0, len(bins) - 1)]
        if not edges:
            out[:side] = -1
            out[side + len(bins) :] = -1
        return out

    return find, names


def _bins(bounds: DataFrame) -> DataFrame:
    """(gc, q) for every integer percent: the first of bounds(q, bound) that it does not exceed, else the last; 101 rows."""
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("q", "bound"))).alias("b"))
    fits = lambda g: F.filter("b", lambda x: x["bound"] >= g)
    q = lambda g: F.when(F.size(fits(g)) > 0, fits(g)[0]["q"]).otherwise(F.element_at("b", -1)["q"])
    return table.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda g: F.struct(g.alias("gc"), q(g).alias("q")))).alias("x")).select("x.*")


def gc_hexamers(seqs: DataFrame, bounds: DataFrame, *keep: str, edges: bool = False, width: int = GC_WIDTH) -> DataFrame:
    """(keep, i, hexamer, q): every hexamer with the GC bin of the window of `width` bases in whose middle it stands.

    Hexamers nearer to an end than half a window are left out; with edges they take the bin of the first or last
    window. Sequences shorter than a window take the bin of the whole sequence for all hexamers. The work is
    linear: a part of a sequence has the letters around it that its windows need."""
    side = (width - ORDER - 1) // 2
    rest = width - side - ORDER - 1
    n = F.col("n")
    last = lambda x: F.least(F.greatest(x, F.lit(0)), (n - width).cast("long"))  # noqa: E731  start of a window
    lead = width - ORDER - 1
    rows = chunks(seqs.where(F.length("seq") >= width), *keep, overlap=width - 1, lead=lead)
    # The last part of a sequence has its last starts in the overlap, the others only their own.
    ends = F.col("at") - F.col("first") + F.length("seq") == n
    own = F.when(ends, F.length("seq") - F.col("first") - ORDER).otherwise(F.length("seq") - F.col("first") - width + 1)
    words = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.substring("b", (F.col("first") + j + 1).cast("int"), F.lit(ORDER + 1)).cast("string"))
    start = lambda j: (last(F.col("at") + j - side) - F.col("at") + F.col("first")).cast("int")  # noqa: E731  of the window, in the part
    percents = _gc_counts(F.col("seq"), width, lambda c: F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: F.floor(100 * F.get(c, start(j)) / width).cast("int")))
    rows = rows.select(*keep, "n", "at", "first", own.alias("own"), "seq", F.col("seq").cast("binary").alias("b"))
    rows = rows.select(*keep, "n", "at", F.posexplode(F.arrays_zip(words.alias("hexamer"), percents.alias("gc"))).alias("j", "x"))
    rows = rows.select(*keep, "n", (F.col("at") + F.col("j")).cast("int").alias("i"), "x.hexamer", "x.gc")
    if not edges:
        rows = rows.where((F.col("i") >= side) & (F.col("i") + ORDER + 1 + rest <= n))
    whole = seqs.where((F.length("seq") < width) & (F.length("seq") > ORDER)).withColumn("gc", F.floor(100 * _gc(F.col("seq")) / F.length("seq")).cast("int"))
    short = _windows(whole, *keep, "gc").select(*keep, "i", "hexamer", "gc")
    return rows.select(*keep, "i", "hexamer", "gc").union(short).join(F.broadcast(_bins(bounds)), "gc").select(*keep, "i", "hexamer", "q")


def count_gc_kmers(seqs: DataFrame, bounds: DataFrame, model: Column, period: int | None = None) -> DataFrame:
    """(q, model, k, hist, base, n): count_kmers() by the GC bin of each position's window; model may use i, and period
    is that of count_hexamers()."""
    if period is None:
        six = gc_hexamers(seqs, bounds).select("q", model.cast("int").alias("model"), "hexamer").groupBy("q", "model", "hexamer").agg(F.count("*").alias("n"))
    else:
        find, names = _gc_bins(bounds, GC_WIDTH, False)
        rows = arrays.count_words(seqs, [], period, find, "at int")
        q = F.element_at(F.array(*(F.lit(q).cast(bounds.schema["q"].dataType) for q in names)), F.col("at") + 1) if names else F.lit(None).cast(bounds.schema["q"].dataType)
        six = rows.groupBy(q.alias("q"), model.cast("int").alias("model"), "hexamer").agg(F.sum("n").alias("n"))
    rows = six.select("q", "model", "hexamer", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"))
    rows = rows.groupBy("q", "model", "k", F.substring("hexamer", F.lit(1), F.col("k")).alias("w")).agg(F.sum("n").alias("n"))
    return rows.select("q", "model", "k", F.substring("w", F.lit(1), F.col("k") - 1).alias("hist"), F.substring("w", F.col("k"), F.lit(1)).alias("base"), "n")


def train_by_bin(train, *counts: DataFrame) -> DataFrame:
    """The tables that train(*counts) makes, for every GC bin of counts(q, model, k, hist, base, n) in one pass: bin and
    model travel as one number. train is any trainer whose result has a model column."""
    both = [c.withColumn("model", (F.col("q") * 100 + F.col("model")).cast("int")).drop("q") for c in counts]
    out = train(*both)
    rest = [c for c in out.columns if c != "model"]
    return out.select(F.floor(F.col("model") / 100).cast("int").alias("q"), (F.col("model") % 100).cast("int").alias("model"), *rest)


def gc_window_loglik(seqs: DataFrame, bounds: DataFrame, chains: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, loglik): each hexamer under the order-5 chain of chains(q, model, hist, base, p) for the GC bin of its own
    window, and the model of its place's remainder by three. Positions whose bin has no chain add nothing. Chains have
    4,096 rows a bin and model, which bounds what tasks are given."""
    find, names = _gc_bins(bounds, GC_WIDTH, True)
    tables = bin_logs(chains)

    def body(batch):
        index, sums = [], []
        for k, seq in enumerate(arrays.column(batch)):
            code = arrays.letters(seq or b"")
            if len(code) <= ORDER or not names:
                continue
            bins = find(code)
            each = [_phased(code, tables[names[q]], bins == q) for q in np.unique(bins).tolist() if names[q] in tables]
            if any(found for _, found in each):
                index.append(k)
                sums.append(sum(total for total, _ in each))
        return index, [pa.array(sums, pa.float64())]

    return arrays.extend(seqs, [key], "loglik double", body).groupBy(key).agg(F.sum("loglik").alias("loglik"))


def partition_stats(models: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation and range of p over training splits, and the clipped band around the mean."""
    out = models.groupBy(*keys).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"), F.min("p").alias("lo_rng"), F.max("p").alias("hi_rng"))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-5)), F.lit(1 - 1e-5))
    return out.withColumn("lo_var", clip(F.col("mean") - F.col("sd"))).withColumn("hi_var", clip(F.col("mean") + F.col("sd")))


def gc_quantiles(histogram: DataFrame, parts: int = 4) -> DataFrame:
    """(q, bound): GC percents that end each of `parts` equal-count bins of histogram(gc, n).

    The histogram has at most 101 rows, which is what its window without partitions sorts."""
    own = Window.orderBy("gc")
    rows = histogram.select("gc", F.sum("n").over(own).alias("till"), F.sum("n").over(Window.partitionBy()).alias("total"))
    cuts = rows.select("gc", "till", "total", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("q"))
    return cuts.where(F.col("till") * parts >= F.col("q") * F.col("total")).groupBy("q").agg(F.min("gc").alias("bound"))


def coding_call(posteriors: DataFrame, key: str = "seq_id", noncoding: int = NONCODING) -> DataFrame:
    """(key, coding, p_coding, best): whether p_coding, the sum of posteriors(key, model, posterior) of all coding models,
    exceeds one half; best is the most probable model, the lowest on ties at six digits."""
    total = F.sum(F.when(F.col("model") != noncoding, F.col("posterior")).otherwise(0.0))
    best = F.max_by("model", F.struct(F.round("posterior", 6), -F.col("model")))
    return posteriors.groupBy(key).agg((total > 0.5).alias("coding"), total.alias("p_coding"), best.alias("best"))
