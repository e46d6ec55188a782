"""Column functions on nucleotide sequences. Positions are one-based, intervals closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extents around a start codon, flank for content scores, least peptide, smoothing bounds.
UPSTREAM, CODON, DOWNSTREAM, SITE = 5, 3, 3, 11
FLANK, FALSE_GAP, MIN_PEPTIDE, MIN_TRAINING = 96, 105, 50, 100
FIRST_CODON = FLANK + UPSTREAM + 1
PROB_MIN, MAX_FAULT = 0.05, 0.0005
BASES = "ACGT"
#: Amino acids of the standard code, codons in TCAG order; a stop is a hyphen.
AMINO_ACIDS = "FFLLSSSSYY--CC-WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")


def normalize_seq(seq: Column, ambiguous: str = "keep", seed: Column | None = None) -> Column:
    """Upper case, U as T. Other symbols stay (keep), make the result null (reject), or become a base
    that a hash of seed and the sequence picks (seeded), the same one in every run."""
    plain = F.translate(F.upper(seq), "U", "T")
    if ambiguous == "keep":
        return plain
    if ambiguous == "reject":
        return F.when(~plain.rlike("[^ACGT]"), plain)
    if ambiguous != "seeded":
        raise ValueError(f"unknown policy {ambiguous}")
    pick = lambda i: F.substring(F.lit(BASES), F.pmod(F.xxhash64(seed if seed is not None else F.lit(0), i), F.lit(4)).cast("int") + 1, F.lit(1))
    fixed = F.transform(F.split(plain, ""), lambda b, i: F.when(F.instr(F.lit(BASES), b) > 0, b).otherwise(pick(i)))
    return F.array_join(fixed, "")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def subseq(contig: Column, start: Column, stop: Column, strand: Column) -> Column:
    """The slice between start and stop in either order, on its strand; null when out of range."""
    lo, hi = F.least(start, stop), F.greatest(start, stop)
    cut = F.upper(F.substring(contig, lo.cast("int"), (hi - lo + 1).cast("int")))
    inside = (lo >= 1) & (hi <= F.length(contig))
    return F.when(inside, F.when(strand == "-", revcomp(cut)).otherwise(cut))


def codons(seq: Column) -> Column:
    """Array of whole codons from the first base on; seq is evaluated once, whatever expression it is."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), 0)


def amino_acid(codon: Column) -> Column:
    """One letter, X for a codon with other symbols."""
    digits = [F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    known = codon.rlike("^[ACGT]{3}$")
    return F.when(known, F.substring(F.lit(AMINO_ACIDS), (digits[0] * 16 + digits[1] * 4 + digits[2] + 1).cast("int"), F.lit(1))).otherwise("X")


def translate_cds(seq: Column) -> Column:
    """Peptide of seq; an incomplete codon at the end is a question mark."""
    tail = F.when(F.length(seq) % 3 != 0, "?").otherwise("")
    return F.concat(F.array_join(F.transform(codons(seq), amino_acid), ""), tail)


def is_met(codon: Column) -> Column:
    return codon == "ATG"


def is_stop(codon: Column) -> Column:
    return codon.isin(*STOPS)


def met_scorable(pos: Column, length: Column, extra: int = 0) -> Column:
    """Whether a codon at pos has the bases around it that a site needs, and extra more on each side."""
    return (pos - UPSTREAM - extra >= 1) & (pos + CODON - 1 + DOWNSTREAM + extra <= length)


def peptide_long_enough(pos: Column, length: Column) -> Column:
    """At least MIN_PEPTIDE codons from pos to the end of the coding part of a flanked sequence."""
    return F.floor((length - FLANK - DOWNSTREAM + 1 - pos) / 3) >= MIN_PEPTIDE


def cds_eligible(length: Column) -> Column:
    """A flanked sequence whose coding part is a positive multiple of three."""
    return (length > 2 * FLANK + UPSTREAM + DOWNSTREAM) & ((length - 2 * FLANK - UPSTREAM - DOWNSTREAM) % 3 == 0)


def training_reject(length: Column, first: Column | int = FIRST_CODON, after: Column | int = DOWNSTREAM + FLANK, bound: int = FLANK + 1) -> Column:
    """Why a sequence cannot be trained on, null where it can: 'short' (under bound bases), 'first codon' (it lacks bases
    behind it to be scored), 'order' (the stop codon lies before the first codon), 'frame' (the coding part is no multiple of three).

    first is the one-based place of the first codon, after the number of bases behind the coding part."""
    first, after = (c if isinstance(c, Column) else F.lit(c) for c in (first, after))
    reason = F.when(length < bound, "short").when(length < first + CODON - 1 + DOWNSTREAM, "first codon").when(length - 2 - after < first, "order")
    return reason.when((length - after - first + 1) % 3 != 0, "frame")


def clean_training(seq: Column) -> Column:
    return seq.rlike("^[ACGTacgt]+$") & (F.length(seq) > 6)


def masked_share(seq: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(F.upper(seq), "[^X]", "")), F.length(seq))


def mask_reject(seq: Column, max_share: float) -> Column:
    """'masked' where more than max_share of the residues are X, 'empty' where there are none, else null."""
    return F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, "empty").when(masked_share(seq) > max_share, "masked")


def lead_flank_ok(seq: Column) -> Column:
    return F.regexp_count(F.substring(seq, 1, FLANK + UPSTREAM), F.lit("[^ACGTacgt]")) < (FLANK + UPSTREAM) // 10


def canonical_start_stop(seq: Column) -> Column:
    """A start codon at FIRST_CODON and a stop codon just before the last DOWNSTREAM + FLANK bases."""
    last = F.substring(seq, (F.length(seq) - DOWNSTREAM - FLANK - 2).cast("int"), F.lit(3))
    return is_met(F.substring(seq, FIRST_CODON, 3)) & is_stop(last)


def canonical_reject(seq: Column) -> Column:
    """'start' without a start codon at FIRST_CODON, 'stop' without a stop codon before the last flank, null for a canonical frame."""
    return F.when(~is_met(F.substring(seq, FIRST_CODON, CODON)), "start").when(~canonical_start_stop(seq), "stop")


def hard_mask(seq: Column) -> Column:
    return F.translate(seq, "acgt", "NNNN")


def site_at(seq: Column, pos: Column | int = FIRST_CODON) -> Column:
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.substring(seq, (pos - UPSTREAM).cast("int"), F.lit(SITE))


def hamming(a: Column, b: Column) -> Column:
    """Positions in which strings of equal length differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def accept_tis(tis: Column, cds_length: Column) -> Column:
    offset = tis - (FLANK + UPSTREAM)
    return (offset < 45) | (offset / cds_length < 0.2)


def clip_to_tis(seq: Column, tis: Column) -> Column:
    """The coding part from the predicted start on, without the flank at the end."""
    return F.substring(seq, tis.cast("int"), (F.length(seq) - DOWNSTREAM - FLANK - tis + 1).cast("int"))


def log_or_inf(p: Column) -> Column:
    """Natural logarithm with minus infinity at zero."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
