"""String functions on receptor names and sequences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the order in which residues are numbered; the gap is last.
ALPHABET = "ARNDCEQGHILKMFPSTWYV-"


def rename_gene(name: Column) -> Column:
    """IMGT style: TCRBV05-01 gives TRBV5-1; names in that style stay; a null stays null."""
    out = F.regexp_replace(name, "^TCR", "TR")
    out = F.regexp_replace(out, r"([VJ])0(\d)", "$1$2")
    return F.regexp_replace(out, r"-0(\d)", "-$1")


def pad_gap(seq: Column, length: int) -> Column:
    """A gap in the middle up to ``length``; an odd residue goes left. Longer sequences give null."""
    n = F.length(seq)
    left = F.floor((n + 1) / 2).cast("int")
    gap = F.repeat(F.lit("-"), (F.lit(length) - n).cast("int"))
    return F.when(n <= length, F.concat(F.substring(seq, F.lit(1), left), gap, F.substring(seq, left + 1, n)))


def residue_numbers(seq: Column) -> Column:
    """Index of each residue in ALPHABET; an unknown residue gives -1."""
    known = F.array(*[F.lit(x) for x in ALPHABET])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: (F.coalesce(F.array_position(known, c), F.lit(0)) - 1).cast("int"))


def sample_name(path: Column, suffix: str = "") -> Column:
    """File basename, without ``suffix`` where it ends so."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.lit(bool(suffix)) & base.endswith(suffix), F.substring(base, F.lit(1), F.length(base) - len(suffix))).otherwise(base)


def token_ids(seq: Column, vocabulary: dict[str, int], start: str = "<cls>", stop: str = "<sep>", unknown: str = "<unk>") -> Column:
    """Ids of the start token, each residue and the stop token, by a vocabulary that holds the three special tokens; null gives those of an empty sequence."""
    ids = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    letters = F.filter(F.split(F.coalesce(seq, F.lit("")), ""), lambda c: c != "")
    inner = F.transform(letters, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(vocabulary[unknown])))
    return F.concat(F.array(F.lit(vocabulary[start])), inner, F.array(F.lit(vocabulary[stop])))


def pad_tokens(ids: Column, length: Column | int, fill: int = 0) -> Column:
    """``ids`` filled at the end up to ``length`` (the batch's longest); longer ones stay whole."""
    width = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def token_mask(ids: Column, length: Column | int) -> Column:
    """1 for each token and 0 for each place that ``pad_tokens`` fills."""
    return pad_tokens(F.transform(ids, lambda _: F.lit(1)), length)
