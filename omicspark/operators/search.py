"""Places of peptides in the sequences that they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

#: Letters of a seed, and peptides of one entry that are sought in one pass over its sequence.
SEED_LETTERS = 8
BLOCK_PEPTIDES = 4096
#: Up to so many peptides are sought one by one, which takes less than numbering the windows of a sequence.
FEW_PEPTIDES = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _seeds(letters: np.ndarray, size: int) -> np.ndarray:
    """A number of each window of ``size`` letters; equal windows have equal numbers."""
    codes = np.zeros(max(0, len(letters) - size + 1), dtype=np.uint64)
    for k in range(size):
        codes = (codes + letters[k : k + len(codes)]) * _MIX
    return codes


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def places_of(sequence: str, peptides: list[str]) -> dict[str, list[int]]:
    """0-based starts, ascending, of every occurrence of each peptide, overlapping ones included.

    Of many peptides, one pass numbers all windows of a seed's length; windows that equal the beginning of a
    peptide are then compared in full. Empty peptides and those without a place are left out.
    """
    found: dict[str, list[int]] = {}
    wanted = [p for p in set(peptides) if 0 < len(p) <= len(sequence)]
    if not wanted:
        return found
    if len(wanted) <= FEW_PEPTIDES:
        for peptide in wanted:
            at = sequence.find(peptide)
            while at >= 0:
                found.setdefault(peptide, []).append(at)
                at = sequence.find(peptide, at + 1)
        return found
    size = min(SEED_LETTERS, min(map(len, wanted)))
    by_seed: dict[int, list[str]] = {}
    heads = np.concatenate([_seeds(_letters(p[:size]), size) for p in wanted])
    for head, peptide in zip(heads.tolist(), wanted):
        by_seed.setdefault(head, []).append(peptide)
    windows = _seeds(_letters(sequence), size)
    order = np.unique(heads)
    near = order[np.minimum(np.searchsorted(order, windows), len(order) - 1)]
    at = np.flatnonzero(near == windows)
    for start, head in zip(at.tolist(), windows[at].tolist()):
        for peptide in by_seed[head]:
            if sequence.startswith(peptide, start):
                found.setdefault(peptide, []).append(start)
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, genes, peptides, starts = [], [], [], []
        for entry, gene, sequence, block in zip(*(batch.column(i) for i in range(4))):
            found = places_of(sequence.as_py() or "", block.as_py())
            # The first row tells that the entry exists, the others where its peptides are.
            entries += [entry.as_py()] * (len(found) + 1)
            genes += [gene.as_py()] + [None] * len(found)
            peptides += [None, *found]
            starts += [None, *found.values()]
        columns = [
            pa.array(entries, pa.string()), pa.array(genes, pa.string()),
            pa.array(peptides, pa.string()), pa.array(starts, pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "gene", "peptide", "starts"])


def entry_places(pairs: DataFrame, entries: DataFrame, block_peptides: int = BLOCK_PEPTIDES) -> DataFrame:
    """(entry, gene, peptide, starts array<int>) of the distinct (entry, peptide) of ``pairs``.

    An entry that exists has a row with its gene and no peptide, at least one, and a row without a gene for each
    peptide that has a place. ``entries`` is (entry, gene, sequence); of rows that share an id the longest counts.
    A sequence travels once, meets all its peptides in one row and is scanned once; an entry with more than
    ``block_peptides`` is dealt into blocks by a hash of the peptide, so no row gathers an unbounded list. Nulls and
    empty texts have no places.
    """
    # The work per byte is high, so partitions must not be merged for being small.
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["entry", "block"]
    wanted = pairs.select("entry", F.coalesce("peptide", F.lit("")).alias("peptide")).where("entry IS NOT NULL").distinct()
    sizes = wanted.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / block_peptides).cast("int").alias("blocks"))
    # Few entries have that many; written, they are known to be few and the sequences stay where they are.
    large = cut_lineage(sizes.where("blocks > 1"))
    dealt = wanted.join(large, "entry", "left")
    block = F.pmod(F.xxhash64("peptide"), F.coalesce("blocks", F.lit(1))).cast("int")
    gathered = dealt.select("entry", block.alias("block"), "peptide").repartition(partitions, *keys)
    gathered = gathered.groupBy(*keys).agg(F.collect_list("peptide").alias("peptides"))
    blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    spread = entries.where("entry IS NOT NULL").join(large, "entry", "left").select("entry", blocks, "gene", "sequence")
    # Both sides are dealt alike, so the longest text of an id is found and met where the texts arrive.
    longest = F.max_by(F.struct("gene", "sequence"), F.length("sequence")).alias("e")
    single = spread.repartition(partitions, *keys).groupBy(*keys).agg(longest).select(*keys, "e.*")
    met = single.join(gathered.hint("merge"), keys).select("entry", "gene", "sequence", "peptides")
    return met.mapInArrow(_search, "entry string, gene string, peptide string, starts array<int>")


def peptide_places(pairs: DataFrame, entries: DataFrame, block_peptides: int = BLOCK_PEPTIDES) -> DataFrame:
    """(entry, peptide, starts array<int>) of the distinct (entry, peptide) of ``pairs`` that have a place.

    ``entries`` is (entry, sequence).
    """
    nameless = entries.select("entry", F.lit(None).cast("string").alias("gene"), "sequence")
    return entry_places(pairs, nameless, block_peptides).where("peptide IS NOT NULL").drop("gene")
