"""Known answers of localisation, site assignment, normalisation and result layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.operators import artifacts, design, network, ptm, qc, query, search, summarize
from omicspark.plans import workflows


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_bare_peptide(spark):
    df = one(spark, s="[R].iHTGEkPYEcVQcGk.[S]")
    assert df.select(E.bare_peptide(F.col("s"))).first()[0] == "IHTGEKPYECVQCGK"


def test_sites_and_scores(spark):
    df = one(spark, m="N-Term(TMT6plex); C3(DBIA); xC12(DBIA); C4(Other); N-Term(DBIA)", s="C3(DBIA): 50; C4(DBIA): 50.0; C4(X): 9")
    sites = df.select(E.modification_sites(F.col("m"), "DBIA")).first()[0]
    assert [tuple(x) for x in sites] == [("C", 3), ("C", 12), ("N-term", 1)]
    scores = df.select(E.localization_scores(F.col("s"), "DBIA")).first()[0]
    assert [tuple(x) for x in scores] == [("C", 3, 50.0), ("C", 4, 50.0)]


def test_occurrences_overlap(spark):
    rows = [("AAAA", "AA", [0, 1, 2]), ("XABAB", "AB", [1, 3]), ("AB", "ABC", []), ("AB", "", []), ("ABCA", "A", [0, 3]),
            ("ABABA", "ABA", [0, 2]), ("", "A", [])]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, p string")
    got = df.select("s", "p", E.occurrences(F.col("s"), F.col("p")).alias("o")).collect()
    assert [(r["s"], r["p"], list(r["o"])) for r in got] == rows


@pytest.mark.parametrize(
    "scores, sequence, token, status",
    [
        ("C3(DBIA): 50; C4(DBIA): 50", "MACKACCKTT", "candidate_C6|C7", "Ambiguous"),
        ("C3(DBIA): 100; C4(DBIA): 100", "MACKACCKTT", "C6+C7", "Confident"),
        ("", "WWWW", "peptide_C2_unmapped", "Unscored"),
    ],
)
def test_site_assignment(spark, scores, sequence, token, status):
    peptide = "KACCK" if scores else "ACCK"
    mods = "C3(DBIA); C4(DBIA)" if scores else "C2(DBIA)"
    df = one(spark, Master_Protein_Accessions="P1", PeptideSequence=peptide, Modifications=mods,
             ptmRS_Best_Site_Probabilities=scores, protein_sequence=sequence)
    row = ptm.assign_sites(df, "DBIA").first()
    assert (row["SiteToken"], row["LocalizationStatus"]) == (token, status)
    assert row["ProteinName"] == f"P1_{token}"


def test_coverage_two_of_three(spark):
    frame = design.ptm_design(spark, {f"{i}": {"c": "A", "replicate": i} for i in (1, 2, 3)})
    rows = [("two", "A", "1"), ("two", "A", "2"), ("one", "A", "3")]
    df = spark.createDataFrame(rows, "ProteinName string, Condition string, Channel string")
    assert [r[0] for r in ptm.covered_items(df, frame, 0.40).collect()] == ["two"]
    wide = design.ptm_design(spark, {f"{i}": {"c": "A", "replicate": i} for i in range(10)})
    three = spark.createDataFrame([("p", "A", str(i)) for i in range(3)], "ProteinName string, Condition string, Channel string")
    assert ptm.covered_items(three, wide, 0.7).count() == 0


def test_coverage_counts_channels_in_one_exchange(spark):
    channels = {f"{i}": {"c": "AB"[i % 2], "replicate": i} for i in range(150)}
    frame = design.ptm_design(spark, channels)
    rows = [("all", "AB"[i % 2], f"{i}") for i in range(150)]
    rows += [("enough", "AB"[i % 2], f"{i}") for i in range(150) if i % 2 == 0 or i % 10 in (1, 3, 5)]
    rows += [("scarce", "AB"[i % 2], f"{i}") for i in range(150) if i % 2 == 0 or (i % 10 in (1, 3, 5) and i < 140)]
    rows += [("repeated", "A", "0")] * 200 + [("half", "A", f"{i}") for i in range(0, 150, 2)]
    rows += [("strange", "AB"[1 - i % 2], f"{i}") for i in range(150)] + [(None, "AB"[i % 2], f"{i}") for i in range(150)]
    rows += [("unnamed", None, "0"), ("unnamed", "A", None), ("norm", "Norm", "1")]
    df = spark.createDataFrame(rows, "ProteinName string, Condition string, Channel string")
    found = ptm.covered_items(df, frame, 0.40)
    assert sorted(r[0] for r in found.collect()) == ["all", "enough"]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
    assert ptm.covered_items(df, design.ptm_design(spark, {}), 0.40).count() == 0
    assert {r[0] for r in ptm.covered_items(df, frame, 1.0).collect()} == {r[0] for r in rows if r[0]}


def test_conditions_of_samples_are_not_sorted_out_of_all_rows(spark, monkeypatch):
    written = []
    cut = summarize.cut_lineage
    monkeypatch.setattr(summarize, "cut_lineage", lambda df: written.append(df) or cut(df))
    rows = [(f"p{i % 5}", f"f{i % 3}", f"s{i % 2}", "A" if i % 4 else "B", 2.0 ** (i % 7)) for i in range(60)]
    features = spark.createDataFrame(rows, "ProteinName string, PSM string, BioReplicate string, Condition string, Intensity double")
    out = summarize.summarize_layers(features).collect()
    assert {(r["sample_id"], r["condition"]) for r in out} == {("s0", "A"), ("s1", "A")}
    kinds = next(df for df in written if df.columns == ["sample", "condition"])
    lines = kinds._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate" in [line for line in lines if "Aggregate" in line][-1]


MAPPING = {
    "126": {"condition": "DMSO", "replicate": 1}, "127N": {"condition": "DMSO", "replicate": 2},
    "128N": {"condition": "DRUG", "replicate": 1}, "129N": {"condition": "DRUG", "replicate": 2},
}
HEADER = ["Annotated Sequence", "Modifications", "Charge", "Contaminant", "Master Protein Accessions", "Quan Info",
          "Average Reporter SN", "Isolation Interference in Percent", "Normalized CHIMERYS Coefficient",
          "ptmRS Best Site Probabilities", *[f"Abundance {c}" for c in MAPPING]]


def export(path, rows):
    lines = ["\t".join(HEADER)] + ["\t".join(r) for r in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_site_study_from_files(spark, tmp_path):
    def psm(sequence, mods, charge, accession, scores, values, sn="9", interference="10"):
        return [sequence, mods, charge, "False", accession, "", sn, interference, "0.9", scores, *map(str, values)]

    site = psm("[K].ACK.[T]", "C2(DBIA)", "2", "P12345", "C2(DBIA): 99", (100, 110, 400, 440))
    rows = [site, site, psm("[K].WWK.[T]", "", "2", "P12345", "", (100, 100, 100, 100)),
            psm("[K].ACK.[T]", "C2(DBIA)", "3", "P12345", "C2(DBIA): 99", (90, 100, 350, 420)),
            psm("[K].ACK.[T]", "C2(DBIA)", "2", "P12345", "", (9, 9, 9, 9), interference="51")]
    for i in range(8):
        rows.append(psm(f"[K].GC{'GAVLIMFW'[i]}K.[T]", "C2(DBIA)", "2", f"Q{i}", "C2(DBIA): 99", (50 + i, 60 - i, 70 + 2 * i, 75)))
    proteins = [psm(f"[K].{'GAVLIMFW'[i]}{'GAVLIMFW'[j]}K.[T]", "", "2", a, "", (80 + i, 82 - j, 85 + j, 88))
                for a in ["P12345"] + [f"Q{k}" for k in range(8)] for i, j in ((0, 1), (2, 3), (4, 5))]
    fasta = tmp_path / "p.fasta"
    fasta.write_text(">sp|P12345|TEST GN=GENE1\nMACKTT\n", encoding="utf-8")
    tables = workflows.run_ptm(
        spark, export(tmp_path / "ptm.txt", rows), str(fasta), MAPPING,
        [{"group1": {"condition": "DRUG"}, "group2": {"condition": "DMSO"}}], "DBIA",
        export(tmp_path / "protein.txt", proteins), workflows.Options(resolve_shared=False), "none",
    )
    counts = {(r["Section"], r["Metric"]): r["Value"] for r in tables["filter_counts"].collect()}
    assert counts[("ptm", "input_psms")] == 13 and counts[("ptm", "quality_filtered_psms")] == 12
    assert counts[("ptm", "long_reporter_rows")] == 48
    abundance = tables["site_abundance"].where("ProteinName = 'P12345_C3' and Channel = '126'").collect()
    assert sorted(r["Abundance"] for r in abundance) == [90.0, 200.0]
    meta = tables["site_metadata"].where("ProteinName = 'P12345_C3'").first()
    assert (meta["Gene"], meta["LocalizationStatus"], meta["ConfidentEvidence"]) == ("GENE1", "Confident", 3)
    features = tables["ptm_input"]
    assert features.select("PSM", "Channel", "Run").distinct().count() == features.count()
    result = tables["ptm_results"].where("protein_accession = 'P12345_C3'").first()
    assert result["log2_fold_change"] == pytest.approx(2.0, abs=0.2) and result["Status"] == "Estimated"
    adjusted = tables["adjusted_results"].where("protein_accession = 'P12345_C3'").first()
    assert adjusted["ProteinMatch"] == "exact"
    assert adjusted["standard_error"] >= result["standard_error"]


def test_adjusted_match_levels(spark):
    rows = spark.createDataFrame(
        [("c", "s1", "P1", True), ("c", "s2", "P2", True), ("c", "s3", "P3", True), ("c", "s4", "P4", False)],
        "comparison_id string, protein_accession string, GlobalProtein string, Adjusted boolean",
    )
    meta = spark.createDataFrame([("s1", "P1"), ("s2", "P2-4"), ("s3", "X"), ("s4", "P4")], "ProteinName string, ProteinAccession string")
    known = spark.createDataFrame([("c", p) for p in ("P1", "P2", "P3", "P4")], "comparison_id string, protein string")
    got = {r["protein_accession"]: r["ProteinMatch"] for r in ptm.keep_adjusted(rows, meta, known).collect()}
    assert got == {"s1": "exact", "s2": "canonical_fallback"}


def test_provenance_fraction(spark):
    peptides = spark.createDataFrame(
        [("P1", "D1", "protein", "observed"), ("P1", "D1", "protein", "imputed"), ("P2", "D1", "protein", "missing")],
        "protein_accession string, sample_id string, result_layer string, provenance string",
    )
    got = {r[0]: r["imputation_fraction"] for r in artifacts.feature_provenance(peptides).collect()}
    assert got == {"P1": 0.5, "P2": None}


def test_psm_summary(spark):
    rows = [("a", "A", 1), ("b", "A", 1), ("a", "A", 2), ("a", "B", 1)]
    row = qc.psm_summary(spark.createDataFrame(rows, "Unique_PSM string, Condition string, Replicate int")).first()
    assert row["total_psms"] == 2 and row["avg_psms_per_sample"] == 1.3


def test_accession_match_is_exact(spark):
    df = spark.createDataFrame([("P2; P1",), ("P10",), ("P1",)], "a string")
    assert {r[0] for r in df.where(E.accession_matches(F.col("a"), "P1")).collect()} == {"P2; P1", "P1"}


def test_pages(spark):
    df = spark.range(25).withColumnRenamed("id", "n")
    seen, last = [], None
    while part := [r["n"] for r in query.page_after(df, "n", last, 10).collect()]:
        seen, last = seen + part, part[-1]
    assert seen == list(range(25))
    points = spark.range(5).selectExpr("4 - id as condition_order", "id as sample_order")
    assert [r["condition_order"] for r in query.ordered_points(points).collect()] == [0, 1, 2, 3, 4]


def test_network_limits(spark):
    diff = spark.createDataFrame([("P1", "G1", 2.0, 0.01), ("P2", "G2", -2.0, 0.01)],
                                 "protein_accession string, gene_name string, log2_fold_change double, adjusted_p_value double")
    edges = spark.createDataFrame([("P1", "P2", "Activation", 3, 2), ("P1", "P9", "Complex", 3, 2)],
                                  "source string, target string, interaction string, evidence_count int, paper_count int")
    nodes, kept = network.subnetwork(diff, edges)
    assert nodes.count() == 2 and kept.count() == 1
    with pytest.raises(network.SeedCount):
        network.subnetwork(diff, edges, max_seeds=2)
    with pytest.raises(network.SeedCount):
        network.subnetwork(diff, edges, p_cut=0.001)


def test_numbered_sites_equal_the_rows_with_their_texts(spark):
    """Numbers stand for the same sites, features and evidence as the texts; null equals null."""
    rows = [
        (accession, sequence, mods, scores, source, "2" if source < 9 else charge, channel, "DMSO", 1, "Sample", f"{channel}_1", 1.0 + source)
        for accession, sequence, mods, scores, source in (
            ("P1", "[K].ACK.[T]", "C2(DBIA)", "C2(DBIA): 99", 1), ("P1", "[K].ACK.[T]", "C2(DBIA)", None, 2),
            ("P1", "[K].ACK.[T]", "C2(DBIA)", None, 3), (None, "[K].WCW.[T]", "C2(DBIA)", "", 4), ("P9", None, "C1(DBIA)", None, 9),
        )
        for channel, charge in (("126", "2"), ("127N", "3"))
    ]
    names = ["Master_Protein_Accessions", "Annotated_Sequence", "Modifications", "ptmRS_Best_Site_Probabilities", "_SourceRow", "Charge",
             "Channel", "Condition", "Replicate", "Role", "BioReplicate", "Abundance"]
    types = ["string", "string", "string", "string", "long", "string", "string", "string", "int", "string", "string", "double"]
    df = ptm.with_peptide(spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types))))
    texts = spark.createDataFrame([("P1", "G1", "MACKTT")], "accession string, gene string, sequence string")
    wide = ptm.localize(df, texts, "DBIA")
    numbered = ptm.number_sites(df, texts, "DBIA")
    assert not set(numbered.rows.columns) & {"ProteinName", "Peptidoform", "Modifications", "Annotated_Sequence"}

    def same(one, two):
        columns = sorted(one.columns)
        assert columns == sorted(two.columns)
        a, b = (sorted(map(repr, x.select(*columns).collect())) for x in (one, two))
        assert a == b and a

    same(numbered.named_features(numbered.features()), ptm.sum_features(wide, ptm.FEATURE_KEYS))
    found, want = numbered.evidence(), ptm.site_evidence(wide)
    same(numbered.named_evidence(found), want)
    same(numbered.metadata(found, "DBIA"), ptm.site_metadata(want, "DBIA"))
    same(numbered.peptidoform_counts(found), ptm.peptidoform_counts(want))
    few = wide.drop("_SourceRow")
    less = ptm.number_sites(df.drop("_SourceRow"), texts, "DBIA")
    same(less.named_evidence(less.evidence()), ptm.site_evidence(few))


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    df = ptm.with_peptide(spark.createDataFrame(
        [("P1", "ACK", "C2(DBIA)", i, "2", "126", "A", 1, "Sample", "A_1", 1.0) for i in range(3)],
        "Master_Protein_Accessions string, Annotated_Sequence string, Modifications string, _SourceRow long, Charge string, "
        "Channel string, Condition string, Replicate int, Role string, BioReplicate string, Abundance double",
    ))
    texts = spark.createDataFrame([("P1", "G1", "MACKTT")], "accession string, gene string, sequence string")
    twice = df.select("Master_Protein_Accessions").unionByName(df.select("Master_Protein_Accessions"))
    assert ptm._share_hashes(twice, ["Master_Protein_Accessions"])
    monkeypatch.setattr(ptm, "_share_hashes", lambda *_: True)
    assert [r["ProteinName"] for r in ptm.number_sites(df, texts, "DBIA").sites.collect()] == ["P1_C3"]
    numbered = ptm.number_sites(df, texts, "DBIA")
    assert numbered.features().first()["Abundance"] == 3.0


def test_localization_texts_are_taken_apart_once(spark):
    df = one(spark, a="C2(DBIA): 98; C4(DBIA): 76", b="C3(DBIA): 75", c="0.9", m="C2(DBIA); M1(Oxidation)")
    sites = E.modification_sites(F.col("m"), "DBIA")

    def best(a, b, c):
        made = E.best_localization(sites, "DBIA", [(a, "first"), (b, "second")], c)
        return df.select(made.alias("x")).select("x.*")

    plan = best(F.col("a"), F.col("b"), F.col("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3
    got = [best(*x).first() for x in (
        (F.col("a"), F.col("b"), F.col("c")), (F.lit(" "), F.col("b"), F.col("c")),
        (F.lit(None), F.lit("C2(X): 9"), F.col("c")), (F.lit(""), F.lit(""), F.lit("none")),
    )]
    assert [(r["source"], [tuple(s) for s in r["scores"]]) for r in got] == [
        ("first", [("C", 2, 98.0), ("C", 4, 76.0)]), ("second", [("C", 3, 75.0)]),
        ("CHIMERYS score", [("C", 2, 90.0)]), ("Unscored", []),
    ]


def test_labels_of_many_places_are_not_compared_with_each_other(spark):
    starts = list(range(0, 3000, 1))
    df = spark.createDataFrame([([("C", 2), ("C", 1), ("K", 1)], starts)], "s array<struct<residue:string,position:int>>, p array<int>")
    made = df.select(E.protein_labels(F.col("s"), F.col("p")).alias("x"))
    got = made.first()["x"]
    want = sorted({(start + p, r + str(start + p)) for start in starts for r, p in (("C", 2), ("C", 1), ("K", 1))})
    assert got == [label for _, label in want]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "array_distinct(flatten" not in plan and "array_sort(" not in plan


def test_background_is_read_once(spark):
    rows = [("AK", "2", c, 1.0 + i) for i, c in enumerate(("126", "127N"))] + [("CK", "2", "126", 5.0)]
    df = spark.createDataFrame(rows, "PeptideSequence string, Charge string, Channel string, Abundance double")
    complete = ptm.complete_background(df, spark.createDataFrame([("126",), ("127N",)], "Channel string"))
    plan = complete._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, complete.collect())) == [("AK", "2", "126", 1.0), ("AK", "2", "127N", 2.0)]


def test_rows_and_texts_of_one_site(spark):
    rows = spark.createDataFrame([(0, 0, 0), (5, 5, 5), (6, 5, 5)], "__u long, __f long, __p long")
    names = spark.createDataFrame([(0, 0, 0, "a"), (5, 5, 5, "b"), (6, 5, 5, "b")], "__u long, __f long, __p long, ProteinName string")
    site = ptm.NumberedSites(rows, names).of_site(5)
    assert sorted(r["__u"] for r in site.sites.collect()) == sorted(r["__u"] for r in site.rows.collect()) == [5, 6]
    assert ptm.NumberedSites(rows, names).of_site(None).rows.count() == 0


def test_heads_of_sequences(spark):
    """The heads of sequences that the rows read equal those of whole sequences."""
    from omicspark.registry import load
    from omicspark.registry.base import VIEWS

    load()
    texts = [None, "", "éa b.c" * 5, "1234 .,;" * 200 + "abcdéß" * 20, "Plain text of letters " * 50, "...." * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    heads, whole = (
        spark.sql(VIEWS[v][1], documents=docs).selectExpr("accession", "substr(sequence, 1, 40) AS s").orderBy("accession").collect()
        for v in ("proteome_heads", "proteome")
    )
    assert heads == whole and len(heads) == len(texts)


def test_counts_of_peptidoforms_are_grouped_by_numbers(spark):
    """Names are grouped only where two features share them, as a missing accession and one called nan do."""
    rows = [(a, "ACK", "C2(DBIA)", i, "2", "126", "A", 1, "Sample", "A_1", 1.0) for i, a in enumerate((None, "nan", "nan", "P1"))]
    df = ptm.with_peptide(spark.createDataFrame(
        rows,
        "Master_Protein_Accessions string, Annotated_Sequence string, Modifications string, _SourceRow long, Charge string, "
        "Channel string, Condition string, Replicate int, Role string, BioReplicate string, Abundance double",
    ))
    texts = spark.createDataFrame([("nan", "G0", "MMMM"), ("P1", "G1", "MACKTT")], "accession string, gene string, sequence string")

    def counted(rows):
        numbered = ptm.number_sites(rows, texts, "DBIA")
        return numbered.peptidoform_counts(numbered.evidence())

    shared = counted(df)
    assert sorted(map(tuple, shared.collect())) == [
        ("P1_C3", "P1 · C3", "ACK|C2(DBIA)", "2", 1),
        ("nan_peptide_C2_unmapped", "nan · peptide C2 · FASTA-unmapped", "ACK|C2(DBIA)", "2", 3),
    ]
    own = counted(df.where("Master_Protein_Accessions IS NOT NULL"))
    assert sorted(r["PSMCount"] for r in own.collect()) == [1, 2]
    groups = [x for x in own._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert groups and not any("ProteinName" in x for x in groups)


def test_sequences_travel_once(spark):
    """Isoforms are looked up as they stand and without their isoform; of rows that share an id the longest counts."""
    entries = spark.createDataFrame(
        [("P1", "G1", "MACK"), ("P1", "G9", "MACKTACK"), ("P2-2", "G2", "ACK"), ("P2", "G3", "MMACK"), ("P3", None, None), ("P4", "G4", "")],
        "entry string, gene string, sequence string",
    )
    pairs = [(e, p) for e in ("P1", "P2-2", "P2", "P3", "P4", "lost") for p in ("ACK", "", None)]
    df = spark.createDataFrame(pairs, "entry string, peptide string")
    for size in (1, 4096):
        placed = search.entry_places(df, entries, size)
        got = {tuple(r[:3]): r["starts"] for r in placed.collect()}
        assert got == {
            ("P1", "G9", None): None, ("P1", None, "ACK"): [1, 5], ("P2-2", "G2", None): None, ("P2-2", None, "ACK"): [0],
            ("P2", "G3", None): None, ("P2", None, "ACK"): [2], ("P3", None, None): None, ("P4", "G4", None): None,
        }
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    # One deal of the sequences and one of their peptides.
    assert plan.count("RepartitionByExpression") == 2
    rows = [(a, "ACK", "C2(DBIA)", i, "2", "126", "A", 1, "Sample", "A_1", 1.0) for i, a in enumerate(("P1", "P2-2", "P2-3", "P3", "P4-1", "P1; P2"))]
    sited = ptm.number_sites(ptm.with_peptide(spark.createDataFrame(
        rows,
        "Master_Protein_Accessions string, Annotated_Sequence string, Modifications string, _SourceRow long, Charge string, "
        "Channel string, Condition string, Replicate int, Role string, BioReplicate string, Abundance double",
    )), entries.withColumnRenamed("entry", "accession"), "DBIA").sites
    assert sorted((r["ProteinName"], r["Gene"], r["ProteinMapping"]) for r in sited.collect()) == [
        ("P1; P2_peptide_C2_unmapped", "", "unmapped"), ("P1_candidate_C3|C7", "G9", "exact"), ("P2-2_C2", "G2", "exact"),
        ("P2-3_C4", "G3", "canonical_fallback"), ("P3_peptide_C2_unmapped", "", "exact"),
        ("P4-1_peptide_C2_unmapped", "G4", "canonical_fallback"),
    ]


def test_intensity_reads_measures_alone(spark):
    rows = [(f"F{i}", c, r, float(i + 1)) for i in range(40) for c, r in (("A", "1"), ("A", "2"), ("B", None))] + [("F0", "A", "1", -1.0)]
    psms = spark.createDataFrame(rows, "Unique_PSM string, Condition string, Replicate string, Abundance double")
    made = qc.normalized_intensity(psms)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Rows are neither named nor brought together by sample or bin: what they meet was written.
    assert "Unique_PSM" not in plan and "LogicalRDD" not in plan
    got = {(r["Condition"], r["Replicate"]): r for r in made.collect()}
    assert {k: r["value_count"] for k, r in got.items()} == {("A", "1"): 40, ("A", "2"): 40, ("B", None): 40}
    # The medians 20, 20.5 and 20.5 become 20.5, the one of most rows.
    assert got[("B", None)]["median"] == pytest.approx((np.log2(20) + np.log2(21)) / 2)
    assert got[("A", "1")]["median"] == pytest.approx((np.log2(20) + np.log2(21)) / 2 + np.log2(20.5 / 20))


def test_quality_tables_asked_for_alone(spark):
    names = "ProteinName string, Condition string, Replicate int, NormalizedAbundance double, Imputed boolean"
    sites = spark.createDataFrame([("P", "A", 1, 2.0, False)], names)
    psms = spark.createDataFrame([("F", "A", "A_1", 2.0)], "PSM string, Condition string, BioReplicate string, Intensity double")
    results = spark.createDataFrame([("c", 0.5)], "comparison_id string, p_value double")
    assert set(qc.ptm_qc(sites, psms, results, only=["intensity"])) == {"intensity"}
    assert len(qc.ptm_qc(sites, psms, results)) == 8
