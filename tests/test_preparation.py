"""Known answers of reading, filtering, designs and coverage."""

import pytest
from pyspark.sql import functions as F

from omicspark.operators import design, protein, psm
from omicspark.plans import workflows
from omicspark.sources import readers, writers

TMT_HEADER = [
    "Sequence", "Modifications", "Charge", "Contaminant", "Master Protein Accessions", "Quan Info",
    "Average Reporter SN", "Normalized CHIMERYS Coefficient", "Abundance 127N", "Abundance 126",
]


def tmt_rows(spark):
    rows = [
        ("EDGE", None, "2", "False", "P1; P2", "", "5", "0.8", "100", "200"),
        ("LOW_SN", None, "2", "False", "P1", "", "4.999", "0.9", "100", "200"),
        ("LOW_CO", None, "2", "False", "P1", "", "9", "0.799", "100", "200"),
        ("NULL_SN", None, "2", "False", "P1", "", None, "0.9", "100", "200"),
        ("TEXT", None, "2", "False", "P1", "", "9", "high", "100", "200"),
        ("PLUS", None, "2", "+", "P1", "", "9", "0.9", "100", "200"),
        ("NAN", None, "2", "False", "P1", "", "NaN", "0.9", "100", "200"),
        ("NOVALUE", None, "2", "False", "P1", "No Value", "9", "0.9", "100", "200"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in TMT_HEADER))


def test_tmt_filter_is_inclusive_and_strict_about_missing_quality(spark):
    kept = psm.filter_psm_tmt(tmt_rows(spark))
    assert [r["Sequence"] for r in kept.collect()] == ["EDGE"]
    assert psm.unpivot_channels(kept).count() == 2


def test_channels_are_ordered_by_number_then_suffix():
    names = ["Abundance 127C", "Abundance 126", "Abundance 127N", "Abundance Ratio", "Abundance 9"]
    assert list(psm.channel_columns(names)) == ["9", "126", "127N", "127C"]


def test_validation_finds_text_in_any_row(spark):
    good = tmt_rows(spark)
    assert psm.validate_psm(good, "tmt") == ["126", "127N"]
    bad = good.withColumn("Abundance 126", F.when(F.col("Sequence") == "NAN", "oops").otherwise("1"))
    with pytest.raises(psm.InvalidInput):
        psm.validate_psm(bad, "tmt")
    with pytest.raises(psm.InvalidInput):
        psm.validate_psm(good.drop("Charge"), "tmt")


def test_dia_prefers_quan_value_before_the_cast(spark):
    rows = spark.createDataFrame(
        [("A", "500", "1000"), ("B", None, "7"), ("C", "bad", "9")],
        "Sequence string, `Quan Value` string, Abundance string",
    )
    got = {r["Sequence"]: r["Abundance"] for r in psm.with_abundance(rows).collect()}
    assert got == {"A": 500.0, "B": 7.0, "C": None}


def test_designs(spark):
    with pytest.raises(design.InvalidDesign):
        design.tmt_design(spark, {"a::126": {"c": "x"}, "b::126": {"c": "y"}})
    assert design.tmt_design(spark, {"a::126": {"c": "x"}, "b::126": {"c": "y"}}, "a").count() == 1
    with pytest.raises(design.InvalidDesign):
        design.ptm_design(spark, {"a::126": {"c": "x"}, "b::126": {"c": "x"}})
    frame = design.ptm_design(spark, {"126": {"z": "1", "a": "x", "replicate": 2}, "131": {"a": "x", "role": "Bridge"}})
    got = {r["Channel"]: (r["Condition"], r["BioReplicate"]) for r in frame.collect()}
    assert got == {"126": ("x_1", "x_1_2"), "131": ("Norm", "Norm_1")}
    with pytest.raises(design.InvalidDesign):
        design.check_design_matches(["126"], frame)


def test_contrast_matching():
    levels = ["DMSO_4h", "DMSO_24h", "INCZ_4h"]
    assert design.match_condition(["DMSO", "4h"], levels, "exact") == ["DMSO_4h"]
    assert design.match_condition(["4h"], levels, "token") == ["DMSO_4h", "INCZ_4h"]
    with pytest.raises(design.InvalidDesign):
        design.match_condition(["DMSO"], levels, "contains")


def test_pooled_contrast_weights(spark):
    item = [{"group1": {"t": "4h"}, "group2": {"t": "24h"}}]
    levels = ["A_4h", "B_4h", "A_24h"]
    mean = {r["condition"]: r["weight"] for r in design.contrasts(spark, item, levels, "token").collect()}
    assert mean == {"A_4h": 0.5, "B_4h": 0.5, "A_24h": -1.0}
    total = design.contrasts(spark, item, levels, "token", weights="sum").collect()
    assert {r["condition"]: r["weight"] for r in total} == {"A_4h": 1.0, "B_4h": 1.0, "A_24h": -1.0}


LONG = "Unique_PSM string, Master_Protein_Accessions string, Condition string, Replicate int, Abundance double"


def test_shared_psm_goes_to_the_protein_with_more_distinct_psms(spark):
    rows = [("s", "LOW; HIGH1; HIGH2", "A", 1, 1.0)]
    rows += [(f"h{i}", "HIGH1; HIGH2", "A", 1, 1.0) for i in range(3)]
    rows += [("l", "LOW", "A", r, 1.0) for r in range(9)]
    got = protein.resolve_shared(spark.createDataFrame(rows, LONG)).where("Unique_PSM = 's'").collect()
    assert [r["Master_Protein_Accessions"] for r in got] == ["HIGH1"]


def test_coverage(spark):
    rows = [("p", "P", "A", r, 1.0) for r in (1, 2, 3)] + [("p", "P", "B", r, 1.0) for r in (1, 2)]
    rows += [("q", "Q", "A", r, 1.0) for r in (1, 2, 3)]
    df = spark.createDataFrame(rows, LONG)
    kept = protein.coverage_filter(df, {"A": 3, "B": 3}, 0.40, 1)
    assert {r["Unique_PSM"] for r in kept.collect()} == {"p"}
    assert protein.coverage_filter(df, {"A": 3, "B": 3, "C": 3}, 0.40, 1).count() == 0
    assert protein.coverage_filter(df, {"A": 3, "B": 3}, 0.40, 2).count() == 0
    assert protein.coverage_filter(df, {"A": 3, "B": 3}, 1.0, 1).count() == 8
    # 100 x 0.29 is 29 in decimal arithmetic and 28 in binary.
    many = spark.createDataFrame([("p", "P", "A", r, 1.0) for r in range(71)], LONG)
    assert protein.coverage_filter(many, {"A": 100}, 0.29, 1).count() == 71
    with pytest.raises(ValueError):
        protein.coverage_filter(df, {"A": 0}, 0.4, 1)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_psm_files(spark, tmp_path):
    one = write(tmp_path / "s a+1.txt", "Sequence\tQuan Value\nAA,B\t5\n")
    two = write(tmp_path / "b.txt", "Sequence\tQuan Value\nCC\t\n")
    df = readers.read_psm(spark, [one, two], with_filename=True)
    got = {(r["Sequence"], r["Quan Value"], r["filename"]) for r in df.collect()}
    assert got == {("AA,B", "5", "s a+1.txt"), ("CC", None, "b.txt")}
    with pytest.raises(psm.InvalidInput):
        readers.read_psm(spark, write(tmp_path / "c.txt", "justoneheader\nx\n"))


def test_files_with_other_column_orders_and_delimiters(spark, tmp_path):
    one = write(tmp_path / "a.txt", "Sequence\tCharge\tNote\nAA\t2\tx\n")
    two = write(tmp_path / "b.csv", "Charge,Sequence\n3,BB\n")
    empty = write(tmp_path / "c.txt", "")
    rows = readers.read_psm(spark, [one, two, empty]).select("Sequence", "Charge", "Note").collect()
    assert {tuple(r) for r in rows} == {("AA", "2", "x"), ("BB", "3", None)}
    with pytest.raises(psm.InvalidInput):
        readers.read_psm(spark, [empty])


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    path = write(tmp_path / "x.fasta", ">sp|P1|X 3'->5' exonuclease GN=EXO\nMACK\r\nAA\r\n>P2 a>b\nCC\n")
    rows = {r["accession"]: (r["gene"], r["sequence"]) for r in readers.read_fasta(spark, path).collect()}
    assert rows == {"P1": ("EXO", "MACKAA"), "P2": ("", "CC")}


def test_comparisons_by_criteria(spark):
    mapping = {
        "126": {"time": "4h", "drug": "A+B", "replicate": 1}, "127": {"time": "4h", "drug": "D", "replicate": 1},
        "128": {"time": "24h", "drug": "D", "replicate": 1}, "129": {"time": "4h", "drug": "D", "role": "Bridge"},
    }
    groups = design.condition_groups(mapping, "ptm")
    assert list(groups) == ["A+B_4h", "D_4h", "D_24h"]
    items = [
        {"group1": {"time": "4h", "drug": "A+B"}, "group2": {"time": "4h", "drug": "D"}},
        {"group1": {"drug": "D"}, "group2": {"drug": "A+B"}},
        {"group1": {"drug": "X"}, "group2": {"drug": "D"}},
    ]
    rows, contrast, unmatched = design.configured_contrasts(spark, items, groups)
    assert {(r["comparison_id"], r["condition"]): r["weight"] for r in contrast.collect()} == {
        ("4h+A+B_vs_4h+D", "A+B_4h"): 1.0, ("4h+A+B_vs_4h+D", "D_4h"): -1.0,
        ("D_vs_A+B", "D_4h"): 0.5, ("D_vs_A+B", "D_24h"): 0.5, ("D_vs_A+B", "A+B_4h"): -1.0,
    }
    assert [(r["group1_label"], r["group2_label"]) for r in rows.orderBy("comparison_order").collect()] == [
        ("A+B_4h", "D_4h"), ("D", "A+B_4h"), ("X", "D"),
    ]
    assert [tuple(r) for r in unmatched.collect()] == [("X_vs_D", "group1", "X")]


def test_study_from_files_has_genes_batches_and_enrichment(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    channels = ["126", "127N", "127C", "128N", "128C", "129N"]
    head = ["Sequence", "Modifications", "Charge", "Contaminant", "Master Protein Accessions", "Quan Info",
            "Average Reporter SN", "Normalized CHIMERYS Coefficient", *[f"Abundance {c}" for c in channels]]
    lines = ["\t".join(head)]
    for p in range(40):
        for k in range(2):
            shift = [0, 0, 0, 1.5, 1.5, 1.5] if p < 20 else [0] * 6
            values = 2 ** (10 + rng.normal(0, 0.1, 6) + shift)
            lines.append("\t".join([f"PEP{p}X{k}", "", "2", "False", f"P{p}", "", "9", "0.9", *[f"{v:.3f}" for v in values]]))
    path = write(tmp_path / "psm.txt", "\n".join(lines) + "\n")
    genes = write(tmp_path / "genes.tsv", "Entry\tGene Names\n" + "".join(f"P{p}\tG{p} other\n" for p in range(40)))
    mapping = {c: {"drug": "D" if i < 3 else "I", "replicate": i % 3 + 1} for i, c in enumerate(channels)}
    items = [{"group1": {"drug": "I"}, "group2": {"drug": "D"}}, {"group1": {"drug": "Z"}, "group2": {"drug": "D"}}]
    tables = workflows.run_tmt(spark, [path], mapping, items, gene_map=genes)
    rows = tables["differential"].collect()
    assert len(rows) == 40 and all(r["gene_name"] == "G" + r["protein_accession"][1:] for r in rows)
    assert [r["comparison_id"] for r in tables["unmatched_comparisons"].collect()] == ["Z_vs_D"]
    assert {r["gene_name"] for r in tables["protein_abundance"].collect()} == {f"G{p}" for p in range(40)}
    sets = spark.createDataFrame([("up", f"G{p}") for p in range(20)], "set string, gene string")
    found = workflows.enrichment(tables["differential"], sets, permutations=200).collect()
    assert [(r["comparison_id"], r["set"]) for r in found] == [("I_vs_D", "up")] and found[0]["nes"] > 1
    assert tables["normalization_coefficients"].count() > 0


def test_a_batch_that_the_condition_settles_is_left_out(spark):
    rows = [("s1", "A", "1"), ("s2", "A", "1"), ("s3", "B", "2")]
    shape = "sample string, condition string, batch string"
    use = workflows.Options(use_batch=True)
    assert not workflows.uses_batch(spark.createDataFrame(rows, shape), use)
    assert workflows.uses_batch(spark.createDataFrame([*rows, ("s4", "B", "1")], shape), use)
    assert not workflows.uses_batch(spark.createDataFrame([("s1", "A", None)], shape), use)


def test_fasta_and_maps(spark, tmp_path):
    path = write(
        tmp_path / "x.fasta",
        ">sp|P12345|TEST some protein GN=GENE1 PE=1\nMACK\nacckTT\n>P9 plain\nAAA\n>tr|Q1-2|X GN=G2\nCC\n",
    )
    rows = {r["accession"]: (r["gene"], r["sequence"]) for r in readers.read_fasta(spark, path).collect()}
    assert rows == {"P12345": ("GENE1", "MACKACCKTT"), "P9": ("", "AAA"), "Q1-2": ("G2", "CC")}
    wanted = spark.createDataFrame([("P12345-3",)], "accession string")
    assert [r["accession"] for r in readers.read_fasta(spark, path, wanted).collect()] == ["P12345"]
    gmt = write(tmp_path / "s.gmt", "set1\tabout\tA\tB\nshort\tx\nset2\t\tC\n")
    assert {tuple(r) for r in readers.read_gmt(spark, gmt).collect()} == {("set1", "A"), ("set1", "B"), ("set2", "C")}
    genes = write(tmp_path / "g.tsv", "Entry\tGene Names\nP1\tABC DEF;G\nP2\t\n")
    assert [tuple(r) for r in readers.read_gene_map(spark, genes).collect()] == [("P1", "ABC")]


def test_result_shards(spark, tmp_path):
    a = write(tmp_path / "a.tsv", "Protein\tlogFC\tLabel\nP1\t1.5\tx\nP2\tNA\tx\n")
    b = write(tmp_path / "b.tsv", "Label\tProtein\nNaN\tP3\n")
    rows = {r["Protein"]: (r["logFC"], r["Label"]) for r in readers.union_result_shards(spark, [a, b]).collect()}
    assert rows == {"P1": (1.5, "x"), "P2": (None, "x"), "P3": (None, None)}


def test_artifacts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "p", i, "protein") for i in range(9)], "comparison_id string, p string, n int, result_layer string")
    writers.write_artifact(df, str(tmp_path), "t", ["comparison_id", "n"], ["result_layer"])
    assert readers.read_artifact(spark, str(tmp_path), "t").count() == 9


def test_tmt_file_to_long_rows(spark, tmp_path):
    lines = ["\t".join(TMT_HEADER)] + ["\t".join("" if v is None else v for v in r) for r in tmt_rows(spark).collect()]
    path = write(tmp_path / "psm.txt", "\n".join(lines) + "\n")
    frame = design.tmt_design(spark, {"126": {"drug": "D", "replicate": 1}, "127N": {"drug": "I", "replicate": 1}})
    rows = workflows.prepare_tmt(spark, [path], frame).collect()
    assert {(r["Unique_PSM"], r["Condition"], r["Abundance"]) for r in rows} == {("EDGE||2", "D", 200.0), ("EDGE||2", "I", 100.0)}


def test_rows_must_be_preprocessed(spark):
    rows = spark.createDataFrame([("p", "P1", "+"), ("q", " ", None)], "Unique_PSM string, Master_Protein_Accessions string, Contaminant string")
    with pytest.raises(psm.InvalidInput):
        psm.assert_preprocessed(rows)
    with pytest.raises(psm.InvalidInput):
        psm.assert_preprocessed(rows.drop("Unique_PSM"))
    good = rows.where("Unique_PSM = 'p'").withColumn("Contaminant", F.lit("False"))
    assert psm.assert_preprocessed(good).count() == 1


def bytes_read(spark):
    """Bytes that the stages so far have read."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_headers_cost_a_buffer_of_each_file(spark, tmp_path):
    lines = "".join(f"{i}\tPEPTIDE{i}\n" for i in range(300_000))
    for i in range(3):
        write(tmp_path / f"part {i}+x.txt", "Charge\tSequence\n" + lines)
    write(tmp_path / "other.txt", "Sequence,Charge\nA,1\n")
    write(tmp_path / "empty.txt", "")
    before = bytes_read(spark)
    groups = readers.files_by_header(spark, str(tmp_path))
    assert bytes_read(spark) - before <= 4 * 65536 < len(lines)
    assert {h: len(files) for h, files in groups.items()} == {"Charge\tSequence": 3, "Sequence,Charge": 1}
    assert readers.read_psm(spark, str(tmp_path)).count() == 900_001


def test_headers_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_FILES_PER_JOB", 4)
    for i in range(11):
        write(tmp_path / f"{i}.txt", f"a\tb{i % 2}\n1\t2\n")
    assert {h: len(files) for h, files in readers.files_by_header(spark, str(tmp_path)).items()} == {"a\tb0": 6, "a\tb1": 5}


def test_batches_by_sample_and_by_contained_experiment(spark):
    frame = spark.createDataFrame(
        [("f1", "drug_A_1"), ("f2", "exp7x_A_2"), ("f3", "longexp7_B_1"), ("f4", "Ünexp_B_2"), ("f5", None)], "filename string, Sample_Origination string"
    )
    batches = spark.createDataFrame(
        [("drug_A_1", "b0", None), (None, "b1", "exp7"), (None, "b2", "longexp7"), (None, "b9", ""), (None, "b3", "Ün"), (None, "b8", "x" * 40)],
        "Sample_Origination string, batch string, experiment string",
    )
    got = {r["filename"]: r["batch"] for r in design.with_batches(frame, batches).collect()}
    # Of several experiments inside an id the first by name gives the batch.
    assert got == {"f1": "b0", "f2": "b1", "f3": "b1", "f4": "b3", "f5": None}
    with pytest.raises(design.InvalidDesign):
        design.with_batches(frame, batches.where("batch <> 'b3'"))


def test_rows_of_a_file_do_not_meet_in_one_task(spark):
    """A design is known to be small, so the rows stay where they are."""
    rows = spark.range(100).selectExpr("concat('f', id % 2) AS filename", "id")
    files = spark.createDataFrame([("f0", "A"), ("f1", "B")], "filename string, Condition string")
    joined = psm.join_design(rows, files, "filename")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert joined.count() == 100
