"""Whole analyses composed from the operators, one lineage per table.

A table that several later tables read is written once to the shared folder,
so nothing upstream runs twice and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.operators import artifacts, design, enrich, fit, normalize, pca, protein, psm, ptm, qc
from omicspark.operators import summarize as summarise_ops
from omicspark.session import cut_lineage
from omicspark.sources import readers


@dataclass(frozen=True)
class Options:
    """Settings of a run.

    ``contrast_rule`` and ``contrast_weights`` say which conditions a side of a
    comparison stands for and how it pools them; ``standards`` are the proteins
    or features that the 'globalStandards' normalisation trusts; ``conditions``,
    if given, keeps the samples of these conditions only.
    """

    resolve_shared: bool = True
    max_missing: float = 0.40
    min_psms: int = 1
    normalization: str | None = None
    imputation: str = "none"
    summary: str | None = None
    min_features: int = 2
    subset: str = "all"
    n_top: int = 3
    adjust: str = "BH"
    robust: bool = True
    use_batch: bool = False
    p_cut: float = 0.05
    contrast_rule: str = "criteria"
    contrast_weights: str = "mean"
    conditions: Sequence[str] = field(default_factory=tuple)
    standards: Sequence[str] = field(default_factory=tuple)


# ---------------------------------------------------------------- preparation


def prepare_tmt_frame(raw: DataFrame, channel_design: DataFrame) -> DataFrame:
    """Long PSM rows of a wide reporter export: filter, unpivot, design, identity."""
    labels = psm.channel_columns(raw.columns)
    long = psm.unpivot_channels(psm.filter_psm_tmt(raw), labels)
    long = psm.filter_channel_abundance(long)
    joined = psm.join_design(long, channel_design, "Channel")
    return psm.normalize_columns(psm.with_unique_psm(joined))


def prepare_tmt(spark: SparkSession, paths: Sequence[str], channel_design: DataFrame) -> DataFrame:
    raw = readers.read_psm(spark, paths)
    psm.validate_psm(raw, "tmt")
    rows = prepare_tmt_frame(raw, channel_design)
    if rows.isEmpty():
        raise psm.InvalidInput("no PSM rows matched the configured reporter channels")
    return rows


def prepare_dia_frame(raw: DataFrame, file_design: DataFrame) -> DataFrame:
    """Long PSM rows of per-sample exports with a ``filename`` column."""
    rows = psm.with_abundance(psm.filter_psm_dia(raw))
    joined = psm.join_design(rows, file_design, "filename").drop("filename")
    return psm.normalize_columns(psm.with_unique_psm(joined))


def prepare_dia(spark: SparkSession, paths: Sequence[str], file_design: DataFrame) -> DataFrame:
    raw = readers.read_psm(spark, paths, with_filename=True)
    psm.validate_psm(raw, "dia")
    rows = prepare_dia_frame(raw, file_design)
    if rows.isEmpty():
        raise psm.InvalidInput("no PSM rows matched the configured files")
    return rows


def prepare_ptm_frame(raw: DataFrame, channel_design: DataFrame, role: str) -> DataFrame:
    rows = psm.filter_psm_ptm(psm.with_source_row(raw), role)
    labels = psm.channel_columns(raw.columns)
    long = psm.filter_channel_abundance(psm.unpivot_channels(psm.canonical_sequence(rows), labels))
    joined = psm.join_design(long, channel_design, "Channel")
    return psm.normalize_columns(psm.with_unique_psm(joined, sequence="Annotated_Sequence"))


def prepare_ptm(spark: SparkSession, path: str, channel_design: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """(long rows, filter counts) of one modification or protein export."""
    raw = readers.read_psm(spark, path)
    labels = psm.channel_columns(raw.columns)
    design.check_design_matches(list(labels), channel_design)
    missing = [c for c in psm.REQUIRED["ptm"] if c not in raw.columns and role == "ptm"]
    if missing:
        raise psm.InvalidInput(f"missing required columns: {missing}")
    long = prepare_ptm_frame(raw, channel_design, role)
    counts = psm.filter_counts(
        {
            "input_psms": raw,
            "quality_filtered_psms": psm.filter_psm_ptm(raw, role),
            "long_reporter_rows": long,
        },
        section=role,
    )
    return long, counts


# ---------------------------------------------------------- proteins to tests


def feature_levels(rows: DataFrame, duplicates: str) -> DataFrame:
    """(protein, feature, sample, log2_abundance) of prepared PSM rows."""
    named = rows.select(
        F.col("Master_Protein_Accessions").alias("protein"),
        F.col("Unique_PSM").alias("feature"),
        F.col("Sample_Origination").alias("sample"),
        F.col("Abundance").alias("abundance"),
    )
    return normalize.log2_features(named, duplicates)


def covered_rows(rows: DataFrame, design_frame: DataFrame, options: Options) -> DataFrame:
    # The coverage rule reads its input several times, so it is written once.
    resolved = cut_lineage(protein.resolve_shared(rows, options.resolve_shared))
    expected = design.expected_replicates(design_frame)
    return protein.coverage_filter(resolved, expected, options.max_missing, options.min_psms)


def normalized(pre: DataFrame, options: Options, dia: bool) -> DataFrame:
    """Feature levels under the normalisation of the options; 'none' leaves them."""
    method = options.normalization or ("center.median" if dia else "equalizeMedians")
    if method == "none":
        return pre
    if method == "globalStandards":
        return normalize.global_standards(pre, list(options.standards))
    if method == "equalizeMedians":
        return normalize.equalize_medians(pre)
    return normalize.normalize(pre, method)


def protein_tables(
    rows: DataFrame, design_frame: DataFrame, comparisons: DataFrame, options: Options, pipeline: str,
    dia: bool, contrast: DataFrame | None = None, genes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All canonical tables of a protein study from its prepared PSM rows.

    ``contrast`` are the comparisons' weights; without it the comparison labels
    are condition names. ``genes`` is a map (accession, gene).
    """
    if options.conditions:
        kept = F.col("Condition").isin(list(options.conditions))
        rows, design_frame = rows.where(kept), design_frame.where(kept)
    covered = cut_lineage(covered_rows(rows, design_frame, options))
    pre = cut_lineage(feature_levels(covered, "sum" if dia else "max"))
    post = normalized(pre, options, dia)
    if options.imputation == "censored":
        filled = cut_lineage(summarise_ops.impute_censored(post))
    else:
        filled = cut_lineage(normalize.impute(post, options.imputation))
    if dia:
        levels = summarise_ops.summarize(filled, options.summary or "robustSummary")
    else:
        levels = summarise_ops.summarize_tmp(filled, options.min_features, options.subset, options.n_top)
    samples = design_frame.select(
        F.col("Sample_Origination").alias("sample"),
        F.col("Condition").alias("condition"),
        F.col("Replicate").cast("string").alias("replicate"),
        (F.col("batch") if "batch" in design_frame.columns else F.lit(None)).cast("string").alias("batch"),
    ).distinct()
    levels = cut_lineage(
        levels.withColumnRenamed("log2_abundance", "level").join(samples.select("sample", "condition", "batch"), "sample")
    )
    return {
        "psms": covered,
        "normalization_coefficients": normalize.normalization_coefficients(pre, post),
        **study_tables(levels, filled, samples, comparisons, options, pipeline, dia, covered, contrast, genes),
    }


def uses_batch(samples: DataFrame, options: Options) -> bool:
    """Whether models get a batch part: asked for, known, and not settled by the condition alone."""
    if not options.use_batch or samples.where("batch IS NOT NULL").isEmpty():
        return False
    return not design.batch_confounded(samples).first()["confounded"]


def study_tables(
    levels: DataFrame, features: DataFrame, samples: DataFrame, comparisons: DataFrame,
    options: Options, pipeline: str, robust: bool, psms: DataFrame,
    contrast: DataFrame | None = None, genes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Catalogs, abundances, tests and QC of fitted protein levels.

    ``levels``: protein, sample, condition, batch, level. ``comparisons``: the
    configured comparison rows. A batch that the condition settles is left out
    of the models. Where batches are used, ``batch_free_levels`` shows the
    levels without them.
    """
    if contrast is None:
        contrast = design.contrasts_from_catalog(comparisons, samples)
    batched = robust and uses_batch(samples, options)
    if robust:
        fits = cut_lineage(fit.fit_models(levels, options.robust, use_batch=batched))
        tests = fit.contrast_models(fits, contrast, options.adjust, moderated=True, flat=fit.zero_variance(levels))
    else:
        tests = fit.contrast_group_means(fit.fit_group_means(levels), contrast, options.adjust)
    catalog = catalog_of(samples, comparisons)
    names = None
    if genes is not None:
        proteins = levels.select(F.col("protein").alias("ProteinAccession")).distinct()
        names = cut_lineage(protein.gene_labels(proteins, genes, "ProteinAccession", out="Gene"))
    gene_of = lambda df: _named(df, names)
    long = gene_of(levels.withColumnRenamed("protein", "protein_accession")).select(
        "protein_accession",
        "gene_name",
        F.col("sample").alias("sample_id"),
        F.col("level").alias("processed_log2_abundance"),
        F.lit("model_estimated").alias("provenance"),
    )
    peptides = gene_of(features.withColumnRenamed("protein", "protein_accession")).select(
        "protein_accession",
        "gene_name",
        F.col("feature").alias("peptide_id"),
        F.col("sample").alias("sample_id"),
        F.col("log2_abundance").alias("processed_log2_abundance"),
        "provenance",
        F.lit(pipeline).alias("pipeline"),
        F.lit("protein").alias("result_layer"),
    )
    peptides = artifacts.with_catalog(peptides, catalog)
    proteins = artifacts.annotate_provenance(artifacts.protein_abundance(long, catalog, pipeline), peptides)
    differential = fit.differential_table(tests, "protein", pipeline)
    counts = psms.select(F.col("Master_Protein_Accessions").alias("ProteinName"), F.col("Unique_PSM").alias("PSM"))
    differential = artifacts.fill_annotations(differential, counts, names)
    metrics = qc.qc_sample_metrics(proteins)
    groups = qc.qc_group_metrics(proteins, peptides)
    shown = {"batch_free_levels": fit.remove_batch_effect(levels)} if batched else {}
    return {
        **shown,
        "sample_catalog": catalog,
        "protein_abundance": proteins,
        "peptide_abundance": peptides,
        "differential": differential,
        "comparison_catalog": artifacts.comparison_catalog(differential, comparisons, catalog, options.p_cut),
        "qc_sample_metrics": metrics,
        "qc_group_metrics": groups,
        "qc_psm_completeness": qc.psm_completeness(peptides),
        "qc_psm_intensity": qc.psm_intensity(peptides),
        "qc_summary": qc.qc_summary(proteins, metrics, groups, psms),
    }


def _named(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """``df`` with the gene name of each protein, null without a gene map."""
    if names is None:
        return df.withColumn("gene_name", F.lit(None).cast("string"))
    return df.join(names.select(F.col("ProteinAccession").alias("protein_accession"), F.col("Gene").alias("gene_name")), "protein_accession", "left")


def catalog_of(samples: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Sample catalog; conditions in the order the comparisons first name them."""
    from pyspark.sql import Window

    named = comparisons.select(
        F.explode(
            F.array(
                F.struct(F.col("group1_label").alias("condition"), (F.col("comparison_order") * 2).alias("at")),
                F.struct(F.col("group2_label").alias("condition"), (F.col("comparison_order") * 2 + 1).alias("at")),
            )
        ).alias("c")
    )
    first = named.groupBy(F.col("c.condition").alias("condition")).agg(F.min("c.at").alias("at"))
    # Designs have one row per sample and catalogs one per comparison.
    orders = first.select("condition", (F.row_number().over(Window.orderBy("at")) - 1).alias("condition_order"))
    ordered = samples.withColumn(
        "sample_order", F.row_number().over(Window.orderBy("condition", F.col("replicate").cast("int"), "sample")) - 1
    )
    return artifacts.sample_catalog(ordered.withColumnRenamed("sample", "sample_id"), orders)


def sample_pca(tables: Mapping[str, DataFrame]) -> DataFrame:
    """PCA rows of a finished study, with the condition of each sample."""
    rows = tables["protein_abundance"].where(F.col("result_layer") == "protein")
    scores = pca.pca(rows, tables["sample_catalog"])
    return scores.join(tables["sample_catalog"].select("sample_id", "condition"), "sample_id")


def run_tmt(
    spark: SparkSession, paths: Sequence[str], mapping: Mapping[str, Mapping[str, object]],
    comparisons: Sequence[Mapping[str, Mapping[str, object]]], options: Options = Options(),
    gene_map: str | None = None,
) -> dict[str, DataFrame]:
    """Reporter-ion protein study: preparation to QC tables. ``gene_map`` is the path of a gene map."""
    frame = design.tmt_design(spark, mapping)
    return _study(spark, prepare_tmt(spark, paths, frame), frame, mapping, comparisons, options, gene_map, "tmt")


def run_dia(
    spark: SparkSession, paths: Sequence[str], metadata: Mapping[str, Mapping[str, object]],
    comparisons: Sequence[Mapping[str, Mapping[str, object]]], options: Options = Options(),
    gene_map: str | None = None, batches: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Label-free protein study: one export per sample. ``gene_map`` is the path of a gene map.

    ``batches`` (Sample_Origination, batch, experiment) gives each sample its batch, by its id or else by the
    experiment whose name the id contains.
    """
    frame = design.design_from_metadata(spark, metadata)
    if batches is not None:
        frame = cut_lineage(design.with_batches(frame, batches))
    return _study(spark, prepare_dia(spark, paths, frame), frame, metadata, comparisons, options, gene_map, "dia")


def _study(
    spark: SparkSession, rows: DataFrame, frame: DataFrame, mapping: Mapping[str, Mapping[str, object]],
    comparisons: Sequence[Mapping[str, Mapping[str, object]]], options: Options, gene_map: str | None, kind: str,
) -> dict[str, DataFrame]:
    groups = design.condition_groups(mapping, kind)
    named, contrast, unmatched = design.configured_contrasts(
        spark, comparisons, groups, options.contrast_rule, options.contrast_weights
    )
    genes = readers.read_gene_map(spark, gene_map) if gene_map else None
    tables = protein_tables(rows, frame, named, options, kind, kind == "dia", contrast, genes)
    return {**tables, "unmatched_comparisons": unmatched, "qc_pca": sample_pca(tables)}


def run_ptm(
    spark: SparkSession, ptm_path: str, fasta_path: str, mapping: Mapping[str, Mapping[str, object]],
    comparisons: Sequence[Mapping[str, Mapping[str, object]]], target: str,
    protein_path: str | None = None, options: Options = Options(), normalization: str = "background_peptide",
    min_background: int = 50,
) -> dict[str, object]:
    """Modification-site study with an optional protein layer."""
    frame = design.ptm_design(spark, mapping)
    rows, counts = prepare_ptm(spark, ptm_path, frame, "ptm")
    rows = cut_lineage(protein.resolve_shared(rows, options.resolve_shared))
    proteins = None
    if protein_path:
        proteins, more = prepare_ptm(spark, protein_path, frame, "protein")
        proteins = cut_lineage(protein.resolve_shared(proteins, options.resolve_shared))
        counts = counts.unionByName(more)
    accessions = rows.select(F.explode(F.split("Master_Protein_Accessions", ";")).alias("a"))
    accessions = accessions.select(F.trim("a").alias("accession")).where("accession != ''").distinct()
    sequences = cut_lineage(readers.read_fasta(spark, fasta_path, accessions))
    tables = ptm.build_sites(
        rows, frame, sequences, target, options.max_missing, normalization, proteins, min_background
    )
    groups = design.condition_groups(mapping, "ptm")
    named, contrast, unmatched = design.configured_contrasts(
        spark, comparisons, groups, options.contrast_rule, options.contrast_weights
    )
    results = site_results(tables, named, options, contrast)
    return {"filter_counts": counts, **tables, **results, "unmatched_comparisons": unmatched}


def site_results(
    tables: Mapping[str, object], comparisons: DataFrame, options: Options, contrasts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Site, protein and adjusted result layers from the feature tables."""
    summary = cut_lineage(summarise_ops.summarize_layers(tables["ptm_input"], tables.get("protein_input")))

    def layer(name: str) -> DataFrame:
        levels = summary.where(F.col("result_layer") == name).select(
            F.col("protein_accession").alias("protein"), F.col("sample_id").alias("sample"),
            "condition", F.col("processed_log2_abundance").alias("level"),
        )
        contrast = contrasts
        if contrast is None:
            contrast = design.contrasts_from_catalog(comparisons, levels.select("condition").distinct())
        fits = fit.fit_models(levels, robust=False)
        tests = fit.contrast_models(cut_lineage(fits), contrast, options.adjust, moderated=True)
        return tests.withColumnRenamed("protein", "protein_accession")

    metadata = tables["site_metadata"]
    sites = cut_lineage(layer("ptm"))
    out = {
        "summary": summary,
        "ptm_results": ptm.merge_site_metadata(
            ptm.add_unestimable_all(sites, metadata, comparisons), metadata
        ),
        "qc": qc.ptm_qc(tables["site_abundance"], tables["ptm_input"], sites),
    }
    if tables.get("protein_input") is not None:
        proteins = cut_lineage(layer("protein"))
        own = metadata.select(
            F.col("ProteinName").alias("protein_accession"), F.col("ProteinAccession").alias("__a")
        )
        known = proteins.select(F.col("protein_accession").alias("protein")).distinct()
        owned = match_global(own, known)
        adjusted = ptm.adjust_ptm(sites.join(owned, "protein_accession"), proteins, options.adjust)
        quantified = proteins.select("comparison_id", F.col("protein_accession").alias("protein"))
        out["protein_results"] = ptm.protein_annotation(proteins, metadata, None, tables["protein_input"])
        out["adjusted_results"] = ptm.keep_adjusted(adjusted, metadata, quantified)
    return out


def match_global(sites: DataFrame, proteins: DataFrame) -> DataFrame:
    """(site, GlobalProtein): the site's own protein, else the one without isoform ending."""
    exact = proteins.select(F.col("protein").alias("__a"), F.col("protein").alias("__exact"))
    base = proteins.groupBy(E.strip_isoform(F.col("protein")).alias("__s")).agg(F.min("protein").alias("__base"))
    joined = sites.join(exact, "__a", "left").withColumn("__s", E.strip_isoform(F.col("__a")))
    joined = joined.join(base, "__s", "left")
    found = F.coalesce("__exact", "__base")
    return joined.where(found.isNotNull()).select("protein_accession", found.alias("GlobalProtein"))


def enrichment(differential: DataFrame, sets: DataFrame, comparison: str | None = None, **options) -> DataFrame:
    """Enrichment of every comparison of a differential table, or of one, in one job."""
    by = ["comparison_id"]
    ranked = enrich.one_metric_per_gene(enrich.ranked_genes(differential, comparison), by)
    return enrich.prerank(cut_lineage(enrich.with_positions(ranked, by=by)), sets, by=by, **options)
