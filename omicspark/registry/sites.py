"""Queries of modification sites, their normalisation and result layers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.operators import design, ptm, qc, summarize
from omicspark.plans import workflows
from omicspark.registry import fits, proteins
from omicspark.registry.base import Tables, query
from omicspark.registry.preparation import PTM_CHANNELS
from omicspark.registry.quality import CV, quart, rounded
from omicspark.session import cut_lineage

TARGET = "DBIA"
ROWS = "_SourceRow"
# One entry per source row; its channels share the attributes.
SITES = r"""k AS (SELECT DISTINCT _SourceRow AS id, Master_Protein_Accessions AS acc, Annotated_Sequence AS seq, Modifications AS mods,
  ptmRS_Best_Site_Probabilities AS rs, CHIMERYS_Best_Site_Probabilities AS cb, TRY_CAST(CHIMERYS_PTM_Localization_Score AS DOUBLE) AS one,
  Charge FROM ptm_rows WHERE contains(coalesce(Modifications, ''), '(DBIA)')),
pep AS (SELECT *, upper(regexp_replace(CASE WHEN len(string_split(seq, '.')) >= 3 THEN string_split(seq, '.')[2] ELSE seq END, '[^A-Za-z]', '', 'g')) AS peptide FROM k),
seqs AS (SELECT accession, arg_max(gene, length(sequence)) AS gene, arg_max(sequence, length(sequence)) AS sequence FROM proteome GROUP BY 1),
looked AS (SELECT pep.*, CASE WHEN e.accession IS NOT NULL THEN 'exact' WHEN b.accession IS NOT NULL THEN 'canonical_fallback' ELSE 'unmapped' END AS mapping,
  coalesce(e.gene, b.gene, '') AS gene, coalesce(e.sequence, b.sequence) AS sequence FROM pep LEFT JOIN seqs e ON e.accession = acc
  LEFT JOIN seqs b ON e.accession IS NULL AND NOT contains(acc, ';') AND b.accession = string_split(acc, '-')[1]),
tok AS (SELECT id, u.t, u.o FROM k, unnest(string_split(mods, ';')) WITH ORDINALITY AS u(t, o)),
site0 AS (SELECT id, o, rtrim(head, '0123456789') AS w, substr(head, length(rtrim(head, '0123456789')) + 1) AS d
  FROM (SELECT id, o, trim(split_part(t, '(', 1)) AS head, split_part(t, '(', 2) AS tail FROM tok)
  WHERE trim(tail) = 'DBIA)' AND regexp_full_match(rtrim(head, '0123456789'), '[A-Za-z-]+')),
site AS (SELECT id, o, CASE WHEN d <> '' THEN upper(right(w, 1)) WHEN lower(w) IN ('n-term', 'nterm') THEN 'N-term' WHEN lower(w) IN ('c-term', 'cterm') THEN 'C-term' END AS residue,
  CASE WHEN d <> '' THEN CAST(d AS INTEGER) WHEN lower(w) IN ('n-term', 'nterm') THEN 1 ELSE -1 END AS position FROM site0),
count_sites AS (SELECT id, count(*) AS n FROM site GROUP BY id),
st AS (SELECT id, 1 AS src, u.t, u.o FROM k, unnest(string_split(rs, ';')) WITH ORDINALITY AS u(t, o)
  UNION ALL SELECT id, 2, u.t, u.o FROM k, unnest(string_split(cb, ';')) WITH ORDINALITY AS u(t, o)),
sc0 AS (SELECT id, src, o, upper(right(w, 1)) AS residue, CAST(substr(head, length(w) + 1) AS INTEGER) AS position, CAST(trim(score) AS DOUBLE) AS score
  FROM (SELECT id, src, o, trim(split_part(t, '(', 1)) AS head, rtrim(trim(split_part(t, '(', 1)), '0123456789') AS w,
    split_part(split_part(t, '(', 2), ':', 1) AS name, split_part(t, ':', 2) AS score FROM st)
  WHERE trim(name) = 'DBIA)' AND regexp_full_match(w, '[A-Za-z]+') AND w <> head AND regexp_full_match(trim(score), '[0-9.]+')),
first AS (SELECT id, min(src) AS src FROM sc0 GROUP BY id),
score AS (SELECT sc0.id, sc0.src, o, residue, position, score FROM sc0 JOIN first USING (id, src)
  UNION ALL SELECT site.id, 3, o, residue, position, CASE WHEN one <= 1 THEN one * 100 ELSE one END FROM site JOIN k USING (id) WHERE one IS NOT NULL AND site.id NOT IN (SELECT id FROM first)),
state AS (SELECT l.id, coalesce(n, 0) AS n_sites, greatest(1, coalesce(n, 0)) AS need, count(s.score) AS n_scores, count(*) FILTER (WHERE s.score >= 75) AS n_sure, min(s.src) AS src,
  coalesce(string_agg(CAST(s.score AS VARCHAR), '|' ORDER BY s.o), '') AS scores FROM looked l LEFT JOIN count_sites USING (id) LEFT JOIN score s ON s.id = l.id GROUP BY ALL),
status AS (SELECT *, CASE WHEN n_scores > 0 AND n_sure >= need THEN 'Confident' WHEN n_scores > 0 THEN 'Ambiguous' ELSE 'Unscored' END AS status FROM state),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -score, position, o) AS rk FROM score WHERE score >= 75),
local AS (SELECT r.id, rk AS o, residue, position FROM ranked r JOIN status s ON s.id = r.id AND s.status = 'Confident' AND rk <= need
  UNION ALL SELECT c.id, o, residue, position FROM score c JOIN status s ON s.id = c.id AND s.status = 'Ambiguous'
  UNION ALL SELECT t.id, o, residue, position FROM site t JOIN status s ON s.id = t.id AND s.status = 'Unscored'),
labels AS (SELECT l.id, coalesce(string_agg(CASE WHEN residue = 'N-term' AND position = 1 THEN 'N-term' ELSE residue || CAST(position AS VARCHAR) END, '|' ORDER BY o), '?0') AS labels
  FROM looked l LEFT JOIN local USING (id) GROUP BY l.id),
starts AS (SELECT id, instr(sequence, peptide) - 1 AS start, sequence, peptide FROM looked WHERE peptide <> '' AND contains(sequence, peptide)
  UNION ALL SELECT id, start + instr(substr(sequence, start + 2), peptide), sequence, peptide FROM starts WHERE instr(substr(sequence, start + 2), peptide) > 0),
n_starts AS (SELECT id, count(*) AS n FROM starts GROUP BY id),
mapped AS (SELECT DISTINCT id, start + position AS num, residue || CAST(start + position AS VARCHAR) AS label FROM starts JOIN local USING (id) WHERE position > 0),
joined AS (SELECT id, count(*) AS n, string_agg(label, '|' ORDER BY num, label) AS bar, string_agg(label, '+' ORDER BY num, label) AS plus FROM mapped GROUP BY id),
assigned AS (SELECT l.id, acc, peptide, mods, Charge, gene, mapping, labels, status, scores, coalesce(bar, '') AS bar,
  CASE src WHEN 1 THEN 'ptmRS' WHEN 2 THEN 'CHIMERYS best-site' WHEN 3 THEN 'CHIMERYS score' ELSE 'Unscored' END AS source,
  CASE WHEN j.id IS NULL THEN 'peptide_' || labels || '_unmapped' WHEN status = 'Ambiguous' OR s.n > 1 THEN 'candidate_' || bar ELSE plus END AS token,
  CASE WHEN j.id IS NULL THEN acc || ' · peptide ' || labels || ' · FASTA-unmapped'
       WHEN status = 'Ambiguous' OR s.n > 1 THEN acc || ' · candidate ' || CASE WHEN j.n = 1 THEN 'position' ELSE 'positions' END || ' ' || bar ELSE acc || ' · ' || plus END AS label,
  CASE WHEN j.id IS NULL THEN 'FASTA-unmapped' WHEN status = 'Ambiguous' OR s.n > 1 THEN 'Candidate positions' ELSE 'FASTA mapped' END AS mapping_status
  FROM looked l JOIN labels USING (id) JOIN status USING (id) LEFT JOIN joined j ON j.id = l.id LEFT JOIN n_starts s ON s.id = l.id),
feat AS (SELECT acc || '_' || token AS ProteinName, acc AS ProteinAccession, gene AS Gene, token AS SiteToken, label AS SiteLabel, peptide AS PeptideSequence,
  peptide || '|' || coalesce(mods, '') AS Peptidoform, p.Charge, Channel, Condition, Replicate, Role, BioReplicate, sum(Abundance) AS Abundance
  FROM ptm_rows p JOIN assigned a ON a.id = p._SourceRow GROUP BY ALL)"""
EXPECTED = "(VALUES ('DMSO', '126'), ('DMSO', '127N'), ('INCZ', '127C')) AS e(Condition, Channel)"


def covered(item: str, source: str, fraction: str) -> str:
    return f"""need AS (SELECT Condition, CAST(ceil((1 - {fraction}::DOUBLE) * count(*)) AS BIGINT) AS need FROM {EXPECTED} GROUP BY 1),
grid AS (SELECT i.item, n.Condition, n.need, count(DISTINCT s.Channel) AS seen FROM (SELECT DISTINCT {item} AS item FROM {source}) i CROSS JOIN need n
  LEFT JOIN (SELECT DISTINCT {item} AS item, f.Condition, f.Channel FROM {source} f JOIN {EXPECTED} ON e.Condition = f.Condition AND e.Channel = f.Channel) s
  ON s.item = i.item AND s.Condition = n.Condition GROUP BY ALL),
passing AS (SELECT item FROM grid GROUP BY item HAVING bool_and(seen >= need))"""


SITE_VIEWS = ("ptm_rows", "proteome")


def sited(t: Tables) -> ptm.NumberedSites:
    chosen, _ = ptm.split_target_background(ptm.with_peptide(t.view("ptm_rows")), TARGET)
    return ptm.number_sites(chosen, t.view("proteome"), TARGET)


def site_texts(t: Tables, names: list[str]) -> DataFrame:
    """Each source row with the ``names`` of its site."""
    numbered = sited(t)
    return numbered.named(numbered.rows.select(ROWS, "__u").distinct(), "__u", names).drop("__u").distinct()


def site_features(t: Tables) -> DataFrame:
    numbered = sited(t)
    return numbered.named_features(numbered.features()).select(*ptm.FEATURE_KEYS, "Abundance")


def study_design(t: Tables) -> DataFrame:
    return design.ptm_design(t.spark, PTM_CHANNELS)


def channels(t: Tables) -> DataFrame:
    return ptm.expected_channels(study_design(t)).select("Channel").distinct()


@query(
    "bare_peptides",
    "I1",
    """SELECT DISTINCT Annotated_Sequence, upper(regexp_replace(CASE WHEN len(string_split(Annotated_Sequence, '.')) >= 3 THEN string_split(Annotated_Sequence, '.')[2]
  ELSE Annotated_Sequence END, '[^A-Za-z]', '', 'g')) AS peptide FROM ptm_rows""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return t.view("ptm_rows").select(
        "Annotated_Sequence", E.bare_peptide(F.col("Annotated_Sequence")).alias("peptide")
    ).distinct()


@query(
    "modification_sites",
    "I2",
    f"""WITH {SITES} SELECT id AS {ROWS}, string_agg(residue || CAST(position AS VARCHAR), ',' ORDER BY o) AS sites FROM site GROUP BY id""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    sites = E.modification_sites(F.col("Modifications"), TARGET)
    text = F.array_join(F.transform(sites, lambda s: F.concat(s["residue"], s["position"].cast("string"))), ",")
    return t.view("ptm_rows").select(ROWS, text.alias("sites")).where("sites <> ''").distinct()


@query(
    "localization_scores",
    "I3 I4",
    f"""WITH {SITES} SELECT id AS {ROWS}, src AS source, scores FROM status WHERE n_scores > 0""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    rows = site_texts(t, ["LocalizationScores", "LocalizationSource"]).where(F.col("LocalizationScores") != "")
    names = {"ptmRS": 1, "CHIMERYS best-site": 2, "CHIMERYS score": 3}
    number = F.lit(None).cast("int")
    for name, n in names.items():
        number = F.when(F.col("LocalizationSource") == name, n).otherwise(number)
    return rows.select(ROWS, number.alias("source"), F.col("LocalizationScores").alias("scores"))


@query(
    "peptide_occurrences",
    "I5",
    f"WITH {SITES} SELECT id AS {ROWS}, CAST(start AS INTEGER) AS start FROM starts",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    chosen, _ = ptm.split_target_background(ptm.with_peptide(t.view("ptm_rows")), TARGET)
    rows = ptm.match_sequences(chosen, t.view("proteome"))
    found = E.occurrences(F.coalesce(F.col("protein_sequence"), F.lit("")), F.col("PeptideSequence"))
    return rows.select(ROWS, F.explode(found).alias("start")).distinct()


@query(
    "sequence_lookup",
    "D13",
    f"WITH {SITES} SELECT DISTINCT acc AS Master_Protein_Accessions, gene AS \"Gene\", mapping AS ProteinMapping, coalesce(length(sequence), 0) AS residues FROM looked",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    chosen, _ = ptm.split_target_background(t.view("ptm_rows"), TARGET)
    found = ptm.match_sequences(chosen.select("Master_Protein_Accessions").distinct(), t.view("proteome"))
    size = F.coalesce(F.length("protein_sequence"), F.lit(0)).cast("bigint")
    return found.select("Master_Protein_Accessions", "Gene", "ProteinMapping", size.alias("residues"))


ASSIGNED = ["ProteinName", "SiteLabel", "LocalizationStatus", "LocalizationSource", "LocalizationScores",
            "PeptidePositions", "ProteinPositions", "MappingStatus", "ProteinMapping", "Gene"]


@query(
    "site_assignment",
    "I6 I4 D9 B10",
    f"""WITH {SITES} SELECT id AS {ROWS}, acc || '_' || token AS ProteinName, label AS SiteLabel, status AS LocalizationStatus, source AS LocalizationSource,
  scores AS LocalizationScores, labels AS PeptidePositions, bar AS ProteinPositions, mapping_status AS MappingStatus, mapping AS ProteinMapping, gene AS "Gene" FROM assigned""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return site_texts(t, ASSIGNED)


@query("site_feature_sums", "E5 P4", f"WITH {SITES} SELECT * FROM feat", SITE_VIEWS)
def _(t: Tables) -> DataFrame:
    return site_features(t)


@query(
    "feature_identifiers",
    "I7",
    f"""WITH {SITES} SELECT DISTINCT ProteinName, Peptidoform, Charge, 'F' || substr(sha1(ProteinName || chr(31) || Peptidoform), 1, 16) || '_' || CAST(CAST(Charge AS INTEGER) AS VARCHAR) AS PSM,
  'S' || substr(sha1(ProteinName), 1, 12) || '|' || Peptidoform AS PeptideSequence FROM feat""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    name, form, charge = F.col("ProteinName"), F.col("Peptidoform"), F.col("Charge")
    numbered = sited(t)
    forms = numbered.rows.select("__f", "Charge").distinct()
    # The identifiers follow from the names, so they are worked out for distinct names.
    named = numbered.named(forms, "__f", ["ProteinName", "Peptidoform"]).select("ProteinName", "Peptidoform", "Charge")
    return named.distinct().select(
        "ProteinName", "Peptidoform", "Charge", E.feature_id(name, form, charge).alias("PSM"),
        E.balanced_peptide_id(name, form).alias("PeptideSequence"),
    )


@query(
    "site_coverage",
    "E6",
    f"WITH {SITES}, {covered('ProteinName', 'feat', '0.40')} SELECT item AS ProteinName FROM passing",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered = sited(t)
    passing = ptm.covered_items(numbered.features(), study_design(t), 0.40, "__p")
    return numbered.named(passing, "__p", ["ProteinName"]).select("ProteinName")


STATUS_RANK = "CASE status WHEN 'Confident' THEN 2 WHEN 'Ambiguous' THEN 1 ELSE 0 END"
EV = "ev AS (SELECT *, acc || '_' || token AS ProteinName FROM assigned WHERE acc || '_' || token IN (SELECT item FROM passing))"
EVIDENCE = f"{covered('ProteinName', 'feat', '0.40')}, {EV}"


def passing_evidence(t: Tables) -> tuple[ptm.NumberedSites, DataFrame]:
    numbered = sited(t)
    passing = ptm.covered_items(numbered.features(), study_design(t), 0.40, "__p")
    return numbered, numbered.evidence(passing)


@query(
    "site_metadata",
    "E7 P4",
    f"""WITH {SITES}, {EVIDENCE} SELECT ProteinName, arg_min(acc, id) AS ProteinAccession, arg_min(gene, id) AS "Gene", arg_min(token, id) AS SiteToken, arg_min(label, id) AS SiteLabel,
  arg_max(status, {STATUS_RANK}) AS LocalizationStatus, arg_min(mapping_status, id) AS MappingStatus, arg_min(mapping, id) AS ProteinMapping, 'DBIA' AS TargetModification,
  count(*) FILTER (WHERE status = 'Confident') AS ConfidentEvidence, count(*) FILTER (WHERE status = 'Ambiguous') AS AmbiguousEvidence,
  count(*) FILTER (WHERE status = 'Unscored') AS UnscoredEvidence FROM ev GROUP BY ProteinName""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered, evidence = passing_evidence(t)
    return numbered.metadata(evidence, TARGET)


@query(
    "peptidoform_counts",
    "E8",
    f"""WITH {SITES}, {EVIDENCE} SELECT ProteinName, label AS SiteLabel, peptide || '|' || coalesce(mods, '') AS Peptidoform, Charge, count(*) AS PSMCount FROM ev GROUP BY ALL""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered, evidence = passing_evidence(t)
    return numbered.peptidoform_counts(evidence)


@query(
    "localization_summary",
    "E24",
    f"""WITH {SITES}, {EVIDENCE}, m AS (SELECT ProteinName, arg_max(status, {STATUS_RANK}) AS s, arg_min(mapping_status, id) AS p FROM ev GROUP BY 1)
SELECT 'localization' AS section, s AS status, count(*) AS sites FROM m GROUP BY s UNION ALL SELECT 'mapping', p, count(*) FROM m GROUP BY p""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered, evidence = passing_evidence(t)
    return ptm.localization_summary(numbered.metadata(evidence, TARGET))


@query(
    "centered_median_normalization",
    "J6",
    f"""WITH {SITES}, m AS (SELECT Channel, quantile_cont(log2(Abundance), 0.5) AS m FROM feat WHERE Channel IN ('126', '127N', '127C') AND Abundance > 0 GROUP BY 1),
f AS (SELECT Channel, pow(2, m - (SELECT quantile_cont(m, 0.5) FROM m)) AS f FROM m)
SELECT ProteinName, Peptidoform, Charge, feat.Channel, round(Abundance / coalesce(f, 1), 5) AS NormalizedAbundance FROM feat LEFT JOIN f ON f.Channel = feat.Channel""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered = sited(t)
    out, _ = ptm.normalize_centered_median(cut_lineage(numbered.features()), channels(t))
    out = numbered.named_features(out)
    return rounded(out.select("ProteinName", "Peptidoform", "Charge", "Channel", "NormalizedAbundance"), ["NormalizedAbundance"], 5)


BACKGROUND = r"""bg AS (SELECT upper(regexp_replace(CASE WHEN len(string_split(Annotated_Sequence, '.')) >= 3 THEN string_split(Annotated_Sequence, '.')[2] ELSE Annotated_Sequence END, '[^A-Za-z]', '', 'g')) AS pep,
  Charge, Channel, sum(Abundance) AS a FROM ptm_rows WHERE NOT contains(coalesce(Modifications, ''), '(DBIA)') AND Channel IN ('126', '127N', '127C') GROUP BY ALL),
complete AS (SELECT * FROM bg WHERE (pep, Charge) IN (SELECT (pep, Charge) FROM bg GROUP BY pep, Charge HAVING count(*) = 3)),
m AS (SELECT Channel, quantile_cont(log2(a), 0.5) AS m FROM complete GROUP BY 1), f AS (SELECT Channel, pow(2, m - (SELECT quantile_cont(m, 0.5) FROM m)) AS f FROM m)"""


@query(
    "background_channel_factors",
    "J5",
    f"WITH {BACKGROUND} SELECT Channel, round(f, 6) AS factor, (SELECT count(*) / 3 FROM complete) AS features FROM f",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    target, rest = ptm.split_target_background(ptm.with_peptide(t.view("ptm_rows")), TARGET)
    _, outcome = ptm.normalize_background(target, rest, channels(t), 1)
    out = outcome.factors.withColumn("features", F.lit(float(outcome.complete_feature_count)))
    return rounded(out, ["factor"])


@query(
    "background_normalization",
    "J5 P4",
    f"""WITH {SITES}, {BACKGROUND} SELECT ProteinName, Peptidoform, Charge, feat.Channel, round(Abundance / coalesce(f, 1), 5) AS NormalizedAbundance
FROM feat LEFT JOIN f ON f.Channel = feat.Channel""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    numbered = sited(t)
    _, rest = ptm.split_target_background(ptm.with_peptide(t.view("ptm_rows")), TARGET)
    out, _ = ptm.normalize_background(numbered.features(), rest, channels(t), 1)
    out = numbered.named_features(out)
    return rounded(out.select("ProteinName", "Peptidoform", "Charge", "Channel", "NormalizedAbundance"), ["NormalizedAbundance"], 5)


def site_tables(t: Tables, with_evidence: bool = True) -> dict[str, object]:
    # Both layers need the peptides, and nothing else of the annotated sequences.
    rows = cut_lineage(ptm.with_peptide(t.view("ptm_rows")).drop("Annotated_Sequence", "Peptidoform"))
    return ptm.build_sites(
        rows, study_design(t), t.view("proteome"), TARGET, 0.40, "centered_median", rows, with_evidence=with_evidence, written=True
    )


@query(
    "site_feature_table",
    "P4 I7 J6",
    f"""WITH {SITES}, {covered('ProteinName', 'feat', '0.40')},
m AS (SELECT Channel, quantile_cont(log2(Abundance), 0.5) AS m FROM feat WHERE Channel IN ('126', '127N', '127C') GROUP BY 1),
f AS (SELECT Channel, pow(2, m - (SELECT quantile_cont(m, 0.5) FROM m)) AS f FROM m)
SELECT ProteinName, 'S' || substr(sha1(ProteinName), 1, 12) || '|' || Peptidoform AS PeptideSequence, CAST(Charge AS INTEGER) AS Charge,
  'F' || substr(sha1(ProteinName || chr(31) || Peptidoform), 1, 16) || '_' || Charge AS PSM, '1' AS Mixture, '1' AS TechRepMixture, '1_1' AS Run,
  feat.Channel, Condition, BioReplicate, round(Abundance / coalesce(f, 1), 5) AS Intensity
FROM feat LEFT JOIN f ON f.Channel = feat.Channel WHERE ProteinName IN (SELECT item FROM passing)""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return rounded(site_tables(t, with_evidence=False)["ptm_input"], ["Intensity"], 5)


def second(text: str) -> str:
    """The rule of ``covered`` under other names, for a query that needs it twice."""
    return re.sub(r"\b(need|grid|passing)\b", r"\g<1>2", text)


# Both layers are polished together; a layer's name before a protein keeps them apart.
LAYERS = f"""{SITES}, {covered('ProteinName', 'feat', '0.40')},
m AS (SELECT Channel, quantile_cont(log2(Abundance), 0.5) AS m FROM feat WHERE Channel IN ('126', '127N', '127C') GROUP BY 1),
f AS (SELECT Channel, pow(2, m - (SELECT quantile_cont(m, 0.5) FROM m)) AS f FROM m),
site_cell AS (SELECT 'ptm:' || ProteinName AS protein, Peptidoform || '|' || Charge AS feature, BioReplicate AS sample, log2(max(Abundance / coalesce(f, 1))) AS log2_abundance
  FROM feat LEFT JOIN f ON f.Channel = feat.Channel WHERE ProteinName IN (SELECT item FROM passing) GROUP BY ALL HAVING max(Abundance / coalesce(f, 1)) > 0),
form AS (SELECT Master_Protein_Accessions AS acc, upper(regexp_replace(CASE WHEN len(string_split(Annotated_Sequence, '.')) >= 3 THEN string_split(Annotated_Sequence, '.')[2] ELSE Annotated_Sequence END, '[^A-Za-z]', '', 'g'))
  || '|' || coalesce(Modifications, '') AS form, Charge, Channel, Condition, Replicate, Role, BioReplicate, Abundance FROM ptm_rows),
total AS (SELECT acc, form, Charge, Channel, Condition, Replicate, Role, BioReplicate, sum(Abundance) AS Abundance FROM form GROUP BY ALL),
{second(covered('acc', 'total', '0.40'))},
protein_cell AS (SELECT 'protein:' || acc AS protein, form || '|' || Charge AS feature, BioReplicate AS sample, log2(max(Abundance)) AS log2_abundance
  FROM total WHERE acc IN (SELECT item FROM passing2) GROUP BY ALL HAVING max(Abundance) > 0),
center AS (SELECT sample, quantile_cont(log2_abundance, 0.5) AS c FROM protein_cell GROUP BY sample),
level AS (SELECT protein, feature, p.sample, log2_abundance - (c - (SELECT quantile_cont(c, 0.5) FROM center)) AS log2_abundance
  FROM protein_cell p JOIN center ON center.sample = p.sample UNION ALL SELECT * FROM site_cell),
"""


@query(
    "site_layer_summary",
    "J13 P4",
    f"""WITH {LAYERS} {fits.polished_or_median('level')}, kind AS (SELECT BioReplicate AS sample, min(Condition) AS condition FROM ptm_rows GROUP BY 1)
SELECT substr(protein, strpos(protein, ':') + 1) AS protein_accession, s.sample AS sample_id, condition, log2_abundance AS processed_log2_abundance,
  split_part(protein, ':', 1) AS result_layer FROM summary s JOIN kind ON kind.sample = s.sample WHERE condition <> 'Norm'""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    tables = site_tables(t, with_evidence=False)
    return rounded(summarize.summarize_layers(tables["ptm_input"], tables["protein_input"]), ["processed_log2_abundance"], 5)


STUDY_CONTRAST = "(VALUES ('INCZ_vs_DMSO', 'INCZ', 1.0::DOUBLE), ('INCZ_vs_DMSO', 'DMSO', -1.0::DOUBLE)) AS k(comparison_id, condition, weight)"


def tested(layer: str) -> str:
    """CTE ``test`` of one layer of the summary: condition means, moderated, INCZ against DMSO."""
    return f"""{LAYERS} {fits.polished_or_median('level', 12)}, kind AS (SELECT BioReplicate AS sample, min(Condition) AS condition FROM ptm_rows GROUP BY 1),
observed AS (SELECT substr(protein, strpos(protein, ':') + 1) AS protein, condition AS g, log2_abundance AS y FROM summary s JOIN kind ON kind.sample = s.sample
  WHERE condition <> 'Norm' AND split_part(protein, ':', 1) = '{layer}'),
{fits.mean_model('observed')}, {fits.PRIOR}, {fits.contrasts('tested', STUDY_CONTRAST)}"""


@query(
    "site_study_results",
    "P12 P17 J20 J21 J24",
    f"""WITH {tested('ptm')}, {EV},
site_meta AS (SELECT ProteinName, arg_min(gene, id) AS "Gene", arg_min(token, id) AS SiteToken, arg_max(status, {STATUS_RANK}) AS LocalizationStatus FROM ev GROUP BY ProteinName)
SELECT ProteinName AS protein_accession, 'INCZ_vs_DMSO' AS comparison_id, round(fc, 5) AS log2_fold_change, round(se, 4) AS standard_error,
  CASE WHEN se > 1e-6 THEN round(p, 4) END AS p_value, CASE WHEN p IS NULL THEN 'Unestimable' ELSE 'Estimated' END AS "Status", "Gene", SiteToken, LocalizationStatus
FROM site_meta LEFT JOIN test ON test.protein = ProteinName""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    out = site_study(t)["ptm_results"]
    zero = lambda c: F.col(c) + F.lit(0.0)
    return out.select(
        "protein_accession", "comparison_id", F.round(zero("log2_fold_change"), 5).alias("log2_fold_change"),
        F.round(zero("standard_error"), 4).alias("standard_error"),
        F.when(F.col("standard_error") > 1e-6, F.round("p_value", 4)).alias("p_value"), "Status", "Gene", "SiteToken", "LocalizationStatus",
    )


@query(
    "site_study_adjusted",
    "P12 D12 J23",
    f"""WITH site_test AS MATERIALIZED (WITH RECURSIVE {tested('ptm')} SELECT * FROM test),
protein_test AS MATERIALIZED (WITH RECURSIVE {tested('protein')} SELECT * FROM test),
owner AS MATERIALIZED (WITH RECURSIVE {SITES}, {EVIDENCE} SELECT ProteinName, arg_min(acc, id) AS acc FROM ev GROUP BY ProteinName),
base AS (SELECT regexp_replace(protein, '-\\d+$', '') AS stem, min(protein) AS base FROM protein_test GROUP BY 1),
matched AS (SELECT ProteinName, acc, coalesce(e.protein, base) AS other FROM owner LEFT JOIN (SELECT DISTINCT protein FROM protein_test) e ON e.protein = acc
  LEFT JOIN base ON stem = regexp_replace(acc, '-\\d+$', '')),
pair AS (SELECT s.protein, m.acc, m.other, s.fc - p.fc AS fc, pow(s.se, 2) AS a, pow(p.se, 2) AS b, s.df AS da, p.df AS db
  FROM site_test s JOIN matched m ON m.ProteinName = s.protein JOIN protein_test p ON p.protein = m.other),
stat2 AS (SELECT protein, acc, other, fc, sqrt(a + b) AS se, pow(a + b, 2) / (a * a / da + b * b / db) AS df, fc / sqrt(a + b) AS t FROM pair)
SELECT protein AS protein_accession, other AS "GlobalProtein", round(fc, 5) AS log2_fold_change, round(se, 4) AS standard_error, round(df, 2) AS df, round({fits.t_tail('t', f'CASE WHEN isinf(df) THEN {fits.ENDLESS} ELSE df END')}, 4) AS p_value,
  CASE WHEN other = acc THEN 'exact' ELSE 'canonical_fallback' END AS "ProteinMatch" FROM stat2 WHERE split_part(other, '-', 1) = split_part(acc, '-', 1)""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    out = site_study(t)["adjusted_results"]
    digits = {"log2_fold_change": 5, "standard_error": 4, "df": 2, "p_value": 4}
    rounded_ones = [F.round(F.col(c) + F.lit(0.0), d).alias(c) for c, d in digits.items()]
    return out.select("protein_accession", "GlobalProtein", *rounded_ones, "ProteinMatch")


def site_study(t: Tables) -> dict[str, DataFrame]:
    comparisons = t.spark.createDataFrame(
        [("INCZ_vs_DMSO", "INCZ", "DMSO")], "comparison_id string, group1_label string, group2_label string"
    )
    return workflows.site_results(site_tables(t), comparisons, workflows.Options())


ABUND = f"""{SITES}, s AS (SELECT *, Condition || '_' || CAST(Replicate AS VARCHAR) AS Sample FROM feat)"""


@query(
    "site_qc_completeness",
    "P11 E15",
    f"""WITH {ABUND} SELECT Sample, count(DISTINCT ProteinName) FILTER (WHERE Abundance > 20) AS present, (SELECT count(DISTINCT ProteinName) FROM s) AS total,
  (SELECT count(DISTINCT ProteinName) FROM s) - count(DISTINCT ProteinName) FILTER (WHERE Abundance > 20) AS missing FROM s GROUP BY Sample""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    features = site_features(t)
    shifted = features.withColumn("NormalizedAbundance", F.col("Abundance") - 20).withColumn("Imputed", F.lit(False))
    psms = ptm.feature_input(features, "ProteinName", "Abundance")
    return qc.ptm_qc(shifted, psms, t.view("diff"), only=["site_completeness"])["site_completeness"]


SITE_PSMS = "q AS (SELECT ProteinName || chr(31) || Peptidoform || chr(31) || CAST(CAST(Charge AS INTEGER) AS VARCHAR) AS k, Condition, Replicate, Sample, Abundance FROM s)"


def site_frame(t: Tables, name: str) -> DataFrame:
    """One quality frame of the sites, with an abundance that nothing normalised.

    Features are written by numbers. A frame takes from them what it needs, so texts that it does not show stay behind.
    """
    numbered = sited(t)
    features = numbered.named_features(cut_lineage(numbered.features())).select(*ptm.FEATURE_KEYS, "Abundance")
    features = features.withColumn("NormalizedAbundance", F.col("Abundance")).withColumn("Imputed", F.lit(False))
    psms = ptm.feature_input(features, "ProteinName", "Abundance")
    return qc.ptm_qc(features, psms, t.view("diff"), only=[name])[name]


@query(
    "site_qc_psm_completeness",
    "P11 E15",
    f"""WITH {ABUND}, {SITE_PSMS} SELECT Sample, count(DISTINCT k) FILTER (WHERE Abundance > 0) AS present, (SELECT count(DISTINCT k) FROM q) AS total,
  (SELECT count(DISTINCT k) FROM q) - count(DISTINCT k) FILTER (WHERE Abundance > 0) AS missing FROM q GROUP BY Sample""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return site_frame(t, "psm_completeness")


@query(
    "site_qc_psm_intensity",
    "P11 E17",
    f"""WITH {ABUND}, {SITE_PSMS}, m AS (SELECT *, quantile_cont(Abundance, 0.5) OVER (PARTITION BY Condition, Replicate) AS sm FROM q),
g AS (SELECT quantile_cont(sm, 0.5) AS g FROM m),
v AS (SELECT Condition, CAST(Replicate AS VARCHAR) AS Replicate, CASE WHEN Abundance > 0 THEN log2(Abundance * (g.g / sm)) END AS x FROM m, g),
b AS (SELECT Condition, Replicate, min(x) AS lo, max(x) AS hi, count(x) AS value_count, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS c
  FROM v GROUP BY ALL)
SELECT Condition, Replicate, value_count, round(a, 6) AS q1, round(md, 6) AS median, round(c, 6) AS q3,
  round(greatest(a - 1.5 * (c - a), lo), 6) AS lowerfence, round(least(c + 1.5 * (c - a), hi), 6) AS upperfence FROM b""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return rounded(site_frame(t, "intensity"), ["q1", "median", "q3", "lowerfence", "upperfence"])


@query(
    "site_qc_pvalues",
    "P11 E20",
    """WITH b AS (SELECT comparison_id, least(CAST(floor(p_value * 20) AS INTEGER), 19) AS bin FROM diff WHERE p_value BETWEEN 0 AND 1),
g AS (SELECT comparison_id, CAST(r.range AS INTEGER) AS bin FROM (SELECT DISTINCT comparison_id FROM diff), range(20) r)
SELECT g.comparison_id, g.bin, count(b.bin) AS count FROM g LEFT JOIN b ON b.comparison_id = g.comparison_id AND b.bin = g.bin GROUP BY ALL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return site_frame(t, "pvalues")


@query(
    "site_detail_peptidoforms",
    "P14 E8",
    f"""WITH {SITES}, {EVIDENCE}, one AS (SELECT min(ProteinName) AS site FROM ev),
m AS (SELECT arg_min(token, id) AS SiteToken, arg_max(status, {STATUS_RANK}) AS LocalizationStatus, arg_min(mapping_status, id) AS MappingStatus FROM ev, one WHERE ProteinName = site)
SELECT ProteinName, label AS SiteLabel, peptide || '|' || coalesce(mods, '') AS Peptidoform, Charge, count(*) AS PSMCount, SiteToken, LocalizationStatus, MappingStatus
FROM ev, one, m WHERE ProteinName = site GROUP BY ALL""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    """The peptidoforms of one site beside its metadata."""
    details = first_site(t)
    shown = details["site"].select("SiteToken", "LocalizationStatus", "MappingStatus")
    return details["peptidoforms"].withColumn("__k", F.lit(0)).join(shown.withColumn("__k", F.lit(0)), "__k").drop("__k")


def first_site(t: Tables) -> dict[str, DataFrame]:
    numbered, found = passing_evidence(t)
    names = numbered.named(found.select("__p").distinct(), "__p", ["ProteinName"])
    first = names.agg(F.min_by("__p", "ProteinName").alias("p"), F.min("ProteinName").alias("name")).first()
    site = first["name"] or ""
    evidence = cut_lineage(numbered.of_site(first["p"]).named_evidence(found.where(F.col("__p") == F.lit(first["p"]))))
    return ptm.site_details(site, ptm.site_metadata(evidence, TARGET), evidence, ptm.peptidoform_counts(evidence))


@query(
    "site_detail_evidence",
    "P14",
    f"""WITH {SITES}, {EVIDENCE} SELECT status AS LocalizationStatus, source AS LocalizationSource, scores AS LocalizationScores, labels AS PeptidePositions, bar AS ProteinPositions, count(*) AS rows
FROM ev WHERE ProteinName = (SELECT min(ProteinName) FROM ev) GROUP BY ALL""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    columns = ["LocalizationStatus", "LocalizationSource", "LocalizationScores", "PeptidePositions", "ProteinPositions"]
    return first_site(t)["evidence"].groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "site_levels",
    "P11 C3",
    f"WITH {ABUND} SELECT ProteinName AS protein, Sample AS sample, Condition AS condition, round(avg(log2(Abundance)), 6) AS level FROM s GROUP BY ALL",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    features = site_features(t)
    return rounded(qc.site_levels(features.withColumn("NormalizedAbundance", F.col("Abundance"))), ["level"])


@query(
    "site_abundance_rows",
    "P14",
    f"""WITH {SITES} SELECT Channel, Condition, Replicate, round(sum(Abundance), 4) AS NormalizedAbundance, round(log2(sum(Abundance)), 6) AS Abundance
FROM feat WHERE ProteinName = 'S4_peptide_C3_unmapped' GROUP BY ALL""",
    SITE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    features = site_features(t).withColumn("NormalizedAbundance", F.col("Abundance"))
    out = ptm.site_abundance("S4_peptide_C3_unmapped", None, features)
    return rounded(rounded(out, ["NormalizedAbundance"], 4), ["Abundance"])


# ---------------------------------------------------------------- result layers

META = "meta AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS ProteinName, p_brand AS Gene, p_type AS MappingStatus FROM part)"


def part_metadata(t: Tables) -> DataFrame:
    return t.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ProteinName"),
        F.col("p_brand").alias("Gene"), F.col("p_type").alias("MappingStatus"),
    )


@query(
    "unestimable_sites",
    "D10 J24",
    f"""WITH {META}, one AS (SELECT * FROM diff WHERE result_layer = 'ptm' AND comparison_id = 'D1_vs_DMSO')
SELECT protein_accession, comparison_id, log2_fold_change, p_value, CASE WHEN p_value IS NULL THEN 'Unestimable' ELSE 'Estimated' END AS Status FROM one
UNION ALL SELECT ProteinName, 'D1_vs_DMSO', NULL, NULL, 'Unestimable' FROM meta WHERE ProteinName NOT IN (SELECT protein_accession FROM one)""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    one = t.view("diff").where("result_layer = 'ptm' and comparison_id = 'D1_vs_DMSO'")
    one = one.select("protein_accession", "comparison_id", "log2_fold_change", "p_value")
    return ptm.add_unestimable(one, part_metadata(t), "D1_vs_DMSO")


@query(
    "unestimable_sites_all_comparisons",
    "D10 J24 P12",
    f"""WITH {META}, d AS (SELECT * FROM diff WHERE result_layer = 'ptm')
SELECT protein_accession, comparison_id, log2_fold_change, p_value, CASE WHEN p_value IS NULL THEN 'Unestimable' ELSE 'Estimated' END AS Status FROM d
UNION ALL SELECT m.ProteinName, c.comparison_id, NULL, NULL, 'Unestimable' FROM meta m CROSS JOIN catalog c
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.protein_accession = m.ProteinName AND d.comparison_id = c.comparison_id)""",
    ("diff", "catalog"),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("diff").where("result_layer = 'ptm'")
    rows = rows.select("protein_accession", "comparison_id", "log2_fold_change", "p_value")
    return ptm.add_unestimable_all(rows, part_metadata(t), t.view("catalog"))


@query(
    "site_metadata_join",
    "D11",
    f"""WITH {META} SELECT protein_accession, comparison_id, result_layer, p_value, Gene AS "Gene", MappingStatus FROM diff LEFT JOIN meta ON ProteinName = protein_accession""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("diff").select("protein_accession", "comparison_id", "result_layer", "p_value")
    return ptm.merge_site_metadata(rows, part_metadata(t))


GLOBAL = """res AS (SELECT comparison_id, protein_accession, log2_fold_change, psm_count > 2 AS Adjusted,
  protein_accession || CASE WHEN psm_count % 3 = 0 THEN '-2' ELSE '' END AS GlobalProtein FROM diff WHERE result_layer = 'ptm'),
own AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS site, 'P' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '-3' ELSE '' END AS ProteinAccession FROM part),
known AS (SELECT DISTINCT comparison_id, protein_accession || CASE WHEN psm_count % 3 = 0 THEN '-2' ELSE '' END AS protein FROM diff WHERE psm_count IS NOT NULL)"""


@query(
    "adjusted_layer_filter",
    "D12",
    f"""WITH {GLOBAL} SELECT r.comparison_id, r.protein_accession, r.GlobalProtein, o.ProteinAccession,
  CASE WHEN r.GlobalProtein = coalesce(o.ProteinAccession, '') THEN 'exact' ELSE 'canonical_fallback' END AS ProteinMatch
FROM res r LEFT JOIN own o ON o.site = r.protein_accession WHERE coalesce(Adjusted, false)
  AND EXISTS (SELECT 1 FROM known k WHERE k.comparison_id = r.comparison_id AND k.protein = r.GlobalProtein)
  AND split_part(r.GlobalProtein, '-', 1) = split_part(coalesce(o.ProteinAccession, ''), '-', 1)""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    diff = t.view("diff")
    suffix = F.when(F.col("psm_count") % 3 == 0, "-2").otherwise("")
    named = F.concat("protein_accession", suffix)
    rows = diff.where("result_layer = 'ptm'").select(
        "comparison_id", "protein_accession", "log2_fold_change", (F.col("psm_count") > 2).alias("Adjusted"), named.alias("GlobalProtein")
    )
    own = t.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ProteinName"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "-3").otherwise("")).alias("ProteinAccession"),
    )
    known = diff.where("psm_count is not null").select("comparison_id", named.alias("protein"))
    out = ptm.keep_adjusted(rows, own, known)
    return out.select("comparison_id", "protein_accession", "GlobalProtein", "ProteinAccession", "ProteinMatch")


@query(
    "protein_adjusted_effects",
    "J23",
    """SELECT s.comparison_id, s.protein_accession, s.log2_fold_change - p.log2_fold_change AS log2_fold_change,
  round(sqrt(pow(s.standard_error, 2) + pow(p.standard_error, 2)), 6) AS standard_error FROM diff s JOIN diff p
  ON p.comparison_id = s.comparison_id AND p.protein_accession = s.protein_accession WHERE s.result_layer = 'ptm' AND p.result_layer = 'protein'""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("diff").select(
        "comparison_id", "protein_accession", "log2_fold_change", "standard_error", "result_layer", F.lit(8.0).alias("df")
    )
    sites = rows.where("result_layer = 'ptm'").withColumn("GlobalProtein", F.col("protein_accession"))
    out = ptm.adjust_ptm(sites, rows.where("result_layer = 'protein'"))
    out = out.select("comparison_id", "protein_accession", "log2_fold_change", "standard_error")
    return rounded(out, ["standard_error"])


@query(
    "protein_annotation",
    "P13",
    """WITH r AS (SELECT protein_accession, min(gene_name) AS g FROM diff WHERE result_layer = 'protein' GROUP BY 1),
m AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS g FROM part),
q AS (SELECT 'P' || substr(accession, 2) AS a, gene AS g FROM proteome WHERE gene <> ''),
n AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS a, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT comparison_id, d.protein_accession, coalesce(q.g, m.g, r.g, '') AS gene_name, coalesce(n.n, psm_count, 0) AS psm_count
FROM diff d LEFT JOIN r USING (protein_accession) LEFT JOIN m ON m.a = d.protein_accession LEFT JOIN q ON q.a = d.protein_accession LEFT JOIN n ON n.a = d.protein_accession
WHERE result_layer = 'protein'""",
    ("diff", "proteome"),
)
def _(t: Tables) -> DataFrame:
    results = t.view("diff").where("result_layer = 'protein'").select("comparison_id", "protein_accession", "gene_name", "psm_count")
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    gene = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    metadata = t.table("part").select(name.alias("ProteinAccession"), gene.alias("Gene"))
    sequences = t.view("proteome").withColumn("accession", F.concat(F.lit("P"), F.expr("substr(accession, 2)")))
    psms = t.table("lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ProteinName"), F.col("l_orderkey").alias("PSM")
    )
    return ptm.protein_annotation(results, metadata, sequences, psms).select(
        "comparison_id", "protein_accession", "gene_name", "psm_count"
    )


# ------------------------------------------------------------- whole protein studies


def study(t: Tables, dia: bool) -> dict[str, DataFrame]:
    """A protein study on the PSM view: observed design, comparisons between its conditions."""
    rows = t.view("psm")
    frame = rows.select("Condition", "Replicate", "Sample_Origination").distinct()
    comparisons = t.spark.createDataFrame(
        [("A_vs_N", "A", "N", 0), ("R_vs_N", "R", "N", 1)],
        "comparison_id string, group1_label string, group2_label string, comparison_order int",
    )
    return workflows.protein_tables(
        rows, frame, comparisons, workflows.Options(max_missing=0.29), "dia" if dia else "tmt", dia,
        genes=proteins.part_genes(t),
    )


@query(
    "study_gene_names",
    "P17 D19",
    f"""WITH {proteins.RESOLVED}, {proteins.coverage('resolved', proteins.OBSERVED.format('resolved'), '0.29', 1)},
{proteins.genes_of('covered')} SELECT DISTINCT Master_Protein_Accessions AS protein_accession,
  coalesce(label, regexp_replace(Master_Protein_Accessions, '-\\d+$', '')) AS gene_name
FROM covered LEFT JOIN labels ON g = Master_Protein_Accessions WHERE Abundance > 0""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return study(t, False)["protein_abundance"].select("protein_accession", "gene_name").distinct()


PAIRS = "(VALUES ('A_vs_N', 'A', 1.0::DOUBLE), ('A_vs_N', 'N', -1.0::DOUBLE), ('R_vs_N', 'R', 1.0::DOUBLE), ('R_vs_N', 'N', -1.0::DOUBLE)) AS k(comparison_id, condition, weight)"


def study_levels(duplicates: str, center: str, summary: str) -> str:
    """CTEs of a protein study up to ``levels``: shared peptides, coverage, feature levels and their summary."""
    return f"""{proteins.RESOLVED}, {proteins.coverage('resolved', proteins.OBSERVED.format('resolved'), '0.29', 1)}, {proteins.genes_of('covered')},
raw_level AS (SELECT Master_Protein_Accessions AS protein, Unique_PSM AS feature, Sample_Origination AS sample, log2({duplicates}(Abundance)) AS x
  FROM covered GROUP BY ALL HAVING {duplicates}(Abundance) > 0),
middle AS (SELECT sample, quantile_cont(x, 0.5) AS c FROM raw_level GROUP BY sample),
feature_level AS (SELECT protein, feature, r.sample, x - ({center}) AS log2_abundance FROM raw_level r JOIN middle ON middle.sample = r.sample),
{summary}, kind AS (SELECT DISTINCT Sample_Origination AS sample, Condition AS condition FROM psm),
levels AS (SELECT protein, s.sample, condition, log2_abundance AS level FROM summarized s JOIN kind ON kind.sample = s.sample)"""


def chain(duplicates: str, center: str, summary: str, model: str, tested: str, flat: bool) -> str:
    """SQL of a whole protein study: its levels, models, tests, genes and counts."""
    return f"""WITH {study_levels(duplicates, center, summary)},
observed AS (SELECT protein, condition AS g, level AS y FROM levels),
{model}, {fits.contrasts(tested, PAIRS, flat=flat)},
psm_counts AS (SELECT Master_Protein_Accessions AS protein, count(DISTINCT Unique_PSM) AS psm_count FROM covered GROUP BY 1)
SELECT comparison_id, protein AS protein_accession, coalesce(label, regexp_replace(protein, '-\\d+$', '')) AS gene_name, round(fc, 5) AS log2_fold_change, round(se, 5) AS standard_error,
  CASE WHEN se > 1e-6 THEN round(t, 3) END AS statistic, CASE WHEN se > 1e-6 THEN round(p, 5) END AS p_value, CASE WHEN se > 1e-6 THEN round(adjusted, 4) END AS adjusted_p_value, psm_count
FROM test LEFT JOIN labels ON g = protein LEFT JOIN psm_counts USING (protein)"""


TMT = (
    "max", "c - (SELECT quantile_cont(c, 0.5) FROM middle)",
    f"{fits.polished_or_median('feature_level', 12)}, summarized AS (SELECT * FROM summary)",
)


def differential_shown(df: DataFrame) -> DataFrame:
    sure = F.col("standard_error") > 1e-6
    zero = lambda c, d: F.round(F.col(c) + F.lit(0.0), d)
    return df.select(
        "comparison_id", "protein_accession", "gene_name", zero("log2_fold_change", 5).alias("log2_fold_change"),
        zero("standard_error", 5).alias("standard_error"), F.when(sure, zero("statistic", 3)).alias("statistic"),
        F.when(sure, F.round("p_value", 5)).alias("p_value"), F.when(sure, F.round("adjusted_p_value", 4)).alias("adjusted_p_value"), "psm_count",
    )


@query(
    "tmt_study_differential",
    "P17 P8 J4 J10 J18 J20",
    chain(*TMT, fits.mean_model("observed"), "model", False),
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return differential_shown(study(t, False)["differential"])


@query(
    "dia_study_differential",
    "P17 P8 J2 J9 J17 J20 J21",
    chain(
        "sum", "c", f"{fits.ROBUST.format(source='feature_level', digits=12)}, summarized AS (SELECT * FROM fitted)",
        f"{fits.HUBER}, {fits.PRIOR}", "tested", True,
    ),
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return differential_shown(study(t, True)["differential"])


QUALITY_COLUMNS = [
    "group_by", "group_value", "sample_count", "observation_count", "q1", "median", "q3", "protein_cv_count", "protein_cv_q1",
    "protein_cv_median", "protein_cv_q3", "peptide_cv_count", "peptide_cv_q1", "peptide_cv_median", "peptide_cv_q3",
]


@query(
    "tmt_study_group_quality",
    "P9 P17",
    f"""WITH {study_levels(*TMT)},
a AS (SELECT condition, count(DISTINCT sample) AS sample_count, count(level) AS observation_count, {quart('level')} FROM levels GROUP BY condition),
pv AS (SELECT condition, protein, {CV.format('level')} AS cv FROM levels GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT condition, count(*) AS protein_cv_count, {quart('cv', ("protein_cv_q1", "protein_cv_median", "protein_cv_q3"), 5)} FROM pv WHERE isfinite(cv) GROUP BY condition),
ev AS (SELECT condition, protein, feature, {CV.format('log2_abundance')} AS cv FROM feature_level f JOIN kind ON kind.sample = f.sample GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT condition, count(*) AS peptide_cv_count, {quart('cv', ("peptide_cv_q1", "peptide_cv_median", "peptide_cv_q3"), 4)} FROM ev WHERE isfinite(cv) GROUP BY condition)
SELECT 'condition' AS group_by, condition AS group_value, * EXCLUDE (condition) FROM a LEFT JOIN p USING (condition) LEFT JOIN e USING (condition)""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    out = study(t, False)["qc_group_metrics"].select(*QUALITY_COLUMNS)
    out = rounded(out, ["q1", "median", "q3"])
    out = rounded(out, ["protein_cv_q1", "protein_cv_median", "protein_cv_q3"], 5)
    return rounded(out, ["peptide_cv_q1", "peptide_cv_median", "peptide_cv_q3"], 4)


