"""Document fingerprints: Merkle trees over sentences, paragraphs and sections, as DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

LINES = r"[^\n]*\n+|[^\n]+"
SENTENCES = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
LEAVES = "[^,;]+"
#: Characters of a section's hash in a fingerprint, and of a leaf's.
SECTION_DIGITS = 16
LEAF_LETTERS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def _leaf(sentence: Column) -> Column:
    digest = _sha(sentence)
    short = F.base64(F.unhex(F.left(digest, F.lit(LEAF_LETTERS * 6 // 4))))
    return F.struct(digest.alias("hash"), F.concat(short, F.char_length(sentence).cast("string")).alias("leaf"))


def _paragraph(line: Column) -> Column:
    def node(leaves: Column) -> Column:
        digest = _sha(F.array_join(leaves["hash"], ""))
        # A blank line ends a section; so does one paragraph in 16, by its hash, so that sections stay short.
        last = digest.startswith("0") | line.contains("\n\n")
        return F.struct(
            digest.alias("hash"),
            F.array_join(leaves["leaf"], ",").alias("leaves"),
            F.when(last, "|").otherwise(";").alias("close"),
        )

    return _let(F.transform(F.regexp_extract_all(line, F.lit(SENTENCES), F.lit(0)), _leaf), node)


def _sections(paragraphs: Column, field: str) -> Column:
    joined = F.array_join(F.transform(paragraphs, lambda p: F.concat(p[field], p["close"])), "")
    return F.split(F.regexp_replace(joined, r"[|;]$", ""), r"\|")


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text as a string: root, then sections, separated by ``|``.

    A leaf is a sentence or the end of a line; the leaves of a line are a paragraph; paragraphs up to a blank
    line, or up to one whose hash starts with 0, are a section. Every node's hash is the SHA-256 of those of its
    children, so equal roots mean equal texts. A section is written as 16 digits of its hash, a colon, and its
    paragraphs, each with ``;`` in between; a leaf as 48 bits of its hash and its length in code points. Null
    texts count as empty.
    """

    def tree(paragraphs: Column) -> Column:
        hashes = F.transform(_sections(paragraphs, "hash"), _sha)
        listed = F.zip_with(
            hashes, _sections(paragraphs, "leaves"), lambda h, x: F.concat(F.left(h, F.lit(SECTION_DIGITS)), F.lit(":"), x)
        )
        return F.concat(_sha(F.array_join(hashes, "")), F.lit("|"), F.array_join(listed, "|"))

    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINES), F.lit(0))
    return _let(F.transform(lines, _paragraph), tree)


def root(tree: Column) -> Column:
    """The hash of the whole text."""
    return F.substring_index(tree, "|", 1)


def _branches(tree: Column) -> Column:
    return F.slice(F.split(tree, r"\|"), F.lit(2), F.size(F.split(tree, r"\|")))


def _leaves(sections: Column) -> Column:
    own = lambda s: F.regexp_extract_all(F.substr(s, F.lit(SECTION_DIGITS + 2)), F.lit(LEAVES), F.lit(0))
    return F.flatten(F.transform(sections, own))


def _length(leaves: Column) -> Column:
    size = lambda x: F.substr(x, F.lit(LEAF_LETTERS + 1)).cast("long")
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + size(x))


def likeness(a: Column, b: Column) -> Column:
    """Share of their code points, 0 to 1, that two fingerprints have in common; 1 for equal roots, 0 for a null.

    Equal sections count whole; below sections that differ, equal leaves count. What repeats within a text
    counts once: twice the common length over the sum of both.
    """

    def compared(x: Column, y: Column) -> Column:
        common = _length(_leaves(F.array_intersect(x, y)))
        return _let(
            F.struct(
                common.alias("common"),
                F.array_distinct(_leaves(F.array_except(x, y))).alias("x"),
                F.array_distinct(_leaves(F.array_except(y, x))).alias("y"),
            ),
            lambda s: 2.0
            * (s["common"] + _length(F.array_intersect(s["x"], s["y"])))
            / (2 * s["common"] + _length(s["x"]) + _length(s["y"])),
        )

    far = _let(F.struct(_branches(a).alias("x"), _branches(b).alias("y")), lambda s: compared(s["x"], s["y"]))
    return F.when(a.isNull() | b.isNull(), 0.0).when(root(a) == root(b), 1.0).otherwise(F.coalesce(far, F.lit(0.0)))


def _agreeing(x: Column, y: Column) -> Column:
    """How many elements two arrays share before they first differ."""
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.least(F.size(x), F.size(y)).cast("long")).otherwise(first - 1).cast("int")


def _shared_start(x: Column, y: Column) -> Column:
    """Code points of the equal leaves at the start: whole sections first, then leaves of the first that differs."""

    def below(n: Column) -> Column:
        rest = lambda s: _leaves(F.slice(s, n + 1, F.size(s)))
        leaves = F.struct(rest(x).alias("x"), rest(y).alias("y"))
        inner = _let(leaves, lambda s: _length(F.slice(s["x"], F.lit(1), _agreeing(s["x"], s["y"]))))
        return _length(_leaves(F.slice(x, F.lit(1), n))) + inner

    return _let(_agreeing(x, y), below)


def edited_span(a: Column, b: Column) -> Column:
    """struct(start, stop): the code points of the first text outside the leaves that both texts start and end with.

    Null where the roots are equal or a fingerprint is null; an insertion at a leaf's border has start = stop.
    """

    def located(s: Column) -> Column:
        ends = lambda c: F.reverse(_leaves(c))
        size = _length(_leaves(s["x"]))
        start = _shared_start(s["x"], s["y"])
        same_end = _let(
            F.struct(ends(s["x"]).alias("p"), ends(s["y"]).alias("q")),
            lambda e: _length(F.slice(e["p"], F.lit(1), _agreeing(e["p"], e["q"]))),
        )
        return F.struct(start.alias("start"), F.greatest(start, size - same_end).alias("stop"))

    both = F.struct(_branches(a).alias("x"), _branches(b).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull() & (root(a) != root(b)), _let(both, located))


def successors(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, next): each distinct id with the next greater one; the last with the first.

    Ids are cut into ranges, and a range is ordered by itself; only the first id of each range, as many as
    there are shuffle partitions, is ordered in one place. Null ids are left out.
    """
    ranged = cut_lineage(
        ids.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"))
        .distinct()
        .repartitionByRange("id")
        .withColumn("part", F.spark_partition_id())
    )
    heads = ranged.groupBy("part").agg(F.min("id").alias("head"))
    order = Window.orderBy("head")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after"))
    inside = Window.partitionBy("part").orderBy("id")
    return (
        ranged.withColumn("following", F.lead("id").over(inside))
        .join(after, "part")
        .select("id", F.coalesce("following", "after").alias("next"))
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4) -> DataFrame:
    """Each document's tree, and that of its text with the last 1/``parts`` replaced from the next document's start.

    Returns (id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint), one row per input row.
    The last floor(n_chars / parts) code points give way to the first as many (or all) of the next document by
    ascending id; after the last id comes the first, which may be the document itself. Of rows that share the
    next id the one with the smallest MD5 of its text is taken. Documents without an id have no next: they lose
    their end, and ``next_fingerprint`` is null. Null texts count as empty, an empty table gives an empty
    result, and other columns are not read.

    Texts are shuffled once, by id, with their trees; starts of texts go on to the document before.
    """
    own = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        fingerprint(F.col(text_col)).alias("tree"),
    )
    named, unnamed = own.where("id IS NOT NULL"), own.where("id IS NULL")
    cut = lambda size: F.floor(size / parts).cast("int")
    # Of each id: the longest start that its rows ask for, and the text that speaks for the id.
    asked = cut_lineage(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .groupBy("id")
        .agg(F.max(cut(F.char_length("text"))).alias("wanted"), F.min(F.md5("text")).alias("speaker"))
    )
    links = successors(asked, "id").join(asked.select("id", "wanted"), "id")
    needs = cut_lineage(
        links.join(asked.select(F.col("id").alias("next"), "speaker"), "next").select(
            "next", "speaker", F.col("id").alias("before"), "wanted"
        )
    )
    starts = (
        named.join(needs.hint("merge"), named["id"] == needs["next"])
        # The speaker is the least of its id: <= says the same as =, and leaves the id as the only join key,
        # so that both joins read one shuffle of the texts.
        .where(F.md5("text") <= F.col("speaker"))
        .select("before", F.left("text", F.col("wanted")).alias("start"), F.col("tree").alias("next_tree"))
        .groupBy("before")
        .agg(F.first("start").alias("start"), F.first("next_tree").alias("next_tree"))
    )
    joined = named.join(starts.hint("merge"), named["id"] == starts["before"], "left").drop("before")
    alone = unnamed.withColumns({"start": F.lit(None).cast("string"), "next_tree": F.lit(None).cast("string")})
    size = F.char_length("text")
    edited = F.concat(
        F.left("text", size - cut(size)), F.coalesce(F.left("start", cut(size)), F.lit(""))
    )
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col),
        size.cast("long").alias("n_chars"),
        edited.alias("edited"),
        F.col("tree").alias("fingerprint"),
        F.col("next_tree").alias("next_fingerprint"),
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
