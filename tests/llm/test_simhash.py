import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from omicspark.llm import simhash
from omicspark.llm.components import connected_components

SHAPE = "doc_id long, text string, fp string, id string, component_id string"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBcÉ \t\n\x1c\x85", max_size=60) | st.none())
def test_fingerprint_equals_bitwise_majority(text):
    assert simhash.fingerprint_of(text) % (1 << 64) == brute.fingerprint(text)


def test_fingerprint_of_long_text_in_chunks():
    text = " ".join(random.Random(1).choices("ab cd ef gh ij".split(), k=40_000))
    assert simhash.fingerprint_of(text) % (1 << 64) == brute.fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 6), st.data())
def test_some_mask_avoids_any_few_bits(radius, data):
    flipped = data.draw(st.lists(st.integers(0, 63), max_size=radius, unique=True))
    word = sum(1 << i for i in flipped)
    assert any(mask & word == 0 for mask in simhash.covering_masks(radius))


def test_masks_keep_half_of_the_bits():
    assert all(28 <= m.bit_count() <= 36 for m in simhash.covering_masks(4))


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_forest_has_the_components_of_all_pairs(spark, block_rows):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            word = centre
            for i in rng.sample(range(64), rng.randint(0, 5)):
                word ^= 1 << i
            values.add(word)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.link_forest(table, 4, block_rows)
    assert all((a ^ b) % (1 << 64) != 0 and ((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links.collect())
    found = {r.node: r.component for r in connected_components(links).collect()}
    roots = brute.components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)
    groups = {}
    for v, root in zip(signed, roots):
        groups.setdefault(root, set()).add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def rows():
    base = " ".join(f"word{i}" for i in range(300))
    return [
        (7, base, "x", "x", "x"), (3, base, None, None, None), (9, base + " tail", "", "", ""), (5, "Other Words", "", "", ""),
        (6, "other words", "", "", ""), (1, None, "", "", ""), (2, "", "", "", ""), (4, " \t\n", "", "", ""),
        (8, "alone", "", "", ""), (8, "alone", "", "", ""), (None, base, "", "", ""), (None, "nobody", "", "", ""),
    ]


def test_nulls_copies_and_clashing_columns(spark):
    found = simhash.near_duplicates(spark.createDataFrame(rows(), SHAPE)).collect()
    assert len(found) == 12
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i: by_id[i].component_id for i in by_id} == {7: 3, 3: 3, 9: 3, 5: 5, 6: 5, 1: 1, 2: 1, 4: 1, 8: 8}
    assert by_id[1].fingerprint == 0
    assert sorted((r.component_id is None, r.component_id) for r in found if r.doc_id is None) == [(False, 3), (True, None)]


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one(spark.createDataFrame(rows(), SHAPE))
    assert kept.columns == ["doc_id", "text", "fp", "id", "component_id"]
    assert sorted((r.doc_id or 0, (r.text or "")[:8]) for r in kept.collect()) == [
        (0, "nobody"), (1, ""), (3, "word0 wo"), (5, "Other Wo"), (8, "alone"),
    ]


def test_repeated_id_in_two_groups(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(3, long), (5, long), (5, "different text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:4]) for r in simhash.keep_one(docs).collect()) == [(3, "w0 w"), (5, "diff")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_one(docs).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(200, 260)] + [(5, 5), (None, 4)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 200 for i in [*range(200, 260), 1000]}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = simhash.near_duplicates(docs).collect()
    assert all(r.fingerprint % (1 << 64) == brute.fingerprint(texts[r.doc_id]) for r in found)
    ordered = sorted(found, key=lambda r: r.doc_id)
    marks = [r.fingerprint % (1 << 64) for r in ordered]
    roots = brute.components(len(marks), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert [r.component_id for r in ordered] == [ordered[i].doc_id for i in roots]
