"""Line, exact and SimHash dedup against brute force on awkward rows and on the smallest tables."""

import hashlib
import itertools
import random

import pytest
import xxhash

from daygrain.llm import exact_dedup, line_dedup, simhash
from daygrain.llm.common import components
from tests.llm.data import PASSAGE, ROWS


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- lines -------------------------------------------------------------------------------------------


def lines_by_hand(rows, size=3):
    """Cleaned text of every distinct (id, text), by looking at all windows in order."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    places = {}
    for key in order:
        solid = [(i, x) for i, x in enumerate((key[1] or "").split("\n")) if x.strip(" \t\r")]
        for k in range(len(solid) - size + 1):
            window = tuple(x for _, x in solid[k : k + size])
            places.setdefault(window, []).append((key, solid[k][0], solid[k + size - 1][0]))
    gone = {}
    for found in places.values():
        for key, first, last in found[1:]:
            gone.setdefault(key, set()).update(range(first, last + 1))
    out = {}
    for key in order:
        kept = [x for i, x in enumerate((key[1] or "").split("\n")) if i not in gone.get(key, ())]
        out[key] = None if key[1] is None else "\n".join(kept) if key in gone else key[1]
    return out


def test_lines_match_brute_force(docs):
    expected = lines_by_hand([(r[0], r[1]) for r in ROWS])
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_removed", "source", "h").collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.text) for r in got) == sorted(str(expected[r[0], r[1]]) for r in ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text.endswith(PASSAGE)  # the first occurrence stays
    assert by_id[6].text == "and more of its own"
    assert by_id[7].text == "x\n"  # no window spans the blank line
    assert by_id[13].text == "same"  # windows of one text overlap themselves
    assert by_id[4].text is None and by_id[3].text == "" and by_id[5].n_removed == 0


def test_no_lines(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_use_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- whole texts -------------------------------------------------------------------------------------


def test_exact_groups(docs):
    got = exact_dedup.exact_duplicates(docs, carry=("text", "source")).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(lower(r[1]), []).append(r[0])
    for r in got:
        ids = groups[lower(r.text)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for key in groups:
        assert sum(r.kept for r in got if lower(r.text) == key) == 1  # also of repeated rows


def test_exact_digest_and_short_prefix(spark):
    rows = [(i, t) for i, t in enumerate(["same start A", "same start B", "SAME START a", "same start C", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", exact_dedup.whole_digest("text"))
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df, carry=("d",), prefix=4).collect()}
    assert [got[i].keep_id for i in range(5)] == [2, 1, 2, 3, 4]
    assert got[1].d == hashlib.sha256(b"same start b").hexdigest()


def test_no_texts(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


# --- fingerprints ------------------------------------------------------------------------------------


def print_by_hand(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lower(text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def check_components(rows, got):
    prints = {r[1]: print_by_hand(r[1]) for r in rows}
    distinct = sorted(set(prints.values()))
    near = [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    root = components_by_hand(distinct, near)
    least = {}
    for r in rows:
        least.setdefault(root[prints[r[1]]], []).append(r[0])
    for r in got:
        assert r.print % (1 << 64) == prints[r.text]
        ids = [i for i in least[root[prints[r.text]]] if i is not None]
        assert r.component_id == min(ids, default=None)


def test_fingerprint_of_short_texts():
    for text in (None, "", " \t", "One", "one two", "A b C d", "nbsp is a letter here", "a b c a b c a b c"):
        assert simhash.fingerprint(text) % (1 << 64) == print_by_hand(text)


def test_simhash_on_awkward_rows(docs):
    got = simhash.near_duplicates(docs, carry=("text",)).collect()
    assert len(got) == len(ROWS)
    check_components(ROWS, got)


def test_simhash_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check_components([tuple(r) for r in docs.collect()], simhash.near_duplicates(docs, carry=("text",)).collect())


def test_no_link_is_lost(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for p in base:
        for _ in range(12):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "print long"))
    expected = {tuple(sorted(x)) for x in itertools.combinations(signed, 2) if ((x[0] ^ x[1]) % (1 << 64)).bit_count() <= 2}
    assert {tuple(r) for r in got.collect()} == expected and expected


def test_one_of_each_group_stays(docs):
    got = simhash.drop_near_duplicates(docs).collect()
    assert got[0].__fields__ == docs.columns
    named = simhash.near_duplicates(docs, carry=("text",)).collect()
    assert len(got) == len({r.root for r in named})
    assert {r.doc_id for r in got} == {r.component_id for r in named}


def test_no_fingerprints(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


# --- components --------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    if shape == "path":
        edges = [(i, i + 1) for i in range(60)]
    elif shape == "star":
        edges = [(100, i) for i in range(60)] + [(7, 7), (None, 3)]
    else:
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {n for e in real for n in e}
    assert {r.node: r.root for r in got} == components_by_hand(nodes, real)
    assert len(got) == len(nodes)
