"""The Merkle manifest against plain Python, on odd rows and over several persisted levels."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from risklane.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, tree string, `Hash` int"
ODD = [(1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (None, "b", "en", 0, ""), (3, None, "xx", 1, "é\n\n"), (3, None, "xx", 1, "é\n\n"),
       (9, "", "en", 2, "no line end"), (4, "é", "fr", 5, "one\ntwo"), (-7, "Z", "en", 1, "\n"), (4, "é", "fr", 5, "other\ntext")]
MANY = [(i, "hot", "en", i, f"line {i}\nend") for i in range(300)] + [(1000 + i, f"s{i:03}", "en", 1, "x\ny") for i in range(95)]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i:i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def way(found, at):
    steps = []
    for level in found[:-1]:
        first = at - at % 3
        steps.append((level[first:at], level[at + 1:first + 3]))
        at //= 3
    return steps


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        trees[source].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        built[source] = levels([leaf(row) for row in trees[source]])
    top = levels([built[source][-1][0] for source in order])
    out = []
    for place, source in enumerate(order):
        for at, row in enumerate(trees[source]):
            steps = way(built[source], at) + way(top, place)
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            value = leaf((*row[:4], text))
            for before, after in steps:
                value = digest(*before, value, *after)
            proof = digest(*[h for before, after in steps for h in before + after])
            out.append((row[0], leaf(row), built[source][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return out


@pytest.mark.parametrize("rows", [ODD, MANY, ODD[:1], [ODD[3]], MANY[:81], MANY[:82]], ids=["odd", "many", "one", "null source", "81", "82"])
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA).repartition(3)
    got = merkle.audit(docs, merkle.without_line_ends(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(docs, merkle.without_line_ends(docs)).collect() == []


def test_untouched_rows_are_verified_and_blocks_are_bounded(spark):
    docs = spark.createDataFrame([(*row, "clash", 1) for row in MANY], SCHEMA)
    assert merkle.audit(docs).filter("not verified").isEmpty()
    leaves = docs.select(merkle.tree_key(F.col("source")).alias("tree"), "doc_id", F.sha2("text", 256).alias("hash"),
                         F.lit(None).cast("string").alias("item"))
    built = merkle.build(leaves, "doc_id")
    assert len(built.trees) == 2 and len(built.top) == 2
    assert built.trees[0].filter(F.size("run") > 81).isEmpty()
    # Only levels 0 and 4 are stored: 300 leaves of one tree, then its 4 nodes.
    assert built.trees[1].filter("tree = 'vhot'").select(F.size("run")).first()[0] == 4


def test_long_text(spark):
    docs = spark.createDataFrame([(2, "a", "en", 1, "long\n" * 400_000, "x", 1)], SCHEMA)
    row = merkle.audit(docs, merkle.without_line_ends(docs)).first()
    assert tuple(row) == brute([(2, "a", "en", 1, "long\n" * 400_000)])[0]
