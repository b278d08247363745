"""The manifest against a plain tree, on rows with nulls, equal ids, repeated rows and groups around the fan-out."""

import hashlib
import zlib

import pytest

from mullion.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, key int, pos string, leaf string, root int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    """The root, and (left, right) siblings per level for every leaf."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 16:p - p % 16 + 16]
            paths[i].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
            at[i] = p // 16
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        group = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        built.append((group, *tree([leaf(r, r[4]) for r in group])))
    root, upper = tree([b[1] for b in built])
    out = []
    for (group, top, paths), above in zip(built, upper):
        for r, path in zip(group, paths):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for a, b in path + above:
                fold = sha(a + fold + b)
            out.append((r[0], leaf(r, r[4]), top, root, sha("".join(a + b for a, b in path + above)), fold, fold == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "l", 2) for r in rows], SCHEMA)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())))


ODD = [(None, None, None, None, None), (None, None, "x", 1, "A"), (5, "", "e", 1, "A"), (5, "", "e", 1, "A"), (5, "", "e", 1, "B"), (7, "-", "e", 0, ""), (8, "=", "e", 0, "É Ü"), (10**15, "Z", "e", 9, "Word " * 40000)]


@pytest.mark.parametrize("rows", [
    [(0, "s", "e", 1, "T")],
    ODD,
    [*ODD, *[(i, "s", "e", i, "Tx" * (i % 9)) for i in range(600)], *[(i, f"g{i}", "e", i, "One") for i in range(40)]],
    [*[(i, "a", "e", 1, "T") for i in range(16)], *[(i, "b", "e", 1, "T") for i in range(17)], *[(i, "c", "e", 1, "T") for i in range(257)]],
], ids=["one", "odd", "many", "edges"])
def test_manifest(spark, rows):
    assert rows_of(merkle.manifest(table(spark, rows))) == sorted(map(str, plain(rows)))


def test_manifest_of_repeated_rows_in_one_group(spark):
    rows = [(1, "s", "e", 1, "T")] * 300
    assert rows_of(merkle.manifest(table(spark, rows))) == sorted(map(str, plain(rows)))


def test_manifest_of_an_empty_table(spark):
    got = merkle.manifest(table(spark, []))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_every_tampering_with_capitals_shows(spark):
    got = {r.doc_id: r.verified for r in merkle.manifest(table(spark, [(i, "s", "e", 1, "Cap" if i % 2 else "low") for i in range(200)])).collect()}
    assert all(ok == (zlib.crc32(str(i).encode()) % 5 != 0 or i % 2 == 0) for i, ok in got.items())
