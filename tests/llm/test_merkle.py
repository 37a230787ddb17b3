import hashlib
import zlib

from pyspark.sql import functions as F

from shelfwise.llm import merkle, queries
from tests.llm.conftest import SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_force(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS])


def tree(nodes):
    """(root, siblings of each node as (left, right) per level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
            at[k] = i // 8
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def by_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is None, r["doc_id"] or 0, leaf_by_force(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, last = tree([inner[g][0] for g in order])
    out = []
    for g, up in zip(order, last):
        for (null, doc_id, leaf), path in zip(sorted(groups[g]), inner[g][1]):
            out.append((None if null else doc_id, leaf, inner[g][0], root, h(*[s for pair in path + up for s in pair])))
    return sorted(out, key=str)


def proofs(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path"))).collect()), key=str)


def test_trees_of_many_sizes_equal_brute_force(spark):
    """One leaf, exact powers, partial runs, several blocks and more than one round of blocks."""
    sizes = {None: 1, "": 8, "a": 9, "b": 64, "c": 65, "d": 512, "e": 513, "f": 1100, "é": 2}
    rows = [{"doc_id": k if k % 7 else None, "source": None if k % 3 else "s", "lang": lang, "n_chars": k, "text": f"T{k} ü"} for lang, n in sizes.items() for k in range(n)]
    got = proofs(merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    assert got == by_force(rows)


def test_many_languages_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [{"doc_id": k, "source": "s", "lang": f"l{k % 70}", "n_chars": 1, "text": str(k)} for k in range(6000)]
    assert proofs(merkle.manifest(spark.createDataFrame(rows))) == by_force(rows)


def test_stored_blocks_stay_narrow(spark, monkeypatch):
    """A reader holds 4,096 stored rows at once: with all paths in them, a block of many leaves took 0.8 MB."""
    widths, store = [], merkle.settle

    def watched(df):
        out = store(df)
        widths.append(out.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0])
        return out

    monkeypatch.setattr(merkle, "settle", watched)
    docs = spark.range(1500).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "cast(id as string) as text")
    assert merkle.manifest(docs, F.upper("text")).count() == 1500
    assert widths and max(widths) < 32_000


def test_a_proof_holds_for_its_leaf_only(spark):
    rows = [(k, "s", "en" if k % 4 else "fr", 3, f"Text {k}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!")))
    got = merkle.verified(merkle.manifest(docs, changed)).collect()
    assert len(got) == 90 and all(r.verified == (r.doc_id % 5 != 0) for r in got)


def test_the_query_tampers_by_checksum(spark, table):
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    for r in queries.op13_merkle(spark, SMALL).collect():
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified != tampered and (r.folded_root == r.root) == r.verified


def test_odd_rows(odd, none):
    rows = [{**{f: None for f in merkle.FIELDS}, "doc_id": r.doc_id, "text": r.text} for r in odd.collect()]
    got = proofs(merkle.manifest(odd))
    assert len(got) == len(rows) and got == by_force(rows)
    assert merkle.verified(merkle.manifest(odd)).where("not verified").count() == 0
    assert merkle.manifest(none).count() == 0
