"""The pipeline's stages, on the smallest tables: types, that decisions take effect, and that clean documents stay."""

import corpus_pipeline as P
from tests.llm.test_operators import every_shingle, jaccard_links, shingle_sets, union
from triadic.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.select(*P.COLUMNS).schema
    ids = {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "packing":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows) or name == "quality"
        left = {r["doc_id"] for r in rows}
        assert left <= ids
        if name == "quality":
            known = [d for d in labels if d in ids]
            assert sum((d in left) == bool(labels[d]) for d in known) >= 0.95 * len(known)
        if name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in __import__("triadic.llm.ngram_join", fromlist=["x"]).near_duplicates(docs).collect()}
            assert left == {d for d, c in groups.items() if d == c}
        if name == "secrets":
            from triadic.llm.secrets import report

            assert left == ids and report(out).where("n_access + n_hex > 0").isEmpty()
        before, ids, docs = left, left, out
    assert before == ids


def texts_of(spark, *stages):
    """(documents before the last of these stages, what it returns)"""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    for s in stages[:-1]:
        docs = dict(P.STAGES)[s](spark, docs, SF)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    return before, dict(P.STAGES)[stages[-1]](spark, docs, SF).collect()


def test_quality_stage(spark):
    before, after = texts_of(spark, "quality")
    scores = {r["doc_id"]: r["score"] for r in queries.op6_quality(spark, SF).collect()}
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in before.items() if scores[d] >= 0.3}


def test_lines_stage(spark):
    """No line goes without one before it that links reach by brute force, and nearly all that could go do."""
    before, after = texts_of(spark, "lines")
    white = " \t\r\x0b\x0c"
    clean = lambda x: x.strip(white).lower()
    first: dict[str, tuple] = {}
    for d in sorted(before):
        for n, x in enumerate((before[d] or "").split("\n")):
            if clean(x).strip():
                first.setdefault(clean(x), (d, n))
    known = sorted(first, key=len)
    sets = [every_shingle(x) for x in known]
    links = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if len(known[j]) - 9 > 1.25 * len(a) + 40 and len(b) > 1.25 * len(a):
                if len(known[j]) > 3 * len(known[i]) + 100:
                    break
                continue
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                links.append((i, j))
    roots = union(len(known), links)
    best: dict[int, tuple] = {}
    for i, x in enumerate(known):
        best[roots[i]] = min(best.get(roots[i], (10**9,)), first[x])
    root_of = {x: roots[i] for i, x in enumerate(known)}
    could = gone = 0
    left = {r["doc_id"]: r["text"] for r in after}
    for d, text in before.items():
        parts = (text or "").split("\n")
        must = [x for n, x in enumerate(parts) if not clean(x).strip() or best[root_of[clean(x)]] == (d, n)]
        could += len(parts) - len(must)
        kept = left.get(d, "" if text else text)
        now = (kept or "").split("\n") if kept != "" or text == "" else []
        gone += len(parts) - len(now) if text is not None else 0
        it = iter(parts)
        assert all(x in it for x in now)  # in order
        if d in left and text is not None:
            rest = iter(now)
            assert all(x in rest for x in must), d
    assert 0.97 * could <= gone <= could


def test_near_duplicates_stage(spark):
    before, after = texts_of(spark, "near_duplicates")
    ids = sorted(before)
    roots = union(len(ids), jaccard_links(shingle_sets([before[d] for d in ids])))
    assert {r["doc_id"]: r["text"] for r in after} == {d: before[d] for i, d in enumerate(ids) if roots[i] == i}


def test_packing_stage(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = texts_of(spark, "packing")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    size = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before.items()}
    got: dict[int, int] = {}
    at: dict[int, list] = {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == size
    for own in at.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(at) <= -(-sum(size.values()) // 1024) + 2


def test_odd_tables(spark):
    """Each stage takes nulls, empty and repeated rows, another type of n_chars, and no rows at all."""
    rows = [(i, t, None, "s", 0) for i, t in enumerate([None, "", " ", "one line\none line", "one line", "token=abcdefgh12", "a b c d e f g " * 30, "a b c d e f g " * 30])]
    rows += [rows[6], (None, "a text without an id", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.dtypes == docs.dtypes
        assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    import __spark_entry__ as E

    names = list(E.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(E.oracle_sql()) <= set(names)
