import glob

from triadic.operators.detect import detect_communities
from triadic.operators.graph import symmetrize
from triadic.scratch import Scratch
from triadic.sources.edge_list import load_graph, read_edge_list
from triadic.sources.sinks import write_detection, write_state
from triadic.streaming import replay as S


def test_read_detect_write(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n2 3\n1 3\n3 4\n4 4\n2 1\n")
    g = load_graph(spark, str(tmp_path / "g.txt"))
    assert g.undirected_count() == 4 and g.vertices.count() == 4
    where = write_detection(detect_communities(g.edges), str(tmp_path / "out"))
    rows = sorted(line for f in glob.glob(where["final_partition"] + "/part-*") for line in open(f).read().split())
    assert rows == ["1,3", "2,3", "3,3"]
    assert len([x for f in glob.glob(where["triangle_counts"] + "/part-*") for x in open(f).read().split()]) == 4


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("3 4\n4 5\n")
    (src / "b.txt").write_text("3 5\n")
    bulk = symmetrize(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long"))
    for _ in range(2):  # a second run finds nothing new
        q = S.start(S.edge_stream(spark, str(src), files_per_batch=1), bulk, str(tmp_path / "state"), str(tmp_path / "cp"), n_rounds=1)
        q.awaitTermination()
    assert sorted(x.name for x in (tmp_path / "state").iterdir()) == ["v1", "v2"]
    s = S.load(spark, str(tmp_path / "state"), 2)
    assert {r["id"]: r["t"] for r in s.vertices.collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    out = write_state(s, str(tmp_path / "out"))
    assert sorted(line for f in glob.glob(out + "/part-*") for line in open(f).read().split()) == sorted(f"{r['id']},{r['cid']}" for r in s.vertices.collect())
    assert read_edge_list(spark, str(src)).count() == 3


def test_few_rows_make_few_files(spark):
    scratch = Scratch(spark, "files")
    for rows, n in ((100, 1), (10**9, 8), (None, 8)):
        t = scratch.table(spark.range(100).repartition(8), rows=rows)
        assert len(t.inputFiles()) == n and sorted(r["id"] for r in t.collect()) == list(range(100))
    scratch.close()
