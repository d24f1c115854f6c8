import zipfile
from dataclasses import replace

import pytest

from lodestone.cli import main
from lodestone.config import Settings, load_config, validate_config
from lodestone.engine import Engine
from lodestone.operators import catalog, ranking
from lodestone.sources.files import EXTRACTORS, extract, html_text


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub/.git").mkdir(parents=True)
    (root / "a.md").write_text("Machine learning and artificial intelligence.\nNeural networks learn.")
    (root / "b.txt").write_bytes(b"Database systems use query optimization \xff and indexes.\r\nLearning too.")
    (root / "sub/c.html").write_text("<html><script>no</script><body><p>Python  programming</p><nav>menu</nav> guide</body></html>")
    (root / "sub/empty.txt").write_bytes(b"\xff")  # no valid character
    (root / "sub/skip.log").write_text("machine learning")
    (root / "sub/.git/x.txt").write_text("machine learning")
    return root


def test_index_and_search(spark, tmp_path, folder):
    settings = Settings(store=str(tmp_path / "store"))
    settings = replace(settings, index=replace(settings.index, exclude_patterns=("**/.git/**",)))
    engine = Engine(spark, settings)
    counts = engine.index([str(folder)])
    assert counts["indexed"] == 3 and counts["empty"] == 1
    out = engine.search("machine learning")
    assert out["items"][0]["path"].endswith("a.md") and "**Machine** **learning**" in out["items"][0]["snippet"] and not out["cache_hit"]
    assert engine.search("machine learning")["cache_hit"] and engine.get_cache_stats()["size"] == 1
    assert {i["path"].rsplit("/", 1)[1] for i in engine.search("learning", exact=True)["items"]} == {"a.md", "b.txt"}
    one = [engine.search("learning", page=p, per_page=1) for p in (1, 2, 3)]
    assert [x["has_next"] for x in one] == [True, True, False] and len({x["items"][0]["chunk_id"] for x in one}) == 3
    (folder / "b.txt").write_text("Nothing about that subject")
    (folder / "sub/c.html").unlink()
    counts = engine.index([str(folder)])
    assert (counts["changed"], counts["deleted"], counts["unchanged"]) == (1, 1, 1)
    assert engine.status()["total_files"] == 2 and engine.store.read("vectors").count() == 2
    assert [i["path"].rsplit("/", 1)[1] for i in engine.search("learning", exact=True)["items"]] == ["a.md"]
    engine.reset()
    assert engine.store.versions() == []


def test_slices_and_cli(spark, tmp_path, folder, monkeypatch, capsys):
    monkeypatch.setenv("LA_STORE_PATH", str(tmp_path / "store2"))
    monkeypatch.setattr("lodestone.cli.load_config", lambda _: replace(s := load_config(), index=replace(s.index, exclude_patterns=())))
    asked = ["index", str(folder / "sub"), "--max-items", "1", "--allow", ".html,.md"]
    assert main(asked, spark)["slices"] >= 1 and main(asked, spark) == {"slices": 0}
    assert main(["index", str(tmp_path / "nowhere"), "--max-items", "1"], spark) == {"slices": 0}
    found = main(["find", "python", "--show-context"], spark)
    assert [i["path"].rsplit("/", 1)[1] for i in found["items"]] == ["c.html"] and "1. " in capsys.readouterr().out
    # a reset store forgets what has been seen
    assert main(["reset"], spark) == {"reset": True} and main(asked, spark)["slices"] >= 1
    assert "reset" in capsys.readouterr().out


def test_faults(spark, tmp_path, folder):
    """Missing roots, unreadable files, a failing embedder, a search that fails."""

    class Failing:
        dim = 4

        def embed(self, texts):
            raise RuntimeError("no model")

    (folder / "bad.docx").write_bytes(b"junk")
    (folder / "own.md").write_text("x")
    settings = Settings(store=str(tmp_path / "store"))
    settings = replace(settings, index=replace(settings.index, exclude_patterns=("**/.git/**",), max_pdf_pages=3))
    engine = Engine(spark, settings, Failing(), {".md": lambda raw: "text of an own extractor about learning"})
    failed = engine.search("learning")
    assert failed["items"] == [] and "no index" in failed["error"]
    assert engine.index([str(tmp_path / "nowhere")]) == {}
    counts = engine.index([str(folder), str(tmp_path / "nowhere")])
    assert counts["unreadable"] == 1 and counts["indexed"] == 4
    status = engine.status()
    assert (status["total_files"], status["total_fts_entries"], status["total_vectors"], status["total_errors"]) == (4, 4, 0, 1)
    assert {i["path"].rsplit("/", 1)[1] for i in engine.search("learning")["items"]} == {"a.md", "b.txt", "own.md"}
    got = engine.batch([(1, "learning"), (2, "python"), (3, "")]).collect()
    assert {r.query_id for r in got} == {1, 2} and sum(r.query_id == 1 for r in got) == 3
    # only what is below the roots of a pass can be gone
    assert engine.index([str(folder / "sub")]) == {"empty": 1, "indexed": 1, "unchanged": 1} and engine.status()["total_files"] == 4
    assert engine.extractors[".pdf"].keywords == {"pages": 3}


def test_pdf_parsers_in_turn(monkeypatch):
    from lodestone.sources import files

    def broken(raw, pages):
        raise ValueError(raw)

    monkeypatch.setattr(files, "PDF_PARSERS", (broken, lambda raw, pages: ["one", " ", "two", "three"][:pages]))
    assert files.pdf_text(b"", 3) == "one\n\ntwo" and extract("/x.pdf", b"", files.extractors_of(Settings().index)) == "one\n\ntwo\n\nthree"
    monkeypatch.setattr(files, "PDF_PARSERS", (broken,))
    assert files.pdf_text(b"") is None


def test_nearest(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import vector

    rng = np.random.default_rng(1)
    held = [(f"v{i:03}", v.tolist()) for i, v in enumerate(rng.normal(size=(150, 8)))] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0]), ("twin", None)]
    held[-1] = ("twin", held[0][1])
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 8)))] + [(9, held[0][1])]
    monkeypatch.setattr(vector, "BLOCK", 4)
    df = spark.createDataFrame(held, "chunk_id string, embedding array<double>").repartition(3)
    got = {}
    for r in vector.nearest(df, asked, 10).collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))

    def cosine(a, b):
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) if b is not None and len(a) == len(b) and any(b) else 0.0

    for i, v in asked:
        want = sorted(((c, cosine(v, w)) for c, w in held), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == want
    assert vector.nearest(df, [], 10).count() == 0 and vector.nearest(df.limit(0), asked, 10).count() == 0


def test_bench(spark, tmp_path, monkeypatch, capsys):
    from lodestone import bench

    monkeypatch.setenv("LA_STORE_PATH", str(tmp_path / "store"))
    runs = [bench.main(["--create-test-env", "--cleanup", "--queries", "river trade", "stone bridges"], spark) for _ in range(2)]
    assert runs[0]["files_indexed"] == 3 and runs[0]["compared"] == [] and runs[0]["search"]["total_results"] == [3, 3] and runs[0]["search"]["cache_hits"] == 2
    assert {r["measure"] for r in runs[1]["compared"]} == {"t_index", "t_search_hybrid"}
    for r in runs[1]["compared"]:
        assert abs(r["improvement"] - (r["previous"] - r["seconds"]) / r["previous"] * 100) < 1e-6
    assert bench.load(spark, str(tmp_path / "store-runs/search_bench")).count() == 2 and "t_index" in capsys.readouterr().out


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("search: {top_k: 7, unknown: 1}\nindex: {max_tokens: 100, overlap: 10}\npaths: {store: s}\n")
    pytest.importorskip("yaml")
    s = load_config(str(tmp_path / "c.yaml"), {"LA_SEARCH_BM25_WEIGHT": "0.5"})
    assert (s.search.top_k, s.search.bm25_weight, s.index.max_tokens, s.store) == (7, 0.5, 100, "s")
    assert validate_config({}) and not validate_config({"search": {"bm25_weight": 2.0}}) and not validate_config({"index": {"embed_batch": 0}}) and not validate_config({"index": {"overlap": 1200}})


def test_extractors(tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as box:
        box.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>')
    assert extract("/a/D.DOCX", (tmp_path / "d.docx").read_bytes()) == "One two\nThree"
    assert extract("/a/x.rtf", b"a\xffb\r\nc\rd") == "ab\nc\nd" and extract("/a/x.docx", b"junk") is None
    assert html_text(b"<title>T</title><style>s</style><p> a  b </p>\n<footer>f</footer>&eacute;") == "T a b é"
    assert extract("/a/x.md", b"z", EXTRACTORS | {".md": lambda raw: "own"}) == "own"


def test_ranking(spark):
    df = spark.createDataFrame([(0, "f", f"c{i}", 1.0 - i / 10) for i in range(5)] + [(1, "g", "x", 9.0)], "query_id long, file_id string, chunk_id string, score double")
    scaled = {(r.query_id, r.chunk_id): r.s for r in df.withColumn("s", ranking.minmax(ranking.F.col("score"))).collect()}
    assert scaled[0, "c0"] == 1.0 and scaled[0, "c4"] == 0.0 and scaled[1, "x"] == 9.0
    pages = [ranking.paged(df, p, 2).where("query_id = 0").collect() for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [2, 2, 1] and [r.chunk_id for p in pages for r in p] == [f"c{i}" for i in range(5)]
    assert [r.chunk_id for r in ranking.best_by_file(df, 2).where("query_id = 0").orderBy("chunk_id").collect()] == ["c0", "c1"]
    assert ranking.paged(df.limit(0), 1, 2).count() == 0


def test_catalog(spark):
    files = spark.createDataFrame([("f1", "/a", 3, 1, 10), ("f2", "/b", 4, 1, 11)], "file_id string, path string, size long, mtime long, indexed_at long")
    chunks = spark.createDataFrame([("c1", "f1"), ("c2", "f1")], "chunk_id string, file_id string")
    assert {(r.path, r.chunk_count) for r in catalog.file_chunk_counts(files, chunks).collect()} == {("/a", 2), ("/b", 0)}
    newer = spark.createDataFrame([("f3", "/a", 3, 2, 20)], files.schema)
    assert {r.file_id for r in catalog.upsert_files(files, newer).collect()} == {"f3", "f2"}
    left = catalog.delete_files(files.where("path = '/a'"), files=files, chunks=chunks)
    assert left["files"].count() == 1 and left["chunks"].count() == 0
    assert catalog.db_stats(files.limit(0), chunks, files.select("path")).first().total_files == 0
