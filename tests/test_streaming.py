from pdf_files import bloated, build, simple
from paperloom.plans import inspect, passes
from paperloom.session import shared_dir
from paperloom.sinks import report
from paperloom.sources.pdf import parse_file, read_files, read_pdf
from paperloom.streaming.watch import watch


def test_each_file_once(spark, tmp_path):
    shared_dir(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(build(bloated()))
    for _ in range(2):
        watch(spark, str(folder), str(out), str(tmp_path / "seen")).awaitTermination()
        (folder / "b.PDF").write_bytes(build(simple()))
    found = {r.path.rsplit("/", 1)[1]: bytes(r.bytes) for r in spark.read.parquet(f"{out}/files").collect()}
    assert set(found) == {"a.pdf", "b.PDF"} and spark.read.parquet(f"{out}/files").count() == 2
    assert len(found["a.pdf"]) < len(build(bloated())) and parse_file(found["b.PDF"])


def test_report(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(bloated()))
    files = read_files(spark, str(tmp_path))
    data, stats = passes.run(files)
    before, after = (inspect.category_totals(inspect.inspect_items(read_pdf(f))) for f in (files, data))
    changes, key = report.file_changes(before, after), files.first().file_id
    text = report.markdown(changes, stats, key)
    assert "| Metadata |" in text and "| Fonts |" not in text and "recompressed" in text
    assert report.html(changes, stats, key, "a & b").startswith("<!DOCTYPE html>")
