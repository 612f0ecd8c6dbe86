"""A followed folder: new files and new versions of files reach the index once."""

from sylvan.streaming.follow import follow, latest


def test_follow(spark, tmp_path):
    folder, index, checkpoint = (str(tmp_path / x) for x in ("src", "index", "checkpoint"))
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("a = 1\n")
    (tmp_path / "src" / "no.txt").write_text("text")
    names = lambda: sorted((r.file_path.rsplit("/", 1)[1], r.name) for r in latest(spark, index).filter("type = 'assignment'").collect())

    def run():
        follow(spark, folder, index, checkpoint, once=True).awaitTermination(120)

    run()
    assert names() == [("a.py", "a")]
    (tmp_path / "src" / "sub" / "b.py").write_text("b = 2\n")
    run()
    assert names() == [("a.py", "a"), ("b.py", "b")]
    run()
    assert names() == [("a.py", "a"), ("b.py", "b")]
