from __future__ import annotations

import pytest

from termforge.__main__ import main


def lines(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


@pytest.fixture
def texts(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i, t in ((1, "apples banana bananas"), (2, "banana cherry"), (3, "apple cherries cherry cherry"), (4, "durian")):
        (docs / str(i)).write_text(t)
    (tmp_path / "q.txt").write_text("Apples AND cherry\n\nNOT banana\n")
    (tmp_path / "free.txt").write_text("apple cherry\nnothing\n")
    (tmp_path / "cases.csv").write_text(
        "document_id,content,title,date_posted,court\n" + "".join(f'{i},"{t}",{t.split()[0]},2001,High\n' for i, t in ((1, "apples banana"), (2, "banana cherry"), (3, "apple cherry cherry")))
    )
    return tmp_path


def test_boolean(spark, texts):
    at = ["-d", f"{texts}/d", "-p", f"{texts}/p"]
    main(["index", "-i", f"{texts}/docs", *at], spark)
    main(["search", *at, "-q", f"{texts}/q.txt", "-o", f"{texts}/out"], spark)
    assert lines(texts / "out") == ["3", "", "3 4"]


def test_cosine(spark, texts):
    at = ["-m", "cosine", "-d", f"{texts}/d", "-p", f"{texts}/p"]
    main(["index", "-i", f"{texts}/docs", *at], spark)
    main(["search", *at, "-q", f"{texts}/free.txt", "-o", f"{texts}/out"], spark)
    assert lines(texts / "out") == ["3 2 1", ""]


def test_boolean_in_parts(spark, texts):
    at = ["-d", f"{texts}/d", "-p", f"{texts}/p"]
    main(["index", "-i", f"{texts}/docs", *at], spark)
    main(["search", "--parts", *at, "-q", f"{texts}/q.txt", "-o", f"{texts}/out"], spark)
    assert [x.strip() for x in lines(texts / "out")] == ["3", "", "3 4"]


@pytest.mark.parametrize("model", ["zoned", "feedback"])
def test_zoned(spark, texts, model):
    at = ["-m", model, "-d", f"{texts}/d", "-p", f"{texts}/p"]
    main(["index", "-i", f"{texts}/cases.csv", *at], spark)
    main(["search", *at, "-q", f"{texts}/free.txt", "-o", f"{texts}/out"], spark)
    found = lines(texts / "out")
    assert sorted(found[0].split()) == ["1", "2", "3"] and found[1:] == [""]


def test_label(spark, texts):
    (texts / "train").write_text("x abcd\nx abcde\ny bcdef\n")
    (texts / "test").write_text("abcde\nbcdef\nzzzz\n")
    main(["label", "-b", f"{texts}/train", "-t", f"{texts}/test", "-o", f"{texts}/out"], spark)
    assert lines(texts / "out") == ["x abcde", "y bcdef", "other zzzz"]
