import os
import stat

import pytest

from linkloom.sources import inputs as I


@pytest.fixture
def site(tmp_path):
    files = {"a.md": "[x](y)", "b.HTML": "<a href=z>", "c.bin": "no", ".hidden.md": "h", "skip/d.md": "d", "sub/e.txt": "e", "sub/.git/f.md": "f", ".gitignore": "skip/\n*.html\n!b.HTML\n", "bad.txt": None}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(b"\xff\xfe\xfa" if text is None else text.encode())
    return tmp_path


def names(df):
    return sorted(os.path.basename(r["source"]) for r in df.collect())


def test_folders_follow_ignore_files(spark, site):
    assert names(I.read_folder(spark, str(site))) == ["a.md", "b.HTML", "e.txt"]
    assert names(I.read_folder(spark, str(site), hidden=True, no_ignore=True)) == [".hidden.md", "a.md", "b.HTML", "d.md", "e.txt", "f.md"]
    assert names(I.read_folder(spark, str(site), extensions=("txt",), exclude_path=("sub",))) == []


def test_globs_and_files_ignore_extensions(spark, site):
    assert names(I.read_glob(spark, f"{site}/*.b*")) == ["c.bin"]
    assert names(I.read_glob(spark, f"{site}/*.html", ignore_case=True)) == ["b.HTML"]
    assert names(I.read_files(spark, [f"{site}/c.bin", f"{site}/bad.txt"])) == ["c.bin"]  # the other is no UTF-8
    row = I.read_files(spark, [f"{site}/b.HTML"]).first()
    assert (row["file_type"], row["content"], row["source_kind"]) == ("html", "<a href=z>", "file")


def test_kinds(site):
    assert [I.classify(x) for x in ("-", "https://h.org", f"{site}/a.md", f"{site}/*.md")] == ["stdin", "url", "file", "glob"]
    assert I.classify("c:/x", exists=lambda p: True) == "file"
    with pytest.raises(ValueError):
        I.classify("nothing/here")
    assert I.distinct_inputs(["a", "b", "a"]) == ["a", "b"]


def test_lists(spark, tmp_path):
    p = tmp_path / "list"
    p.write_text("a.md\n\n # no\n#no\n b.md \n")
    assert [r[0] for r in I.lines_of(spark, str(p)).collect()] == ["a.md", "b.md"]
    assert I.ignore_patterns(spark, str(p)) == ["a.md", " b.md "]


def test_remote_documents(spark):
    http = spark.createDataFrame([("GET", "https://h.org/a.md", 200, "x"), ("GET", "https://h.org/e", 500, "y")], "method string, url_nofrag string, status int, body string")
    urls = spark.createDataFrame([("https://h.org/a.md#f",), ("https://h.org/e",), ("https://h.org/m",)], "url string")
    got = {r["source"]: (r["file_type"], r["content"], r["error_kind"]) for r in I.from_urls(urls, http).collect()}
    assert got == {"https://h.org/a.md#f": ("markdown", "x", None), "https://h.org/e": ("html", None, "ReadInputUrlStatusCode"), "https://h.org/m": ("html", None, "NetworkRequest")}


def test_preprocessor(spark, tmp_path):
    script = tmp_path / "up.sh"
    script.write_text('#!/bin/sh\n[ "$1" = bad ] && { echo oops >&2; exit 3; }\necho "got $1"\n')
    script.chmod(script.stat().st_mode | stat.S_IEXEC)
    rows = I.from_texts(spark, ["good", "bad"])
    got = {r["source"]: (r["content"], r["error_text"]) for r in I.preprocessed(rows, str(script)).collect()}
    assert got["good"] == ("got good\n", None)
    assert got["bad"] == (None, f"Preprocessor command '{script}' failed with 'oops'")


def test_index_of_files(spark, site):
    rows = {r["path"]: r for r in I.fs_index(spark, str(site)).collect()}
    assert rows[str(site)]["is_dir"] and rows[f"{site}/sub/e.txt"]["ext"] == "txt"


def test_missing_files_are_error_rows(spark, site):
    from linkloom.config import LinkCheckConfig
    from linkloom.operators.check import Snapshots
    from linkloom.plans import pipeline

    paths = [f"{site}/a.md", f"{site}/gone.md", f"{site}/.hidden.md", f"{site}/.gone.md", f"{site}/a.md"]
    got = {os.path.basename(r["source"]): (r["content"], r["error_kind"], r["file_type"]) for r in I.read_files(spark, paths).collect()}
    assert got == {"a.md": ("[x](y)", None, "markdown"), ".hidden.md": ("h", None, "markdown"), "gone.md": (None, "ReadFileInput", "markdown"), ".gone.md": (None, "ReadFileInput", "markdown")}
    assert names(I.read_files(spark, paths, skip_missing=True)) == [".hidden.md", "a.md"]
    assert I.read_files(spark, [f"{site}/gone.md"], skip_missing=True).count() == 0
    assert names(I.read_files(spark, paths, exclude_path=("gone",))) == [".hidden.md", "a.md"]
    http = spark.createDataFrame([], "method string, url_nofrag string, status int, error_class string, error_message string, headers map<string,string>, body string, final_url string, redirects array<struct<url:string,code:int>>, duration_ms double")
    run = pipeline.check_links(I.read_files(spark, paths), Snapshots(http=http), LinkCheckConfig()).collect()
    failed = [r for r in run if r["status"]["error_kind"] == "ReadFileInput"]
    assert sorted(os.path.basename(r["source"]) for r in failed) == [".gone.md", "gone.md"] and all(r["uri"] == "error:" and "gone.md" in r["status"]["text"] for r in failed)


def test_inputs_under_the_options(spark, site):
    from linkloom.config import LinkCheckConfig

    (site / "list").write_text(f"{site}/sub\n# no\n{site}/gone.md\n")
    config = LinkCheckConfig(files_from=f"{site}/list", default_extension="html", exclude_path=("bad",))
    got = {os.path.basename(r["source"]): (r["file_type"], r["error_kind"]) for r in I.read_inputs(spark, ["-", f"{site}/c.bin", f"{site}/*.MD", f"{site}/c.bin"], config, stdin="x").collect()}
    assert got == {"<stdin>": ("html", None), "c.bin": ("html", None), "e.txt": ("plaintext", None), "gone.md": ("markdown", "ReadFileInput")}
    assert names(I.read_inputs(spark, [f"{site}/gone.md", "nowhere"], LinkCheckConfig(skip_missing=True))) == []
    with pytest.raises(ValueError, match="not found"):
        I.read_inputs(spark, ["nowhere"], LinkCheckConfig())
    assert names(I.read_inputs(spark, [f"{site}/*.MD"], LinkCheckConfig(glob_ignore_case=True))) == ["a.md"]
