import json

import pytest

from linkloom import config as C
from linkloom.functions import rewrite as R
from linkloom.functions import status as S


def test_ranges():
    assert S.parse_ranges("200") == ((200, 200),)
    assert S.parse_ranges("200..204,..=150,500..") == ((200, 203), (100, 150), (500, 999))
    assert S.parse_ranges("100..=200,150..=300,400") == ((100, 300), (400, 400))
    for bad in ("99", "1000", "300..200", "200..200", "a", "..=", "200..1001", "2-3"):
        with pytest.raises(ValueError):
            S.parse_ranges(bad)


def test_parsers():
    assert R.parse_header(" X-A : b:c ") == ("x-a", "b:c")
    assert R.parse_basic_auth("^https u:p:w") == ("^https", "u", "p:w")
    assert R.parse_remap("^a$  b") == ("^a$", "b")
    assert C.parse_methods("head, get") == ("HEAD", "GET")
    assert C.parse_duration("1m 30s") == 90 and C.parse_duration("50ms") == 0.05 and C.parse_duration("7") == 7
    assert C.shown_duration(3661) == "1h 1m 1s" and C.shown_duration(0.155, True) == "155ms" and C.shown_duration(0) == "0s"
    for call, text in ((R.parse_header, "no colon"), (R.parse_basic_auth, "a b c"), (R.parse_basic_auth, "a b"), (R.parse_remap, "one"), (C.parse_methods, "get,,head"), (C.parse_duration, "1x")):
        with pytest.raises(ValueError):
            call(text)


def test_replacements_are_translated():
    assert R.java_replacement("$1-${name_a}-$b$$\\") == "$1-${namea}-${b}\\$\\\\"
    assert R.java_pattern("(?P<a_b>x)") == "(?<ab>x)"


def test_merge_and_files(tmp_path):
    (tmp_path / "a.toml").write_text('max-retries = 1\nexclude = ["x"]\ntimeout = "5s"\n[hosts."h.org"]\nconcurrency = 3\nheaders = { A = "1" }\n')
    (tmp_path / "package.json").write_text(json.dumps({"tool": {"exclude": "y", "max_retries": 2, "user-agent": "z", "hosts": {"h.org": {"concurrency": 9, "request_interval": "1s"}}}}))
    one, two = C.load(str(tmp_path / "a.toml")), C.load(str(tmp_path / "package.json"), ("tool",))
    both = C.merge(one, two)
    assert both.get("max_retries") == 1 and both.exclude == ("x", "y") and both.get("user_agent") == "z" and both.get("timeout_s") == 5
    h = both.hosts["h.org"]
    assert (h.concurrency, h.request_interval_ms, h.headers) == (3, 1000, {"a": "1"})
    with pytest.raises(ValueError):
        C.from_mapping({"unknown": 1})
    with pytest.raises(ValueError):
        C.from_mapping({"include_fragments": "some"})


def test_derived_options():
    c = C.LinkCheckConfig(accept="404", offline=True, method="head,get", verbose=1, header=("A: b",))
    assert c.accepted == ((404, 404),) and c.filter().schemes == ("file",) and c.methods == ("HEAD", "GET") and c.detailed and c.headers == {"a": "b"}
    assert C.LinkCheckConfig().accepted == ((100, 103), (200, 299)) and not C.LinkCheckConfig().detailed
