import hashlib
import hmac
import posixpath
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.functions import checks, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_canonical_paths(spark):
    paths = ["/projects/p/a.jsonl", "a/./b/../b/c d.png", "projects/-Users-robin-x/s.jsonl", "robin/y/robins.txt", "100%25.txt", "été.md", "", "a//b/"]
    want = ["projects/p/a.jsonl", "a/b/c%20d.png", "projects/-Users-__USER__-x/s.jsonl", "__USER__/y/robins.txt", "100%2525.txt", "%C3%A9t%C3%A9.md", "", "a/b"]
    assert column(spark, paths, lambda c: text.canonical_path(c, "robin")) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12, alphabet=st.characters(exclude_characters="\0", exclude_categories=["Cs"])), min_size=5, max_size=20))
def test_percent_encoding(spark, values):
    assert column(spark, values, text.percent_encode) == [quote(v, safe="~") for v in values]


def test_clean_path_agrees_with_posix(spark):
    paths = ["a/b/../c", "a/../../b", "./x", "x/./y//z", "a/b/.."]
    assert column(spark, paths, lambda c: F.array_join(text.clean_path(c), "/")) == [posixpath.normpath(p) for p in paths]


def test_hmac(spark):
    key = bytes(range(1, 33))
    messages = ["", "a/b", "é" * 100]
    assert column(spark, messages, lambda c: checks.hmac_sha256(key, c)) == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in messages]


def test_key_names(spark):
    keys = ["api_key", "apiKey", "x-api-key", "Authorization", "input_tokens", "max_tokens", "secret_scanning_enabled", "object_key", "MY_TOKEN", "id_key", ""]
    assert column(spark, keys, text.is_secret_key) == [True, True, True, True, False, False, False, False, True, False, False]
    assert column(spark, ["AWSSecretKey", "tokenCount"], text.key_words) == [["aws", "secret", "key"], ["token", "count"]]


def test_remotes(spark):
    urls = ["git@Host.org:team/repo.git", "https://u:p@host.org/team/repo.git/", "ssh://git@host.org:22/team/repo"]
    got = column(spark, urls, text.remote_host_path)
    assert [(r["host"], r["path"]) for r in got][0] == ("host.org", "team/repo")
    assert got[2]["host"] == "host.org" and got[2]["path"] == "team/repo"


def test_globs():
    import re

    match = lambda g, p: bool(re.match(text.glob_regex(g), p))
    assert match("projects/**/*.jsonl", "projects/a/b/c.jsonl") and match("projects/**/*.jsonl", "projects/c.jsonl")
    assert not match("projects/*.jsonl", "projects/a/c.jsonl") and match("/a/{b,c}.tx?", "a/c.txt")


def test_small_text(spark):
    assert column(spark, ["a\tb\x01 \n c"], text.one_line) == ["a b c"]
    assert column(spark, ["<t>1</t> hi <t>open"], lambda c: text.strip_tag(c, "t")) == [" hi "]
    assert column(spark, ["/a/b/c"], text.ancestors) == [["/a/b/c", "/a/b", "/a"]]
    assert column(spark, ["x-store"], lambda c: text.part_name(c, F.lit("x"))) == ["store"]
    assert checks.sample_indexes(9, 5) == [0, 2, 4, 6, 8] and checks.sample_indexes(3, 5) == [0, 1, 2]
