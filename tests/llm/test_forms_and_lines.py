"""Problems 6 and 3: cases by hand, brute force, empty and odd input."""

import collections
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.llm import forms, sitelines


@pytest.mark.parametrize(
    "text,expected",
    [
        ("", ""),
        ("Ｓứｃ khỏe", "Sức khỏe"),
        (unicodedata.normalize("NFD", "Điều trị"), "Điều trị"),
        ("kế\u200bt q\u00aduả\ufeff", "kết quả"),
        ("a\u00a0b\u3000c\u2009d", "a b c d"),
        ("Вạn khám", "Bạn khám"),
        ("ðã Ɖiều", "đã Điều"),
        ("chỉ số γ, β và α", "chỉ số γ, β và α"),
        ("µg cm² 37°C “x” – … 👍🏽 👩‍⚕️", "µg cm² 37°C “x” – … 👍🏽 👩‍⚕️"),
        ("a\tb\nc\r\n", "a\tb\nc\r\n"),
        ("Москва", "Москва"),
        ("там, вот и кот", "там, вот и кот"),
        ("кhám тốt", "khám tốt"),
        ("𝐛ệnh 𝑣à ⅻ ℍà ⓐn", "bệnh và xii Hà an"),
        ("bệոh Ꭺn ᴛim", "bệnh An tim"),
        ("x ∈ ℕ, № 5, ℃, ™, ℹ", "x ∈ N, № 5, ℃, ™, ℹ"),
    ],
)
def test_form(text, expected):
    assert forms.form(text) == expected
    assert forms.form(expected) == expected  # a form is its own form


def test_skeletons_meet():
    assert forms.skeleton("Вạn") == forms.skeleton("Bạn") == forms.skeleton(unicodedata.normalize("NFD", "Bạn"))
    assert forms.skeleton("bạn") != forms.skeleton("bán")


def test_the_skeleton_decides(spark, monkeypatch):
    """Without prototypes no look-alike is proposed."""
    df = spark.createDataFrame([("a", "Вạn"), ("b", "Bạn")], "k string, t string")
    assert [r.key for r in forms.differing(df, "k", "t").collect()] == ["a"]
    assert forms.skeleton("𝐁ạn") == forms.skeleton("Вạn") == forms.skeleton("Ᏼạn")
    for text in ("Bạn khám, µg cm² “x” 5 ℃ №", "", "Вạn", "e\u0301", "ﬁ ½ ͅ"):
        assert forms.representative(text) == forms.unicodedata.normalize("NFC", forms.skeleton(text))
    step = forms.skeleton
    monkeypatch.setattr(forms, "skeleton", lambda t: forms.unicodedata.normalize("NFD", t))
    assert forms.form("Вạn") == "Вạn" and step("Вạn") != forms.skeleton("Вạn")


def test_differing_nulls_copies_and_other_columns(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", "x\u00a0y", 1), ("c", "x\u00a0y", 1), ("d", "xy", 1), (None, "x\u00a0y", 1), ("e", "x" * 50_000 + "\u2003", 1)]
    df = spark.createDataFrame(rows, "key string, text string, form int")
    assert sorted((r.key or "-") for r in forms.differing(df, "key", "text").collect()) == ["-", "c", "e"]
    assert forms.differing(df.limit(0), "key", "text").count() == 0
    got = {r.key: r.form for r in forms.one_form(df.filter("key in ('a', 'b', 'd')"), "key", "text").collect()}
    assert got == {"a": None, "b": "", "d": "xy"}
    groups = forms.look_alikes(spark.createDataFrame([("1", "Вạn"), ("2", "Bạn"), ("3", None)], "k string, t string"), "k", "t").collect()
    assert sorted((r.key, r.members) for r in groups) == [("1", 2), ("2", 2)]


def test_site_names(spark):
    rows = [(1, " WWW.A.vn ", None), (2, "", "https://www.b.vn/x"), (3, None, "http://C.vn:80/y"), (4, None, None), (None, "d.vn", None), (1, " WWW.A.vn ", None)]
    df = spark.createDataFrame(rows, "article_id long, source_domain string, source_url string")
    assert sorted(tuple(r) for r in sitelines.site_of(df).collect()) == [(1, "a.vn"), (2, "b.vn"), (3, "c.vn")]


def test_repeated_lines_by_brute_force(spark):
    import random

    rng = random.Random(1)
    sections, audit = [], []
    for d in range(400):
        site = "hot.vn" if d % 3 == 0 else f"s{d % 11}.vn"
        audit.append((d, site if d % 17 else None, None))
        lines = [f"câu {rng.randint(1, 60)} riêng {rng.choice('abcdefgh')}" for _ in range(4)]
        if rng.random() < 0.5:
            lines.insert(1, f"Bản quyền {site} số {rng.randint(1, 99)}")
        if rng.random() < 0.3:
            lines.append(rng.choice(["Chia sẻ bài này", "CHIA  SẺ bài này", "Ｃhia sẻ bài này"]))
        sections.append((d, f"k{d}", "\n".join(lines)))
    sections += [sections[0], (400, "k400", None), (401, "k401", ""), (None, "k402", "x")]
    s = spark.createDataFrame(sections, "doc_id long, section_id string, content string")
    a = spark.createDataFrame(audit, "article_id long, source_domain string, source_url string")
    lines = sitelines.line_rows(s).cache()
    got = {tuple(r) for r in sitelines.found_lines(lines, sitelines.site_documents(s, a)).collect()}
    site = {d: x for d, x, _ in audit if x}
    docs, seen, where = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for d, k, t in sections:
        if d in site:
            docs[site[d]].add(d)
            for n, line in enumerate((t or "").split("\n"), 1):
                if key := forms.line_key_form(line):
                    seen[site[d], key].add(d)
                    where[site[d], key].add((k, n))
    often = {k for k, v in seen.items() if len(v) >= 3 and len(v) >= 0.2 * len(docs[k[0]])}
    boiler = {p for k in often if k[1].startswith(("bản quyền", "chia sẻ")) for p in where[k]}
    assert boiler <= got <= {p for k in often for p in where[k]}
    clean = {r.section_id: r.content for r in sitelines.without_lines(s, spark.createDataFrame(list(got), "key string, line_no int")).collect()}
    for d, k, t in sections:
        if t is not None:
            assert clean[k] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (k, n) not in got)
    assert clean["k400"] is None


def line_table(spark, has):
    """has: {site: (documents, {line: documents with it})}"""
    docs, lines, d = [], [], 0
    for site, (n, own) in has.items():
        for i in range(n):
            d += 1
            docs.append((d, site))
            lines += [(d, int(line)) for line, k in own.items() if i < k] + [(d, 10_000 + d)]
    return spark.createDataFrame(lines, "doc_id long, line long"), spark.createDataFrame(docs, "doc_id long, site string")


def test_the_test_decides(spark):
    """A line that passes the shares on one small site, while all others have it nearly as often, fails the test; those that several or all
    sites repeat are found on each."""
    has = {f"s{i}": (100, {1: 19, 2: 60 if i < 6 else 1, 4: 50}) for i in range(9)}
    has["few"] = (40, {1: 9, 2: 12, 3: 12, 4: 20})
    lines, docs = line_table(spark, has)
    often = {(r.site, r.line) for r in sitelines.line_counts(lines, docs).filter("often").collect()}
    got = {(r.site, r.line) for r in sitelines.repeated_lines(lines, docs).collect()}
    assert ("few", 1) in often
    assert got == often - {("few", 1)} == {("few", 2), ("few", 3), ("few", 4), *((f"s{i}", 2) for i in range(6)), *((f"s{i}", 4) for i in range(9))}


def test_no_sites_and_one_site(spark):
    s = spark.createDataFrame([(d, f"k{d}", f"chung\nriêng {'abcde'[d]}") for d in range(5)], "doc_id long, section_id string, content string")
    none = spark.createDataFrame([], "article_id long, source_domain string, source_url string")
    lines = sitelines.line_rows(s)
    assert sitelines.found_lines(lines, sitelines.site_documents(s, none)).count() == 0
    only = spark.createDataFrame([(d, "a.vn", None) for d in range(5)], "article_id long, source_domain string, source_url string")
    found = sitelines.found_lines(lines, sitelines.site_documents(s, only), min_docs=3)
    assert {r.line_no for r in found.collect()} <= {1}
    assert sitelines.found_lines(sitelines.line_rows(s.limit(0)), sitelines.site_documents(s.limit(0), only)).count() == 0
    assert s.select(F.count("*")).first()[0] == 5
