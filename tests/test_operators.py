"""Small cases of operators, by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T, web as W
from textloom.operators import bio, dictionary as D, evaluate, langgate, relational as R, spans as S, structure as P
from textloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_keys(spark):
    assert one(spark, T.heading_key(F.lit("II. Đối tượng và phương pháp"))) == "doi tuong va phuong phap"
    assert one(spark, T.slug(F.lit("Chấn thương chỉnh hình"))) == "chan_thuong_chinh_hinh"
    assert one(spark, T.slug(F.lit("  "))) == "uncategorised"
    assert one(spark, T.match_key(F.lit("  Viêm--GAN_b  "))) == "viêm gan b"
    assert one(spark, T.chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert one(spark, T.chunks(F.lit(""), 3)) == []
    assert one(spark, T.reflow(F.lit("một dòng\ngãy ra.\n- mục\n\nhai"))) == "một dòng gãy ra.\n- mục\nhai"
    assert one(spark, T.tone_placement(F.lit("hóa học, thúy"))) == "hoá học, thuý"
    assert one(spark, T.with_tones(F.lit("bi tang huyet ap nang"), {"tang huyet ap": "tăng huyết áp"})) == "bi tăng huyết áp nang"
    assert one(spark, T.person_score(F.lit("Nguyễn Văn An, Trần Thị Bình"))) > one(spark, T.person_score(F.lit("kết quả điều trị 2020.")))


def test_urls(spark):
    assert one(spark, W.canonical_url(F.lit("HTTPS://WWW.A.vn//b//c/?q=1#x"))) == "https://www.a.vn/b/c/"
    assert one(spark, W.canonical_url(F.lit("ftp://a.vn/b"))) is None
    assert one(spark, W.absolute_url(F.lit("/x"), F.lit("https://a.vn/b/c"))) == "https://a.vn/x"
    assert one(spark, W.absolute_url(F.lit("d.html"), F.lit("https://a.vn/b/c.html"))) == "https://a.vn/b/d.html"
    assert one(spark, W.journal_base(F.lit("https://a.vn/j/issue/view/3?x=1"))) == "https://a.vn/j"
    assert one(spark, W.allowed_by_robots(F.lit("https://a.vn/admin/x"), ["/admin"])) is False


def test_tokens_and_occurrences(spark):
    text = "chụp X-quang, rồi sốt. Sốt lại"
    got = one(spark, S.tokens(F.lit(text), "hyphen"))
    assert [t.word for t in got] == ["chụp", "X-quang", ",", "rồi", "sốt", ".", "Sốt", "lại"]
    assert all(text[t.start : t.end] == t.word for t in got)
    assert one(spark, S.occurrences(F.lit(text), F.lit("sốt"))) == [18, 23]
    assert one(spark, S.tokens(F.lit(""), "plain")) == []


def spans(spark, rows):
    return spark.createDataFrame([(list(r),) for r in [rows]], "s array<struct<start:int,end:int,label:string>>")


def test_policies(spark):
    df = spans(spark, [(0, 7, "a"), (0, 12, "b"), (20, 23, "c")])
    pick = lambda p: [(x.start, x.end) for x in df.select(S.resolved(F.col("s"), p, ["label"]).alias("r")).first().r]
    assert pick("gold") == [(0, 12), (20, 23)]
    assert pick("shortest") == [(0, 7), (20, 23)]
    assert pick("earliest") == [(0, 12), (20, 23)]


def test_overlap_join_and_matching_by_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [(d, s, s + rng.randint(1, 300), rng.choice("ab"), i) for i, (d, s) in enumerate((rng.randint(0, 2), rng.randint(0, 900)) for _ in range(n))]
    a, b = make(40), make(40)
    schema = "doc long, start int, end int, label string, id long"
    l, r = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((x.l_id, x.r_id) for x in S.overlap_join(l, r, ["doc"], width=64).collect())
    assert got == sorted((x[4], y[4]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    edges = spark.createDataFrame([("d", x, y) for x, y in [(1, 1), (1, 2), (2, 1), (3, 1), (3, 3)]], "g string, l long, r long")
    assert S.bipartite_size(edges, ["g"]).first().matched == 3


def test_relaxed_and_exact(spark):
    schema = "doc long, start int, end int, label string, id long"
    pred = spark.createDataFrame([(1, 10, 25, "D", 1), (1, 10, 25, "D", 2), (1, 40, 50, "S", 3)], schema)
    gold = spark.createDataFrame([(1, 10, 20, "D", 1), (1, 40, 50, "D", 2)], schema)
    exact = {r.label: (r.tp, r.fp, r.fn) for r in evaluate.exact_counts(pred, gold, ["doc"]).collect()}
    assert exact["D"] == (0, 2, 2)
    assert evaluate.relaxed_pairs(pred, gold, ["doc"]).count() == 1
    kinds = sorted(r.error_type for r in evaluate.errors(pred, gold, ["doc"]).collect())
    assert kinds == ["BOUNDARY", "FALSE_POSITIVE", "LABEL"]


def test_tags(spark):
    assert one(spark, bio.repaired(F.array(*(F.lit(x) for x in ("I-A", "I-A", "O", "I-B", "x"))))) == ["B-A", "I-A", "O", "B-B", "O"]
    d = one(spark, bio.detokenised(F.array(*(F.lit(x) for x in ("(", "sốt", ")", "nhẹ", ".")))))
    assert d.text == "(sốt) nhẹ." and [d.text[s.start : s.end] for s in d.spans] == ["(", "sốt", ")", "nhẹ", "."]
    sp = F.array(F.struct(F.lit("ho").alias("text"), F.lit("S").alias("label"), F.lit(3).alias("start"), F.lit(5).alias("end")))
    r = one(spark, bio.replaced_span(F.lit("bị ho khan"), sp, F.lit(1), F.lit("khó thở")))
    assert r.text == "bị khó thở khan" and r.text[r.spans[0].start : r.spans[0].end] == "khó thở"


def test_language_gate(spark):
    vi = "Nghiên cứu được thực hiện trên các bệnh nhân tại bệnh viện và kết quả là tốt. " * 20
    en = "The study was done in patients with the disease and the results are good. " * 20
    label = lambda t: one(spark, langgate.assessment(F.lit(t))).label
    assert (label(vi), label(en), label(""), label("*** 12 --- " * 30)) == ("vi", "en", "unknown", "unknown")
    assert one(spark, langgate.admission(langgate.assessment(F.lit("")))) == "REJECTED_NO_TEXT"
    assert one(spark, langgate.admission(langgate.assessment(F.lit(vi)))) == "ACCEPTED"


def test_structure(spark):
    kind = lambda h: one(spark, P.section_type(F.lit(h)))
    assert [kind(h).type for h in ("ĐẶT VẤN ĐỀ", "KẾT LUẬN", "Tài liệu tham khảo", "xyz", "")] == ["INTRODUCTION", "CONCLUSION", "REFERENCES", "OTHER", "UNKNOWN"]
    assert kind("ĐẶT VẤN ĐỀ").confidence >= 0.91
    blocks = spark.createDataFrame([(1, 50.0, 10.0, 550.0, 20.0), (1, 50.0, 30.0, 280.0, 40.0), (1, 50.0, 60.0, 280.0, 70.0), (1, 320.0, 30.0, 550.0, 40.0), (1, 320.0, 60.0, 550.0, 70.0)], "p int, x0 double, y0 double, x1 double, y1 double").withColumn("page_width", F.lit(600.0))
    order = [(r.x0, r.y0) for r in P.reading_order(blocks, ["p"]).orderBy("ord").collect()]
    assert order == [(50.0, 10.0), (50.0, 30.0), (50.0, 60.0), (320.0, 30.0), (320.0, 60.0)]
    assert one(spark, P.packed(F.array(F.lit("aaa"), F.lit("bb"), F.lit("cccccccc")), 6)) == ["aaa\nbb", "cccccccc"]


def test_upsert_and_sequences(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, w string")
    got = sorted(tuple(r) for r in R.upsert(old, new, ["k"], keep=("w",)).select("k", "v", "w").collect())
    assert got == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z")]
    df = spark.createDataFrame([("g" if i % 3 else "h", i) for i in range(1000)], "g string, i int")
    seq = R.sequence_ids(df, F.col("g"), [F.col("i")]).orderBy("g", "i").collect()
    assert [r.seq_id for r in seq if r.g == "h"] == [f"h_{n:06d}" for n in range(1, 335)]


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"id": "1", "n": 2}\n\nbroken\n{"id": "2", "n": 3}\n', encoding="utf-8")
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("id", ST.StringType()), ST.StructField("n", ST.IntegerType())])
    assert sorted(r.id for r in files.read_jsonl(spark, str(p), schema).collect()) == ["1", "2"]
    kept = files.read_jsonl(spark, str(p), schema, keep_broken=True).filter("_invalid is not null").collect()
    assert len(kept) == 1 and kept[0]._corrupt == "broken"
    c = tmp_path / "a.conll"
    c.write_text("chụp\tB-D\nphổi\tI-D\n\nho\tB-S\n.\tX\n", encoding="utf-8")
    rows = files.read_conll(spark, str(c), strict=["D", "S"]).collect()
    assert len(rows) == 4 and [r.issue for r in rows if r.issue] == ["BAD_TAG:X"]
    ann = spark.createDataFrame([(1, "T1\tD 0 3\tsốt\nT2\tD 5 6;8 9\tx y\nT3\tD 0 2\tho"), (2, "T1\tD 0 2\tho")], "doc_id int, ann string")
    texts = spark.createDataFrame([(1, "sốt rồi ho"), (2, "ho ho")], "doc_id int, text string")
    got = sorted((r.doc_id, r.text, r.start, r.issue) for r in files.read_standoff(ann, texts).collect() if r.start is not None)
    assert got == [(1, "ho", 8, "OFFSET_CORRECTED"), (1, "sốt", 0, None), (2, "ho", 0, None)]
    f = tmp_path / "d.txt"
    f.write_text("x")
    files.write_manifest(str(tmp_path / "m.json"), "1", {"d": str(f)})
    assert files.verified(str(tmp_path / "m.json"), str(tmp_path))["version"] == "1"


def test_terms_case_suffix_and_offsets(spark):
    """Signs that end a term belong to it, capitals only match capitals, offsets are those of the untouched text."""
    entries = spark.createDataFrame(
        [("đau cột sống thắt lưng yêu thống", "M54", "SYMPTOM", "Đau cột sống thắt lưng (Yêu thống)", False), ("hen", "J45", "DISEASE", "HEN", True), ("bệnh", "X", "DISEASE", "bệnh", False)],
        "key string, code string, category string, surface string, case_sensitive boolean",
    )
    texts = [(1, "Chẩn đoán: đau cột sống thắt lưng (yêu thống), theo dõi."), (2, "HEN chứ không phải hen"), (3, "İstanbul bệnh"), (4, "bệnh"), (5, "Đau cột sống thắt lưng, yêu thống")]
    got = sorted((r.key, r.text, r.start) for r in D.candidates(spark.createDataFrame(texts, "k long, t string"), "k", "t", entries).collect())
    at = texts[0][1].index("đau")
    assert got == [(1, "đau cột sống thắt lưng (yêu thống)", at), (2, "HEN", 0), (3, "bệnh", 9), (4, "bệnh", 0), (5, "Đau cột sống thắt lưng, yêu thống", 0)]


def test_first_words_beyond_the_bound_change_nothing(spark, monkeypatch):
    entries = spark.createDataFrame([("ho khan", "R05", "SYMPTOM"), ("sốt", "R50", "SYMPTOM")], "key string, code string, category string")
    texts = spark.createDataFrame([(1, "Sốt cao và ho khan, ho."), (2, "ho khan sot")], "k long, t string")
    few = sorted(map(tuple, D.candidates(texts, "k", "t", entries).collect()))
    monkeypatch.setattr(D, "FIRST_WORDS", 1)
    assert few == sorted(map(tuple, D.candidates(texts, "k", "t", entries).collect())) and len(few) == 3


def test_occurrences_by_mode(spark):
    find = lambda mode: one(spark, S.occurrences(F.lit("aXa axa, xaxax"), F.lit("axa"), mode))
    assert find("free") == [0, 4, 10] and find("tokens") == [0, 4] and find("overlapping") == [0, 4, 10]
    assert one(spark, S.occurrences(F.lit("aaaa"), F.lit("aa"), "overlapping")) == [0, 1, 2] and one(spark, S.occurrences(F.lit("x"), F.lit(""))) == []


def test_long_texts_are_cut_in_one_pass(spark):
    import time

    df = spark.createDataFrame([("từ ngữ, " * 40_000,)], "t string")
    df.select(F.size(S.tokens(F.col("t"), "plain"))).collect()
    began = time.time()
    words = df.select(F.size(S.tokens(F.col("t"), "plain")).alias("n")).first().n
    assert words == 120_000 and time.time() - began < 10


def test_greedy_choice_by_brute_force(spark):
    import random

    rng = random.Random(4)
    sets = []
    for k in range(40):
        spans = {(s := rng.randint(0, 60), s + rng.randint(1, 12)) for _ in range(rng.randint(1, 25))}
        sets.append((k, [{"start": s, "end": e, "label": "x"} for s, e in sorted(spans)]))
    df = spark.createDataFrame(sets, "k int, s array<struct<start:int,end:int,label:string>>")
    got = {r.k: [(x.start, x.end) for x in r.r] for r in df.select("k", S.resolved(F.col("s"), "gold", ["label"]).alias("r")).collect()}
    for k, spans in sets:
        kept = []
        for s, e in sorted(((x["start"], x["end"]) for x in spans), key=lambda x: (x[0] - x[1], x)):
            if all(e <= a or b <= s for a, b in kept):
                kept.append((s, e))
        assert got[k] == sorted(kept)


def test_a_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from textloom import runtime

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        runtime.shared_folder(cluster)


def test_written_tables_can_be_cleared(spark):
    import os

    from textloom import runtime

    kept = list(runtime._written)
    runtime._written.clear()
    df = runtime.materialise(spark.range(5).toDF("a"), "probe")
    path = runtime._written[0].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    runtime.clear(spark)
    assert not os.path.isdir(path) and not runtime._written
    runtime._written.extend(kept)


def test_tone_pairs(spark):
    from textloom.functions.text import _tone_pairs

    pairs = _tone_pairs()
    assert len(pairs) == 60 and pairs["òa"] == "oà" and pairs["ỤY"] == "UỴ" and pairs["Ủa"] == "Uả" and pairs["ọe"] == "oẹ"
    assert one(spark, T.tone_placement(F.lit("THỦY, Òa, mùa"))) == "THUỶ, Oà, muà"


def test_each_file_of_a_dictionary_has_its_own_header(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}.csv").write_text(f"sheet {i}\nnote\ncode,name\nA0{i},Bệnh {i}\nB0{i},\"Sốt, ho\"\n", encoding="utf-8")
    df = files.read_dictionary(spark, str(tmp_path), ["code", "name"], header_row=3)
    assert sorted(map(tuple, df.collect())) == [("A00", "Bệnh 0"), ("A01", "Bệnh 1"), ("B00", "Sốt, ho"), ("B01", "Sốt, ho")]
