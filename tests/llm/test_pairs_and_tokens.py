"""Problems 7 to 10."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import encoding, mixing, pairs, subjects

Q = "Em năm nay 52 tuổi, bị ho khan ba hôm nay, đã uống thuốc 9 ngày. Tôi nên khám ở đâu và thở oxy mất bao lâu?"
A = "Chào em, Bạn nên làm siêu âm để loại trừ bệnh và theo dõi trong 3 tuần. Khi nào đỡ thì tái khám."


@pytest.mark.parametrize(
    "question,answer,expected",
    [
        (Q, None, "empty_answer"),
        (Q, "", "empty_answer"),
        (Q, " \n", "empty_answer"),
        (Q, "<p>&nbsp;</p>", "empty_answer"),
        (Q, "Đang cập nhật", "empty_answer"),
        (Q, A, None),
        (None, A, None),
        ("", A, None),
        (Q, A + " Chúc em sớm bình phục", None),
        (Q, A + " Chúc gia đình bình an :)", None),
        (Q, A + " Trân trọng (Dr. on duty)", None),
        (Q, A[:-20], "truncated_answer"),
        (Q, A + " Cụ thể như sau:", "truncated_answer"),
        (Q, A + " Ngoài ra, bạn cần…", "truncated_answer"),
        (Q, A + " Bạn nên<br", "truncated_answer"),
        (Q, A + " Tốt nhất (", "truncated_answer"),
        (Q, Q, "copied_question"),
        (Q, "Chào em, " + Q.lower(), "copied_question"),
        (Q, "Bạn hỏi: “" + Q[:60] + "” " + A * 2, None),
        (Q, "Xin lỗi bạn, bác sĩ không thể trả lời nội dung này qua mạng. Mong bạn thông cảm.", "refusal"),
        (Q, "Câu hỏi của bạn hơi ngoài chuyên khoa của tôi nhưng tôi vẫn xin góp ý. " + A, None),
        (Q, "You should have a blood test and you must not stop the drugs before the next visit with your doctor.", "other_language"),
        (Q, "Ban nen lam sieu am de loai tru benh va theo doi trong ba tuan, khi nao do thi tai kham nhe.", None),
    ],
)
def test_defects(question, answer, expected):
    got = pairs.defect(question, answer, pairs.Refusals())
    assert (got and got[0]) == expected


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I can't help with that.",
        "I am unable to advise on this matter.",
        "We do not give medical advice here. Kind regards.",
        "Tôi không thể đưa ra ý kiến về vấn đề này.",
        "Chúng tôi không thể đưa ra lời khuyên cho trường hợp của bạn.",
        "Rất tiếc, ban biên tập xin từ chối bình luận về chủ đề này.",
        "Nội dung này vượt quá phạm vi chuyên môn của chúng tôi.",
        "Nous ne sommes pas en mesure de vous donner un avis.",
    ],
)
def test_refusals_in_other_words(answer):
    """Held out: none of these sentences stands in the tables."""
    assert pairs.Refusals()(pairs.plain(answer).lower())
    assert pairs.defect(None, answer, pairs.Refusals())[0] == "refusal"


@pytest.mark.parametrize(
    "answer",
    [
        "Bạn không nên nghe tư vấn trên mạng mà cần khám trực tiếp.",
        "Kết quả lần trước của bạn chưa đủ để kết luận.",
        "Bạn không thể tự ý ngưng thuốc khi chưa tái khám.",
        "Khi không đỡ, bạn hãy xin tư vấn của bác sĩ.",
        "You should not wait for advice on the phone.",
        "This drug does not help with the cough, so stop it and rest.",
        "Do not stop the drug without the advice of your doctor.",
    ],
)
def test_advice_is_no_refusal(answer):
    got = pairs.defect(None, answer, pairs.Refusals())
    assert got is None or got[0] != "refusal"


def test_suffix_automaton_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        q = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        grams = {tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        covered = set()
        for i in range(len(a)):
            for j in range(i + 3, len(a) + 1):
                if tuple(a[i:j]) in grams:
                    covered |= set(range(i, j))
        assert pairs.Suffixes(q).covered(a, 3) == len(covered)


def test_pairs_table(spark):
    rows = [(1, Q, None, "x"), (1, Q, None, "x"), (2, Q, A, "x"), (3, None, "?", "x"), (4, Q, A * 400, "x")]
    df = spark.createDataFrame(rows, "key long, q string, a string, defect string")
    assert sorted((r.key, r.defect) for r in pairs.defective(df, "key", "q", "a").collect()) == [(1, "empty_answer"), (3, "empty_answer")]
    assert pairs.defective(df.limit(0), "key", "q", "a").count() == 0


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.FOLDER}/{encoding.VOCABULARY}.json")
    t.encode_special_tokens = True
    ids = encoding.encoder()
    rng = random.Random(9)
    signs = [*"ab'st .\n\t\r éđ1２!\"…ve\x1c\x85​🩺👍🏽  　", "'s", "'t", " '", "<|endoftext|>", "  ", "Điều trị", " " * 7, "ab" * 300]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for s in texts:
        assert np.frombuffer(ids(s), dtype=np.int32).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_forced_pairs_cut_texts_of_any_script():
    ranks = encoding.ranks_of(encoding.vocabulary())
    cuts, inside = encoding.forced_cuts(ranks), encoding.inner_pairs(ranks)
    text = "Người bệnh được khám tại viện, không sốt. Патиент 患者です qzxvqj"
    raw = text.encode()
    at = cuts(raw).tolist()
    assert len(at) > len(text.split()) and all(not inside[raw[i - 1], raw[i]] for i in at)
    assert [len(t) for t in ranks if any(not inside[a, b] for a, b in zip(t, t[1:]))] == []
    assert cuts(b"").tolist() == [] and cuts(b"a").tolist() == []


def test_ids_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "ab", 0), (3, "ab", 0), (4, "dài " * 30_000, 0)], "doc_id long, text string, ids int")
    got = sorted((r.key, len(r.ids)) for r in encoding.encoded(df, "doc_id", "text").collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == 0 and got[2][1] > 0
    counts = {r.key: r.n_tokens for r in encoding.encoded(df, "doc_id", "text", counts_only=True).collect()}
    assert counts[4] == got[4][1]
    assert encoding.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_mix(spark):
    rng = random.Random(10)
    rows = [(i, "big" if i % 3 else (" SMALL" if i % 2 else "mid"), rng.randint(1, 50)) for i in range(3000)]
    rows += [rows[0], (9001, None, 5), (9002, "other", 5), (9003, "big", None), (9004, "big", 0), (None, "big", 3)]
    df = spark.createDataFrame(rows, "key long, source string, n long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 1), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixed(df, targets, "key", "source", "n", total="exact").cache()
    assert drawn.select("key").distinct().count() == drawn.count()
    took = {r.source: (r.t, r.m) for r in drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("m")).collect()}
    whole = sum(t for t, _ in took.values())
    assert abs(took["big"][0] / whole - 0.5) < 0.01 and abs(took["small"][0] / whole - 0.3) < 0.01 and abs(took["mid"][0] / whole - 0.2) < 0.01
    assert took["big"][1] == 1 and took["small"][1] <= 3 and "other" not in took
    again = mixing.mixed(df.repartition(7), targets, "key", "source", "n", total="exact")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    report = {r.source: r for r in mixing.shares(df.dropDuplicates(["key"]), drawn, targets, "source", "n").collect()}
    assert report["absent"].taken == 0 and report[None].share == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-4
    assert mixing.mixed(df.limit(0), targets, "key", "source", "n").count() == 0
    assert mixing.mixed(df, targets.limit(0), "key", "source", "n").count() == 0


def test_subjects(spark):
    rng = random.Random(11)
    words = {"sport": ["cầu thủ", "trận đấu", "huấn luyện viên", "đội tuyển"], "law": ["hợp đồng", "khiếu nại", "điều khoản", "khởi kiện"], "heart": ["van tim", "mạch vành", "nhịp tim", "huyết áp"]}
    frame = ["Theo ghi nhận thì {} được nhắc nhiều cùng {} trong năm", "Kết quả cho thấy {} thay đổi khi có {} rõ rệt", "Nhóm tác giả nhận thấy {} và {} đi cùng"]
    docs, truth = [], {}
    for i in range(300):
        own = rng.sample(sorted(words), rng.choice([1, 1, 2]))
        says = [rng.choice(frame).format(*rng.sample(words[s], 2)) for s in own for _ in range(4)]
        docs.append((i, ". ".join(says) + ".", 1))
        truth[i] = set(own)
    docs += [docs[0], (900, None, 1), (901, " ", 1), (902, "", 1)]
    labels = [(i, s) for i in range(0, 300, 5) for s in sorted(truth[i])] + [(5, "law"), (None, "law"), (7777, "law"), (0, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject int")
    seeds = spark.createDataFrame(labels, "doc_id long, subject string")
    got = {}
    for r in subjects.subject_areas(df, seeds).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.95 * len(truth)
    assert not {900, 901, 902} & set(got)
    assert subjects.subject_areas(df, seeds.limit(0)).count() == 0 and subjects.subject_areas(df.limit(0), seeds).count() == 0
