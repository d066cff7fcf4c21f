"""Problem 1: sentences are cut in linear time and classified together as they are one by one."""

import random
import re
import time

from textloom.llm import language, sitelines

SAID = [
    "Nghiên cứu cho thấy bệnh nhân được điều trị bằng thuốc mới có kết quả tốt hơn.",
    "The study shows that patients who were treated with the new drug had better results.",
    "L'étude montre que les patients traités avec le nouveau médicament ont eu de meilleurs résultats.",
    "Benh nhan duoc dieu tri bang thuoc moi co ket qua tot hon.",
    "zxqj 8f3k wqpt xx-17 kkjh.",
    "Tuổi 45/60...",
    "*** 12 ---",
]


def test_sentences_are_cut_as_by_the_plain_pattern():
    plain = re.compile(r"(?:[.!?…]+[\"”’)]*|(?<!\d)/(?!\d))(?=\s)|\n+")
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab1.!…?\"”)/ \n\n..  ") for _ in range(rng.randint(0, 30)))
        ends = [0, *(m.end() for m in plain.finditer(text)), len(text)]
        assert language.sentences(text) == [text[a:b] for a, b in zip(ends, ends[1:]) if any(c.isalpha() for c in text[a:b])]


def test_long_runs_of_dots_take_linear_time():
    began = time.process_time()
    assert language.sentences("Mục lục" + "." * 100_000) == ["Mục lục" + "." * 100_000]
    assert time.process_time() - began < 2


def test_together_as_one_by_one(monkeypatch):
    monkeypatch.setattr(language, "AT_ONCE", 5)
    dictionaries, rng = language.fit([]), random.Random(2)
    one, many = language.classifier(dictionaries), language.classifier_of_many(dictionaries)
    said = [rng.choice(SAID) for _ in range(64)]
    assert many(said) == [one(s) for s in said] and many([]) == [] and {name for name, _ in many(said)} == {"vi", "en", "fr", None}
    texts = ["", *(" ".join(rng.choices(SAID, k=rng.randint(0, 9))) for _ in range(40)), "12"]
    assert [language.joined(found) for found in language.classified(texts, many)] == [language.runs(t, one) for t in texts]


def test_sizes_of_lines(spark, monkeypatch):
    monkeypatch.setattr(sitelines, "LINES_AT_ONCE", 3)
    dictionaries, rng = language.fit([]), random.Random(3)
    classify = language.classifier(dictionaries)
    rows = [(i, f"s{i}", "\n".join(rng.choices([*SAID, "", " ".join(SAID)], k=rng.randint(0, 6))) if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, section_id string, content string")
    got = sitelines.line_rows(df, language.line_sizes(dictionaries), ", vi int, en int, fr int").collect()
    want = {}
    for _, key, text in rows:
        for n, raw in enumerate((text or "").split("\n"), 1):
            if raw:
                sizes = dict.fromkeys(("vi", "en", "fr"), 0)
                for name, n_of, _ in language.runs(raw, classify):
                    sizes[name] += n_of
                want[key, n] = tuple(sizes.values())
    assert {(r.key, r.line_no): (r.vi, r.en, r.fr) for r in got} == want and len(got) == len(want)
