"""Problems 1 and 2."""

import random

from textloom.llm import language, splitting

VI = "Nghiên cứu cho thấy bệnh nhân được điều trị bằng thuốc mới có kết quả tốt hơn. "
EN = "The study shows that patients who were treated with the new drug had better results. "
FR = "L'étude montre que les patients traités avec le nouveau médicament ont eu de meilleurs résultats. "


def test_sentences_and_verdicts():
    classify = language.classifier(language.fit([]))
    assert [classify(s)[0] for s in (VI, EN, FR, language.plain(VI), VI.upper())] == ["vi", "en", "fr", "vi", "vi"]
    assert classify("zxqj 8f3k wqpt xx-17 kkjh")[0] is None and classify("")[0] is None
    assert [r[0] for r in language.runs(VI * 3 + EN * 2 + VI, classify)] == ["vi", "en", "vi"]
    assert language.verdict({}) == ("unknown", 0.0)
    assert language.verdict({"vi": 75, "en": 25})[0] == "mixed" and language.verdict({"vi": 76, "en": 24})[0] == "vi"


def test_held_out_accuracy():
    import duckdb

    rows = duckdb.sql("select distinct doc_id, abstract_en, abstract_vi from '/root/testdata/sf0.01/article_extraction.parquet'").fetchall()
    fitted, held = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    classify = language.classifier(language.fit([t for r in fitted for t in r[1:] if t]))
    marks = set("ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ")
    right = total = 0
    for r in held:
        for t in r[1:]:
            for s in language.sentences(t or ""):
                low = s.lower()
                if len(s) > 40 and "le " not in low and "les " not in low:
                    accented = sum(c in marks for c in low)
                    if accented > 4 or (accented == 0 and " the " in low and " nhat la " not in low and " giup " not in low):
                        total += 1
                        right += classify(s)[0] == ("vi" if accented > 4 else "en")
    assert total > 500 and right >= 0.99 * total


def test_stretches_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "*** 12 ---", 0), (4, VI * 4 + EN * 4, 0), (4, VI * 4 + EN * 4, 0), (5, EN * 3000, 0)]
    df = spark.createDataFrame(rows, "key long, text string, seg int")
    got = sorted((r.key, r.seg, r.lang) for r in language.stretches(df, language.fit([]), "key", "text").distinct().collect())
    assert got == [(2, 0, "unknown"), (3, 0, "unknown"), (4, 0, "mixed"), (4, 1, "vi"), (4, 2, "en"), (5, 0, "en")]
    assert language.stretches(df.limit(0), language.fit([]), "key", "text").count() == 0


def test_pieces_hold():
    rng = random.Random(2)
    for _ in range(300):
        words = ["x" * rng.choice([1, 3, 7, 30, 90]) for _ in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n\n"]) for w in words)
        limit, overlap = rng.choice([20, 50, 100]), rng.choice([0, 5, 19])
        cut = splitting.pieces(text, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        for (a, b, s), (c, d, _) in zip(cut, cut[1:]):
            assert b - a <= limit and c == max(b - overlap, 0) and d > b
            assert s or not any(t.isspace() for t in text[max(b - (limit - overlap), 0) : b])
    assert splitting.pieces("", 10, 2) == [] and splitting.pieces("abc", 10, 2) == [(0, 3, 3)]
    assert splitting.pieces("a" * 25, 10, 12)[0] == (0, 10, 0)


def test_strongest_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, 200).astype(np.int8)
    table = splitting.Strongest(v)
    for _ in range(500):
        lo, hi = sorted(rng.integers(0, 200, 2))
        best = v[lo : hi + 1].max()
        assert table.query(int(lo), int(hi)) == (best, max(i for i in range(lo, hi + 1) if v[i] == best))


def test_tables_stay_small_on_long_texts():
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, 300_000).astype(np.int8)
    table = splitting.Strongest(v, 501)
    for at in range(0, 299_000, 777):
        lo, hi = at, at + int(rng.integers(0, 501))
        best = v[lo : hi + 1].max()
        assert table.query(lo, hi) == (best, lo + int(np.flatnonzero(v[lo : hi + 1] == best)[-1]))
        assert sum(r.nbytes for r in table.rows) < 2_000_000
    text = "Một câu dài hơn. " * 120_000
    cut = splitting.pieces(text, 1000, 50)
    assert cut[-1][1] == len(text) and all(b - a <= 1000 and s == splitting.SENTENCE for a, b, s in cut[:-1])


def test_oversized_table(spark):
    rows = [("a", "T", "x " * 30, 1), ("a", "T", "x " * 30, 1), ("b", None, "y" * 60, 1), ("c", "T", None, 1), ("d", "T", "", 1), ("e", "U", "short", 1)]
    df = spark.createDataFrame(rows, "section_id string, canonical_type string, content string, piece int")
    limits = spark.createDataFrame([("T", 20, 4), ("*", 50, 0)], "canonical_type string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(df, limits).collect()
    assert {(r.key, r.forced) for r in got} == {("a", 0), ("b", 1)}
    assert all(len(r.text) <= (20 if r.key == "a" else 50) for r in got)
    assert len([r for r in got if r.piece == 1]) == 2
    again = splitting.split_oversized(df, limits, copies=True).collect()
    assert set(again) == set(got) and len([r for r in again if r.piece == 1]) == 3
    assert splitting.split_oversized(df, limits.limit(0)).count() == 0 and splitting.split_oversized(df.limit(0), limits).count() == 0
