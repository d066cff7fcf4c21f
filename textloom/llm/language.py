"""Problem 1: the language of documents and of the stretches of mixed ones, by compression.

A sentence is encoded with zstandard under a raw-content dictionary of each language; the smallest encoding names the
language, a narrow margin or a poor encoding names none. Dictionaries grow from short seeds by a bounded sample of the
texts at hand. Vietnamese typed without accents has its own dictionary and counts as Vietnamese.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.arrow import map_batches
from textloom.llm.forms import form

SEEDS = {
    "vi": (
        "Trong những năm gần đây, nhiều người đã được khám và điều trị tại các bệnh viện của tỉnh. Kết quả cho thấy tỷ lệ mắc bệnh thay đổi theo tuổi, "
        "nhưng không có sự khác biệt giữa nam và nữ. Bệnh nhân cần được theo dõi trong thời gian dài, nhất là khi có sốt hoặc đau ngực. Chúng tôi nhận thấy "
        "phương pháp này làm giảm các triệu chứng của người bệnh. Bạn nên đến gặp bác sĩ để được tư vấn thêm và làm xét nghiệm máu. Ngoài ra, việc ăn uống "
        "đúng cách và nghỉ ngơi cũng rất quan trọng đối với sức khỏe. Nghiên cứu được thực hiện ở một trung tâm y tế, với cỡ mẫu lớn hơn so với báo cáo trước đó. "
        "Theo quy định của pháp luật, hợp đồng phải ghi rõ quyền và nghĩa vụ của hai bên. Phần mềm mới giúp lưu dữ liệu nhanh hơn. Đội bóng tập luyện mỗi ngày. "
        "Cháu bé ăn ít, ngủ không yên và hay khóc đêm. Mẹ cháu hỏi có cần dùng thuốc nữa hay chờ thêm một tuần. Cảm ơn bạn đã gửi câu hỏi, chúc bạn mau khỏe."
    ),
    "en": (
        "In recent years many people have been seen and treated in the hospitals of the region. The results show that the rate of the disease changed with age, "
        "but there was no difference between men and women. Patients should be followed for a long time, especially when they have fever or chest pain. We observed "
        "that this method reduced the symptoms of most of the patients. You should see a doctor for further advice and have a blood test. In addition, eating "
        "properly and resting are very important for your health. The study was carried out at a medical centre, with a larger sample than that of the previous report. "
        "According to the law, the contract must state the rights and duties of both parties. The new software helps to store the data faster. The team trains every day. "
        "The child eats little, does not sleep well and often cries at night. The mother asks whether the drugs are still needed or if she can wait another week. Thank you for your question."
    ),
    "fr": (
        "Ces dernières années, de nombreuses personnes ont été examinées et traitées dans les hôpitaux de la région. Les résultats montrent que le taux de la maladie varie selon l'âge, "
        "mais il n'y a pas de différence entre les hommes et les femmes. Les patients doivent être suivis pendant une longue période, surtout en cas de fièvre ou de douleur. Nous avons observé "
        "que cette méthode a réduit les symptômes chez la plupart des malades. Vous devriez consulter un médecin pour un avis et faire une prise de sang. En outre, bien manger "
        "et se reposer sont très importants pour votre santé. L'étude a été réalisée dans un centre de santé, avec un échantillon plus grand que celui du rapport précédent. "
        "Selon la loi, le contrat doit préciser les droits et les devoirs des deux parties. Le nouveau logiciel aide à garder les données. L'équipe s'entraîne tous les jours. "
        "L'enfant mange peu, ne dort pas bien et pleure souvent la nuit. La mère demande si les médicaments sont encore nécessaires ou si elle peut attendre une semaine. Merci de votre question."
    ),
}
SAMPLE_ROWS = 3000  # rows that the dictionaries are fitted on, at most
SAMPLE_CHARACTERS = 16_000_000  # of those rows, at most; texts are taken whole
DICTIONARY_BYTES = 49_152  # of each language, at most
SECOND_SHARE = 0.25  # of the text, from which a second language makes it mixed
MIN_MARGIN = 0.03  # bytes saved per byte of text against the next language
MAX_RATIO = 0.8  # encoded bytes per byte of text beyond which it is no language's
AT_ONCE = 1024  # sentences that one dictionary encodes before the next one does, about: its tables stay in the processor's cache
LINES_KEPT = 1 << 16  # a task remembers, at most

#: Ends of lines, a slash not behind a digit, or signs with closing quotes, the latter two before a blank. It begins with a class, which is searched
#: faster than alternatives, and a run of signs is tried once, not from each of its signs.
_sentence = re.compile(r"[.!?…/\n](?:(?<=\n)\n*+|(?<=/)(?<!\d/)(?=\s)|(?<=[.!?…])(?<![.!?…]{2})[.!?…]*+[\"”’)]*+(?=\s))")
_marks = re.compile("[\u0300-\u036f]+")
_letters = re.compile(r"[^\W\d_]")


def plain(text: str) -> str:
    """Without accents."""
    return _marks.sub("", unicodedata.normalize("NFD", text)).replace("đ", "d").replace("Đ", "D")


def sentences(text: str) -> list[str]:
    """Sentences in order, each with its end; a stretch without letters belongs to the sentence before it."""
    out: list[str] = []
    at = 0
    for m in _sentence.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return [s for s in out if _letters.search(s)]


def classifier(dictionaries: dict[str, bytes]) -> Callable[[str], tuple[str | None, float]]:
    """sentence -> (language or None, confidence). Confidence is the share of the encoding saved against the next language."""
    classify = classifier_of_many(dictionaries)
    return lambda sentence: classify([sentence])[0]


def classifier_of_many(dictionaries: dict[str, bytes]) -> Callable[[list[str]], list[tuple[str | None, float]]]:
    """The same of sentences, one dictionary after another."""
    import zstandard

    encoders = []
    for name, raw in dictionaries.items():
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=3)
        encoders.append((name.split("_")[0], zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
    frame = len(encoders[0][1](b""))
    languages = list(dict.fromkeys(name for name, _ in encoders))

    def part(raws: list[bytes]) -> Iterator[tuple[str | None, float]]:
        best = np.full((len(languages), len(raws)), 1 << 60)
        for name, encode in encoders:
            own = best[languages.index(name)]
            np.minimum(own, [len(encode(raw)) - frame for raw in raws], out=own)
        first, size = best.argmin(axis=0), np.array([len(raw) for raw in raws])
        a, b = np.sort(best, axis=0)[:2]
        none = (size == 0) | (a > MAX_RATIO * size) | (b - a < np.maximum(2, MIN_MARGIN * size))
        for i, x, y, no in zip(first.tolist(), a.tolist(), b.tolist(), none.tolist()):
            yield (None, 0.0) if no else (languages[i], round((y - x) / max(y, 1), 4))

    def classify(sentences: list[str]) -> list[tuple[str | None, float]]:
        raws = [" ".join(s.lower().split()).encode("utf-8", "replace") for s in sentences]
        return [found for at in range(0, len(raws), AT_ONCE) for found in part(raws[at : at + AT_ONCE])]

    return classify


def classified(texts: Iterable[str], classify) -> Iterator[list[tuple[str | None, float, int]]]:
    """Of each text (language or None, confidence, characters) of its sentences in reading order. classify is as from classifier_of_many;
    texts go to it together as soon as they have AT_ONCE sentences."""
    held: list[list[str]] = []

    def found() -> list[list[tuple[str | None, float, int]]]:
        each = iter(classify([s for own in held for s in own]))
        return [[(*next(each), len(s.strip())) for s in own] for own in held]

    waiting = 0
    for text in texts:
        held.append(sentences(form(text)))
        waiting += len(held[-1])
        if waiting >= AT_ONCE:
            yield from found()
            held, waiting = [], 0
    yield from found()


def fit(texts: list[str]) -> dict[str, bytes]:
    """Dictionaries of each language: seeds, then two rounds over the sample, keeping the sentences surest of their language."""

    def build(found: dict[str, list[str]]) -> dict[str, bytes]:
        out = {}
        for name, seed in SEEDS.items():
            body, size = [], 0
            for s in dict.fromkeys(found.get(name, [])):
                size += len(s.encode()) + 1
                if size > DICTIONARY_BYTES - len(seed.encode()) - 1:
                    break
                body.append(s)
            text = "\n".join([*body, seed]).lower()
            out[name] = text.encode()
            if name == "vi":
                out["vi_plain"] = plain(text).encode()
        return out

    dictionaries = build({})
    pool = [" ".join(s.split()) for t in texts for s in sentences(form(t))]
    for least in (0.2, 0.15):
        found: dict[str, list[str]] = {}
        for s, (name, sure) in zip(pool, classifier_of_many(dictionaries)(pool)):
            if name and sure >= least and len(s) >= 40:
                found.setdefault(name, []).append(s)
        dictionaries = build(found)
    return dictionaries


def sample(*columns: tuple[DataFrame, str], rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS) -> list[str]:
    """At most rows texts of at most so many characters together, chosen by hash, shared out evenly among the columns. Texts are whole; those
    beyond the bound are left out. Rows are thinned by hash before they are ordered, so that what is ordered does not grow with the
    partitions; the count that needs is read from the files' footers."""
    out: list[str] = []
    for df, name in columns:
        share = rows // len(columns)
        kept = min(1.0, 4 * share / max(df.count(), 1))
        picked = df.select(F.col(name).alias("t")).filter("length(trim(t)) > 0").withColumn("h", F.xxhash64("t"))
        picked = picked.filter(F.pmod("h", F.lit(1 << 31)) <= int(kept * (1 << 31))).orderBy("h", "t").limit(share)
        upto = F.sum(F.length("t")).over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))  # of at most share rows
        out += [r.t for r in picked.withColumn("upto", upto).filter(F.col("upto") <= characters // len(columns)).collect()]
    return out


def verdict(sizes: dict[str, int]) -> tuple[str, float]:
    """Language of a text whose sentences of each language have these sizes, and the share of its main language."""
    total = sum(sizes.values())
    if not total:
        return "unknown", 0.0
    ranked = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
    if len(ranked) > 1 and ranked[1][1] >= SECOND_SHARE * total:
        return "mixed", round(ranked[0][1] / total, 4)
    return ranked[0][0], round(ranked[0][1] / total, 4)


def runs(text: str, classify) -> list[tuple[str, int, float]]:
    """(language, characters, confidence) of the longest runs of sentences in one language, in reading order.
    Sentences of no language join no run."""
    return joined((*classify(s), len(s.strip())) for s in sentences(form(text)))


def joined(found: Iterable[tuple[str | None, float, int]]) -> list[tuple[str, int, float]]:
    """The runs of sentences (language, confidence, characters)."""
    out: list[list] = []
    for name, sure, n in found:
        if name is None:
            continue
        if out and out[-1][0] == name:
            out[-1][1] += n
            out[-1][2] += sure * n
        else:
            out.append([name, n, sure * n])
    return [(name, n, round(w / n, 4)) for name, n, w in out]


def stretches(df: DataFrame, dictionaries: dict[str, bytes], key: str, text: str) -> DataFrame:
    """(key, seg, lang, confidence): seg 0 is the whole text, and of a mixed one seg 1, 2, ... its runs in reading order.

    Null texts give no rows; blank texts and texts without words are unknown with confidence 0; repeated rows are repeated. No shuffle."""

    def work():
        classify = classifier_of_many(dictionaries)

        def step(columns):
            keys, texts = columns
            for k, each in zip(keys, classified(texts, classify)):
                found = joined(each)
                sizes: dict[str, int] = {}
                for name, n, _ in found:
                    sizes[name] = sizes.get(name, 0) + n
                lang, share = verdict(sizes)
                sure = sum(c * n for _, n, c in found) / max(1, sum(n for _, n, _ in found))
                yield k, 0, lang, round(share * sure, 4)
                if lang == "mixed":
                    yield from ((k, i, name, c) for i, (name, _, c) in enumerate(found, 1))

        return step

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return map_batches(source, work, f"key {df.schema[key].dataType.simpleString()}, seg int, lang string, confidence double")


def line_sizes(dictionaries: dict[str, bytes]):
    """For sitelines.line_rows: characters of lines in each language."""

    def extra():
        classify = classifier_of_many(dictionaries)
        kept: dict[str, tuple[int, int, int]] = {}  # lines of a site come again and again

        def measure(raws: list[str]) -> list[tuple[int, int, int]]:
            if len(kept) > LINES_KEPT:
                kept.clear()
            new = [raw for raw in dict.fromkeys(raws) if raw not in kept]
            for raw, found in zip(new, classified(new, classify)):
                sizes = {"vi": 0, "en": 0, "fr": 0}
                for name, _, n in found:
                    if name:
                        sizes[name] += n
                kept[raw] = tuple(sizes.values())
            return [kept[raw] for raw in raws]

        return measure

    return extra


def of_documents(lines: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of every document of docs (doc_id) by its lines (doc_id, key, line_no, line, vi, en, fr) without
    those at places (key, line_no). Repeated lines rows count once; documents without words are unknown."""
    own = lines.dropDuplicates(["key", "line_no", "line"]).join(places, ["key", "line_no"], "left_anti")
    sums = own.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("vi", "en", "fr")))
    joined = docs.select("doc_id").distinct().join(sums, "doc_id", "left").na.fill(0, ["vi", "en", "fr"])
    total = F.col("vi") + F.col("en") + F.col("fr")
    most = F.greatest("vi", "en", "fr")
    second = F.sort_array(F.array("vi", "en", "fr"))[1]
    lang = (
        F.when(total == 0, "unknown")
        .when(second >= SECOND_SHARE * total, "mixed")
        .when(F.col("vi") == most, "vi")
        .when(F.col("en") == most, "en")
        .otherwise("fr")
    )
    return joined.select("doc_id", lang.alias("lang"), F.when(total > 0, F.round(most / total, 4)).otherwise(0.0).alias("confidence"))
