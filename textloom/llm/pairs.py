"""Problem 7: broken question and answer pairs, one defect each.

Copies: a suffix automaton of the question's words is traversed with the answer; words inside long matches are covered.
Refusals: an Aho-Corasick automaton finds the parts a refusal is composed of (a negated ability or will, an act of answering); they
refuse where they follow each other closely, and the answer is a refusal if nothing but courtesies stands beside them. Truncation: the end of the last
sentence and a stack of open delimiters. Language: votes of stop words that only one language has.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import map_batches
from textloom.llm.forms import form
from textloom.llm.language import plain

MATCH_WORDS = 4  # a match of fewer words covers nothing
COPIED_SHARE = 0.65  # of the answer's words without greetings, from which it is a copy

# Fixed values, without accents: placeholders, refusing phrases, courtesies, stop words.
PLACEHOLDERS = {
    "n/a", "na", "null", "none", "nan", "dang cap nhat", "trong", "chua co", "chua co cau tra loi", "chua tra loi", "khong co", "khong co noi dung",
    "updating", "pending", "tbd", "todo", "no answer", "empty", "blank", "undefined", "nil", "xxx", "test",
}
# Parts of refusals, by language: (first parts, second parts, words that may stand between at most). Any first part refuses with any second.
REFUSALS = {
    "vi": (
        (
            ("khong", "khong the", "chang the", "chua the", "chua du thong tin", "tu choi", "xin mien", "ngung", "ngung nhan", "tam ngung", "dung nhan", "thoi nhan"),
            ("tra loi", "giai dap", "tu van", "loi khuyen", "y kien", "gop y", "binh luan", "nhan xet", "nhan dinh", "suy doan", "phong doan", "ban ve", "ban den", "ban luan", "noi gi", "phan tich"),
            5,
        ),
        (("xin", "xin phep", "danh"), ("khep lai", "dung tai day", "dung o day", "dung lai", "nhuong lai", "nhuong loi"), 3),
        (("ngoai", "vuot", "vuot qua", "khong thuoc", "khong phai"), ("pham vi", "chuyen khoa", "chuyen mon", "linh vuc", "kha nang"), 2),
    ),
    "en": (
        (
            ("unable", "cannot", "can not", "can t", "could not", "not able", "won t", "will not", "we do not", "we don t", "i do not", "i don t", "not permitted", "not allowed", "not in a position", "decline",
             "declines", "declined", "refuse", "refuses", "rather not", "no doctor", "no one", "nobody", "give no", "gives no", "offer no", "only your own doctor", "only your doctor"),
            ("answer", "answers", "reply", "respond", "comment", "advise", "advice", "help", "say", "discuss", "opinion", "opinions", "assist", "speculate", "recommendation", "recommendations", "available"),
            5,
        ),
        (("questions", "question", "topic", "column"), ("closed", "withdrawn"), 8),
        (("outside", "beyond", "not within"), ("our column", "our field", "our scope", "the scope", "my field", "my scope", "our competence", "my competence", "our remit", "column covers"), 3),
    ),
    "fr": (
        (
            ("ne pouvons", "ne pouvons pas", "ne peux", "ne peut", "refusons", "refuse", "declinons", "pas en mesure", "ne souhaitons pas", "aucun medecin", "aucun conseil"),
            ("repondre", "conseil", "conseils", "conseiller", "commenter", "avis", "aider", "disponible", "prononcer", "donner"),
            5,
        ),
        (("hors de", "pas de"), ("notre domaine", "mon domaine", "notre competence", "notre specialite", "notre ressort"), 2),
    ),
}
#: Words between the parts that turn a sentence into advice.
ADVISING = {"nen", "can", "phai", "hay", "should", "must", "take", "stop", "wait", "devez", "devriez"}
COURTESY = (
    "chao", "than chao", "thua", "kinh gui", "kinh chao", "ban than men", "cam on", "rat tiec", "xin loi ban", "chuc", "tran trong", "than men", "than ai", "hen gap", "hen ban",
    "ban goi tong dai", "mong ban", "mong anh", "mong chi", "ban vui long hoi", "kind regards", "best wishes", "best regards", "regards", "sincerely", "take care",
    "get well", "we hope you understand", "please ask elsewhere", "thank you", "hello", "dear", "good day", "good morning", "hi", "sorry for the late",
    "cordialement", "bon retablissement", "bonne journee", "merci", "bonjour", "bac si oi",
)
CLOSINGS = (
    "chuc", "tran trong", "than men", "than ai", "hen gap", "hen ban", "ban goi tong dai", "kind regards", "best wishes", "best regards", "regards", "sincerely", "take care",
    "get well", "cordialement", "bon retablissement", "bonne journee", "cam on",
)
STOPWORDS = {
    "vi": "va cua khong cac nguoi benh duoc voi trong khi nen cho nay nhung tai hon theo bi den ban bac si chau em toi co la khoang sau truoc neu ngay tuan thang nhat phai thi lam can dieu tri thuoc dang cung da hoi xin ve gi nao minh chi",
    "en": "the of and was were with for you is your are this that have has from which at by be or not been after before should may than when if on as it there where about during more",
    "fr": "le les des du et est une dans pour avec vous votre chez sur apres que qui au aux par ont il elle ne pas plus ou sont cette ces leur a ete selon",
}

_tag, _open_tag, _entity = re.compile(r"<[^<>]*>"), re.compile(r"<[/a-zA-Z][^<>]*$"), re.compile(r"&#?\w+;")
_word = re.compile(r"[^\W_]+")
_end = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|\n+")
_aside = re.compile(r"\([^()]{0,40}\)$")
_smile = re.compile(r"[:;]-?[)(D]$")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}


class Suffixes:
    """Suffix automaton over a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for w in words:
            cur = self._state(self.len[last] + 1)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.len[p] + 1)
                    self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def covered(self, words: list[str], least: int) -> int:
        """Words of the sequence inside matches of at least `least` words."""
        state = size = covered = upto = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                size = 0
            if size >= least:
                covered += i + 1 - max(upto, i + 1 - size)
                upto = i + 1
        return covered


def courteous(sentence: str) -> bool:
    """A short greeting, thanks or closing (without accents, lower case)."""
    s = sentence.strip()
    return len(s.split()) <= 12 and any(s.startswith(c) and not s[len(c) : len(c) + 1].isalpha() for c in COURTESY)


def language_votes(words: list[str]) -> str | None:
    """The language most stop words vote for, none where fewer than 3 or less than two thirds do."""
    n = {k: 0 for k in _VOTES}
    for w in words:
        for k, own in _VOTES.items():
            n[k] += w in own
    best = max(n, key=n.get)
    return best if n[best] >= 3 and n[best] * 3 >= 2 * sum(n.values()) else None


_stop = {k: set(v.split()) for k, v in STOPWORDS.items()}
_VOTES = {k: v - set().union(*(o for n, o in _stop.items() if n != k)) for k, v in _stop.items()}


def unfinished(text: str) -> bool:
    """Whether a text (in its one form, trimmed) breaks off: an ellipsis or an open tag at its end, a delimiter left open in its
    last sentence, or a last sentence without an end that is no closing."""
    if _open_tag.search(text):
        return True
    bare = _tag.sub(" ", text).rstrip()
    if not bare:
        return False
    if bare.endswith(("...", "…")):
        return True
    bare = _aside.sub("", _smile.sub("", bare).rstrip()).rstrip() or bare
    last = _end.split(bare)[-1]
    stack: list[str] = []
    for c in last:
        if c in _OPEN:
            stack.append(_OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
    if stack:
        return True
    close = plain(last).lower().strip(" ,")
    if any(close.startswith(c) for c in CLOSINGS) and len(close.split()) <= 12:
        return False
    end = bare.rstrip("\"”»’')]}").rstrip()
    return not end or not (end[-1] in ".!?" or not (end[-1].isalnum() or end[-1] in ",:;-–—(/&+=<%$"))


def defect(question: str | None, answer: str | None, refusing) -> tuple[str, float] | None:
    """(defect, evidence) of a pair, the first that holds of empty_answer, copied_question, refusal, other_language, truncated_answer."""
    if answer is None:
        return "empty_answer", 1.0
    text = form(answer).strip()
    bare = _entity.sub(" ", _tag.sub(" ", text))
    low = plain(bare).lower()
    words = _word.findall(low)
    if not words or low.strip(" .()[]-–—*_\n\t\"'?!:") in PLACEHOLDERS:
        return "empty_answer", 1.0
    asked = _word.findall(plain(_tag.sub(" ", form(question))).lower()) if question else []
    parts = [s for s in _end.split(low) if _word.search(s)]
    rest = [s for s in parts if not courteous(s)]
    if asked:
        own = [w for s in rest for w in _word.findall(s)] or words
        known = set(asked)
        if sum(w in known for w in own) >= COPIED_SHARE * len(own):  # else no matches can cover that much
            share = Suffixes(asked).covered(own, min(MATCH_WORDS, len(asked))) / len(own)
            if share >= COPIED_SHARE:
                return "copied_question", round(share, 4)
    if all(map(refusing, rest)) if rest else any(map(refusing, parts)):
        return "refusal", 1.0
    if asked:
        theirs = language_votes(asked)
        ours = language_votes([w for s in rest for w in _word.findall(s)] or words)
        if theirs and ours and theirs != ours:
            return "other_language", 1.0
    if unfinished(text):
        return "truncated_answer", 1.0
    return None


class Refusals:
    """Finds refusing sentences by the parts of REFUSALS: one automaton over all parts, run over the words of a sentence."""

    def __init__(self, refusals=REFUSALS):
        import ahocorasick

        parts: dict[str, list[tuple[int, int]]] = {}
        self.gaps = []
        for rules in refusals.values():
            for firsts, seconds, gap in rules:
                for role, phrases in enumerate((firsts, seconds)):
                    for p in phrases:
                        parts.setdefault(p, []).append((len(self.gaps), role))
                self.gaps.append(gap)
        self.automaton = ahocorasick.Automaton()
        for p, roles in parts.items():
            self.automaton.add_word(f" {p} ", (p.count(" ") + 1, roles))
        self.automaton.make_automaton()

    def __call__(self, sentence: str) -> bool:
        words = _word.findall(sentence)
        spaced = f" {' '.join(words)} "
        starts, at = {}, 1
        for i, w in enumerate(words):
            at += len(w) + 1
            starts[at - 1] = i + 1  # place of the blank behind word i
        ends: dict[int, list[int]] = {}
        hits = sorted(((starts[end] - n, n, roles) for end, (n, roles) in self.automaton.iter(spaced)), key=lambda h: h[0])
        for start, n, roles in hits:
            for rule, role in roles:
                if role:
                    for e in ends.get(rule, ()):
                        if 0 <= start - e <= self.gaps[rule] and not ADVISING.intersection(words[e:start]):
                            return True
                else:
                    ends.setdefault(rule, []).append(start + n)
        return False


def defective(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(key, defect, evidence): each defective pair once.

    A null answer is empty. Without a question there is neither copying nor another language. Repeated rows count once; of different
    rows of one key the alphabetically first defect holds. Texts are read whole; no other columns are read; only defects are shuffled."""

    def work():
        refusing = Refusals()

        def step(columns):
            for k, q, a in zip(*columns):
                if found := defect(q, a, refusing):
                    yield k, *found

        return step

    kind = df.schema[key].dataType.simpleString()
    rows = map_batches(df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a")), work, f"key {kind}, defect string, evidence double")
    return rows.groupBy("key").agg(F.min(F.struct("defect", "evidence")).alias("d")).select("key", "d.defect", "d.evidence")
