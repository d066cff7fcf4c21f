"""Problem 3: lines that one site repeats in many of its documents.

Each (site, line) pair is tested: its document frequency within the site against that outside, by log-likelihood
ratio; the false-discovery rate is held by Benjamini and Hochberg's rule. Outside are all documents of other sites. As a line that several
sites repeat hides its excess on one behind the others, those suspected of repeating it are left out: at first where it stands in the stated
share of the documents, then also where it is found in excess, until no more are. A line that passes the shares by chance, while other
sites have it nearly as often, is not in excess. Documents of no known site are neither within nor outside.
"""

from __future__ import annotations

import math
from operator import add

from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import map_batches
from textloom.llm.forms import line_key_form
from textloom.runtime import materialise

LINES_AT_ONCE = 4096  # that extra() of line_rows gets, about
BINS, BIN = 12_000, 0.125  # the ratio is binned for the rank of the false-discovery rule: at most BINS rows reach the driver


def site_of(audit: DataFrame, doc: str = "article_id", domain: str = "source_domain", url: str = "source_url") -> DataFrame:
    """(doc_id, site): domain in lower case without outer blanks and a leading www., or if blank the host of the url.

    Rows without a document or any host are left out; of several sites of one document the greatest counts."""
    host = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    given = F.lower(F.trim(F.regexp_replace(F.col(domain), r"^[\s\u00a0]+|[\s\u00a0]+$", "")))
    site = F.regexp_replace(F.when(F.length(given) > 0, given).otherwise(host), r"^www\.", "")
    named = audit.select(F.col(doc).alias("doc_id"), site.alias("site"))
    return named.filter("doc_id is not null and length(site) > 0").groupBy("doc_id").agg(F.max("site").alias("site"))


def line_rows(sections: DataFrame, extra=None, extra_schema: str = "", doc: str = "doc_id", key: str = "section_id", text: str = "content") -> DataFrame:
    """(doc_id, key, line_no, line[, extra]): one row per non-blank line, line being a 64-bit digest of what makes lines
    the same: the one form, lower case, blanks and numbers alike. extra() gives a function of a list of raw lines, called once a task."""

    def work():
        import xxhash

        more = extra() if extra else None

        def step(columns):
            rows, raws = [], []
            for d, k, t in zip(*columns):
                if not t:
                    continue
                for n, raw in enumerate(t.split("\n"), 1):
                    if same := line_key_form(raw):
                        rows.append((d, k, n, xxhash.xxh3_64_intdigest(same.encode("utf-8", "surrogatepass")) - (1 << 63)))
                        raws.append(raw)
                if more and len(raws) >= LINES_AT_ONCE:
                    yield from map(add, rows, more(raws))
                    rows, raws = [], []
            yield from map(add, rows, more(raws)) if more else rows

        return step

    kind = sections.schema[key].dataType.simpleString()
    source = sections.select(F.col(doc).cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return map_batches(source, work, f"doc_id long, key {kind}, line_no int, line long{extra_schema}")


def _cut(bins: list[tuple[int, int]], tests: int, rate: float) -> float:
    """The least log-likelihood ratio that the false-discovery rule lets pass."""
    passed, least = 0, math.inf
    for b, n in sorted(bins, reverse=True):
        passed += n  # of one bin, any order leaves the same least bin
        if math.erfc(math.sqrt(b * BIN / 2)) <= rate * passed / tests:
            least = b * BIN
    return least


def line_counts(lines: DataFrame, docs: DataFrame, min_docs: int = 3, min_share: float = 0.2) -> DataFrame:
    """(site, line, n, site_docs, often, all_n, all_docs, hopeful): documents of a site that have the line, those of all that have it,
    whether it stands in at least min_docs of the site's documents and min_share of them, and whether it does so on any site.
    Documents of no site are the site ''."""
    docs = docs.filter("doc_id is not null").select("doc_id", F.coalesce("site", F.lit("")).alias("site"))
    sizes = docs.groupBy("site").agg(F.count("*").alias("site_docs"))
    total = docs.agg(F.count("*").alias("all_docs"))  # one row
    counts = lines.select("doc_id", "line").distinct().join(docs, "doc_id").groupBy("site", "line").agg(F.count("*").alias("n"))
    counts = counts.join(sizes, "site").withColumn("often", (F.col("n") >= min_docs) & (F.col("n") >= min_share * F.col("site_docs")))
    around = counts.groupBy("line").agg(F.sum("n").alias("all_n"), F.max("often").alias("hopeful"))
    return counts.join(around, "line").join(F.broadcast(total))


def _excess(own_n, own_docs, other_n, other_docs):
    """One-sided log-likelihood ratio of a line's frequency within against outside; 0 where it is no greater within."""
    a, b, k, m = (x.cast("double") for x in (own_n, own_docs, other_n, other_docs))
    pooled = (a + k) / (b + m)
    term = lambda x, n, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    ratio = 2 * (term(a, b, pooled) + term(b - a, b, 1 - pooled) + term(k, m, pooled) + term(m - k, m, 1 - pooled))
    return F.when(a / b > k / m, ratio).otherwise(0.0)


def tested_lines(counts: DataFrame) -> DataFrame:
    """counts with ratio: each line of each site against the documents of all other sites but the suspected ones (suspected: boolean).
    Where that leaves nothing outside, the line counts as met once in all documents."""
    sums = counts.filter("suspected").groupBy("line").agg(F.sum("n").alias("gone_n"), F.sum("site_docs").alias("gone_docs"))
    sites = counts.drop("ratio").join(sums, "line", "left").na.fill(0, ["gone_n", "gone_docs"])
    own = (~F.col("suspected")).cast("int")  # a suspected site is among those gone
    left = F.col("all_docs") - F.col("gone_docs") - own * F.col("site_docs")
    other_n = F.when(left > 0, F.col("all_n") - F.col("gone_n") - own * F.col("n")).otherwise(F.lit(1))
    other_docs = F.when(left > 0, left).otherwise(F.col("all_docs"))
    return sites.withColumn("ratio", _excess(F.col("n"), F.col("site_docs"), other_n, other_docs)).drop("gone_n", "gone_docs")


def repeated_lines(lines: DataFrame, docs: DataFrame, min_docs: int = 3, min_share: float = 0.2, rate: float = 0.01) -> DataFrame:
    """(site, line, n, site_docs, ratio): lines in significant excess on their site, standing in at least min_docs of its
    documents and in min_share of them.

    lines: (doc_id, line), repeated rows count once. docs: (doc_id, site), one row per document; documents of null site
    do not count. A site may hold any share of the rows: counting is by
    (site, line) with partial sums. Ratios are binned by BIN up to BINS * BIN for the rule's ranks, so that of the tests only a histogram of
    at most BINS rows reaches the driver. After the first pass only lines that are often on some site are tested again. Suspicion only grows,
    and the passes end with the first that adds none. Empty input gives no rows.
    """
    step = F.least(F.floor(F.col("ratio") / BIN), F.lit(BINS)).cast("int")
    histogram = lambda df: [(r.b, r.n, r.new) for r in df.groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("suspected"), 1)).alias("new")).collect()]
    tests = materialise(tested_lines(line_counts(lines, docs, min_docs, min_share).withColumn("suspected", F.col("often"))), "line-tests")
    bins = histogram(tests.filter("not hopeful"))
    state = materialise(tests.filter("hopeful"), "line-tests")
    while True:
        now = histogram(state)
        least = _cut([(b, n) for b, n, _ in bins + now], max(1, sum(n for _, n, _ in bins + now)), rate)
        if not any(b * BIN >= least and new for b, _, new in now):
            return state.filter(F.col("often") & (F.col("ratio") >= least)).select("site", "line", "n", "site_docs", "ratio")
        marked = state.withColumn("suspected", F.col("suspected") | (F.col("ratio") >= least))
        state = materialise(tested_lines(marked).select(*state.columns), "line-tests")


def site_documents(sections: DataFrame, audit: DataFrame) -> DataFrame:
    """(doc_id, site): each document with a row in sections, site null where the audit names none."""
    return sections.select("doc_id").filter("doc_id is not null").distinct().join(site_of(audit), "doc_id", "left")


def found_lines(lines: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    """(key, line_no): the places of repeated lines, each once. lines as from line_rows."""
    excess = repeated_lines(lines, docs, **limits).select("site", "line")
    places = lines.select("doc_id", "key", "line_no", "line").join(docs.filter("site is not null"), "doc_id")
    return places.join(excess, ["site", "line"]).select("key", "line_no").distinct()


def without_lines(sections: DataFrame, places: DataFrame, key: str = "section_id", text: str = "content") -> DataFrame:
    """sections with the lines of places (key, line_no) taken out and the rest joined again in order.

    Other columns stay. Rows without such lines, and null texts, stay as they are; a text all of whose lines go becomes empty."""
    gone = places.groupBy(F.col("key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col("__gone"), (i + 1).cast("int"))), "\n")
    joined = sections.join(gone, sections[key] == gone["__key"], "left")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).drop("__key", "__gone")
