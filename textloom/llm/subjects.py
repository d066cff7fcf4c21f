"""Problem 10: the subject areas of documents, by label propagation over a graph of similar documents.

Documents meet in the blocks of their strongest terms, all with all: pair by pair in small blocks, through the block's centre in large
ones. They are linked where the verified cosine of their term vectors, or with the centre, is high enough. Hand labels flow along the links in rounds of DataFrame joins until
they rest; trusted labels stay clamped, and a document keeps several subjects. The propagated labels then tell which terms speak for
which subject, and so which subject each sentence belongs to: a document has each subject that holds a given share of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.forms import form
from textloom.llm.language import plain
from textloom.llm.neardup import CHUNKS, SKETCH_BITS, sketch
from textloom.runtime import cut, materialise, parallelism

LONG = 6  # letters beyond which a word is a term of its own
BLOCKS = 8  # strongest terms by which a document meets others
BLOCK_DOCS = 32  # of a block up to which all its pairs are compared; documents of larger ones meet through the block's centre, all with all
BITS = 512  # of the sketch that a cosine is verified on; its error is about 0.07
MIN_COSINE = 0.18
KEEP = 0.05  # share from which a document keeps a subject during propagation
STILL = 0.02  # mean change of a document's shares below which the labels rest
EAGER = 10  # rounds in which a document takes its neighbours' shares outright; later ones mix them with its own, ever less, so that none swings for ever
ROUNDS = 200  # beyond which propagation has failed
SHARPER = 3  # power of the propagated shares by which sentences are told
SUPPORT = 0.02  # share of a seed's subject among its neighbours below which the hand label is not trusted
PURE = 0.4  # share of a term's sentences that one subject must have
PRIOR = 2.0  # sentences of the usual make-up that every term is given
BROADCAST_ROWS = 1 << 18  # telling terms up to which they are sent to all executors; more are joined by shuffle
SUBJECTS = 10_000  # distinct subjects of labels, at most: their names are known to the driver
MIN_SHARE = 0.25

_end = re.compile(r"(?:[.!?…]+[\"”’»)]*)(?=\s|$)|\n+")
_words = re.compile(r"[^\W\d_]+")
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.random.default_rng(10).integers(1, 2**63, BITS // 64, dtype=np.uint64) | np.uint64(1)


def document_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, version, sents, chunk, tokens): the terms of each sentence with letters as 64-bit hashes, one row per text with any.

    Terms are pairs of adjacent words and long words, without case, accents and numbers; version is a digest of the text. Rows with a
    chunk hold the task's counters of documents by term (see neardup.sketch)."""
    names, kinds = ["doc_id", "version", "sents", "chunk", "tokens"], [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)

        def word(w: str) -> int:
            """The hash of a word without accents, the last bit telling whether it is long."""
            if len(known) > 1_000_000:
                known.clear()
            bare = plain(w)
            h = known[w] = xxhash.xxh3_64_intdigest(bare.encode()) >> 1 << 1 | (len(bare) > LONG)
            return h

        for batch in batches:
            ids, versions, sizes, lengths, hashes = [], [], [], [], []
            for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if not t or k is None:
                    continue
                n = 0
                for s in _end.split(form(t).lower()):
                    if words := _words.findall(s):
                        n += 1
                        lengths.append(len(words))
                        hashes += [known.get(w) or word(w) for w in words]
                if n:
                    ids.append(k)
                    versions.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63))
                    sizes.append(n)
            if ids:
                h, sent = np.array(hashes, dtype=np.uint64), np.repeat(np.arange(len(lengths)), lengths)
                pair = (h[:-1] * _PAIR[0] + h[1:]) * _PAIR[1]
                pair ^= pair >> np.uint64(32)
                long = (h & np.uint64(1)).astype(bool)
                within = sent[:-1] == sent[1:]
                terms, sent = np.concatenate([pair[within] * _PAIR[0], h[long]]).view(np.int64), np.concatenate([sent[:-1][within], sent[long]])
                order = np.lexsort((terms, sent))
                terms, sent = terms[order], sent[order]
                first = np.concatenate([[True], (terms[1:] != terms[:-1]) | (sent[1:] != sent[:-1])]) if len(terms) else np.zeros(0, dtype=bool)
                terms, sent = terms[first], sent[first]
                doc = np.repeat(np.arange(len(sizes)), sizes)[sent]
                order = np.lexsort((terms, doc))
                t, d = terms[order], doc[order]
                once = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]) if len(t) else np.zeros(0, dtype=bool)
                counts += np.bincount(_bucket(t[once]), minlength=len(counts)).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(sent, minlength=len(lengths)))]).astype(np.int32)
                of = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                sents = pa.ListArray.from_arrays(pa.array(of), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(versions, kinds[1]), sents, pa.array([-1] * len(ids), kinds[3]), pa.nulls(len(ids), kinds[4])], names=names)
        if counts.any():
            rows = [(None, None, None, i, c.tobytes()) for i, c in enumerate(np.split(counts, CHUNKS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    source = df.select(F.col(key).cast("long"), F.col(text))
    return source.mapInArrow(run, "doc_id long, version long, sents array<array<long>>, chunk int, tokens binary")


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _signs(terms: np.ndarray) -> np.ndarray:
    """A row of BITS signs, 1 or -1, for each term, the same wherever the term occurs."""
    x = terms.view(np.uint64)[:, None] * _MIX[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def blocks(docs: DataFrame, counts, n: int) -> DataFrame:
    """(doc_id, bits, term): the BLOCKS strongest terms of each document, with the sign sketch of its term vector.

    A term weighs by its sentences in the document and its rarity among all n documents; terms of one document have no block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, sents = part.column(0).to_numpy(), part.column(1)
                flat = sents.flatten()  # sentences
                ends = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))])
                of = np.concatenate([[0], np.cumsum(sents.value_lengths().to_numpy(zero_copy_only=False))])
                terms, own = np.unique(flat.flatten().to_numpy(), return_inverse=True)
                often = df[_bucket(terms)]
                rare = np.where(often > 1, np.log(max(n, 1) / np.maximum(often, 1)).clip(0), 0.0)
                signs, kept, bits, chosen = _signs(terms), [], [], []
                for i in range(len(ids)):
                    mine, tf = np.unique(own[ends[of[i]] : ends[of[i + 1]]], return_counts=True)
                    strong = tf * rare[mine]
                    weight = ((1 + np.log(tf)) * rare[mine]).astype(np.float32)
                    if not weight.any():
                        continue
                    best = np.lexsort((mine, -strong))[:BLOCKS]
                    kept.append(i)
                    bits.append(np.packbits((weight @ signs[mine]) > 0))
                    chosen.append(mine[best[strong[best] > 0]])
                if kept:
                    lists = lambda values, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(values))
                    sizes, which = [len(c) for c in chosen], np.concatenate(chosen)
                    words = np.concatenate(bits).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[kept]), lists(words, [BITS // 64] * len(kept)), lists(terms[which], sizes)], names=["doc_id", "bits", "terms"]
                    )

    rows = docs.select("doc_id", "sents").mapInArrow(run, "doc_id long, bits array<long>, terms array<long>")
    return rows.select("doc_id", "bits", F.explode("terms").alias("term"))


def _cosine(one: str, other: str):
    differ = sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(BITS // 64)), F.lit(0))
    return F.round(F.cos(differ * (np.pi / BITS)), 6)


def similar_documents(met: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b, cosine), a < b: all pairs of documents that share a block and whose cosine, by their sketches, is at least min_cosine."""
    one, other = met.select("term", F.col("doc_id").alias("a"), F.col("bits").alias("x")), met.select("term", F.col("doc_id").alias("b"), F.col("bits").alias("y"))
    return one.join(other, "term").filter("a < b").select("a", "b", _cosine("x", "y").alias("cosine")).filter(F.col("cosine") >= min_cosine).distinct()


def gathered(met: DataFrame, min_cosine: float) -> DataFrame:
    """(doc_id, term, w): the documents of each block whose cosine w with its centre is at least min_cosine, the centre's sketch having
    the sign of most documents in each place. Any two of a block are linked with the product of their w, without forming the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                terms, of = np.unique(part.column(0).to_numpy(), return_inverse=True)
                words = part.column(1).flatten().to_numpy().reshape(len(of), BITS // 64)
                order = np.argsort(of, kind="stable")
                signs = np.unpackbits(np.ascontiguousarray(words[order]).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
                for t, total in zip(terms.tolist(), np.add.reduceat(signs, np.searchsorted(of[order], np.arange(len(terms))))):
                    sums[t] = sums[t] + total if t in sums else total.astype(np.int64)
        for t, total in sums.items():
            bits = np.packbits(total > 0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([bits.tolist()], pa.list_(pa.int64()))], names=["term", "centre"])

    centres = met.select("term", "bits").repartition(parallelism(met.sparkSession), "term").mapInArrow(run, "term long, centre array<long>")
    return met.join(centres, "term").select("doc_id", "term", _cosine("bits", "centre").alias("w")).filter(F.col("w") >= min_cosine)


def _votes(links: DataFrame, labels: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(doc_id, subject, v): what each document's neighbours say, over links (src, dst, w) and over hubs (doc_id, term, w): there the sum
    over a block's documents goes back to each of them, without its own part."""
    votes = links.join(labels, links.src == labels.doc_id).select(F.col("dst").alias("doc_id"), "subject", (F.col("w") * F.col("share")).alias("v"))
    if hubs is None:
        return votes
    said = hubs.join(labels, "doc_id").select("doc_id", "term", "subject", "w", (F.col("w") * F.col("share")).alias("v"))
    sums = said.groupBy("term", "subject").agg(F.sum("v").alias("v"))
    back = hubs.join(sums, "term").select("doc_id", "subject", (F.col("w") * F.col("v")).alias("v"))
    return votes.unionByName(back).unionByName(said.select("doc_id", "subject", (-F.col("w") * F.col("v")).alias("v")))


def _kept(votes: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of votes (doc_id, subject, v) in partitions by doc_id; shares under KEEP are dropped, the rest adds up to 1."""
    own = Window.partitionBy("doc_id")
    sums = votes.groupBy("doc_id", "subject").agg(F.sum("v").alias("v")).filter("v > 1e-7")  # less is what rounding leaves of a document's own part
    kept = sums.withColumn("share", F.col("v") / F.sum("v").over(own)).filter(F.col("share") >= KEEP)
    return kept.select("doc_id", "subject", F.round(F.col("share") / F.sum("share").over(own), 6).alias("share"))


def propagated(links: DataFrame, seeds: DataFrame, start: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, share): labels at rest. links: (src, dst, w), both ways, in partitions by src. seeds: (doc_id, subject, share), clamped.

    A document's shares are the mean of its neighbours', weighted by w. Documents that no path joins to a seed get none. Each round shuffles
    the votes of links once. Raises RuntimeError if the labels do not rest within ROUNDS rounds."""
    lanes = parallelism(links.sparkSession)
    seeds = cut(seeds.repartition(lanes, "doc_id"))
    labels, clamped = start if start is not None else seeds, seeds.select("doc_id").distinct()
    for turn in range(1, ROUNDS + 1):
        votes = _votes(links, labels, hubs)
        taken = _kept(votes.repartition(lanes, "doc_id"))
        if turn > EAGER:
            step = EAGER / turn
            taken = _kept(taken.select("doc_id", "subject", (F.col("share") * step).alias("v")).unionByName(labels.select("doc_id", "subject", (F.col("share") * (1 - step)).alias("v"))).repartition(lanes, "doc_id"))
        new = cut(taken.join(clamped, "doc_id", "left_anti").unionByName(seeds).repartition(lanes, "doc_id"))
        both = new.join(labels.withColumnRenamed("share", "old"), ["doc_id", "subject"], "full").na.fill(0.0, ["share", "old"])
        moved = both.groupBy("doc_id").agg(F.sum(F.abs(F.col("share") - F.col("old"))).alias("d")).agg(F.avg("d")).first()[0]
        labels = new
        if (moved or 0.0) < STILL:
            return labels
    raise RuntimeError(f"labels did not rest within {ROUNDS} rounds")


def supported(links: DataFrame, labels: DataFrame, seeds: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """The seeds (doc_id, subject) whose subject has at least a share of SUPPORT among the neighbours' labels; those without neighbours are kept."""
    votes = _votes(links, labels, hubs).join(seeds.select("doc_id").distinct(), "doc_id", "left_semi")
    sums = votes.groupBy("doc_id", "subject").agg(F.sum("v").alias("v")).filter("v > 1e-7")
    whole = sums.groupBy("doc_id").agg(F.sum("v").alias("all"))
    judged = seeds.join(whole, "doc_id", "left").join(sums, ["doc_id", "subject"], "left")
    return judged.filter(F.col("all").isNull() | (F.coalesce("v", F.lit(0.0)) >= SUPPORT * F.col("all"))).select("doc_id", "subject")


def telling_terms(docs: DataFrame, labels: DataFrame, pure: float = PURE) -> DataFrame:
    """(term, subject, weight): terms that tell one subject, by documents (doc_id, sents) with labels (doc_id, subject, share): each sentence
    counts for its document's subjects by their shares. The subject must have a share of pure among the term's sentences; its weight is the log of its share against the usual one."""
    told = docs.join(labels, "doc_id")
    counts = told.select(F.explode(F.flatten("sents")).alias("term"), "subject", "share").groupBy("term", "subject").agg(F.sum("share").alias("n"))
    usual = told.groupBy("subject").agg(F.sum(F.col("share") * F.size("sents")).alias("m"))
    usual = materialise(usual, "usual-shares")  # a row per subject
    usual = usual.crossJoin(F.broadcast(usual.agg(F.sum("m").alias("all")))).select("subject", (F.col("m") / F.col("all")).alias("usual"))
    best = counts.groupBy("term").agg(F.sum("n").alias("total"), F.min(F.struct((-F.round("n", 6)).alias("less"), "subject")).alias("b"))
    best = best.select("term", "total", (-F.col("b.less")).alias("n"), F.col("b.subject").alias("subject")).join(F.broadcast(usual), "subject")
    share = (F.col("n") + PRIOR * F.col("usual")) / (F.col("total") + PRIOR)
    return best.filter((share >= pure) & (F.col("usual") < 1)).select("term", "subject", F.log(share / F.col("usual")).alias("weight"))


def subject_of_sentences(sentences: DataFrame, telling: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent, subject, weight): each sentence's subject of the greatest weight (ties: first by name); none where no term tells.
    Sentences of documents in seeds (doc_id, subject) are held to their subjects."""
    if telling.count() <= BROADCAST_ROWS:
        telling = F.broadcast(telling)
    terms = sentences.select("doc_id", "sent", F.explode("terms").alias("term"))
    scores = terms.join(telling, "term").groupBy("doc_id", "sent", "subject").agg(F.round(F.sum("weight"), 6).alias("weight"))
    if seeds is not None:
        held = seeds.groupBy("doc_id").agg(F.collect_set("subject").alias("allowed"))  # bounded by the number of subjects
        scores = scores.join(held, "doc_id", "left").filter("allowed is null or array_contains(allowed, subject)")
    best = F.min(F.struct((-F.col("weight")).alias("less"), "subject"))
    return scores.groupBy("doc_id", "sent").agg(best.alias("b")).select("doc_id", "sent", "b.subject", (-F.col("b.less")).alias("weight"))


def shares(sentences: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of each document's sentences."""
    sizes = sentences.groupBy("doc_id").agg(F.max("sent").alias("n"))
    return subjects.groupBy("doc_id", "subject").agg(F.count("*").alias("k")).join(sizes, "doc_id").select("doc_id", "subject", (F.col("k") / F.col("n")).alias("share"))


def subject_areas(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, subject, share): each subject of at least min_share of a document's sentences.

    labels: (doc_id, subject), repeated rows and labels of unknown documents change nothing, null ones are left out; labels that
    the neighbours of their document hardly bear out are not trusted; the sentences of documents with none such are held to their labels. Repeated rows of documents count once; of different texts of one key
    the one of the greatest digest holds. Null and blank texts get no rows; no labels, no rows. Keys are whole numbers.
    """
    spark = documents.sparkSession
    lanes = parallelism(spark)
    rows = materialise(document_terms(documents, key, text), "document-terms")
    found = rows.filter("chunk < 0")
    docs = cut(found.repartition(lanes, "doc_id").groupBy("doc_id").agg(F.max_by("sents", "version").alias("sents")))
    met = blocks(docs, spark.sparkContext.broadcast(sketch(rows)), docs.count())
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("term"))).filter("n > 1")
    met = materialise(met, "blocks")
    near = similar_documents(met.filter(F.col("n") <= BLOCK_DOCS))
    hubs = cut(gathered(met.filter(F.col("n") > BLOCK_DOCS), MIN_COSINE).repartition(lanes, "term"))
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    links = cut(near.select(both.alias("e"), F.col("cosine").alias("w")).select("e.src", "e.dst", "w").repartition(lanes, "src"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject").filter("doc_id is not null and subject is not null").distinct()
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    names = [r.subject for r in known.select("subject").distinct().orderBy("subject").limit(SUBJECTS + 1).collect()]
    if len(names) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    listed = F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")
    known = known.select("doc_id", F.array_position(listed, F.col("subject")).cast("int").alias("subject"))  # numbers in the order of names
    even = lambda df: df.withColumn("share", 1 / F.count("*").over(Window.partitionBy("doc_id")))
    first = propagated(links, even(known), hubs=hubs)
    trusted = cut(supported(links, first, known, hubs))
    at_rest = propagated(links, even(trusted), first.join(known.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(even(trusted)).repartition(lanes, "doc_id"), hubs)
    sharp = F.pow("share", F.lit(SHARPER))
    sharp = at_rest.select("doc_id", "subject", (sharp / F.sum(sharp).over(Window.partitionBy("doc_id"))).alias("share"))
    sentences = docs.select("doc_id", F.posexplode("sents").alias("pos", "terms")).select("doc_id", (F.col("pos") + 1).alias("sent"), "terms")
    telling = materialise(telling_terms(docs, sharp), "telling-terms")
    signed = known.select("doc_id", F.lit(1).alias("n")).unionByName(trusted.select("doc_id", F.lit(-1).alias("n")))
    doubted = signed.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 0").select(F.col("doc_id").alias("doubted"))
    held = trusted.join(doubted, F.col("doc_id") == F.col("doubted"), "left_anti")
    told = subject_of_sentences(sentences, telling, held)
    return shares(sentences, told).filter(F.col("share") >= min_share).select("doc_id", F.element_at(listed, F.col("subject")).alias("subject"), F.round("share", 6).alias("share"))
