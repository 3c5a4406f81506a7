"""Evaluation texts that leak into training text, found through a positional index.

The index holds the postings (term, document, position) of the training tokens. For each
test item the rarest term of every few consecutive words is looked up; postings of one
document whose offsets agree propose the pair, and the item's full postings in that
document, aligned, give the passages: exact phrases and close ones, in one or two runs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import materialize, row_count_up_to, small_side

#: Words are runs of ASCII letters and digits in lower case: what a wrong decoding or
#: another form of a sign changes are the signs between, so damaged passages agree.
SEPARATORS = "[^a-z0-9]+"
#: Words of items that are mostly in another script: runs of letters and digits, or single
#: signs of scripts that do not part words.
UNPARTED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
ANY_WORD = rf"([{UNPARTED}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{UNPARTED}]]+)"
#: UTF-8 beginnings of full-width and mathematical letters, digits and signs, Latin
#: ligatures, and combining marks.
COMPATIBLE = ("EFBC", "EFBD", "F09D", "EFAC", "CC", "CD")
#: Of so many consecutive item words the rarest one is looked up.
ANCHOR_SPAN = 6
#: Looked-up words that must agree in a document, over two offsets; offsets agree within a band.
ANCHORS_NEEDED, BAND = 3, 8
#: (items of fewer looked-up words need all of theirs)
#: Terms more frequent than this per document carry no evidence of their own, unless they
#: are among the rarer words of their item (an item may leak into very many documents).
COMMON_PER_DOC, RARER_SHARE = 0.2, 0.7
#: Share of the item's words that a document must hold, and of a run's that must agree.
SHARE, DENSITY = 0.4, 0.85
#: Telling words that may be skipped at once, words added or dropped between two, and
#: telling words of a run.
SKIP, DRIFT, LEAST_RUN = 2, 2, 3


def _single(ranges: tuple[tuple[int, int], ...]) -> tuple[str, str]:
    """The signs of the ranges whose compatible form is one sign, and these forms."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for lo, hi in ranges for c in range(lo, hi + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(text: Column) -> Column:
    """Compatible forms of signs in their plain form. A letter with combining marks is one
    non-ASCII letter, as its composed form is."""
    odd, usual = _single(((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)))
    folded = F.translate(text, odd, usual)
    for c in range(0xFB00, 0xFB07):
        folded = F.replace(folded, F.lit(chr(c)), F.lit(unicodedata.normalize("NFKC", chr(c))))
    composed = F.regexp_replace(folded, r"[A-Za-z]\p{Mn}+", "\u00e4")
    held = F.lit(False)
    for start in COMPATIBLE:  # bytes are found faster than by a second pattern over all texts
        held = held | F.contains(text.cast("binary"), F.unhex(F.lit(start)))
    return F.when(held, composed).otherwise(text)


def ascii_words(text: Column) -> Column:
    return F.split(F.lower(plain(text)), SEPARATORS)


def any_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ANY_WORD))


def mostly_ascii(text: Column) -> Column:
    return F.length(F.regexp_replace(plain(text), "[^A-Za-z0-9]", "")) * 2 >= F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def item_terms(items: DataFrame, words: Callable[[Column], Column], key: str = "item_id", text: str = "_t") -> DataFrame:
    """(item_id, i, term): the words of each item in order."""
    return items.select(key, F.posexplode(F.filter(words(F.col(text)), lambda w: w != "")).alias("i", "term"))


def build_index(docs: DataFrame, words: Callable[[Column], Column] = ascii_words, vocabulary: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term_id, doc_id, j) of the corpus; a term's id is its hash, so an index
    serves items that come later too. Whole texts are indexed; empty words count a
    position. With a ``vocabulary`` (term_id) only its terms are kept, which is all that
    a fixed set of items can ask for."""
    tokens = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(words(F.col(text))).alias("j", "term"))
    postings = tokens.where(F.col("term") != "").select(F.xxhash64("term").alias("term_id"), key, "j")
    return postings if vocabulary is None else postings.join(small_side(vocabulary), "term_id", "left_semi")


def leaked_pairs(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "item_text",
    share: float = SHARE,
) -> DataFrame:
    """(doc_id, item_id, share_found, runs): documents that hold at least ``share`` of an
    item's words, in order, in one or two runs whose words agree but for single ones.

    Null and empty texts and items match nothing. Documents or items given twice count
    once (postings are sets; of an item's texts the smallest). Items mostly in another
    script than Latin are searched by words of any script. Items with fewer telling words
    than a run needs must be held with all of them.
    """
    once = items.groupBy(item_key).agg(F.min(item_text).alias("_t")).where(F.col("_t").isNotNull())
    once = materialize(once.withColumn("_ascii", mostly_ascii(F.col("_t"))), "once")
    found = _search(docs, once.where("_ascii"), ascii_words, key, text, item_key, share)
    others = once.where(~F.col("_ascii"))
    return found.unionByName(_search(docs, others, any_words, key, text, item_key, share)) if row_count_up_to(others, 0) else found


def _search(docs: DataFrame, items: DataFrame, words: Callable[[Column], Column], key: str, text: str, item_key: str, share: float) -> DataFrame:
    terms = materialize(item_terms(items, words, item_key).withColumn("term_id", F.xxhash64("term")), "items")
    index = materialize(build_index(docs, words, terms.select("term_id").distinct(), key, text), "postings")
    frequency = materialize(index.groupBy("term_id").agg(F.count("*").alias("cf")), "frequency")
    n_docs = max(docs.count(), 1)
    known = terms.join(small_side(frequency), "term_id", "left")
    by_item = Window.partitionBy(item_key)
    own_rank = F.percent_rank().over(by_item.orderBy(F.coalesce("cf", F.lit(0)), "term"))
    known = known.withColumn("telling", (F.coalesce("cf", F.lit(0)) <= COMMON_PER_DOC * n_docs) | (own_rank <= RARER_SHARE))
    known = known.withColumn("n_words", F.count("*").over(by_item)).withColumn("telling", F.col("telling") | (F.col("n_words") <= 2 * LEAST_RUN)).withColumn("rank", F.sum(F.col("telling").cast("int")).over(by_item.orderBy("i")))
    known = materialize(known, "terms")
    ahead = by_item.orderBy("i").rowsBetween(0, ANCHOR_SPAN - 1)
    rarest = F.min(F.when(F.col("cf") > 0, F.struct("cf", "i", "term_id"))).over(ahead)
    anchors = known.select(item_key, rarest.alias("a")).where(F.col("a").isNotNull()).select(item_key, "a.i", "a.term_id").distinct()
    needed = small_side(materialize(anchors.groupBy(item_key).agg(F.least(F.lit(ANCHORS_NEEDED), F.count("*")).alias("needed")), "needed"))
    hits = index.join(small_side(anchors), "term_id").withColumn("_band", F.floor((F.col("j") - F.col("i")) / BAND))
    hits = hits.select(key, item_key, "i", F.explode(F.array(F.col("_band"), F.col("_band") + 1)).alias("band"))
    # repeated looked-up words only add to a count that proposes pairs; the alignment uses sets
    bands = hits.groupBy(key, item_key, "band").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(key, item_key).orderBy(F.desc("n"), "band"))
    # the two bands that share an offset count as one: take the best and the best that is not beside it
    first = bands.withColumn("_r", best).withColumn("_at", F.first("band").over(Window.partitionBy(key, item_key).orderBy(F.desc("n"), "band")))
    scored = first.groupBy(key, item_key).agg(
        F.max("n").alias("one"), F.max(F.when(F.abs(F.col("band") - F.col("_at")) > 1, F.col("n"))).alias("two")
    )
    pairs = scored.join(needed, item_key).where(F.col("one") + F.coalesce("two", F.lit(0)) >= F.col("needed")).select(key, item_key)
    telling = known.where("telling")
    wanted = small_side(telling.select("term_id", item_key, "i", "rank", "n_words"))
    postings = index.join(small_side(telling.select("term_id").distinct()), "term_id", "left_semi")
    met = postings.join(pairs, key).join(wanted, ["term_id", item_key])
    totals = telling.groupBy(item_key).agg(F.count("*").alias("n_telling")).withColumn("least", F.least(F.lit(LEAST_RUN), F.col("n_telling")))
    grouped = met.groupBy(key, item_key).agg(
        F.countDistinct("i").alias("_found"), F.max("n_words").alias("n_words"), F.collect_list(F.struct("i", "j", "rank")).alias("met")
    )
    hopeful = grouped.join(small_side(totals), item_key).where(F.col("_found") >= F.greatest("least", share * 0.6 * F.col("n_telling")))
    return hopeful.select(key, item_key, "n_words", "n_telling", "least", "met").mapInPandas(
        _aligner(key, item_key, share), f"{key} long, {item_key} long, share_found double, runs int"
    )


def _aligner(key: str, item_key: str, share: float):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = (batch[c] for c in (key, item_key, "n_words", "n_telling", "least", "met"))
            for doc, item, n_words, n_telling, least, met in zip(*columns, strict=True):
                held, telling, runs = best_runs([(m["i"], m["j"], m["rank"]) for m in met], least)
                # words beyond a run's outer telling words are unseen: the larger estimate holds
                found = max(held / n_words, telling / n_telling)
                if found >= share - 1e-9:
                    rows.append((doc, item, found, runs))
            yield pd.DataFrame(rows, columns=[key, item_key, "share_found", "runs"])

    return align


def best_runs(met: list[tuple[int, int, int]], least: int = LEAST_RUN) -> tuple[int, int, int]:
    """(words held, telling words held, number of runs) of the best one or two runs among
    matching words (item position, document position, rank among the item's telling words),
    of at least ``least`` telling words each."""
    met = sorted(set(met))
    by_rank: dict[int, list[tuple[int, int]]] = {}
    chain: dict[tuple[int, int], tuple[int, int, int, int]] = {}  # (i, j) -> length, start i, start j, start rank
    for i, j, rank in met:
        best = (1, i, j, rank)
        for skipped in range(1, SKIP + 1):
            for i0, j0 in by_rank.get(rank - skipped, ()):
                if j0 < j and abs((j - j0) - (i - i0)) <= DRIFT and chain[i0, j0][0] + 1 > best[0]:
                    best = (chain[i0, j0][0] + 1, *chain[i0, j0][1:])
        chain[i, j] = best
        by_rank.setdefault(rank, []).append((i, j))
    ranks = {(i, j): rank for i, j, rank in met}
    ends: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
    for (i, j), (n, i0, j0, r0) in chain.items():
        span = ranks[i, j] - r0 + 1
        if n >= least and n >= DENSITY * span:
            held = (i - i0 + 1) - (span - n)
            if held > ends.get((i0, j0), (0,))[0]:
                ends[i0, j0] = (held, i0, i, j0, j, n)
    runs = sorted(ends.values(), reverse=True)
    best, telling, count = 0, 0, 0
    for k, a in enumerate(runs):
        if a[0] > best:
            best, telling, count = a[0], a[5], 1
        if a[0] * 2 <= best:
            break
        for b in runs[k + 1 :]:
            if a[0] + b[0] <= best:
                break
            if (a[2] < b[1] and a[4] < b[3]) or (b[2] < a[1] and b[4] < a[3]):
                best, telling, count = a[0] + b[0], a[5] + b[5], 2
    return best, telling, count
