"""Weighted BM25 over a stored inverted index of two columns, in bounded blocks.

Postings of a token lie in blocks: one row holds those of its passages whose ids fall
in one range of ``BLOCK_IDS``, with the most hits and the least length among them.
Blocks are stored by bucket of the token, so a search opens the buckets of asked
tokens only, and the statistics of tokens are a small table of their own beside them.

A search keeps each request's best ``k`` as MaxScore does, in joins. What the rarest
phrases of a request give to their passages yields a cutoff that ``k`` passages
reach. Ranges of ids are the same for all tokens, so the bounds of a request's blocks
of one range add up to what any passage there can reach; ranges below the
cutoff are left out before a posting is read. What is left is scored exactly.

A query term is a phrase of one or more tokens. Passages that hold the two rarest tokens
of a phrase come from the blocks, and its places are counted in their stored token
sequences. Contributions are summed as whole numbers: row order cannot change a rank.
Of passages a search reads nothing but these sequences, and the paths of those that
may be among the best.
"""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import index_tokens
from lodestone.operators.ranking import salt_when_wide, top_k
from lodestone.session import BROADCAST_ROWS, collect_bounded, materialize, scratch_root

K1, B = 1.2, 0.75
HEADING_WEIGHT, CONTENT_WEIGHT = 4.0, 1.0
IDF_FLOOR = 1e-6
# Contributions are summed as integers of this fraction: the total then does
# not depend on the order of rows, and equal passages tie exactly.
UNIT = 1_000_000_000_000

TOKEN_BUCKETS = 32
BLOCK_IDS = 256
# Blocks of so many neighbouring ranges and one bucket are made by one task.
STRIPE = 256
# A task folds so many postings, or adds up scores for so many requests and passages.
TASK_ROWS = 1 << 20
# Up to so many asked tokens are named to the scan, which then skips row groups.
NAMED_TOKENS = 64
# The rarest phrases of a request that set its cutoff have so many postings for each result.
LEAD = 4
# A cutoff is sought where the index has so many passages for each result; in a
# smaller one nearly every range holds a result, and none could be left out.
SEARCHED = 256

PLACE = ("chunk_id", "display_path", "start_line")
SEQUENCES = ("heading_tokens", "content_tokens", "doc_len")
BLOCKS = (
    "token string, block bigint, most_hits int, least_len int, at array<int>, lens array<int>, "
    "hits array<int>"
)
TERMS = "token string, df bigint, most_hits int, least_len int"


def query_phrases(queries: DataFrame) -> DataFrame:
    """``qid, phrase, words, times`` from ``qid, terms``."""
    terms = queries.select("qid", F.explode("terms").alias("term"))
    tokens = terms.select("qid", index_tokens(F.array("term")).alias("tokens"))
    phrases = tokens.filter(F.size("tokens") > 0).select(
        "qid", F.array_join("tokens", " ").alias("phrase"), F.size("tokens").alias("words")
    )
    return phrases.groupBy("qid", "phrase", "words").agg(F.count("*").alias("times"))


# ---- the stored index ----


def token_bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(TOKEN_BUCKETS)).cast("int")


def _folded(found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``at, len, hits`` as arrays of one row per key."""
    listed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "len", "hits"))).alias("p"))
    return listed.select(
        *keys,
        F.array_max("p.hits").alias("most_hits"),
        F.array_min("p.len").alias("least_len"),
        F.col("p.at").alias("at"),
        F.col("p.len").alias("lens"),
        F.col("p.hits").alias("hits"),
    )


def _tasks(spark: SparkSession, rows: int, most: int) -> int:
    """So many tasks that each has at most ``most`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def blocks_of(passages: DataFrame, tokens: DataFrame | None = None, size: int = 0) -> DataFrame:
    """``bucket`` and ``BLOCKS`` of every passage, sorted by token within a task.

    One shuffle, by bucket and stripe of ids: both groupings find their rows together, and a
    token of every passage is hot in no task. With ``tokens`` only their postings go through it.
    What follows from token and id is not moved. Of ``size`` postings no task gets too many.
    """

    def weighted(tokens: str, weight: float) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(int(weight)).alias("weight")))

    both = F.concat(weighted("heading_tokens", HEADING_WEIGHT), weighted("content_tokens", CONTENT_WEIGHT))
    found = passages.select("chunk_id", "doc_len", F.inline(both))
    if tokens is not None:
        found = found.join(tokens, "token", "left_semi")
    block = F.expr(f"(chunk_id - pmod(chunk_id, {BLOCK_IDS})) div {BLOCK_IDS}")
    bucket, stripe = token_bucket(F.col("token")), F.expr(f"((chunk_id - pmod(chunk_id, {BLOCK_IDS})) div {BLOCK_IDS}) div {STRIPE}")
    keys = [bucket, stripe]
    dealt = found.repartition(_tasks(passages.sparkSession, size, TASK_ROWS), *keys) if size else found.repartition(*keys)
    dealt = dealt.select("*", bucket.alias("bucket"), stripe.alias("stripe"), block.alias("block"))
    keys = ["bucket", "stripe", "token", "block"]
    summed = dealt.groupBy(*keys, "chunk_id", "doc_len").agg(F.sum("weight").cast("int").alias("hits"))
    postings = summed.select(
        *keys, (F.col("chunk_id") - F.col("block") * BLOCK_IDS).cast("int").alias("at"),
        F.col("doc_len").alias("len"), "hits",
    )
    blocks = _folded(postings, keys).drop("stripe")
    return blocks.sortWithinPartitions("bucket", "token", "block")


def terms_of(blocks: DataFrame) -> DataFrame:
    """``bucket`` and ``TERMS``: passages of every token and bounds over all its blocks."""
    counted = blocks.groupBy("bucket", "token").agg(
        F.sum(F.size("at")).alias("df"),
        F.max("most_hits").alias("most_hits"),
        F.min("least_len").alias("least_len"),
    )
    return counted.sortWithinPartitions("bucket", "token")


def removed_terms(passages: DataFrame) -> DataFrame:
    """``bucket`` and ``TERMS`` that take passages out of the counts again."""
    tokens = F.explode(F.array_distinct(F.concat("heading_tokens", "content_tokens")))
    counted = passages.select(tokens.alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("int")
    return counted.select(
        token_bucket(F.col("token")).alias("bucket"), "token", (-F.col("n")).alias("df"),
        none.alias("most_hits"), none.alias("least_len"),
    )


def passage_totals(passages: DataFrame) -> tuple[int, int]:
    """Number and summed length of passages, to be added to the totals of an index."""
    found = passages.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    return found[0], found[1]


def write_segment(
    passages: DataFrame,
    folder: str,
    removed: DataFrame | None = None,
    tokens: DataFrame | None = None,
    size: int = 0,
) -> None:
    """Blocks and terms of passages of ``size`` postings; the terms also take ``removed`` passages out."""
    spark = passages.sparkSession
    blocks_of(passages, tokens, size).write.partitionBy("bucket").parquet(os.path.join(folder, "blocks"))
    terms = terms_of(_read(spark, folder, "blocks").select("bucket", *_META, "at"))
    if removed is not None:
        terms = terms.unionByName(removed_terms(removed))
    terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy(
        "bucket"
    ).parquet(os.path.join(folder, "terms"))


_META = ["token", "block", "most_hits", "least_len"]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shape = f"{BLOCKS if name == 'blocks' else TERMS}, bucket int"
    return spark.read.schema(shape).parquet(os.path.join(folder, name))


class Inverted(NamedTuple):
    """A stored index: its blocks and terms, the totals it counts with, and its passages' paths.

    ``places`` are the passages with their paths and token sequences; ``dead`` holds ids of
    passages that are in blocks but no longer in the index.
    """

    blocks: DataFrame
    terms: DataFrame
    passages: int
    tokens: int
    places: DataFrame
    dead: DataFrame | None = None
    segmented: bool = False

    @property
    def average(self) -> float:
        return self.tokens / self.passages if self.passages else 0.0


def read_segments(
    spark: SparkSession,
    folders: list[str],
    totals: tuple[int, int],
    places: DataFrame,
    dead: DataFrame | None = None,
) -> Inverted:
    """The index that written segments make up together."""
    frames = {}
    for name in ("blocks", "terms"):
        parts = [_read(spark, folder, name) for folder in folders]
        whole = parts[0] if parts else spark.createDataFrame([], f"{BLOCKS if name == 'blocks' else TERMS}, bucket int")
        for part in parts[1:]:
            whole = whole.unionByName(part)
        frames[name] = whole
    return Inverted(frames["blocks"], frames["terms"], *totals, places.select(*PLACE, *SEQUENCES), dead, len(folders) > 1)


def invert(passages: DataFrame, tokens: DataFrame | None = None) -> Inverted:
    """The index of a frame of passages, written to the shared folder.

    With ``tokens`` (``token``) it answers requests made of these tokens, as the whole index
    would: for a batch that is known beforehand and asked once.
    """
    spark = passages.sparkSession
    folder = os.path.join(scratch_root(spark), "lodestone", f"postings-{uuid.uuid4().hex}")
    if tokens is not None:
        tokens = materialize(tokens.select("token").distinct(), "asked-tokens")
        tokens = F.broadcast(tokens) if tokens.count() <= BROADCAST_ROWS else tokens
    totals = passage_totals(passages)
    write_segment(passages, folder, tokens=tokens, size=totals[1])
    return read_segments(spark, [folder], totals, passages)


# ---- what a request batch asks of it ----


class Phrases(NamedTuple):
    """The distinct phrases of a request batch with short ids, and who asks.

    ``buckets`` are those of all tokens, ``named`` the tokens themselves if they are few.
    """

    dictionary: DataFrame
    asked: DataFrame
    lengths: list[int]
    small: bool
    buckets: list[int]
    named: list[str] | None

    def sized(self, df: DataFrame) -> DataFrame:
        """Hint a broadcast of a frame of at most one row per asked phrase."""
        return F.broadcast(df) if self.small else df

    def pruned(self, stored: DataFrame) -> DataFrame:
        """The part of a stored frame that can hold asked tokens: their buckets, and row groups."""
        wanted = stored.where(F.col("bucket").isin(self.buckets))
        return wanted if self.named is None else wanted.where(F.col("token").isin(self.named))


def number_phrases(phrases: DataFrame) -> Phrases:
    """Write the asked phrases once; everything else derives from that table.

    Numbers of at most ``TOKEN_BUCKETS`` buckets come to the driver, and tokens if they are few.
    """
    stored = materialize(phrases.withColumn("_row", F.monotonically_increasing_id()), "phrases")
    facts = stored.agg(F.count("*").alias("n"), F.collect_set("words").alias("lengths")).first()
    small = facts.n <= BROADCAST_ROWS
    dictionary = stored.groupBy("phrase", "words").agg(F.min("_row").alias("phrase_id"))
    names = dictionary.select("phrase", "phrase_id")
    asked = stored.drop("_row").join(F.broadcast(names) if small else names, "phrase")
    tokens = stored.select(F.explode(F.split("phrase", " ")).alias("token")).distinct()
    buckets = tokens.select(token_bucket(F.col("token")).alias("bucket")).distinct().collect()
    named = collect_bounded(tokens, NAMED_TOKENS)
    return Phrases(
        dictionary,
        asked.drop("phrase"),
        sorted(facts.lengths) or [1],
        small,
        sorted(r.bucket for r in buckets),
        None if named is None else sorted(r.token for r in named),
    )


def _opened(blocks: DataFrame, *names: str) -> DataFrame:
    """A row per posting: ``chunk_id`` and the named arrays' values, beside other columns."""
    arrays = ["at", "lens", "hits"]
    kept = [c for c in blocks.columns if c not in arrays]
    rows = blocks.select(*kept, F.inline(F.arrays_zip("at", *names)))
    chunk = (F.col("block") * BLOCK_IDS + F.col("at")).alias("chunk_id")
    return rows.select(*kept, chunk, *names)


def _live(postings: DataFrame, inverted: Inverted) -> DataFrame:
    if inverted.dead is None:
        return postings
    return postings.join(inverted.dead.select("chunk_id"), "chunk_id", "left_anti")


def _single_blocks(inverted: Inverted, phrases: Phrases) -> DataFrame:
    """``phrase_id`` and the blocks of every phrase of one token."""
    tokens = phrases.dictionary.where("words = 1").select("phrase_id", F.col("phrase").alias("token"))
    stored = phrases.pruned(inverted.blocks)
    return stored.join(phrases.sized(tokens), "token").drop("token", "bucket")


def _occurrences(tokens: str) -> Column:
    """How often the words of a phrase follow each other in a sequence."""
    return F.expr(
        f"size(filter(sequence(1, greatest(size({tokens}) - size(words), 0) + 1), i -> "
        f"get({tokens}, i - 1) = words[0] and slice({tokens}, i, size(words)) = words))"
    )


def phrase_occurrences() -> Column:
    """Weighted hits of ``words`` in both sequences of a passage."""
    return HEADING_WEIGHT * _occurrences("heading_tokens") + CONTENT_WEIGHT * _occurrences("content_tokens")


def _leads(inverted: Inverted, phrases: Phrases) -> DataFrame:
    """``phrase_id, token, second``: the two rarest tokens of phrases of several that the index may hold."""
    split = F.array_distinct(F.split("phrase", " "))
    tokens = phrases.dictionary.where("words > 1").select(
        "phrase_id", F.size(split).alias("needed"), F.explode(split).alias("token")
    )
    df = phrases.pruned(inverted.terms).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    known = df.join(phrases.sized(tokens), "token").groupBy("phrase_id", "needed").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rarest")
    )
    return known.where(F.size("rarest") == F.col("needed")).select(
        "phrase_id", F.get("rarest.token", F.lit(0)).alias("token"), F.get("rarest.token", F.lit(1)).alias("second")
    )


def _several(inverted: Inverted, phrases: Phrases) -> DataFrame:
    """``phrase_id, block, chunk_id, len, hits`` of every match of phrases of several tokens.

    Blocks of a phrase's rarest token meet those of its second rarest, so a common token is not
    listed once for each phrase that has it. What both leave is tested on the sequences.
    """
    leads = materialize(_leads(inverted, phrases), "phrase-leads")
    lists = phrases.pruned(inverted.blocks).select("token", "block", "at")
    first = lists.join(phrases.sized(leads.where("second is not null")), "token").drop("token")
    others = lists.select(F.col("token").alias("second"), "block", F.col("at").alias("others"))
    found = first.join(others, ["second", "block"]).select(
        "phrase_id", "block", F.array_intersect("at", "others").alias("at")
    )
    repeats = leads.where("second is null")
    if not repeats.isEmpty():
        alone = lists.join(phrases.sized(repeats), "token").select("phrase_id", "block", "at")
        found = found.unionByName(alone)
    held = found.select("phrase_id", "block", F.explode("at").alias("at"))
    chunk = (F.col("block") * BLOCK_IDS + F.col("at")).alias("chunk_id")
    # Written, so that the planner knows how few passages are wanted.
    held = materialize(held.select("phrase_id", "block", chunk), "phrase-candidates")
    words = phrases.dictionary.select("phrase_id", F.split("phrase", " ").alias("words"))
    read = held.join(inverted.places.select("chunk_id", *SEQUENCES), "chunk_id").join(phrases.sized(words), "phrase_id")
    counted = read.select(
        "phrase_id", "block", "chunk_id", F.col("doc_len").alias("len"),
        phrase_occurrences().cast("int").alias("hits"),
    )
    return counted.where("hits > 0")


def phrase_hits(inverted: Inverted, phrases: Phrases) -> DataFrame:
    """``phrase_id, chunk_id, len`` and weighted ``hits`` of every match in the index."""
    singles = _opened(
        _single_blocks(inverted, phrases).select("phrase_id", "block", "at", "lens", "hits"), "lens", "hits"
    )
    singles = singles.select("phrase_id", "chunk_id", F.col("lens").alias("len"), "hits")
    singles = _live(singles, inverted)
    if phrases.lengths == [1]:
        return singles
    return singles.unionByName(_several(inverted, phrases).drop("block"))


def inverse_frequency(n: Column, total: Column) -> Column:
    raw = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def contribution(idf: Column, hits: Column, length: Column, average: Column) -> Column:
    return idf * hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / average))


def phrase_terms(inverted: Inverted, phrases: Phrases, several: DataFrame | None = None) -> DataFrame:
    """``phrase_id, df`` of every asked phrase that the index holds.

    Of one token it is in the stored terms; of several the matches are counted.
    """
    tokens = phrases.dictionary.where("words = 1").select("phrase_id", F.col("phrase").alias("token"))
    stored = phrases.pruned(inverted.terms).join(phrases.sized(tokens), "token")
    known = stored.groupBy("phrase_id").agg(F.sum("df").alias("df")).where("df > 0")
    if phrases.lengths == [1]:
        return known
    several = _several(inverted, phrases) if several is None else several
    return known.unionByName(several.groupBy("phrase_id").agg(F.count("*").alias("df")))


# ---- ranking ----


class Ranking(NamedTuple):
    """A batch on its way through the index, for the ranks and for reports."""

    asked: DataFrame  # qid, phrase_id, times, idf, df, before (postings of rarer phrases), scope
    lists: DataFrame  # phrase_id and the blocks of all asked phrases
    wanted: DataFrame  # phrase_id, block and who wants it, after the cutoffs
    cutoffs: DataFrame | None
    scores: DataFrame  # qid, chunk_id, units


def _units(inverted: Inverted, hits: str, length: str) -> Column:
    part = contribution(F.col("idf"), F.col(hits), F.col(length), F.lit(inverted.average))
    return F.round(part * UNIT).cast("bigint")


def _weighed(inverted: Inverted, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who asks what at which weight, and the blocks of all that is asked."""
    numbered = number_phrases(phrases)
    several = None
    if numbered.lengths != [1]:
        several = materialize(_several(inverted, numbered), "phrase-matches")
    terms = phrase_terms(inverted, numbered, several)
    total = F.lit(inverted.passages)
    terms = terms.withColumn("idf", inverse_frequency(F.col("df"), total))
    asked = numbered.asked.join(numbered.sized(terms), "phrase_id")
    rarer = Window.partitionBy("qid").orderBy("df", "phrase_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0)))
    names = ["phrase_id", "block", "most_hits", "least_len", "at", "lens", "hits"]
    lists = _single_blocks(inverted, numbered).select(*names)
    if several is not None:
        matches = several.select(
            "phrase_id", "block", (F.col("chunk_id") - F.col("block") * BLOCK_IDS).cast("int").alias("at"),
            "len", "hits",
        )
        lists = lists.unionByName(_folded(matches, ["phrase_id", "block"]).select(*names))
    return materialize(asked, "weighed-phrases"), lists


def _scores(lists: DataFrame, wanted: DataFrame, inverted: Inverted, requests: int) -> DataFrame:
    """``qid, chunk_id, units`` of what is wanted: ``phrase_id``, perhaps ``block``, and ``askers``.

    Blocks of one range of ids meet unopened, so no pairs of request and passage are shuffled.
    """
    keys = [c for c in ("phrase_id", "block") if c in wanted.columns]
    blocks = lists.select("phrase_id", "block", "at", "lens", "hits").join(wanted, keys)
    blocks = blocks.repartition(_tasks(blocks.sparkSession, requests * inverted.passages, TASK_ROWS), "block")
    rows = _live(_opened(blocks, "lens", "hits"), inverted)
    given = rows.select("block", "chunk_id", F.inline("askers"), "idf", "lens", "hits")
    units = _units(inverted, "hits", "lens") * F.col("times")
    keys = ["qid", "block", "chunk_id", *(["scope"] if "scope" in given.columns else [])]
    summed = given.select(*keys, units.alias("units")).groupBy(*keys).agg(F.sum("units").alias("units"))
    return summed.drop("block")


def _permitted(scores: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return scores
    kept = scores.join(allowed, "chunk_id").filter(F.array_contains("scopes", F.col("scope")))
    return kept.drop("scope", "scopes")


def _asking(asked: DataFrame, *keys: str) -> DataFrame:
    """Who asks, gathered by phrase (and block)."""
    who = F.struct("qid", "times", *(["scope"] if "scope" in asked.columns else []))
    return asked.groupBy("phrase_id", *keys).agg(
        F.first("idf").alias("idf"), F.collect_list(who).alias("askers")
    )


def rank_batch(
    inverted: Inverted, phrases: DataFrame, k: int | None = None, allowed: DataFrame | None = None
) -> Ranking:
    """Scores of a batch: of every match, or with ``k`` of all that can be among the best ``k``."""
    asked, lists = _weighed(inverted, phrases)
    requests = asked.select("qid").distinct().count()
    if k is not None and inverted.passages < SEARCHED * k:
        k = None
    cutoffs = None
    if k is None:
        wanted = _asking(asked)
    else:
        leads = _asking(asked.where(F.col("before") < LEAD * k))
        partial = _permitted(_scores(lists, leads, inverted, requests), allowed)
        salt = salt_when_wide(partial, "chunk_id")
        best = top_k(partial, ["qid"], [F.col("units").desc(), F.col("chunk_id")], k, salt=salt)
        reached = best.where(F.col("rank") == k).select("qid", F.col("units").alias("cutoff"))
        cutoffs = materialize(reached, "cutoffs")
        # A range has a block of each segment; a passage is in one of them.
        meta = lists.groupBy("phrase_id", "block").agg(
            F.max("most_hits").alias("most_hits"), F.min("least_len").alias("least_len")
        )
        # One unit covers the rounding of a bound that is reached exactly.
        bound = (_units(inverted, "most_hits", "least_len") + 1) * F.col("times")
        bounded = meta.join(asked, "phrase_id").withColumn("bound", bound)
        whole = F.sum("bound").over(Window.partitionBy("qid", "block"))
        reachable = bounded.withColumn("whole", whole).join(cutoffs, "qid", "left")
        reachable = reachable.where(F.col("cutoff").isNull() | (F.col("whole") >= F.col("cutoff")))
        wanted = materialize(_asking(reachable, "block"), "wanted-blocks")
    scores = _permitted(_scores(lists, wanted, inverted, requests), allowed)
    if cutoffs is not None:
        scores = scores.join(cutoffs, "qid", "left")
        scores = scores.where(F.col("cutoff").isNull() | (F.col("units") >= F.col("cutoff"))).drop("cutoff")
    return Ranking(asked, lists, wanted, cutoffs, scores)


def keyword_scores(
    inverted: Inverted, phrases: DataFrame, allowed: DataFrame | None = None
) -> DataFrame:
    """``qid, chunk_id, display_path, start_line, score`` of every match; lower is better.

    Frequencies, passage count and mean length come from the whole index. With
    ``allowed`` (``chunk_id, scopes``) a match must be in its request's ``scope``.
    """
    scores = rank_batch(inverted, phrases, None, allowed).scores
    named = scores.join(inverted.places, "chunk_id")
    return named.select("qid", *PLACE, (-F.col("units") / UNIT).alias("score"))


def best_keywords(
    inverted: Inverted, phrases: DataFrame, k: int, allowed: DataFrame | None = None
) -> DataFrame:
    """Best ``k`` passages per query: ``qid, chunk_id, …, score, keyword_rank``."""
    scores = rank_batch(inverted, phrases, k, allowed).scores
    # Paths decide among equal scores only, so few passages need theirs.
    by_score = Window.partitionBy("qid").orderBy(F.desc("units"))
    tied = scores.withColumn("_place", F.rank().over(by_score)).where(F.col("_place") <= k)
    tied = materialize(tied.drop("_place"), "keyword-ties")
    named = tied.join(inverted.places, "chunk_id")
    scored = named.select("qid", *PLACE, (-F.col("units") / UNIT).alias("score"))
    order = [F.col(name) for name in ("score", "display_path", "start_line", "chunk_id")]
    salt = salt_when_wide(scored, "chunk_id")
    return top_k(scored, ["qid"], order, k, rank="keyword_rank", salt=salt)


def opened_blocks(ranking: Ranking) -> tuple[int, int]:
    """How many blocks a batch's requests had among their phrases, and how many were opened."""
    askers = F.coalesce(F.sum(F.size("askers")), F.lit(0))
    lists = ranking.lists.select("phrase_id", "block").distinct()
    had = lists.join(_asking(ranking.asked), "phrase_id").agg(askers).first()[0]
    return had, had if ranking.cutoffs is None else ranking.wanted.agg(askers).first()[0]
