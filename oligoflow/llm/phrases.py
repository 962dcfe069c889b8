"""Collocations from a weighted de Bruijn graph of word runs.

Texts are cut into pieces and pieces into words. The runs of LONGEST words are the graph's edges, from the node of
their first LONGEST - 1 words to that of their last ones, and weigh as often as they occur; each batch adds up its own
before they are shuffled. A piece's last words begin no such run: they are kept as tails, by their number of words.
Nodes that one edge enters and one of the same weight leaves, where no tail ends, hold unary paths
together: pointer jumping brings their edges to the first one and the path becomes one row. Counts of shorter phrases
follow from the flow: a node occurs as often as all edges that leave it and the tails that end there, a node inside a
path as often as its path, and the phrases of one word less are the prefixes of these plus their own tails.

Before that, runs end where two or three neighbouring words don't occur `least` times in a language: no phrase that is
asked for holds such words, and no part of one. Neighbours are counted in full by hashes, and filters of bounded size
keep those that are common enough; where a filter or a hash lets more through there are more edges and the same results.

Cases: null and empty texts have no words; a null language is `und`; repeated rows count each time; a text of any length
is read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LONGEST, LEAST = 5, 100
#: Bits of a filter for each run of words, the most bits (16 MB), and where in a hash the bits of its slots begin.
BITS_EACH, MOST_BITS, SHIFTS = 32, 1 << 27, (0, 27)
#: Words that a task adds up at once.
WORDS_AT_ONCE = 2_000_000
_END = re.compile(rb"[.,;:!?\x0a-\x0d]+")
#: Stands for the end of a piece; no word can be equal to it.
_STOP = b"."


class Words:
    """Word numbers of the texts of one language, until enough are held; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.number, self.words, self.rows = lang, {_STOP: 0}, [_STOP], []

    def add(self, text: bytes) -> int:
        """The number of words added, and one."""
        number = self.number
        found = _END.sub(b" . ", text.lower()).split()
        for word in set(found).difference(number):
            number[word] = len(self.words)
            self.words.append(word)
        self.rows.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        return len(found) + 1

    def numbers(self) -> np.ndarray:
        """All texts one after another, with a stop behind each."""
        stop = np.zeros(1, np.int64)
        return np.concatenate([x for row in self.rows for x in (row, stop)])

    def hashes(self, *columns: np.ndarray) -> np.ndarray:
        """One hash for each row of word numbers, given by columns."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        with np.errstate(over="ignore"):
            x = np.uint64(xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"), len(columns)))
            for c in columns:
                x = (own[c] ^ x) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
        return x


def _by_language(emit):
    """emit(words) of each language whenever enough words are held, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Words] = {}
        count = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in held:
                    held[lang] = Words(lang)
                count += held[lang].add(text)
                if count >= WORDS_AT_ONCE:
                    yield from map(emit, held.values())
                    held, count = {}, 0
        yield from map(emit, held.values())
        held.clear()
        common.release()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    common.small_batches(docs.sparkSession)
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, counts) of the distinct rows of word numbers."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))


def _neighbours(words: Words, n: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """Places where two words stand in one piece, then those where two are common, and three, by the filters given, and
    last those of one word more that may be."""
    at = np.flatnonzero((n[:-1] > 0) & (n[1:] > 0))
    found = [at]
    for size, bits in enumerate(filters, 2):
        at = at[_has(bits, words.hashes(*[n[at + k] for k in range(size)]))]
        found.append(at)
        joined = np.zeros(len(n) + 1, bool)
        joined[at] = True
        at = at[joined[at + 1]]  # both runs of size words in the run of one more
    return [*found, at] if filters else found


def common_runs(docs: DataFrame, least: int, filters: list) -> DataFrame:
    """(run): hashes of the runs of two words, or of three by a filter of two, that occur so often in a language."""

    def emit(words: Words) -> pa.RecordBatch:
        n, held = words.numbers(), [f.value for f in filters]
        at = _neighbours(words, n, held)[-1]
        rows, counts = _counted([n[at + k] for k in range(2 + len(held))])
        return pa.record_batch([pa.array(words.hashes(*rows).view(np.int64)), pa.array(counts.astype(np.int32))], names=["run", "n"])

    rows = _texts(docs).mapInArrow(_by_language(emit), "run long, n int")
    return common.written(rows.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("run"), "phrases-runs")


def run_filters(docs: DataFrame, least: int) -> list:
    """Filters of the common runs of two words and of three, sent to all tasks."""
    context, found = docs.sparkSession.sparkContext, []
    for _ in range(2):
        found.append(context.broadcast(bit_filter(common_runs(docs, least, found))))
    return found


def bit_filter(runs: DataFrame) -> np.ndarray:
    """Bits, as 64-bit words, one for each slot of each run; what comes to the driver has a bound, MOST_BITS."""
    n = runs.count()
    bits = min(MOST_BITS, 1 << max(6, (BITS_EACH * max(n, 1) - 1).bit_length()))
    slots = runs.select(F.explode(F.array(*[F.shiftrightunsigned("run", k).bitwiseAND(F.lit(bits - 1)) for k in SHIFTS])).alias("slot"))
    found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(len(bits) * 64 - 1), np.ones(len(hashes), bool)
    for k in SHIFTS:
        slot = (hashes >> np.uint64(k)) & mask
        found &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return found


def edges(docs: DataFrame, filters: list) -> DataFrame:
    """(id, lang, size, gram, n) as a written table: edges of LONGEST words, and tails of fewer.

    A word begins the longest run of which all two and all three neighbouring words are common.
    """

    def emit(words: Words) -> pa.RecordBatch:
        n = words.numbers()
        _, pairs, threes, _ = _neighbours(words, n, [f.value for f in filters])
        paired, held = np.zeros(len(n), bool), np.zeros(len(n) + LONGEST, bool)
        paired[pairs] = held[threes] = True
        single = np.bincount(n[(n > 0) & ~paired], minlength=len(words.words))
        alone = np.flatnonzero(single)
        columns = [n[pairs], n[pairs + 1]]
        on = np.ones(len(pairs), bool)
        for k in range(LONGEST - 2):  # the third word and further ones
            on = on & held[pairs + k]
            columns.append(np.where(on, n[np.minimum(pairs + 2 + k, len(n) - 1)], 0))
        rows, counts = _counted(columns)
        spelt = words.words
        grams = [spelt[i] for i in alone] + [b" ".join([spelt[i] for i in row if i]) for row in zip(*(c.tolist() for c in rows))]
        size = np.concatenate([np.ones(len(alone), np.int64), sum((c > 0).astype(np.int64) for c in rows)])
        total = np.concatenate([single[alone], counts])
        return pa.record_batch([pa.array([words.lang] * len(grams), pa.string()), pa.array(grams, pa.binary()), pa.array(size.astype(np.int8)), pa.array(total.astype(np.int64))], names=["lang", "gram", "size", "n"])

    rows = _texts(docs).mapInArrow(_by_language(emit), "lang string, gram binary, size byte, n long")
    rows = rows.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return common.written(rows.select(F.monotonically_increasing_id().alias("id"), "lang", F.col("size").cast("int").alias("size"), F.col("gram").cast("string").alias("gram"), "n"), "phrases-edges")


def _first(gram: str, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def _last(gram: str, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def paths(found: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(lang, words, n) as a written table: the edges of `found`, those along unary paths as one row.

    A node is inside a path if one edge enters it and one leaves it, both weigh the same and no tail ends there: it then
    occurs as often as they do. Some run begins each path, so it has a first edge.
    """
    own = found.where(F.col("size") == LONGEST)
    leaves = own.select("lang", _first("gram", LONGEST - 1).alias("node"), F.col("id").alias("out"), F.lit(None).cast("long").alias("into"), "n")
    enters = own.select("lang", _last("gram", LONGEST - 1).alias("node"), F.lit(None).cast("long").alias("out"), F.col("id").alias("into"), "n")
    ends = found.where(F.col("size") == LONGEST - 1).select("lang", F.col("gram").alias("node"), F.lit(None).cast("long").alias("out"), F.lit(None).cast("long").alias("into"), "n")
    node = leaves.unionByName(enters).unionByName(ends).groupBy("lang", "node").agg(
        F.count("*").alias("rows"), F.count("out").alias("outs"), F.count("into").alias("intos"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("out").alias("out"), F.max("into").alias("into"),
    )
    unary = (F.col("rows") == 2) & (F.col("outs") == 1) & (F.col("intos") == 1) & (F.col("low") == F.col("high")) & (F.col("out") != F.col("into"))
    jump = common.written(node.where(unary).select(F.col("out").alias("id"), F.col("into").alias("up"), F.lit(1).cast("long").alias("steps")), "phrases-jump")
    for _ in range(max_rounds):
        over = jump.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        step = jump.join(over, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0).cast("long"))).alias("steps"), F.col("top").isNotNull().alias("moved"))
        step = common.written(step, "phrases-jump")
        jump = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"paths did not end in {max_rounds} rounds")
    placed = own.join(jump, "id", "left").select("lang", "gram", "n", F.coalesce("up", "id").alias("path"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
    along = F.array_sort(F.collect_list(F.struct("steps", "gram")))["gram"]  # no longer than a piece of a text
    whole = placed.groupBy("path", "lang", "n").agg(along.alias("grams"))
    words = F.concat(F.split(F.element_at("grams", 1), " "), F.transform(F.slice("grams", F.lit(2), F.size("grams")), lambda g: F.substring_index(g, " ", -1)))
    return common.written(whole.select("lang", words.alias("words"), "n"), "phrases-paths")


def _windows(size: int, first: int, less: int) -> Column:
    """The runs of size words of `words` that start at first to the last but less, joined."""
    starts = F.sequence(F.lit(first), F.size("words") - size + 1 - less)
    some = F.when(F.size("words") - size + 1 - less >= first, starts).otherwise(F.array().cast("array<int>"))
    return F.explode(F.transform(some, lambda i: F.array_join(F.slice("words", i, F.lit(size)), " ")))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, gram, n) of 1 to LONGEST words], (lang, n) of all words); counts below least may be of cut pieces."""
    found = edges(docs, run_filters(docs, least))
    joined = paths(found)
    tails = [found.where(F.col("size") == k).select("lang", "gram", "n") for k in range(1, LONGEST)]
    inner = joined.select("lang", _windows(LONGEST - 1, 2, 1).alias("gram"), "n")  # the nodes inside: nothing is added there
    start = joined.select("lang", F.array_join(F.slice("words", 1, LONGEST - 1), " ").alias("gram"), "n")
    flow = start.unionByName(tails[LONGEST - 2]).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = [joined.select("lang", _windows(LONGEST, 1, 0).alias("gram"), "n"), common.written(flow.unionByName(inner), f"phrases-{LONGEST - 1}")]
    for size in range(LONGEST - 2, 0, -1):
        longer = counts[-1].select("lang", _first("gram", size).alias("gram"), "n")
        counts.append(common.written(longer.unionByName(tails[size - 1]).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"phrases-{size}"))
    counts = counts[::-1]
    return counts, counts[0].groupBy("lang").agg(F.sum("n").alias("n"))


#: Phrases of a language that one task ranks before the best of each part meet.
RANKED = 200_000


def collocations(docs: DataFrame, least: int = LEAST, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to LONGEST words.

    a, l and r are how often the phrase and the parts of its weakest cut occur, n the words of the language; the score
    is floor(1000 a n / (l r)), in whole numbers of up to 38 digits. Phrases inside a longer one that occurs as often
    are left out; it is enough to look at those of one word more, as counts can't grow with length.
    """
    counts, words = phrase_counts(docs, least)
    often = [c.where(F.col("n") >= least) for c in counts]
    parts = often[0]
    for c in often[1:]:
        parts = parts.unionByName(c)
    parts = common.written(parts, "phrases-often")
    size = F.size(F.split("gram", " "))
    phrases = parts.withColumn("size", size).where("size > 1")
    longer = phrases.where("size > 2")
    over = F.explode(F.array(F.expr("substring_index(gram, ' ', size - 1)"), F.expr("substring_index(gram, ' ', 1 - size)")))
    covered = longer.select("lang", over.alias("gram"), "n").distinct()
    free = phrases.join(covered, ["lang", "gram", "n"], "left_anti")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "gram", F.col("n").alias("a"), "k", F.expr("substring_index(gram, ' ', k)").alias("x"), F.expr("substring_index(gram, ' ', k - size)").alias("y"))
    left, right = (parts.select("lang", F.col("gram").alias(c), F.col("n").alias(to)) for c, to in (("x", "l"), ("y", "r")))
    scored = cuts.join(left, ["lang", "x"]).join(right, ["lang", "y"]).join(F.broadcast(words), "lang")  # one row for each language
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scored = scored.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), whole("l") * whole("r")))
    weakest = scored.groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    rows = common.written(weakest.select("lang", F.col("gram").alias("phrase"), "m.a", "m.l", "m.r", "m.n", "m.score"), "phrases-scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(max(1, -(-rows.count() // RANKED))))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", dealt).orderBy(*order))).where(F.col("rank") <= best)
    final = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return final.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
